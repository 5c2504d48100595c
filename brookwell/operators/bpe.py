"""Byte-pair tokens: texts are cut into words, and pairs are merged once for each distinct word.

The cut is an expression; distinct words, far fewer than words, are counted in Spark and
merged by tasks that read the vocabulary file; lengths or ids are joined back. A
vocabulary file has a base64 token and its rank in each line; its path must be the same
on all executors.
"""

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How text is cut into words before byte pairs are merged; white space is Unicode's.
WORDS = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: Rows whose tokens are Python objects at one time.
AT_ONCE = 128


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: while any neighbours make a token, those of least rank do, the first of them first.

    Parts are a linked list and pairs a heap, so a long word takes n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[word[i : i + 2]], i, word[i : i + 2]) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j], after[i] = pair, None, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (new := parts[k] + parts[after[k]]) in ranks:
                heapq.heappush(heap, (ranks[new], k, new))
    return [ranks[p] for p in parts if p is not None]


def words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, word) of all texts; nothing is left out between words."""
    return docs.select(F.col(id_col), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS), F.lit(0))).alias("pos", "word"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def vocabulary(distinct: DataFrame, path: str) -> DataFrame:
    """(word, ids) of distinct words."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        for batch in _pieces(batches):
            found = [merged(w.encode(), ranks) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["word", "ids"])

    return distinct.select("word").mapInArrow(merge, "word string, ids array<int>")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens) of every row, 0 for a null or empty text; a row's equal words are counted before they meet the vocabulary."""
    rows = docs.select(F.col(id_col), F.col(text_col), F.monotonically_increasing_id().alias("__row"))
    found = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS), F.lit(0))
    counted = rows.select("__row", F.explode(found).alias("word")).groupBy("__row", "word").agg(F.count("*").alias("n"))
    sizes = vocabulary(counted.select("word").distinct(), path).select("word", F.size("ids").alias("size"))
    sums = counted.join(sizes, "word").groupBy("__row").agg(F.sum(F.col("n") * F.col("size")).alias("tokens"))
    return rows.select(id_col, "__row").join(sums, "__row", "left").select(id_col, F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the tokens of each text in order; the ids of one text are one row, as the text was."""
    rows = docs.select(F.col(id_col), F.col(text_col), F.monotonically_increasing_id().alias("__row"))
    placed = words(rows, "__row", text_col)
    known = vocabulary(placed.select("word").distinct(), path)
    met = placed.join(known, "word").groupBy("__row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))
    return rows.select(id_col, "__row").join(met, "__row", "left").select(id_col, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of token ids; bytes that are no UTF-8 are replaced."""
    kind = rows.schema[id_col].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in ranks_of(path).items()}
        for batch in _pieces(batches):
            texts = [b"".join(tokens[i] for i in ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return rows.select(id_col, ids_col).mapInArrow(decode, f"{id_col} {kind}, text string")
