"""Spelling variant grouping: an even-partition pigeonhole join of a corpus's words.

1. Words are counted over all texts. A task packs the letter runs of a slice of texts
   into one array, so each distinct run of a document is looked at once; sums by word
   follow in Spark.
2. A word of length L is cut into two even segments. One edit leaves one of them
   untouched: the first at its place from the start, the second at its place from the
   end. Each word is indexed under its two segments and probes with the substrings at
   those places of words of its own length and of one letter more, which are shifted
   by one for the second segment.
3. A segment that more than ``most`` words share is cut again: what stands beside it
   differs by one edit, too, so it has two segments of its own, and so on until a
   segment is rare or one letter is left beside it (then its words are few, and near).
   No segment, however common, gives all pairs of its words.
4. Candidates that pass the check of one edit are deduplicated. A word's form is the
   most frequent word near it, if it is ``ratio`` times as frequent; forms are followed
   to the last by pointer doubling over written tables.

Defined cases: a null or empty text has no words; a null id counts as an empty one in
the hash that misspells runs; repeated rows count as often as they stand; ties between
forms go to the smallest word in code-point order; a very long text or run is read
whole; an empty table gives an empty one; other columns are not looked at.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookwell.llm import wordhash as wh
from brookwell.llm.work import drop, written

#: A share of 1 / MISSPELT of a corpus's runs loses a letter, to have variants to find.
MISSPELT = 97
LEAST_LETTERS, LEAST_COUNT, RATIO, MOST_SHARING = 5, 3, 2, 32


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


CRC = _crc_table()


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8 rows, and each row's first run (with the total at the end)."""
    n = len(data)
    lower = data | np.uint8(32)
    inside = (lower >= 97) & (lower <= 122) & (data < 128)
    pairs = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF)) if n > 1 else np.zeros(0, np.int64)
    inside[pairs] = inside[pairs + 1] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def crc32s(first: np.ndarray, words: pa.BinaryArray, which: np.ndarray) -> np.ndarray:
    """crc32 of a prefix, whose crc32 is in ``first``, and the word numbered ``which``, for each pair."""
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    letters = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    state = ~first
    at, end = edges[:-1][which], edges[1:][which]
    rows = np.flatnonzero(at < end)
    step = 0
    while len(rows):
        state[rows] = CRC[(state[rows] ^ letters[at[rows] + step]) & 0xFF] ^ (state[rows] >> np.uint32(8))
        step += 1
        rows = rows[at[rows] + step < end[rows]]
    return ~state


def _count_slice(data: np.ndarray, offsets: np.ndarray, ids: list, misspelt: int) -> tuple[list[str], list[int]]:
    starts, ends, first = letter_runs(data, offsets)
    if not len(starts):
        return [], []
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    steps = np.zeros(len(data) + 1, np.int8)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    packed = data[np.cumsum(steps[:-1]) > 0]
    edges = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=edges[1:])
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(packed)]).dictionary_encode()
    words, row = coded.dictionary, np.repeat(np.arange(len(ids)), np.diff(first))
    pairs, n = np.unique(row * len(words) + coded.indices.to_numpy(), return_counts=True)
    row, which = pairs // len(words), pairs % len(words)
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    hashes = crc32s(prefix[row], words, which)
    odd = hashes % np.uint32(misspelt) == 0
    counts = np.bincount(which[~odd], n[~odd], len(words)).astype(np.int64)
    found = [w.decode() for w in words.to_pylist()]
    out = {w: c for w, c in zip(found, counts.tolist(), strict=True) if c}
    for h, k, c in zip(hashes[odd].tolist(), which[odd].tolist(), n[odd].tolist(), strict=True):
        w = found[k]
        w = w[: h % len(w)] + w[h % len(w) + 1 :]
        out[w] = out.get(w, 0) + c
    out.pop("", None)
    return list(out), list(out.values())


def count_words(docs: DataFrame, misspelt: int = MISSPELT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over all documents: lower-cased runs (A-Z only), of which a share of 1 / ``misspelt`` has lost the letter that its hash names."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, data, offsets in wh.slices(batch.column(1)):
                found, n = _count_slice(data, offsets, ids[at : at + len(offsets) - 1], misspelt)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _cut(rows: DataFrame) -> DataFrame:
    """Each row under its two segments: ``letters`` of ``word`` from ``at`` on are left beside those of its key, ``size`` counts them in the shorter word of a pair."""
    half = F.floor(F.col("size") / 2).cast("int")
    rest = F.col("size") - half
    piece = lambda at, n: F.substring("word", at + 1, n)
    first = F.struct(F.xxhash64("key", F.lit(0), half, piece(F.col("at"), half)).alias("key"), (F.col("at") + half).alias("at"), (F.col("letters") - half).alias("letters"), rest.alias("size"))
    second = F.struct(F.xxhash64("key", F.lit(1), rest, piece(F.col("at") + F.col("letters") - rest, rest)).alias("key"), F.col("at"), (F.col("letters") - rest).alias("letters"), half.alias("size"))
    return rows.withColumn("cut", F.explode(F.array(first, second))).select("word", "longer", "cut.*")


def near_pairs(words: DataFrame, most: int = MOST_SHARING) -> DataFrame:
    """Written table (a, b) of the pairs of distinct ``words`` one edit apart, each once; b is the longer or larger one."""
    length = F.length("word").cast("int")
    start = lambda size, longer: F.struct(F.xxhash64(size).alias("key"), F.lit(0).alias("at"), length.alias("letters"), size.alias("size"), F.lit(longer).alias("longer"))
    rows = words.select("word", F.explode(F.array(start(length, False), start(length - 1, True))).alias("s")).select("word", "s.*")
    settled, rows = None, written(_cut(rows.where("size > 0")), "segments")
    while True:
        shared = rows.where("size > 1").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key")
        shared = written(shared, "shared")
        rare = rows.join(shared, "key", "left_anti").select("key", "word", "longer")
        settled = rare if settled is None else settled.union(rare)
        if shared.isEmpty():
            break
        rows = written(_cut(rows.join(shared, "key")), "segments")
    settled = written(settled, "settled")
    left, right = settled.where("NOT longer").select("key", F.col("word").alias("a")), settled.select("key", F.col("word").alias("b"), "longer")
    met = left.join(right.hint("merge"), (left.key == right.key) & (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return written(met.select("a", "b").distinct(), "near")


def follow(forms: DataFrame) -> DataFrame:
    """Written table (word, root) from (word, form): the last of the words that forms lead to, by pointer doubling. Forms may not lead in a circle."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("via"), F.col("root").alias("next"))
        new = written(now.join(ahead, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(now)
        now = new
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def group_variants(
    docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: float = RATIO, misspelt: int = MISSPELT, most: int = MOST_SHARING, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n. ``most`` bounds the words that share a segment; results don't depend on it."""
    words = written(count_words(docs, misspelt, id_col, text_col).where((F.col("n") >= least_count) & (F.length("word") >= least_letters)), "words")
    pairs = near_pairs(words.select("word"), most)
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    met = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best: Column = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = met.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best"))
    known = written(known.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")), "variants")
    roots = follow(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def brute_force(rows: list[tuple], least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: float = RATIO, misspelt: int = MISSPELT) -> list[tuple]:
    """The same by a regular expression, a counter and all pairs: (word, form, root, n, n_near, form_n)."""
    import re
    from collections import Counter

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    counts: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(str.maketrans(upper, upper.lower()))):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % misspelt else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    around = {w: [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in around.items() if vs}
    form = {w: v for w, v in form.items() if words[v] >= ratio * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(around[w]), words[form[w]] if w in form else None))
    return out
