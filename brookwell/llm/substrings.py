"""Substring dedup: repeated fixed-length word windows are removed from all texts.

Method: Rabin-Karp hashes of every window, counted over all documents; windows
that occur more than once merge into maximal removal intervals.

Two shuffles carry the count. Documents are dealt into blocks by a hash of their
content; a block sends each of its distinct window hashes once, packed by bucket,
so copies are pre-aggregated and no bucket gets more than one entry of a window
from one block. The buckets are counted, and one bit for each hash goes back to
the block that sent it. The texts are shuffled once; both uses of the blocks
share that exchange. Blocks, buckets and the partitions that they are dealt to
are numbered by the amount of text, so a task's share stays the same as it grows;
beyond 20,000 blocks of 4 million characters the blocks grow, up to 64 million.

Two rolling hashes over two differently keyed hashes of the words tell windows
apart: one chooses the bucket, the other 64 bits stand in it. Over n distinct
windows in b buckets the chance of any false repeat is about n**2 / (b * 2**65):
5e-4 at 30 GB of text (8e9 windows, 4000 buckets).

Defined cases: null and empty texts have no words and keep nothing; a text of
fewer words than the window is kept whole; a repeated row is a repeat of each of
its windows, so both rows lose them (rows repeated very often are dealt out once,
with their count); null ids are carried through; a very long text lies in one
block; other columns of the input are not looked at, whatever their names.
"""

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookwell.llm import wordhash as wh
from brookwell.llm.work import LEAST_HOT, MOST_HOT, written

U64 = np.uint64
BLOCK_CHARS = 4_000_000
MOST_BLOCK_CHARS = 64_000_000
BUCKET_CHARS = 8_000_000
MOST_PARTITIONS = 100_000


class Windows:
    """The distinct windows of a block of texts, ordered by bucket and hash, and where they occur."""

    def __init__(self, texts: pa.ChunkedArray, width: int, buckets: int):
        self.width, self.slices = width, list(wh.slices(texts))
        self.first, hashes, places, self.whole = [], [], [], []
        for _, data, offsets in self.slices:
            starts, ends, first = wh.words(data, offsets)
            words = wh.word_hashes(data, starts, ends)
            h = wh.window_hashes(words, width)
            other = wh.window_hashes(wh.word_hashes(data, starts, ends, wh.OTHER_KEY), width)
            whole = np.zeros(len(h), bool)
            if len(h):
                row = np.searchsorted(first, np.arange(len(h)), "right") - 1
                whole = np.arange(len(h)) + width <= first[row + 1]
            self.first.append(first)
            self.whole.append(whole)
            hashes.append(h[whole])
            places.append(((other[whole] >> U64(32)) * U64(buckets)) >> U64(32))
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        places = np.concatenate(places).astype(np.int64) if places else np.zeros(0, np.int64)
        order = np.lexsort((hashes, places))
        hashes, places = hashes[order], places[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (places[1:] != places[:-1])
        self.hashes, self.buckets = hashes[new], places[new]
        code = np.cumsum(new) - 1
        self.counts = np.bincount(code, minlength=len(self.hashes))
        self.code = np.empty(len(order), np.int64)
        self.code[order] = code

    def marks(self, repeated: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each slice: bytes, offsets, each row's first word, and which words a repeated window covers."""
        at = 0
        for (_, data, offsets), first, whole, in zip(self.slices, self.first, self.whole, strict=True):
            begins = np.flatnonzero(whole)
            begins, at = begins[repeated[self.code[at : at + len(begins)]]], at + len(begins)
            hit = np.zeros(first[-1] + 1, np.int64)
            if len(begins):
                hit[begins] += 1
                np.subtract.at(hit, begins + self.width, 1)
            yield data, offsets, first, np.cumsum(hit[:-1]) > 0


def _repeated_rows(docs: DataFrame) -> DataFrame:
    """(id, text, rows): rows that are equal in id and text very often become one with a count; the others stay as they are, with a count of 1."""
    total = docs.count()
    hashed = docs.withColumn("h", F.xxhash64("text"))
    often = hashed.groupBy("id", "h").agg(F.count("*").alias("n")).where(F.col("n") > max(LEAST_HOT, total // MOST_HOT)).select(F.col("id").alias("i"), F.col("h").alias("k"))
    often = written(often, "often")
    if often.isEmpty():
        return docs.withColumn("rows", F.lit(1).cast("long"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))
    once = hashed.join(F.broadcast(often), same).groupBy("id", "text").agg(F.count("*").alias("rows"))
    return hashed.join(F.broadcast(often), same, "left_anti").select("id", "text", F.lit(1).cast("long").alias("rows")).union(once)


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text (kept words joined by one space)."""
    spark = docs.sparkSession
    docs = _repeated_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    block_chars = min(MOST_BLOCK_CHARS, max(BLOCK_CHARS, chars // 20_000))
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // block_chars))
    n_buckets = max(1, -(-chars // max(BUCKET_CHARS, 2 * block_chars)))
    block_tasks, bucket_tasks = min(n_blocks, MOST_PARTITIONS), min(n_buckets, MOST_PARTITIONS)
    blocks = docs.select(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).alias("block"), "id", "text", "rows").repartition(block_tasks, "block")

    def found(table: pa.Table) -> tuple[Windows, np.ndarray]:
        """The block's windows, and which of them occur more than once in it."""
        windows = Windows(table["text"], window, n_buckets)
        more = windows.counts > 1
        rows = table["rows"].to_numpy()
        if (rows > 1).any():  # every window of such a row is repeated
            at = 0
            for (row, _, offsets), first, whole in zip(windows.slices, windows.first, windows.whole, strict=True):
                begins = np.flatnonzero(whole)
                of = row + np.searchsorted(first, begins, "right") - 1
                more[windows.code[at : at + len(begins)][rows[of] > 1]] = True
                at += len(begins)
        return windows, more

    def send(table: pa.Table) -> pa.Table:
        windows, more = found(table)
        edges = np.searchsorted(windows.buckets, np.arange(n_buckets + 1))
        used = np.flatnonzero(edges[1:] > edges[:-1])
        cut = lambda keep: [windows.hashes[edges[i] : edges[i + 1]][keep[edges[i] : edges[i + 1]]].tobytes() for i in used]
        return pa.table({
            "bucket": pa.array(used, pa.int64()),
            "block": pa.array([table["block"][0].as_py()] * len(used), pa.int64()),
            "once": pa.array(cut(~more), pa.binary()),
            "more": pa.array(cut(more), pa.binary()),
        })

    def count(table: pa.Table) -> pa.Table:
        once = [np.frombuffer(x, U64) for x in table["once"].to_pylist()]
        more = [np.frombuffer(x, U64) for x in table["more"].to_pylist()]
        values, counts = np.unique(np.concatenate(once), return_counts=True)
        repeated = values[(counts > 1) | np.isin(values, np.concatenate(more))]
        bits = [np.packbits(np.isin(x, repeated, assume_unique=True)).tobytes() for x in once]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    def cut(marks: pa.Table, table: pa.Table) -> pa.Table:
        n_words, n_removed, kept = [], [], []
        if table.num_rows:
            windows, repeated = found(table)
            edges = np.searchsorted(windows.buckets, np.arange(n_buckets + 1))
            for b, bits in zip(marks["bucket"].to_pylist(), marks["bits"].to_pylist(), strict=True):
                once = np.flatnonzero(~repeated[edges[b] : edges[b + 1]]) + edges[b]
                repeated[once[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(once)).astype(bool)]] = True
            for data, offsets, first, covered in windows.marks(repeated):
                raw = data.tobytes()
                for i in range(len(first) - 1):
                    mask = covered[first[i] : first[i + 1]]
                    tokens = raw[offsets[i] : offsets[i + 1]].split()
                    n_words.append(len(tokens))
                    n_removed.append(int(mask.sum()))
                    kept.append(b" ".join(compress(tokens, ~mask) if mask.any() else tokens).decode())
        return pa.table({"id": table["id"], "rows": table["rows"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    sent = blocks.groupBy("block").applyInArrow(send, "bucket long, block long, once binary, more binary").repartition(bucket_tasks, "bucket")
    marks = sent.groupBy("bucket").applyInArrow(count, "block long, bucket long, bits binary").repartition(block_tasks, "block")
    id_type = docs.schema["id"].dataType.simpleString()
    out = marks.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(cut, f"id {id_type}, rows long, n_words long, n_removed long, kept_text string")
    each = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    return out.withColumn("row", each).drop("row", "rows").withColumnRenamed("id", id_col)


def brute_force(rows: list[tuple], window: int = 35) -> list[tuple]:
    """The same by comparing word sequences: (id, n_words, n_removed, kept_text)."""
    from collections import Counter

    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out
