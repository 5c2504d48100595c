"""Quality rules: per-text statistics and cross-document line frequency.

Method: each line is normalised and hashed; for each host the distinct documents
that have the line are counted; lines above the host's limit are removed, and a
document that loses too many of its words is rejected. Exact copies count once,
and so do near copies: texts of a host that agree in a band of a min-hash sketch
of their lines, weighted by words, are one group, and a line above the limit by
texts must be above it by groups too. Copies are the deduplicator's business, and
would otherwise make every line of a copied text look like boilerplate.

Lines, bands, texts and rows that a large share of all rows have are met by a
broadcast of their few keys (``attach``), so none of them fills one task.

Defined cases: a null text has no words, lines or symbols; null hosts form one
host; a null id is carried through; repeated rows get equal results; a very long
text is one row of distinct line hashes, in memory proportional to its length; an
empty table gives an empty one; other columns are not looked at, whatever their
names, and ``clean_documents`` returns exactly the columns it was given.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookwell.llm import wordhash as wh
from brookwell.llm.work import attach, fresh, written

U64 = np.uint64
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SPACES, _DIGITS = re.compile(r"\s+"), re.compile(r"\d+")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Limits of the rules. A line goes if more than LINE_DOCS documents of its host, and more than LINE_SHARE of them, have it.
LINE_DOCS, LINE_SHARE, LEAST_LEFT, LEAST_WORDS, MOST_REPEATED = 20, 0.01, 0.5, 50, 0.5
#: Sketch of a text's lines: texts with share s of their words in common agree in a band with a chance of 1 - (1 - s ** BAND_ROWS) ** BANDS.
BANDS, BAND_ROWS = 10, 4
_SEEDS = wh.mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))[:, None]


def line_hash(line: str) -> int:
    """Of the line in lower case, with single spaces, any number read as 0; as a signed 64-bit integer."""
    normal = _DIGITS.sub("0", _SPACES.sub(" ", line.strip().lower()))
    return int(np.uint64(xxhash.xxh3_64_intdigest(normal.encode("utf-8", "surrogatepass"))).astype(np.int64))


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def text_stats(texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (n_words, word_chars, n_symbols, n_repeat_words) for runs of rows."""
    for _, data, offsets in wh.slices(texts):
        starts, ends, first = wh.words(data, offsets)
        inside = ~wh.SPACE[data]
        rolled = wh.window_hashes(wh.word_hashes(data, starts, ends), 3)
        covered = np.zeros(first[-1] + 1, np.int64)
        if len(rolled):
            row = np.searchsorted(first, np.arange(len(rolled)), "right") - 1
            at = np.flatnonzero(np.arange(len(rolled)) + 3 <= first[row + 1])
            tagged = wh.mix(rolled[at] + row[at].astype(U64) * U64(0x9E3779B97F4A7C15))
            _, code, count = np.unique(tagged, return_inverse=True, return_counts=True)
            begins = at[count[code] > 1]
            covered[begins] += 1
            np.subtract.at(covered, begins + 3, 1)
        yield np.diff(first), _per_row(inside & ((data & 0xC0) != 0x80), offsets), _per_row(SYMBOL[data], offsets), _per_row(np.cumsum(covered[:-1]) > 0, first)


def _lines(text: str) -> tuple[int, dict[int, int]]:
    """Repeated lines, and the words of each distinct normalised line (all its occurrences)."""
    seen, again, found = set(), 0, {}
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if n:
            again += line in seen
            seen.add(line)
            h = line_hash(line)
            found[h] = found.get(h, 0) + n
    return again, found


def sketch(lines: dict[int, int]) -> list[int]:
    """Hash of each band: the lines drawn by weighted min-hash, so a line is drawn by its share of the words. Texts of one line have none."""
    if len(lines) < 2:
        return []
    hashes = np.fromiter(lines, np.int64, len(lines)).view(U64)
    drawn = wh.mix(hashes ^ _SEEDS)
    waits = -np.log(((drawn >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / np.fromiter(lines.values(), np.float64, len(lines))
    won = np.take_along_axis(drawn, waits.argmin(1)[:, None], 1).reshape(BANDS, BAND_ROWS)
    out = np.zeros(BANDS, U64)
    for i in range(BAND_ROWS):
        out = wh.mix(out ^ won[:, i])
    return out.view(np.int64).tolist()


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Written table (id, host, text_hash, statistics, lines, sketch): each text is read once."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(3), "")
            parts = list(text_stats(texts))
            n_words, chars, symbols, repeats = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
            lines = [_lines(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(x, pa.int64()) for x in (n_words, chars, symbols)), pa.array([a for a, _ in lines], pa.int64()), pa.array(repeats, pa.int64()),
                 pa.array([[{"hash": h, "words": n} for h, n in found.items()] for _, found in lines], pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())]))),
                 pa.array([sketch(found) for _, found in lines], pa.list_(pa.int64()))],
                ["id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "sketch"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return written(docs.mapInArrow(run, f"id {kind}, host string, text_hash long, {STATS}, lines array<struct<hash:long,words:long>>, sketch array<long>"), "profile")


def distinct_texts(profiled: DataFrame) -> DataFrame:
    """Written table (host, text_hash, lines, sketch, copies): one row for each text of a host, with the number of its copies."""
    each = profiled.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    return written(each, "texts")


def near_groups(texts: DataFrame) -> DataFrame:
    """Written table (doc, group) of the texts that share a band with another text of their host; the group is the least text of their bands."""
    bands = written(texts.select(F.xxhash64("host", "text_hash").alias("doc"), F.explode("sketch").alias("drawn"), "host").select("doc", F.xxhash64("host", "drawn").alias("band")), "all-bands")
    shared = written(bands.groupBy("band").agg(F.min("doc").alias("group"), F.count("*").alias("n")).where("n > 1"), "bands")
    met = attach(bands, shared, ["band"], "n", bands.count(), merge=False)
    return written(met.groupBy("doc").agg(F.min("group").alias("group")), "near-groups")


def _texts_lines(texts: DataFrame) -> DataFrame:
    """(host, doc, hash, words) of each distinct line of each text; doc stands for the text."""
    return texts.select("host", F.xxhash64("host", "text_hash").alias("doc"), F.explode("lines").alias("x")).select("host", "doc", "x.hash", "x.words")


def common_lines(texts: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """Written table (host, hash, n) of the lines above their host's limit by texts (n of them) and by groups of near copies."""
    totals = texts.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("n_docs"))
    lines = _texts_lines(texts)

    def above(counted: DataFrame, by: str) -> DataFrame:
        counted = counted.where(F.col(by) > line_docs)
        return counted.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col(by) > line_share * F.col("n_docs")).drop("h", "n_docs")

    often = written(above(lines.groupBy("host", "hash").agg(F.count("*").alias("n")), "n"), "often")
    held = attach(lines.drop("words"), often, ["host", "hash"], "n", often.agg(F.sum("n")).first()[0] or 0, merge=False)
    grouped = held.join(near_groups(texts), "doc", "left").select("host", "hash", "n", F.coalesce("group", "doc").alias("group")).distinct()
    return written(above(grouped.groupBy("host", "hash").agg(F.first("n").alias("n"), F.count("*").alias("groups")), "groups").drop("groups"), "common")


def assess(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, least_left: float = LEAST_LEFT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: id, host, text_hash, statistics, removed_words, removed_lines (hashes), base_failed, kept."""
    profiled = profile(docs, id_col, text_col, host_col)
    texts = distinct_texts(profiled)
    common = common_lines(texts, line_docs, line_share)
    lost = attach(_texts_lines(texts), common, ["host", "hash"], "n", common.agg(F.sum("n")).first()[0] or 0, merge=False)
    lost = lost.groupBy(F.col("doc").alias("d")).agg(F.sum("words").alias("removed_words"), F.collect_set("hash").alias("removed_lines"))
    every = texts.select("host", "text_hash", "copies").join(lost, F.xxhash64("host", "text_hash") == F.col("d"), "left").drop("d")
    every = written(every.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long"))), "lost")
    out = attach(profiled.drop("lines", "sketch"), every, ["host", "text_hash"], "copies", profiled.count(), merge=False).drop("copies")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= least_left * F.col("n_words"))).withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The kept documents in their own columns, without the lines above the limits; ``chars_col``, if there, is counted anew."""
    verdict = assess(docs, id_col=id_col, text_col=text_col, host_col=host_col).where("kept")
    i, h, t, gone, n = (fresh(docs, c) for c in ("__id", "__host", "__text", "__gone", "__n"))
    verdict = written(verdict.groupBy(F.col(id_col).alias(i), F.col("host").alias(h), F.col("text_hash").alias(t)).agg(F.max("removed_lines").alias(gone), F.count("*").alias(n)), "verdict")
    keyed = docs.withColumns({i: F.col(id_col), h: F.col(host_col).cast("string"), t: F.xxhash64(text_col)})
    kept = attach(keyed, verdict, [i, h, t], n, verdict.agg(F.sum(n)).first()[0] or 0, merge=False).select(*(F.col(f"`{c}`") for c in docs.columns), gone)
    names = docs.columns
    at = names.index(text_col)

    def drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for i, lines in enumerate(gone):
                if lines and texts[i]:
                    bad = set(lines)
                    texts[i] = "\n".join(x for x in texts[i].split("\n") if not x.strip() or line_hash(x) not in bad)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    out = kept.mapInArrow(drop_lines, docs.schema)
    if chars_col in names:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out
