"""Language identification by language-bitmask n-gram filters.

One Bloom filter serves all languages: each of its slots holds a bitmask with one
bit a language, so that AND-ing an n-gram's slots returns every language that has
it. A text's n-grams are looked up, the bits are counted for each language, the
count is corrected for the filter's false positives (fill ** hashes, by
language), and the largest corrected count decides.

The filter is fitted on at most about ``train_docs`` labelled documents a
language, drawn by a hash of id and text; n-gram counts are summed in Spark. Its
size is fixed by ``slots``, which bounds what the driver gathers and broadcasts.
Fitting looks at text and language only; prediction at the text only.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
documents without a language or id are predicted but not learned from; without
any labelled document all are ``und``; ties go to the language first in code
point order; a text with letters of which no n-gram is known gets the language
with most training documents and score 0; a filter so full that a language's bit is
set in every slot says nothing about that language; more than ``most_langs``
languages raise an error, as such a column is no language; a very long text is cut
into n-grams by itself, in memory proportional to its length; repeated rows get
equal results; other columns are not looked at, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookwell.llm import wordhash as wh
from brookwell.llm.work import fresh, written

U64 = np.uint64
N, HASHES, BITS = 4, 3, 63
SLICE_CHARS = 1 << 19
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once in a worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: n-gram hashes, the text of each (its place in the run), and which texts have a letter.

    Texts are lower-cased; other characters than letters read as one space, and a
    text begins and ends with spaces.
    """
    at = 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars < SLICE_CHARS):
            chars += len(texts[to] or "")
            to += 1
        run = [f" {(t or '').lower()}   " for t in texts[at:to]]
        codes = np.frombuffer("".join(run).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(run)), [len(t) for t in run])
        letter = letters()[codes]
        first = np.ones(len(row), bool)
        first[1:] = row[1:] != row[:-1]
        keep = letter | first
        keep[1:] |= letter[:-1]
        last = np.flatnonzero(np.append(first[1:], True))
        for back in range(2):  # two spaces end a text, so that a single letter has an n-gram
            keep[last - back] = True
        codes, row = np.where(letter, codes, 32)[keep].astype(U64), row[keep]
        has = np.zeros(len(run), bool)
        has[row[letter[keep]]] = True
        n = len(codes) - N + 1
        h = codes[:n].copy()
        for k in range(1, N):
            h = h * U64(0x1FFFFF) + codes[k : n + k]
        whole = (row[:n] == row[N - 1 :]) & has[row[:n]]
        yield wh.mix(h[whole]), row[:n][whole], has
        at = to


def slots_of(h: np.ndarray, slots: int, k: int) -> np.ndarray:
    return (wh.mix(h + U64(k * 0x9E3779B97F4A7C15 % (1 << 64))) % U64(slots)).astype(np.int64)


class Filter:
    """Masks by slot (a row for each word of BITS languages), the languages of the bits, and each bit's false positive rate."""

    def __init__(self, masks: np.ndarray, langs: list[str], most_common: int):
        self.masks, self.langs, self.most_common = masks, langs, most_common
        self.false = np.array([np.count_nonzero(self.bit(masks, b)) / masks.shape[1] for b in range(len(langs))]) ** HASHES

    @staticmethod
    def bit(masks: np.ndarray, b: int) -> np.ndarray:
        return masks[b // BITS] >> U64(b % BITS) & U64(1)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """A row for each word: the languages that have each of the n-grams."""
        found = self.masks[:, slots_of(h, self.masks.shape[1], 0)]
        for k in range(1, HASHES):
            found = found & self.masks[:, slots_of(h, self.masks.shape[1], k)]
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        out, scores = [], []
        for h, row, has in grams(texts):
            masks, n = self.lookup(h), len(has)
            total = np.bincount(row, minlength=n)
            counts = np.array([np.bincount(row, self.bit(masks, b), n) for b in range(len(self.langs))])
            fair = np.maximum(0, counts - total * self.false[:, None]) / np.maximum(1 - self.false[:, None], 1e-9)
            best, top, whole = fair.argmax(axis=0), fair.max(axis=0), fair.sum(axis=0)
            for i in range(n):
                out.append("und" if not has[i] else self.langs[best[i] if top[i] > 0 else self.most_common])
                scores.append(float(min(1.0, top[i] / whole[i])) if has[i] and top[i] > 0 else 0.0)
        return out, scores


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 5000, least_count: int = 3, least_share: float = 0.1, slots: int = 1 << 21, most_langs: int = 1000) -> Filter | None:
    """A filter of the n-grams of each language that occur at least ``least_count`` times and at ``least_share`` of the rate of the language where they are most frequent; None if nothing is labelled."""
    spark = labelled.sparkSession
    labelled = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    known = sorted((r.lang, r.n) for r in sizes.limit(most_langs + 1).collect())
    if not known:
        return None
    if len(known) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    langs = [x for x, _ in known]
    share = F.create_map(*(F.lit(v) for x, n in known for v in (x, min(1.0, train_docs / n))))
    drawn = labelled.where(F.pmod("h", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array([langs.index(x) for x in batch.column(0).to_pylist()])
            texts = batch.column(1).to_pylist()
            for b in np.unique(ids) if len(ids) else ():
                found = [h for h, _, _ in grams([texts[i] for i in np.flatnonzero(ids == b)])]
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), b), pa.int32()), pa.array(values.view(np.int64)), pa.array(n, pa.int64())], ["bit", "gram", "n"])

    counted = written(drawn.mapInArrow(count, "bit int, gram long, n long").groupBy("bit", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = dict(counted.groupBy("bit").agg(F.sum("n")).collect())
    if not totals:
        return None
    rate = F.col("n") / F.create_map(*(F.lit(v) for b, n in totals.items() for v in (int(b), float(n))))[F.col("bit")]
    rated = counted.withColumn("rate", rate)
    peak = rated.groupBy(F.col("gram").alias("g")).agg(F.max("rate").alias("peak"))
    kept = rated.where(F.col("n") >= least_count).join(peak, F.col("gram") == F.col("g")).where(F.col("rate") >= least_share * F.col("peak")).select("bit", "gram")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(0).to_numpy().astype(np.int64)
            mask, word = np.left_shift(np.int64(1), bits % BITS), pa.array((bits // BITS).astype(np.int32))
            h = batch.column(1).to_numpy().view(U64)
            for k in range(HASHES):
                yield pa.RecordBatch.from_arrays([word, pa.array(slots_of(h, slots, k)), pa.array(mask)], ["word", "slot", "mask"])

    table = kept.mapInArrow(place, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros((-(-len(langs) // BITS), slots), U64)
    masks[table["word"].to_numpy(), table["slot"].to_numpy()] = table["mask"].to_numpy().astype(U64)
    return Filter(masks, langs, max(range(len(known)), key=lambda i: (known[i][1], -i)))


def identify(docs: DataFrame, model: Filter | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, the ``carry`` columns, lang_pred, score."""
    spark = docs.sparkSession
    text = fresh(docs.select(id_col, *carry), "__text")
    docs = docs.select(F.col(id_col), *carry, F.col(text_col).alias(text))
    if model is None:
        return docs.drop(text).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop(text).schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")
