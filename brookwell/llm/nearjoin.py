"""N-gram Jaccard join: MinHash banding, then full n-gram sets decide.

1. A text becomes its set of five-word shingles (64-bit hashes; lower-cased words
   between white space). Texts with equal word sequences form one class, whose
   least row stands for it from here on.
2. Band and row counts are chosen so that a pair at the threshold meets in some
   band with at least the target recall. Band hashes are shuffled, never texts:
   each member of a bucket is tied to the bucket's least member, which takes one
   row a member however large the bucket. Components of those ties bound where
   links can be.
3. A component is verified as a whole, or bucket by bucket if that moves fewer
   shingle sets (a pair counts in the first band where it meets), so a chain of
   texts that are somewhat alike costs what its buckets cost. Either is dealt into
   blocks of bounded rows and shingles, and each pair of blocks is verified by
   itself, so no task holds a whole large group. A task intersects the full
   shingle sets of its pairs as a matrix product and returns link counts and a
   spanning forest of the true links, not the pairs. A set that goes to several
   blocks is sent as its difference to the set of the group's head, from which the
   intersections follow exactly: near copies cost what they differ in.
4. Components of the true links are the near-duplicate classes.

Defined cases: a text without words (null, empty, blank) is linked to nothing and
is its own class; one to four words count as a single shingle; repeated rows and
equal texts are one text with a copy count; a null id can belong to a class but
is never its name (a class of null ids only has a null name); a very long text is
one set of shingles, alone in its block if it is larger than a block; other
columns of the input are not looked at, whatever their names.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookwell.llm import wordhash as wh
from brookwell.llm.components import components
from brookwell.llm.work import attach, written

U64 = np.uint64
SHINGLE = 5


def choose_bands(threshold: float = 0.8, recall: float = 0.9999, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): of those that reach ``recall`` at ``threshold``, the most rows a band that ``most_hashes`` allow.

    More rows mean fewer pairs below the threshold that meet by chance.
    """
    best = None
    for rows in range(1, most_hashes + 1):
        miss = 1 - threshold**rows
        bands = max(1, int(np.ceil(np.log(1 - recall) / np.log(miss)))) if miss > 0 else 1
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("most_hashes is too small for this recall")
    return best


def shingles(texts: pa.Array, width: int = SHINGLE, ascii_only: bool = False) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """For each text the digest of its word sequence (None without words) and its sorted distinct shingle hashes.

    Case is folded in all letters, or with ``ascii_only`` in A-Z.
    """
    lower = texts if ascii_only else pa.array([t.lower() if t else "" for t in texts.to_pylist()], pa.large_string())
    for _, data, offsets in wh.slices(lower):
        if ascii_only:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        starts, ends, first = wh.words(data, offsets)
        hashes = wh.word_hashes(data, starts, ends)
        rolled = wh.window_hashes(hashes, width)
        for i in range(len(first) - 1):
            a, b = first[i], first[i + 1]
            if a == b:
                yield None, np.zeros(0, U64)
                continue
            key = hashlib.md5(hashes[a:b].tobytes()).digest()
            yield key, np.unique(rolled[a : b - width + 1]) if b - a >= width else wh.window_hashes(hashes[a:b], int(b - a))


def minhash_bands(sets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band hashes of one shingle set."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 1 << 63, bands * rows, U64) * U64(2) + U64(1)
    b = rng.integers(0, 1 << 63, bands * rows, U64)
    least = np.full(bands * rows, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(sets), 4096):
        part = ((sets[None, at : at + 4096] * a[:, None] + b[:, None]) >> U64(32)).astype(np.uint32)
        least = np.minimum(least, part.min(axis=1))
    weights = rng.integers(1, 1 << 63, rows, U64) * U64(2) + U64(1)
    return wh.mix((wh.mix(least.astype(U64)).reshape(bands, rows) * weights).sum(axis=1))


def sign_minhash(sets: list[np.ndarray], bands: int, rows: int) -> list[np.ndarray]:
    return [minhash_bands(s, bands, rows) for s in sets]


#: From shingle sets, none of them empty, and the numbers of bands and rows to each set's band hashes.
Signer = Callable[[list[np.ndarray], int, int], list[np.ndarray]]


def against(head: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(symmetric difference of two sorted sets, how much of it is in ``own`` only, in ``head`` only)."""
    extra, missing = np.setdiff1d(own, head, assume_unique=True), np.setdiff1d(head, own, assume_unique=True)
    return np.concatenate((extra, missing)), len(extra), len(missing)


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, sizes: np.ndarray | None = None, extra: np.ndarray | None = None, missing: np.ndarray | None = None) -> np.ndarray:
    """Boolean matrix over ``left`` x ``right`` (row numbers of ``sets``): Jaccard similarity is at least ``threshold``.

    With ``sizes``, ``extra`` and ``missing`` the sets are differences to one common set,
    as ``against`` gives them: two texts share what of that set neither lacks, and what
    their differences share stands for both what both lack and what both have beside it.
    """
    lengths = np.array([len(s) for s in sets])
    if sizes is None:
        sizes, extra, missing = lengths, lengths, np.zeros_like(lengths)
    owner = np.repeat(np.arange(len(sets)), lengths)
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    renumber = np.cumsum(shared) - 1
    keep = shared[code]
    code, owner = renumber[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    both, n = np.zeros((len(left), len(right)), np.float32), int(shared.sum())
    at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    for at in range(0, n, 4096):
        lo, hi = np.searchsorted(code, (at, at + 4096))
        c, o = code[lo:hi] - at, owner[lo:hi]
        x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        m = at_left[o] >= 0
        x[at_left[o[m]], c[m]] = 1
        m = at_right[o] >= 0
        y[at_right[o[m]], c[m]] = 1
        both += x @ y.T
    both += (sizes - extra)[left][:, None] - missing[right][None, :]
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return both >= threshold * union - 1e-6


def _signatures(docs: DataFrame, bands: int, rows: int, width: int, ascii_only: bool, sign_sets: Signer) -> DataFrame:
    """Written table (id, text_hash, key, size, bands) of the documents; key is null without words, size counts shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = list(shingles(part.column(2), width, ascii_only))
                signed = iter(sign_sets([s for k, s in found if k is not None], bands, rows))
                keys, sizes = pa.array([k for k, _ in found], pa.binary()), pa.array([len(s) for _, s in found], pa.int64())
                hashes = pa.array([None if k is None else next(signed).view(np.int64) for k, _ in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), keys, sizes, hashes], ["id", "text_hash", "key", "size", "bands"])

    id_type = docs.schema["id"].dataType.simpleString()
    return written(docs.mapInArrow(sign, f"id {id_type}, text_hash long, key binary, size long, bands array<long>"), "signatures")


def _placements(texts: DataFrame, n_texts: int, bands: int, block: int, block_size: int) -> DataFrame:
    """The texts that share a bucket with another, with ``at``: the groups (gid, band, n_blocks) in which each is verified. Band is -1 for a whole component."""
    n_blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("size") / block_size)).cast("int").alias("n_blocks")
    placed = texts.select("uid", "size", F.posexplode("bands").alias("band", "hash"))
    buckets = placed.groupBy("band", "hash").agg(F.min("uid").alias("head"), F.count("*").alias("n"), F.sum("size").alias("size")).where("n > 1")
    buckets = written(buckets.select("band", "hash", "head", "n", n_blocks), "buckets")
    ties = attach(placed.drop("size"), buckets, ["band", "hash"], "n", n_texts * bands).where(F.col("uid") != F.col("head")).select("uid", "head")
    groups = written(components(ties), "groups")

    members = written(groups.withColumnRenamed("node", "uid").join(texts, "uid"), "members")
    roots = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("size")).select("root", "n", n_blocks)
    costs = buckets.join(groups.withColumnRenamed("node", "head"), "head").groupBy("root").agg(F.sum(F.col("n") * F.col("n_blocks")).alias("by_bucket"))
    roots = written(roots.join(costs, "root").withColumn("whole", F.col("n") * F.col("n_blocks") <= F.col("by_bucket")), "roots")
    n_members = members.count()
    here = attach(members, roots, ["root"], "n", n_members).drop("n")
    where = lambda gid, band, head: F.struct(F.col(gid).alias("gid"), band.cast("int").alias("band"), "n_blocks", F.col(head).alias("head"))
    whole = here.where("whole").withColumn("at", F.array(where("root", F.lit(-1), "root")))
    loose = roots.where("NOT whole")
    if loose.isEmpty():
        return whole.drop("n_blocks", "whole", "size", "root")
    loose = written(here.where("NOT whole").drop("n_blocks", "whole", "root"), "loose")
    met = attach(loose.select("uid", F.posexplode("bands").alias("band", "hash")), buckets, ["band", "hash"], "n", n_texts * bands)
    met = met.groupBy("uid").agg(F.collect_list(where("hash", F.col("band"), "head")).alias("at"))
    return whole.drop("n_blocks", "whole", "size", "root").unionByName(loose.join(met, "uid").drop("size"))


def _verified(docs: DataFrame, dealt: DataFrame, n_docs: int, threshold: float, width: int, ascii_only: bool) -> DataFrame:
    """Written table (a, b, links): edges of spanning forests of the true links, and counts of a text's links (b is null)."""
    once = lambda rows: rows.dropDuplicates(["uid"])  # noqa: E731  a row that is repeated very often
    found = attach(docs, dealt, ["id", "text_hash"], "n_copies", n_docs, once).select("uid", "key", "n_copies", "bands", "at", "text")

    def reshingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = list(shingles(part.column(5), width, ascii_only))
                same = pa.array([k == key for (k, _), key in zip(got, part.column(1).to_pylist(), strict=True)], pa.bool_())
                sets = pa.array([s.tobytes() for _, s in got], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:5], sets], ["uid", "n_copies", "bands", "at", "shingles"]).filter(same)

    place = found.schema["at"].dataType.simpleString()
    placed = found.mapInArrow(reshingle, f"uid long, n_copies long, bands array<long>, at {place}, shingles binary").withColumn("g", F.explode("at"))
    placed = written(placed.select("uid", "n_copies", F.when(F.col("g.band") >= 0, F.col("bands")).alias("bands"), "g.*", (F.octet_length("shingles") / 8).cast("long").alias("size"), "shingles"), "placed")
    zero, none = F.lit(0), F.lit(0).cast("long")
    small = placed.where("n_blocks = 1").select("gid", "band", zero.alias("low"), zero.alias("high"), zero.alias("own"), "uid", "n_copies", "bands", "size", F.col("size").alias("extra"), none.alias("missing"), "shingles")

    # The texts of a group of several blocks go to each of them, so they shrink to what tells them from its head.
    many = placed.where("n_blocks > 1")
    heads = many.where("uid = head").dropDuplicates(["gid", "band"]).select(F.col("gid").alias("of"), F.col("band").alias("of_band"), F.col("shingles").alias("common"))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, common = (batch.column(i).to_pylist() for i in (6, 7))
            for at in range(0, batch.num_rows, 500):
                found = [against(np.frombuffer(h, U64), np.frombuffer(s, U64)) for s, h in zip(own[at : at + 500], common[at : at + 500], strict=True)]
                counts = [len(s) // 8 for s in own[at : at + 500]], [e for _, e, _ in found], [m for _, _, m in found]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, 500).columns[:6], *(pa.array(c, pa.int64()) for c in counts), pa.array([d.tobytes() for d, _, _ in found], pa.binary())], ["gid", "band", "n_blocks", "uid", "n_copies", "bands", "size", "extra", "missing", "shingles"])

    met = many.join(heads, (F.col("gid") == F.col("of")) & (F.col("band") == F.col("of_band"))).select("gid", "band", "n_blocks", "uid", "n_copies", "bands", "shingles", "common")
    met = met.mapInArrow(differ, "gid long, band int, n_blocks int, uid long, n_copies long, bands array<long>, size long, extra long, missing long, shingles binary")
    large = (
        met.withColumn("own", F.pmod(F.xxhash64("uid", "gid"), F.col("n_blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select("gid", "band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "uid", "n_copies", "bands", "size", "extra", "missing", "shingles")
    )
    spread = small.union(large)

    def verify(group: pa.Table) -> pa.Table:
        band, low, high = (group[c][0].as_py() for c in ("band", "low", "high"))
        seen: dict[int, int] = {}
        for i, k in enumerate(group["uid"].to_pylist()):
            seen.setdefault(k, i)
        group = group.take(pa.array(seen.values()))
        uids, copies, own_block, *sizes = (group[c].to_numpy() for c in ("uid", "n_copies", "own", "size", "extra", "missing"))
        sets = [np.frombuffer(s, U64) for s in group["shingles"].to_pylist()]
        left = np.flatnonzero(own_block == low)
        right = left if low == high else np.flatnonzero(own_block == high)
        links = np.zeros(len(uids), np.int64)
        label = np.arange(len(uids))
        if len(left) and len(right):
            hit = linked(sets, left, right, threshold, *sizes)
            if low == high:
                np.fill_diagonal(hit, False)
            if band > 0:  # a pair that meets in an earlier band is another group's
                hashes = np.array(group["bands"].to_pylist(), np.int64)
                for k in range(band):
                    hit &= hashes[left, k][:, None] != hashes[right, k][None, :]
            links[left] += hit @ copies[right]
            if low != high:
                links[right] += hit.T @ copies[left]
            while True:  # each takes the least label it touches, until nothing changes
                new = label.copy()
                new[left] = np.minimum(new[left], np.where(hit, label[right][None, :], len(uids)).min(axis=1))
                new[right] = np.minimum(new[right], np.where(hit, new[left][:, None], len(uids)).min(axis=0))
                new = new[new]
                if (new == label).all():
                    break
                label = new
        at = np.flatnonzero(label != np.arange(len(uids)))
        counted = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate([uids[at], uids[counted]])),
            "b": pa.array([*uids[label[at]].tolist(), *[None] * len(counted)], pa.int64()),
            "links": pa.array(np.concatenate([np.zeros(len(at), np.int64), links[counted]])),
        })

    return written(spread.groupBy("gid", "band", "low", "high").applyInArrow(verify, "a long, b long, links long"), "verified")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, most_hashes: int = 128, block: int = 128, block_size: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text",
    width: int = SHINGLE, ascii_only: bool = False, sign_sets: Signer = sign_minhash,
) -> DataFrame:
    """One row per document: id, class_id (least id of its class), n_links (other documents at the threshold or above, copies counted), n_copies (documents of the same words, itself included), n_shingles (size of its set), text_hash, keeps (true for one row of each class, and for rows equal to it).

    ``width`` is the words of a shingle and ``sign_sets`` makes the signatures. ``block`` and ``block_size`` bound the rows and shingles of a block of the verification; results don't depend on them.
    """
    bands, rows = choose_bands(threshold, recall, most_hashes)
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed = _signatures(docs, bands, rows, width, ascii_only, sign_sets)
    texts = signed.where("key IS NOT NULL").groupBy("key").agg(
        F.min(F.struct("id", "text_hash")).alias("any_row"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "text_hash"))).alias("named_row"), F.count("*").alias("n_copies"), F.max("size").alias("size"), F.max("bands").alias("bands")
    )
    texts = texts.select("key", F.coalesce("named_row", "any_row").alias("r"), "n_copies", "size", "bands").select(F.monotonically_increasing_id().alias("uid"), "key", "r.id", "r.text_hash", "n_copies", "size", "bands")
    texts = written(texts, "texts")
    n_docs, n_texts = signed.count(), texts.count()
    dealt = written(_placements(texts, n_texts, bands, block, block_size), "dealt")
    verified = _verified(docs, dealt, n_docs, threshold, width, ascii_only)

    names = texts.drop("bands", "size")
    in_class = written(components(verified.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "uid").join(names, "uid"), "in-class")
    heads = written(in_class.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "text_hash")).alias("h"), F.count("*").alias("n")), "heads")
    classes = attach(in_class.select("uid", "root"), heads, ["root"], "n", n_texts).select("uid", "h")
    links = verified.where("b IS NULL").groupBy(F.col("a").alias("uid")).agg(F.sum("links").alias("links"))
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "text_hash")
    known = names.join(classes, "uid", "left").join(links, "uid", "left").withColumn("h", F.coalesce("h", own))
    known = known.select("key", F.col("h.id").alias("class_id"), "n_copies", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"), F.when(F.col("key") == F.col("h.key"), F.struct("h.id", "h.text_hash")).alias("head"))
    keeps = F.coalesce(F.col("head").eqNullSafe(F.struct("id", "text_hash")), F.lit(False))
    signed = signed.drop("bands").withColumnRenamed("size", "n_shingles")
    with_words = attach(signed.where("key IS NOT NULL"), written(known, "known"), ["key"], "n_copies", n_docs).select("id", "class_id", "n_links", "n_copies", "n_shingles", "text_hash", keeps.alias("keeps"))
    without = signed.where("key IS NULL").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), "n_shingles", "text_hash", F.lit(True).alias("keeps"))
    return with_words.unionByName(without).withColumnRenamed("id", id_col)


def brute_force(rows: list[tuple], threshold: float = 0.8) -> list[tuple]:
    """The same by comparing all pairs: (id, class_id, n_links)."""
    split = [tuple((t or "").lower().encode().split()) for _, t in rows]
    sets = [{w[k : k + SHINGLE] for k in range(max(1, len(w) - SHINGLE + 1))} if w else set() for w in split]
    n = len(rows)
    label, links = list(range(n)), [0] * n
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    names: dict[int, int | None] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[label[i]] = min(d, names.get(label[i], d))
    return [(d, names.get(label[i]), links[i]) for i, (d, _) in enumerate(rows)]
