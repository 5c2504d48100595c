"""Scores of all pairs of a vector table and a query table, in cells: a block of vectors meets a block of queries in one task, as matrices.

Only ids and vectors are shuffled, and each cell passes on what it keeps of a query. Scores
add up their products in the order of the dimensions and are rounded half up to six
digits, as the Column functions of ``functions.vectors`` do: a matrix product only
chooses what is scored so.
"""

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors and queries of a cell: of a search, and where every pair is a result.
SEARCHED, ALL = (50_000, 10_000), (2000, 1000)
#: Vectors and queries of one matrix product.
ROWS, COLUMNS = 4000, 1000
#: Vectors whose best give a search its first bar.
FIRST = 1000
#: How far a matrix product may be from the score in millionths, rounding included.
SLACK = 2.2
COSINE, WORDS, DISTANCE = "cosine", "words", "distance"


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Arrays as rows in double precision; null and those of another length than the first are all NaN."""
    lists = pa.chunked_array(column).combine_chunks() if isinstance(column, pa.Array) else column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    width = lengths[lengths >= 0][0] if (lengths >= 0).any() else 0
    out = np.full((len(lists), width), np.nan)
    fits = lengths == width
    values = lists.filter(pa.array(fits)).flatten()
    out[fits] = values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    return out


def millionths(x: np.ndarray) -> np.ndarray:
    """Scores in whole millionths, half up by their shortest decimals."""
    y = x * 1e6
    n = np.floor(y + 0.5)
    near = np.abs(y - np.floor(y) - 0.5) < np.maximum(1e-6, np.abs(y) * 1e-14)
    for i in np.flatnonzero(near):
        n.flat[i] = float((Decimal(repr(float(x.flat[i]))) * 1_000_000).quantize(Decimal(1), ROUND_HALF_UP))
    return n


def added(of: Callable[[int], np.ndarray], width: int, like: np.ndarray) -> np.ndarray:
    total = np.zeros_like(like)
    for j in range(width):
        total += of(j)
    return total


def exact(kind: str, v: np.ndarray, w: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of vectors ``v`` and ``w`` that broadcast against each other over all but the last axis; ``n`` and ``m`` are squared lengths."""
    like = np.empty(np.broadcast_shapes(v.shape[:-1], w.shape[:-1]))
    if kind == DISTANCE:
        return added(lambda j: np.square(v[..., j] - w[..., j]), v.shape[-1], like)
    product = added(lambda j: v[..., j] * w[..., j], v.shape[-1], like)
    if kind == WORDS:
        size = np.sqrt(n * m)
        product = np.divide(product, size, out=np.where(np.isnan(product), np.nan, 0.0), where=size > 0)
    return (1 + product) / 2


def ready(kind: str, v: np.ndarray, n: np.ndarray, query: bool = False) -> np.ndarray:
    """Vectors whose products with those made ready for the other side grow as pairs get better: cosines, in single precision, or distances with their sign turned."""
    if kind == DISTANCE:
        sizes, ones = (v * v).sum(axis=1)[:, None], np.ones((len(v), 1))
        return np.hstack([2 * v, -ones, -sizes] if query else [v, sizes, ones])
    if kind == WORDS:
        v = v * np.divide(1, np.sqrt(n), out=np.zeros(len(n)), where=n > 0)[:, None]
    return v.astype(np.float32)


def margin(kind: str, v: np.ndarray, w: np.ndarray) -> float:
    """How far a product of ready vectors may be from what the score's millionths say, in products."""
    if kind == DISTANCE:
        sizes = np.nanmax(v[:, -2], initial=0.0) - np.nanmin(w[:, -1], initial=0.0)
        return SLACK * 1e-6 + v.shape[1] * 2.0**-50 * float(sizes)
    longest = [float(np.sqrt(np.nanmax(np.square(x, dtype=float).sum(axis=1), initial=0.0))) for x in (v, w)]
    return SLACK * 2e-6 + (v.shape[1] + 2) * 2.0**-23 * longest[0] * longest[1]


def sorted_by(rows: pa.Table, name: str) -> pa.Table:
    return rows.take(pc.sort_indices(rows, sort_keys=[(name, "ascending")]))


def lengths(rows: pa.Table) -> np.ndarray:
    return rows.column("n").to_numpy().astype(float)


def best_of(kind: str, k: int, least: float | None, left: pa.Table, right: pa.Table) -> pa.Table:
    """The best ``k`` rows of ``left`` for each of ``right``, ties by id; ``least`` is a similarity that all must come near to."""
    left = sorted_by(left, "id")
    v, w, n, m = matrix(left.column("v")), matrix(right.column("v")), lengths(left), lengths(right)
    sign, unit = (1, 1e-6) if kind == DISTANCE else (-1, 2e-6)
    shift = 0.0 if kind == DISTANCE else 1.0
    found_q, found_i, found_m = [], [], []
    ready_v = ready(kind, v, n)
    for q0 in range(0, len(w) if v.shape[1] == w.shape[1] else 0, COLUMNS):
        wq, mq = w[q0 : q0 + COLUMNS], m[q0 : q0 + COLUMNS]
        ready_w = ready(kind, wq, mq, query=True)
        slack = margin(kind, ready_v, ready_w)
        best = (np.empty(0, int), np.empty(0, int), np.empty(0))
        bar = np.full(len(wq), -np.inf if least is None else 2 * least - 1 - slack)
        for i0 in range(0, len(v), ROWS):
            near = ready_w @ ready_v[i0 : i0 + ROWS].T
            if i0 == 0 and near.shape[1] > k:
                some = np.nan_to_num(near[:, : max(k + 1, FIRST)], nan=-np.inf, neginf=-np.inf)
                bar = np.maximum(bar, -np.partition(-some, k - 1, axis=1)[:, k - 1].astype(float) - 2 * slack)
            # The bar in single precision is rounded down, so that nothing at it is lost
            least_near = np.nextafter(bar.astype(near.dtype), -np.inf, dtype=near.dtype)
            q, i = np.divmod(np.flatnonzero((near >= least_near[:, None]).ravel()), near.shape[1])
            real = ~np.isnan(near[q, i])
            q, i = q[real], i[real]
            if not len(i):
                continue
            score = pair_scores(kind, v, wq, n, mq, i + i0, q) if kind != WORDS else word_scores(near[q, i], v, wq, n, mq, i + i0, q)
            q, i, s = np.concatenate([best[0], q]), np.concatenate([best[1], i + i0]), np.concatenate([best[2], sign * millionths(score)])
            order = np.lexsort((i, s, q))
            q, i, s = q[order], i[order], s[order]
            starts = np.searchsorted(q, np.arange(len(wq)))
            r = np.arange(len(q)) - starts[q]
            at = r < k
            best = (q[at], i[at], s[at])
            last = np.flatnonzero(r == k - 1)
            bar[q[last]] = np.maximum(bar[q[last]], -s[last] * unit - shift - slack)
        found_q.append(best[0] + q0), found_i.append(best[1]), found_m.append(best[2])
    q, i, s = (np.concatenate(x) if x else np.empty(0, int) for x in (found_q, found_i, found_m))
    return pa.table({"query_id": right.column("query_id").take(pa.array(q)), "id": left.column("id").take(pa.array(i)), "score": pa.array(sign * s / 1e6, pa.float64())})


def pair_scores(kind: str, v: np.ndarray, w: np.ndarray, n: np.ndarray, m: np.ndarray, i: np.ndarray, q: np.ndarray, step: int = 100_000) -> np.ndarray:
    """Scores of the pairs (i, q), ``step`` at a time."""
    parts = [exact(kind, v[i[a : a + step]], w[q[a : a + step]], n[i[a : a + step]], m[q[a : a + step]]) for a in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.empty(0)


def word_scores(near: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, m: np.ndarray, i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scores of the pairs (i, q) of word vectors, from ``near``, their cosines in single precision. The product of whole numbers is the whole number that a cosine tells within a quarter, else it is added up."""
    size = np.sqrt(n[i] * m[q])
    product = near * size
    out = (1 + np.divide(np.rint(product), size, out=np.zeros(len(size)), where=size > 0)) / 2
    unsure = np.flatnonzero(~(size * (v.shape[1] + 4) * 2.0**-23 < 0.25) | (np.abs(product - np.rint(product)) > 0.25))
    out[unsure] = pair_scores(WORDS, v, w, n, m, i[unsure], q[unsure])
    return out


def all_of(kind: str, least: float | None, left: pa.Table, right: pa.Table) -> pa.Table:
    """Every pair, or those that reach ``least``; the score of a null vector is null."""
    v, w, n, m = matrix(left.column("v")), matrix(right.column("v")), lengths(left), lengths(right)
    if v.shape[1] != w.shape[1]:
        v, w = np.full((len(v), 1), np.nan), np.full((len(w), 1), np.nan)
    w = np.asfortranarray(w)
    ids, asked, scores = [], [], []
    for i0 in range(0, len(v), 64):
        score = exact(kind, v[i0 : i0 + 64, None, :], w[None, :, :], n[i0 : i0 + 64, None], m[None, :]).ravel()
        score = millionths(score) / 1e6
        at = np.flatnonzero(score >= least) if least is not None else np.arange(len(score))
        ids.append(at // len(w) + i0), asked.append(at % len(w)), scores.append(score[at])
    i, q, s = (np.concatenate(x) if x else np.empty(0, int) for x in (ids, asked, scores))
    return pa.table({"query_id": right.column("query_id").take(pa.array(q)), "id": left.column("id").take(pa.array(i)), "score": pa.array(s.astype(float), pa.float64(), mask=np.isnan(s.astype(float)))})


def _in_cells(vectors: DataFrame, queries: DataFrame, size: tuple[int, int], of: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """``of`` over all cells of vectors (id, v, n) and queries (query_id, v, n): (query_id, id, score)."""
    down, across = max(1, -(-vectors.count() // size[0])), max(1, -(-queries.count() // size[1]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("row", F.pmod(F.xxhash64("id"), F.lit(down)).cast("int")).withColumn("column", every(across))
    right = queries.withColumn("column", F.pmod(F.xxhash64("query_id"), F.lit(across)).cast("int")).withColumn("row", every(down))
    kinds = {"query_id": queries.schema["query_id"].dataType, "id": vectors.schema["id"].dataType}
    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items()) + ", score double"
    return left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInArrow(of, schema)


def best(vectors: DataFrame, queries: DataFrame, kind: str, k: int, least: float | None = None, across: int = SEARCHED[1]) -> DataFrame:
    """Rows among which are the ``k`` best of each query, with their rounded scores: at most ``k`` of each block of vectors."""
    return _in_cells(vectors, queries, (SEARCHED[0], across), partial(best_of, kind, k, least))


def every(vectors: DataFrame, queries: DataFrame, kind: str, least: float | None = None) -> DataFrame:
    """Every pair, or those whose score reaches ``least``, in cells small enough to hold them."""
    return _in_cells(vectors, queries, ALL, partial(all_of, kind, least))
