"""Approximate nearest neighbours: an inverted file of coarse centroids with residual codes, written by cell.

A vector is a row of its nearest centroid's cell, as one byte a dimension of what is left
of it beside the centroid. A search scores only the cells nearest to a query, whose
folders alone are read, by those codes; the best of them are scored anew by the whole
vectors. ``vectors.top_k`` is the exact way, and what recall is measured against.
"""

import uuid
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.functions.vectors import dot, similarity, unit
from brookwell.operators import pairs, vectors
from brookwell.operators.kept import kept, shared_path

#: Centroids are fitted on at most this many vectors, those of least hash, and there are at most so many of them.
MOST_SAMPLE, MOST_CELLS = 100_000, 4096
#: Queries are searched in blocks of about this many; vectors and queries that meet in one task, and queries of one matrix product.
BLOCK, TOGETHER, COLUMNS = 10_000, 50_000, 100


@dataclass(frozen=True)
class Inverted:
    """``codes`` (cell, id, code) and ``whole`` (cell, id, unit, ...) are folders by cell; ``centroids`` (cell, centroid, scale) is a written table of at most ``MOST_CELLS`` rows."""

    codes: str
    whole: str
    centroids: DataFrame
    id_col: str

    def read(self, spark: SparkSession, what: str) -> DataFrame:
        return spark.read.parquet(self.codes if what == "codes" else self.whole)


def build(rows: DataFrame, id_col: str, vector: str = "embedding", cells: int | None = None, sample: int = MOST_SAMPLE, rounds: int = 10) -> Inverted:
    """Index every row of ``rows``; about the square root of their number is the number of cells, if it isn't given."""
    spark = rows.sparkSession
    units = kept(rows.withColumn("unit", unit(F.col(vector))).drop(vector), "units")
    cells = min(MOST_CELLS, cells or max(1, round(units.count() ** 0.5)))
    with_vector = units.withColumn("features", array_to_vector("unit"))
    fitted = with_vector.select("features").orderBy(F.xxhash64(id_col)).limit(min(sample, MOST_SAMPLE))
    model = KMeans(k=cells, seed=17, maxIter=rounds).fit(fitted)
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centroids = spark.createDataFrame(centers, "cell int, centroid array<double>")
    dealt = model.transform(with_vector).withColumnRenamed("prediction", "cell").drop("features")
    dealt = dealt.join(F.broadcast(centroids), "cell").withColumn("rest", F.zip_with("unit", "centroid", lambda x, c: x - c)).drop("centroid")
    path = shared_path(spark, f"cells-{uuid.uuid4().hex}")
    dealt.write.partitionBy("cell").parquet(f"{path}/whole")
    whole = spark.read.parquet(f"{path}/whole")
    scales = whole.groupBy("cell").agg(F.max(F.array_max(F.transform("rest", F.abs))).alias("scale"))
    known = kept(centroids.join(scales, "cell").withColumn("scale", F.greatest(F.col("scale") / 127, F.lit(1e-12))), "centroids")
    code = F.transform("rest", lambda x: F.round(x / F.col("scale")).cast("tinyint"))
    whole.join(F.broadcast(known), "cell").select("cell", id_col, code.alias("code")).write.partitionBy("cell").parquet(f"{path}/codes")
    return Inverted(f"{path}/codes", f"{path}/whole", known, id_col)


def _probed(queries: DataFrame, centroids: DataFrame, probes: int) -> DataFrame:
    """(query_id, cell, scale, base): the cells nearest to each query; ``base`` is the query's product with the centroid."""
    met = queries.select("query_id", F.col("unit").alias("q")).crossJoin(F.broadcast(centroids)).select("query_id", "cell", "scale", dot(F.col("q"), F.col("centroid")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("base"), "cell"))
    return met.withColumn("r", rank).where(F.col("r") <= probes).drop("r")


def _nearest_codes(id_col: str, most: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """The best ``most`` codes (cell, id, code) of some cells for each query (query_id, q, cells of cell, scale and base), of the cells it probes; ties by id."""
    left = pairs.sorted_by(left, id_col)
    codes, cell, queries = pairs.matrix(left.column("code")), left.column("cell").to_numpy(), pairs.matrix(right.column("q"))
    known = np.unique(cell)
    place = np.searchsorted(known, cell)
    found_q, found_i, found_n = [], [], []
    for q0 in range(0, len(queries) if len(codes) else 0, COLUMNS):
        some = right.slice(q0, COLUMNS)
        scale, base = np.zeros((len(some), len(known))), np.full((len(some), len(known)), -np.inf)
        for j, probed in enumerate(some.column("cells").to_pylist()):
            for x in probed:
                at = np.searchsorted(known, x["cell"])
                if at < len(known) and known[at] == x["cell"]:
                    scale[j, at], base[j, at] = x["scale"], x["base"]
        near = queries[q0 : q0 + COLUMNS] @ codes.T
        near = np.nan_to_num(base[:, place] + scale[:, place] * near, nan=-np.inf, neginf=-np.inf)
        bar = -np.partition(-near, most - 1, axis=1)[:, most - 1] if near.shape[1] > most else np.full(len(near), -np.inf)
        q, i = np.nonzero((near >= bar[:, None]) & np.isfinite(near))
        order = np.lexsort((i, -near[q, i], q))
        q, i = q[order], i[order]
        at = np.arange(len(q)) - np.searchsorted(q, np.arange(len(near)))[q] < most
        found_q.append(q[at] + q0), found_i.append(i[at]), found_n.append(near[q[at], i[at]])
    q, i, n = (np.concatenate(x) if x else np.empty(0, int) for x in (found_q, found_i, found_n))
    i = pa.array(i)
    return pa.table({"query_id": right.column("query_id").take(pa.array(q)), id_col: left.column(id_col).take(i), "cell": left.column("cell").take(i), "near": pa.array(n.astype(float))})


def search(index: Inverted, queries: DataFrame, k: int, probes: int | None = None, rescored: int = 4, keep: Column | None = None) -> DataFrame:
    """(query_id, similarity, rank and the columns of the rows): about the nearest ``k`` of each query (query_id, unit).

    ``probes`` cells are scored by their codes, and ``rescored`` times ``k`` of them by
    their vectors. Two thirds of the cells are probed if it isn't given: that is what
    vectors without clusters need for a recall of 0.9; where they cluster, a few cells do.
    ``keep`` is a condition on the columns of the rows.
    """
    spark, i = queries.sparkSession, index.id_col
    probes = probes or -(-2 * index.centroids.count() // 3)

    def block(q: DataFrame) -> DataFrame:
        probed = kept(_probed(q, index.centroids, probes), "probed")
        cells = [r[0] for r in probed.select("cell").distinct().collect()]  # at most MOST_CELLS
        some = lambda what: index.read(spark, what).where(F.col("cell").isin(cells))
        codes = some("codes").select("cell", i, "code")
        if keep is not None:
            codes = codes.join(some("whole").where(keep).select(i), i, "left_semi")
        # Cells are dealt into as many groups as hold about TOGETHER vectors; each passes on the best of a query
        groups = F.pmod(F.xxhash64("cell"), F.lit(max(1, -(-codes.count() // TOGETHER)))).alias("group")
        asked = probed.groupBy("query_id", groups).agg(F.collect_list(F.struct("cell", "scale", "base")).alias("cells")).join(q.select("query_id", F.col("unit").alias("q")), "query_id")
        schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, {i} {codes.schema[i].dataType.simpleString()}, cell int, near double"
        coded = codes.withColumn("group", groups).groupBy("group").cogroup(asked.groupBy("group")).applyInArrow(partial(_nearest_codes, i, k * rescored), schema)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), i))
        best = coded.withColumn("r", rank).where(F.col("r") <= k * rescored).select("query_id", i, "cell").join(q.select("query_id", F.col("unit").alias("q")), "query_id")
        met = best.join(some("whole").drop("rest"), ["cell", i]).withColumn("similarity", F.round(similarity(dot(F.col("unit"), F.col("q"))), 6)).drop("q", "unit", "cell")
        return vectors.ranked(met, i, k)

    n_blocks = max(1, -(-queries.count() // BLOCK))
    if n_blocks == 1:
        return block(queries)
    dealt = kept(queries.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))), "queries")
    out = None
    for at in range(n_blocks):
        found = kept(block(dealt.where(F.col("__block") == at).drop("__block")), "found")
        out = found if out is None else out.unionByName(found)
    return out


def recall(found: DataFrame, exact: DataFrame, id_col: str) -> DataFrame:
    """(query_id, recall): the share of the exact neighbours of each query that were found."""
    have = found.select("query_id", id_col, F.lit(1).alias("have"))
    return exact.select("query_id", id_col).join(have, ["query_id", id_col], "left").groupBy("query_id").agg((F.count("have") / F.count("*")).alias("recall"))
