"""Nearest neighbours over vector tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.functions.vectors import cosine, unit
from brookwell.operators import pairs

#: Queries of a cell at most.
MOST_BROADCAST_QUERIES = pairs.SEARCHED[1]
THRESHOLD = 0.2


def prepared(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """With ``unit`` vectors, so that scoring needs one dot product."""
    return vectors.withColumn("unit", unit(F.col(vector)))


def _keyed(rows: DataFrame, id_col: str, name: str, vector: str) -> DataFrame:
    return rows.select(F.col(id_col).alias(name), F.col(vector).alias("v"), F.lit(1.0).alias("n"))


def with_columns(found: DataFrame, rows: DataFrame, id_col: str, *but: str) -> DataFrame:
    """``found`` (query_id, id, ...) with the columns of ``rows`` but some; only what was found meets them, and nothing does where there are none."""
    found = found.withColumnRenamed("id", id_col)
    rest = rows.drop(*but)
    return found.join(rest, id_col).select("query_id", *rest.columns, *(c for c in found.columns if c not in ("query_id", id_col))) if len(rest.columns) > 1 else found


def scored(vectors: DataFrame, queries: DataFrame, id_col: str, keep: Column | None = None, least: float | None = None) -> DataFrame:
    """(query_id, id, similarity): every vector against every query of a stated set, as 1 - d / 2; with ``least``, those that reach it."""
    if keep is not None:
        vectors = vectors.where(keep)
    found = pairs.every(_keyed(vectors, id_col, "id", "unit"), _keyed(queries, "query_id", "query_id", "unit"), pairs.COSINE, least)
    return found.select("query_id", F.col("id").alias(id_col), F.col("score").alias("similarity"))


def ranked(scores: DataFrame, id_col: str, at_most: int) -> DataFrame:
    """The ``at_most`` best of each query with their rank from 1; ties by id. A query's rows are cut down before they meet."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= at_most).withColumn("rank", F.col("rank").cast("long"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, threshold: float = THRESHOLD, keep: Column | None = None) -> DataFrame:
    """Nearest ``k`` of the rows that ``keep`` admits, then those at the threshold or above. Ids are unique; the other columns join what was found."""
    if keep is not None:
        vectors = vectors.where(keep)
    met = pairs.best(_keyed(vectors, id_col, "id", "unit"), _keyed(queries, "query_id", "query_id", "unit"), pairs.COSINE, k, threshold, MOST_BROADCAST_QUERIES)
    found = ranked(met.withColumnRenamed("score", "similarity"), "id", k).where(F.col("similarity") >= threshold)
    return with_columns(found, vectors, id_col, "unit")


def top_k_member(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, member: Column, threshold: float = THRESHOLD) -> DataFrame:
    """For filters that the index can't take: of the nearest 4k those at the threshold and of ``member``, at most k of them. May return fewer than k."""
    found = top_k(vectors, queries, 4 * k, id_col, threshold).where(member).drop("rank")
    return ranked(found, id_col, k)


def by_distance(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str = "embedding") -> DataFrame:
    """Nearest ``k`` by squared Euclidean distance, without a threshold. Ids are unique; the other columns join what was found."""
    met = pairs.best(_keyed(vectors, id_col, "id", vector), _keyed(queries, "query_id", "query_id", vector), pairs.DISTANCE, k, None, MOST_BROADCAST_QUERIES).withColumnRenamed("score", "distance")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    found = met.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return with_columns(found, vectors, id_col, vector, "unit")


def pair_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("cosine", F.round(cosine(F.col(a), F.col(b)), 6))
