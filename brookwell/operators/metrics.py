"""Measures of ranked lists against what is relevant."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_lists(lists: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, hit, reciprocal_rank, precision) from (query_id, rank from 1, relevant).

    A hit is a relevant row among the first ``k``, precision their share of ``k`` (short
    lists count as padded), the reciprocal rank that of the first relevant row of the
    whole list, 0 without one; null relevance is none.
    """
    relevant = F.coalesce("relevant", F.lit(False))
    first = F.min(F.when(relevant, F.col("rank")))
    in_k = F.count_if(relevant & (F.col("rank") <= k))
    return lists.groupBy("query_id").agg((in_k > 0).cast("int").alias("hit"), F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal_rank"), (in_k / k).alias("precision"))


def averaged(measures: DataFrame, *by: str) -> DataFrame:
    """Hit rate, mean reciprocal rank and precision of each group of queries."""
    return measures.groupBy(*by).agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 6).alias(n) for c, n in (("hit", "hit_rate"), ("reciprocal_rank", "mrr"), ("precision", "precision"))))
