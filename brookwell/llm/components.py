"""Connected components of an edge table, by alternating star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookwell.llm.work import attach, drop, written


def _toward_least(edges: DataFrame, n_edges: int, larger_only: bool) -> DataFrame:
    """Hang neighbours on the least member of each closed neighbourhood; a written table.

    With ``larger_only`` each node hands its least member to its larger
    neighbours (large star), otherwise to its smaller ones and itself (small star).
    The edges of a star's centre stay spread: its least member comes to them by broadcast.
    """
    if larger_only:
        edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")), "least")
    met = attach(edges, least, ["a"], "n", 2 * n_edges)
    if larger_only:
        out = written(met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct(), "edges")
    else:
        out = written(met.select("b", "m").union(met.select("a", "m")).toDF("a", "b").where("a > b").distinct(), "edges")
    drop(least)
    return out


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component.

    ``edges`` has two columns of one orderable type. Self-loops and null ends are
    dropped, repeats and directions don't matter, an empty table gives an empty one.
    Each round is written to the shared folder; it ends when every node hangs on one
    node that hangs on none.
    Raises if ``most_rounds`` (more than any 2**30-node graph needs) don't suffice.
    """
    a, b = edges.columns
    now = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(now.select("b", F.lit(0), F.lit(1)))
        loose = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs + holds > 1 AND hangs > 0")
        if loose.isEmpty():
            return now.toDF("node", "root").union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        n = now.count()
        large = _toward_least(now, n, True)
        new = _toward_least(large, n, False)
        drop(now, large)
        now = new
    raise RuntimeError(f"components are not found after {most_rounds} rounds")
