"""Trees as tables of nodes with a parent and a place among its siblings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.operators.kept import kept


def preorder(nodes: DataFrame, tree: str, node: str, parent: str, pos: str, most_depth: int = 20) -> DataFrame:
    """``nodes`` with depth (1 below the root, which is not a row), has_children and node_id: ``n_0001`` and so on in pre-order within a tree.

    One join a level gives each node its path of places. A tree is one map and so of
    bounded size; its nodes are numbered together. Nodes deeper than ``most_depth`` raise.
    """
    nodes = kept(nodes, "nodes")
    level = kept(nodes.where(F.col(parent).isNull()).withColumn("__path", F.array(F.col(pos).cast("long"))), "level")
    found = level
    for _ in range(most_depth):
        above = level.select(F.col(tree).alias("__tree"), F.col(node).alias("__above"), F.col("__path").alias("__upto"))
        below = nodes.join(above, F.col(tree).eqNullSafe(F.col("__tree")) & (F.col(parent) == F.col("__above")))
        level = kept(below.select(*nodes.columns, F.concat("__upto", F.array(F.col(pos).cast("long"))).alias("__path")), "level")
        if level.isEmpty():
            break
        found = found.union(level)
    else:
        raise ValueError(f"a tree is deeper than {most_depth}")
    parents = nodes.where(F.col(parent).isNotNull()).select(F.col(tree).alias("__tree"), F.col(parent).alias("__above")).distinct()
    met = found.join(parents, F.col(tree).eqNullSafe(F.col("__tree")) & (F.col(node) == F.col("__above")), "left")
    number = F.row_number().over(Window.partitionBy(tree).orderBy("__path"))
    return met.select(*nodes.columns, F.size("__path").cast("long").alias("depth"), F.col("__above").isNotNull().alias("has_children"), F.format_string("n_%04d", number).alias("node_id"))
