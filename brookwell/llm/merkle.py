"""Merkle dataset manifest, broadcast upper-tree variant.

1. Each row's leaf is the SHA-256 of its fields (``leaf_of``), in DataFrame functions.
2. Leaves are sorted over ranges of (group, order), so a group's leaves get their ranks
   from the counts of its pieces, however large it is; no text is moved.
3. Blocks of ``fanout ** levels`` neighbours of a group are reduced by tasks to one
   digest each. The driver builds the small trees above the blocks of groups that have
   more than one, and broadcasts those trees; a block's path from its digest to the
   subroot is its suffix path. ``levels`` grows with the rows, so the driver holds at
   most about ``MOST_BLOCKS`` digests of them.
4. The subroots, one row a group in the order of the groups, are reduced in the same way
   to the root. Their paths are rows, which are joined to the blocks by group.
5. Tasks finish the proofs: a row's siblings in its block, then the block's suffix path,
   then the path of its group, and fold each row's leaf along them.

Defined cases: each null field is ``-``; null groups are one group, which comes first;
null orders come first in their group; rows equal in group and order stand in the order
of their leaves; repeated rows are leaves of their own; a null id is never tampered with;
a group of one row has its leaf as subroot and one group its subroot as root, with an
empty proof if both hold; very long texts are hashed where they are read; an empty table
gives an empty one; other columns aren't looked at, whatever their names.
"""

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookwell.llm.work import written

FANOUT, LEAST_LEVELS, MOST_LEVELS = 16, 3, 5
MOST_BLOCKS = 50_000


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """SHA-256 of the fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    coded = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*coded), 256)


def tree(nodes: list[str], fanout: int) -> list[list[str]]:
    """The levels from the nodes up to their one root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def reduced(nodes: list[str], fanout: int, levels: int) -> list[list[str]]:
    """As ``tree`` for one block of a larger group: ``levels`` steps, also where one node alone is hashed."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([sha("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return out


def path(levels: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """For each level below the root, what stands left and right of the node in its run."""
    out = []
    for nodes in levels[:-1]:
        run = at - at % fanout
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + fanout])))
        at //= fanout
    return out


def ranked(leaves: DataFrame) -> DataFrame:
    """Written table of ``leaves`` (key, order, leaf, ...) with ``rank`` within its key and ``rows`` of the key, by a sort over ranges."""
    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = leaves.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(n, "key", "order", "leaf", "tie").sortWithinPartitions("key", "order", "leaf", "tie").drop("tie")
    at = F.monotonically_increasing_id()
    rows = written(rows.withColumn("at", at.bitwiseAND((1 << 33) - 1)).withColumn("part", F.shiftright(at, 33)), "sorted")
    pieces = rows.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # One row a range of a key at most
    by_key = Window.partitionBy("key")
    before = F.coalesce(F.sum("n").over(by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = written(pieces.select("key", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(by_key).alias("rows")), "pieces")
    return written(rows.join(pieces, ["key", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift"), "ranked")


def forest(leaves: DataFrame, fanout: int = FANOUT, levels: int | None = None) -> tuple[DataFrame, DataFrame, dict[str, list[list[str]]], int]:
    """(ranked leaves with their ``block``, written (key, root), the trees above the blocks of keys that have several, levels of a block)."""
    rows = ranked(leaves)
    total = rows.count()
    if levels is None:
        levels = next((k for k in range(LEAST_LEVELS, MOST_LEVELS) if total <= MOST_BLOCKS * fanout**k), MOST_LEVELS)
    size = fanout**levels
    rows = rows.withColumn("block", F.floor(F.col("rank") / size))

    def reduce_block(group: pa.Table) -> pa.Table:
        nodes = [x for _, x in sorted(zip(group["rank"].to_pylist(), group["leaf"].to_pylist(), strict=True))]
        whole = group["rows"][0].as_py() <= size
        digest = (tree(nodes, fanout) if whole else reduced(nodes, fanout, levels))[-1][0]
        return pa.table({"key": group["key"].slice(0, 1), "block": group["block"].slice(0, 1), "digest": pa.array([digest]), "whole": pa.array([whole])})

    blocks = written(rows.select("key", "block", "rank", "rows", "leaf").groupBy("key", "block").applyInArrow(reduce_block, "key string, block long, digest string, whole boolean"), "blocks")
    # At most total / size * 2 rows: only keys of more than one block
    above: dict[str, list[tuple[int, str]]] = {}
    for key, block, digest in blocks.where("NOT whole").select("key", "block", "digest").toLocalIterator():
        above.setdefault(key, []).append((block, digest))
    trees = {key: tree([d for _, d in sorted(found)], fanout) for key, found in above.items()}
    tops = rows.sparkSession.createDataFrame([(key, found[-1][0]) for key, found in trees.items()], "key string, root string")
    roots = written(blocks.where("whole").select("key", F.col("digest").alias("root")).union(tops), "roots")
    return rows, roots, trees, levels


def with_paths(rows: DataFrame, more: DataFrame, trees: dict[str, list[list[str]]], levels: int, fanout: int, finish: Callable[[pa.Table, dict, Iterator], pa.Table], schema: str) -> DataFrame:
    """Each block's table of ``rows`` with its key's row of ``more`` and each row's path, given to ``finish(table, row of more, paths)``."""
    top = rows.sparkSession.sparkContext.broadcast(trees)
    size = fanout**levels
    heads = rows.where(F.col("rank") % size == 0).select(F.col("key").alias("of"), F.col("block").alias("block_of")).join(more.withColumnRenamed("key", "of"), "of")

    def finish_block(head: pa.Table, group: pa.Table) -> pa.Table:
        order = sorted(range(group.num_rows), key=group["rank"].to_pylist().__getitem__)
        group = group.take(pa.array(order, pa.int64()))
        nodes, (key, block) = group["leaf"].to_pylist(), (group[c][0].as_py() for c in ("key", "block"))
        upper = top.value.get(key)
        own = tree(nodes, fanout) if upper is None else reduced(nodes, fanout, levels)
        suffix = [] if upper is None else path(upper, block, fanout)
        return finish(group, head.slice(0, 1).to_pylist()[0], ([*path(own, i, fanout), *suffix] for i in range(len(nodes))))

    return heads.groupBy("of", "block_of").cogroup(rows.groupBy("key", "block")).applyInArrow(finish_block, schema)


def fold(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in steps:
        leaf = sha(left + leaf + right)
    return leaf


def manifest(
    docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT, levels: int | None = None, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text"
) -> DataFrame:
    """One row per document: id, leaf, subroot, root, proof_sha256, folded_root, verified, source.

    ``tampered`` is the text found when the rows are checked (their own, if None); the
    folded root is of the leaf with that text. ``levels`` of a block follow the number of rows.
    """
    texts = lambda text: leaf_of(*(text if c == text_col else F.col(f"`{c}`") for c in fields))
    kind = docs.schema[id_col].dataType.simpleString()
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    leaves = docs.select(key.alias("key"), F.col(id_col).alias("order"), texts(F.col(text_col)).alias("leaf"), texts(F.col(text_col) if tampered is None else tampered).alias("found"))
    rows, subroots, trees, depth = forest(leaves, fanout, levels)

    # The groups, in their order, are the leaves of one more tree
    sources = subroots.select(F.lit("").alias("key"), F.col("key").alias("order"), F.col("root").alias("leaf"))
    groups, roots, upper, upper_depth = forest(sources, fanout, levels)
    steps = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def finish_source(group: pa.Table, head: dict, paths: Iterator) -> pa.Table:
        found = [[{"left": a, "right": b} for a, b in p] for p in paths]
        return pa.table({"key": group["order"], "subroot": group["leaf"], "root": pa.array([head["root"]] * len(found)), "steps": pa.array(found, steps)})

    more = written(with_paths(groups, roots, upper, upper_depth, fanout, finish_source, "key string, subroot string, root string, steps array<struct<left:string,right:string>>"), "sources")

    def finish_rows(group: pa.Table, head: dict, paths: Iterator) -> pa.Table:
        last = [(s["left"], s["right"]) for s in head["steps"]]
        proofs, folded = [], []
        for found, steps in zip(group["found"].to_pylist(), paths, strict=True):
            steps = [*steps, *last]
            proofs.append(sha("".join(a + b for a, b in steps)))
            folded.append(fold(found, steps))
        n, key = len(proofs), group["key"][0].as_py()
        root = head["root"]
        return pa.table({
            "id": group["order"], "leaf": group["leaf"], "subroot": pa.array([head["subroot"]] * n), "root": pa.array([root] * n), "proof_sha256": pa.array(proofs),
            "folded_root": pa.array(folded), "verified": pa.array([x == root for x in folded]), "source": pa.array([key[1:] if key else None] * n, pa.string()),
        })

    out = with_paths(rows, more, trees, depth, fanout, finish_rows, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source string")
    return out.withColumnRenamed("id", id_col)


def brute_force(rows: list[tuple], fanout: int = FANOUT) -> list[tuple]:
    """The same by one tree in memory, for rows (doc_id, source, lang, n_chars, text, tampered text): rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    code = lambda *values: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))
    leaves = [(s is not None, (s or "").encode(), d is not None, d or 0, code(d, s, lang, n, t), code(d, s, lang, n, f), d) for d, s, lang, n, t, f in rows]
    leaves.sort(key=lambda x: x[:5])

    def siblings(nodes: list[str], at: int) -> tuple[list[list[str]], list[int]]:
        out, places = [], []
        while len(nodes) > 1:
            run = nodes[at - at % fanout : at - at % fanout + fanout]
            places.append(at % fanout)
            out.append(run[: at % fanout] + run[at % fanout + 1 :])
            nodes, at = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)], at // fanout
        return out, places

    def top(nodes: list[str]) -> str:
        while len(nodes) > 1:
            nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        return nodes[0]

    names = sorted({x[:2] for x in leaves})
    of = {k: [x for x in leaves if x[:2] == k] for k in names}
    subroots = {k: top([x[4] for x in of[k]]) for k in names}
    out = []
    for at, k in enumerate(names):
        for i, x in enumerate(of[k]):
            (a, b), (c, d) = siblings([y[4] for y in of[k]], i), siblings([subroots[y] for y in names], at)
            folded = x[5]
            for others, place in zip(a + c, b + d, strict=True):
                folded = sha("".join(others[:place]) + folded + "".join(others[place:]))
            root = top([subroots[y] for y in names])
            out.append((x[6], x[4], subroots[k], root, sha("".join("".join(o) for o in a + c)), folded, folded == root))
    return out
