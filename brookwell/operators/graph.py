"""An undirected property graph as two tables: nodes (entity_id, ...) and edges (src <= tgt, weight, ...)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.functions.vectors import path_score
from brookwell.operators.kept import kept


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, weight): each edge from either end; a loop once."""
    there = edges.select(F.col("src").alias("a"), F.col("tgt").alias("b"), "weight")
    return there.union(edges.where("src <> tgt").select("tgt", "src", "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(entity_id, degree) of nodes with an edge; ends are counted before they are shuffled."""
    return both_ways(edges).groupBy(F.col("a").alias("entity_id")).agg(F.count("*").alias("degree"))


def degrees_of(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of each asked id; 0 where it has none."""
    return ids.join(degrees(edges), "entity_id", "left").na.fill(0, ["degree"])


def edge_degrees(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    a = pairs.join(d.select(F.col("entity_id").alias("src"), F.col("degree").alias("da")), "src", "left")
    return a.join(d.select(F.col("entity_id").alias("tgt"), F.col("degree").alias("db")), "tgt", "left").select("src", "tgt", (F.coalesce("da", F.lit(0)) + F.coalesce("db", F.lit(0))).alias("degree"))


def edges_between(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The edge of each asked pair (a, b) in either direction; a missing weight is 1."""
    keyed = pairs.select("a", "b", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("tgt"))
    return keyed.join(edges, ["src", "tgt"]).select("a", "b", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def neighbours(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, neighbour, weight); ids without an edge keep a row of nulls."""
    return ids.join(both_ways(edges).select(F.col("a").alias("entity_id"), F.col("b").alias("neighbour"), "weight"), "entity_id", "left")


def steps(edges: DataFrame) -> DataFrame:
    """Written table (a, b, w, e) of the edges from either end with a number for each edge; a missing weight is 1. Trails read it at every hop."""
    numbered = kept(edges.select("src", "tgt", F.coalesce("weight", F.lit(1.0)).alias("w"), F.monotonically_increasing_id().alias("e")), "edges")
    there = numbered.select(F.col("src").alias("a"), F.col("tgt").alias("b"), "w", "e")
    return there.union(numbered.where("src <> tgt").select("tgt", "src", "w", "e"))


def trails(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, entity_id, hops, score): all trails of 1 to ``hops`` edges from each seed, no edge twice.

    Score is the product of the weights over the length. The trails grow with the
    degrees to the power of ``hops``, so it is at most 3; each step is one join.
    """
    if not 0 <= hops <= 3:
        raise ValueError("hops must be 0 to 3")
    step = steps(edges)
    now = seeds.select(F.col("entity_id").alias("seed"), F.col("entity_id").alias("at"), F.array().cast("array<bigint>").alias("used"), F.array().cast("array<double>").alias("ws"))
    out = None
    for k in range(1, hops + 1):
        now = now.join(step, (now["at"] == step.a) & ~F.array_contains("used", F.col("e"))).select("seed", F.col("b").alias("at"), F.array_append("used", F.col("e")).alias("used"), F.array_append("ws", F.col("w")).alias("ws"))
        rows = now.select("seed", F.col("at").alias("entity_id"), F.lit(k).cast("long").alias("hops"), path_score(F.col("ws")).alias("score"))
        out = rows if out is None else out.union(rows)
    return out if out is not None else now.select("seed", F.col("at").alias("entity_id"), F.lit(0).cast("long").alias("hops"), F.lit(0.0).alias("score")).limit(0)


def best_trails(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, hops, score) with the best score of the trails of one and of two edges from any seed.

    Of the trails that end in one edge at one node only the largest and the least
    product go on, so a hub passes on a row for each of its edges, not for each trail.
    """
    step = steps(edges)
    first = seeds.select(F.col("entity_id").alias("at")).distinct().join(step, F.col("at") == step.a).groupBy(F.col("b").alias("at"), F.col("e").alias("last")).agg(F.max("w").alias("high"), F.min("w").alias("low"))
    first = kept(first, "first")
    second = first.join(step, (first["at"] == step.a) & (F.col("last") != F.col("e"))).groupBy("b").agg(F.max(F.greatest(F.col("high") * F.col("w"), F.col("low") * F.col("w"))).alias("high"))
    one = first.groupBy(F.col("at").alias("entity_id")).agg(F.lit(1).cast("long").alias("hops"), F.max("high").alias("score"))
    return one.union(second.select("b", F.lit(2).cast("long"), F.col("high") / 2))


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 2, most: int = 30) -> DataFrame:
    """Best neighbours of a seed set: least hops and best trail score of each node that is no seed, the ``most`` best."""
    found = best_trails(seeds, edges) if hops == 2 else trails(seeds, edges, hops)
    found = found.join(seeds.select("entity_id"), "entity_id", "left_anti")
    return found.groupBy("entity_id").agg(F.min("hops").alias("hops"), F.round(F.max("score"), 4).alias("score")).orderBy(F.desc("score"), "entity_id").limit(most)


#: A node with more edges than this is a hub, whose edges are dealt into parts of about as many.
HUB = 10_000


def _ahead(edges: DataFrame, hops: int) -> DataFrame:
    """(a, b, w, ahead1, ahead2) of the edges from either end. For three hops it is a written table with the largest products, signs aside, of one and of two edges that lead on from ``b``; else those are null."""
    step = both_ways(edges).withColumnRenamed("weight", "w")
    none = F.lit(None).cast("double")
    if hops < 3:
        return step.select("a", "b", "w", none.alias("ahead1"), none.alias("ahead2"))
    size = F.abs("w")
    for k in (1, 2):
        onward = step.groupBy("a").agg(F.max(size).alias(f"ahead{k}")).withColumnRenamed("a", "b")
        step = kept(step.join(onward, "b"), "ahead")
        size = F.abs("w") * F.col("ahead1")
    return step.select("a", "b", "w", "ahead1", "ahead2")


def _at(front: DataFrame, step: DataFrame) -> DataFrame:
    """Edges at the nodes of ``front``."""
    return step.join(front.select(F.col("at").alias("a")).distinct(), "a", "left_semi")


def messages_over(front: DataFrame, step: DataFrame) -> DataFrame:
    """Rows of ``front`` (at, ...), best a written table, with the other columns of ``step`` (a, b, ...) of each edge at ``at``. Only edges at the front are read on; those of a hub are dealt into parts, to each of which its rows go."""
    step = _at(front, step)
    hubs = kept(step.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("a", F.ceil(F.col("n") / HUB).alias("parts")), "hubs")
    step = step.join(hubs, "a", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("b"), "parts")).otherwise(0)).drop("parts")
    dealt = front.join(hubs.withColumnRenamed("a", "hub"), F.col("at") == F.col("hub"), "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("hub", "parts")
    return dealt.join(step.withColumnRenamed("part", "edge_part"), (F.col("at") == F.col("a")) & (F.col("part") == F.col("edge_part"))).drop("a", "part", "edge_part")


def _onward(walked: DataFrame) -> DataFrame:
    """Steps that don't turn straight back."""
    return walked.where(F.col("came").isNull() | (F.col("b") != F.col("came")))


def _bars(scores: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """Written table (query_id, bar, bar_id): score and id of the ``most``-th best node of each set that has so many, seeds left out, by ``scores`` (query_id, entity_id, score) of some of its trails."""
    nodes = scores.groupBy("query_id", "entity_id").agg(F.round(F.max("score"), 4).alias("bar")).join(start, ["query_id", "entity_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bar"), "entity_id"))
    return kept(nodes.withColumn("r", rank).where(F.col("r") <= most).where(F.col("r") == most).select("query_id", "bar", F.col("entity_id").alias("bar_id")), "bars")


def _beam(front: DataFrame, step: DataFrame, hops: int, most: int) -> DataFrame:
    """(query_id, entity_id, score) of trails that go on over the ``most`` heaviest edges of a node, from the ``most`` ends of each set after which the largest products may follow."""
    size = F.greatest(F.abs("high"), F.abs("low"))
    now, by, seen = front.withColumn("p", size * F.greatest(F.col("ahead1") / 2, F.coalesce(F.col("ahead2") / 3, F.lit(0.0)))), "p", None
    for k in range(2, hops + 1):
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "at", "came"))
        now = kept(now.withColumn("r", best).where(F.col("r") <= most).select("query_id", "at", "came", "high"), "beam")
        heavy = _at(now, step).select("a", "b", "w").withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))).where(F.col("r") <= most)
        walked = _onward(now.join(heavy, F.col("at") == F.col("a"))).groupBy("query_id", F.col("at").alias("came"), F.col("b").alias("at")).agg(F.max(F.col("high") * F.col("w")).alias("high"))
        now, by = kept(walked, "walked"), "high"
        rows = now.select("query_id", F.col("at").alias("entity_id"), (F.col("high") / k).alias("score"))
        seen = rows if seen is None else seen.union(rows)
    return seen


def expand_sets(seeds: DataFrame, edges: DataFrame, hops: int = 2, most: int = 30) -> DataFrame:
    """(query_id, rank, entity_id, hops, score): for every seed set (query_id, entity_id) at once the ``most`` best nodes around it that are no seeds of it.

    The score of a node is the best of its trails of 1 to ``hops`` (at most 3) edges:
    the product of the weights over the length, rounded to four digits; ``hops`` is
    the least. Edges are one a pair, and loops are left out; then a trail of up to
    three edges is a walk that never turns straight back, so what a node passes on
    depends on its last edge only through where it came from. Of each (set, node) the
    two best and the two least products go on, from different nodes: the second
    stands in where the next node is the one that the first came from. The first
    edges give each set a bar, its ``most``-th best node so far: what ranks after that
    can't be among the results. Ends go on only where the largest weight of all may
    lead them to the bar; what they reach over heavy edges raises it, and after that
    only trails are shuffled that may end before it or, by the heaviest edges that
    follow, lead there. Tables that may be small by then are written, so that Spark
    knows it and leaves the edges where they are.
    """
    if not 0 <= hops <= 3:
        raise ValueError("hops must be 0 to 3")
    flat = kept(edges.where("src <> tgt").select("src", "tgt", F.coalesce("weight", F.lit(1.0)).alias("weight")), "edges")
    step, start = _ahead(flat, hops), kept(seeds.select("query_id", "entity_id").distinct(), "start")
    front = start.select("query_id", F.col("entity_id").alias("at"), F.lit(None).cast("string").alias("came"), F.lit(1.0).alias("high"), F.lit(1.0).alias("low"))
    high, low = F.greatest(F.col("high") * F.col("w"), F.col("low") * F.col("w")), F.least(F.col("high") * F.col("w"), F.col("low") * F.col("w"))
    bar, fronts, bars = F.col("bar"), [], None
    reached = start.select("query_id", "entity_id", F.lit(0).cast("long").alias("hops"), F.lit(0.0).alias("score")).limit(0)

    def may_end(score, node):
        return bar.isNull() | ((score >= bar - 1e-4) & (node <= F.col("bar_id"))) | (score > bar + 4e-5)

    def may_lead(k, high, low, ahead1=F.col("ahead1"), ahead2=F.col("ahead2")):
        size, near = F.greatest(F.abs(high), F.abs(low)) * (1 + 1e-9), bar - 1e-4
        far = size * ahead2 / (k + 2) >= near if k + 2 <= hops else F.lit(False)
        return bar.isNull() | (size * ahead1 / (k + 1) >= near) | far

    def barred(rows):
        return rows.join(bars, "query_id", "left")

    def ends(front, k):
        """The nodes of a front that may be among the results."""
        rows = front if bars is None else barred(front).where(may_end(F.col("high") / k, F.col("at")))
        return rows.select("query_id", F.col("at").alias("entity_id"), F.lit(k).cast("long").alias("hops"), (F.col("high") / k).alias("score"))

    for k in range(1, hops + 1):
        walked = _onward(messages_over(front, step))
        if k == hops and k > 1:
            last = kept(walked.where(may_end(high / k, F.col("b"))).groupBy("query_id", F.col("b").alias("entity_id")).agg(F.max(high).alias("high")), "last")
            reached = reached.union(last.select("query_id", "entity_id", F.lit(k).cast("long"), F.col("high") / k))
            break
        if k > 1:
            walked = walked.where(may_end(high / k, F.col("b")) | may_lead(k, high, low))
        # Dealt by set and node once, for the grouping and the two rankings
        walked = walked.select("query_id", F.col("b").alias("next"), F.col("at").alias("from"), high.alias("high"), low.alias("low"), "ahead1", "ahead2").repartition("query_id", "next")
        new = walked.groupBy("query_id", "next", "from").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max("ahead1").alias("ahead1"), F.max("ahead2").alias("ahead2"))
        by = Window.partitionBy("query_id", "next")
        best = new.withColumn("r", F.row_number().over(by.orderBy(F.desc("high"), "from"))).withColumn("s", F.row_number().over(by.orderBy("low", "from"))).where("r <= 2 OR s <= 2")
        front = kept(best.select("query_id", F.col("next").alias("at"), F.col("from").alias("came"), "high", "low", "ahead1", "ahead2"), "front")
        fronts.append(front)
        if k == 1 and hops > 1:
            bars = _bars(ends(front, 1), start, most)
            if hops == 2:
                largest = F.lit(flat.agg(F.max(F.abs("weight"))).first()[0]).cast("double")
                front = kept(barred(front).where(may_lead(1, F.col("high"), F.col("low"), largest)).drop("bar", "bar_id", "ahead1"), "open")
                front = front.join(_at(front, step).groupBy("a").agg(F.max(F.abs("w")).alias("ahead1")), F.col("at") == F.col("a")).drop("a")
            front = kept(barred(front).where(may_lead(1, F.col("high"), F.col("low"))).drop("bar", "bar_id"), "open")
            bars = _bars(ends(fronts[0], 1).select("query_id", "entity_id", "score").union(_beam(front, step, hops, most)), start, most)
        if k < hops:
            front = kept(barred(front).where(may_lead(k, F.col("high"), F.col("low"))).drop("ahead1", "ahead2"), "onward")
    for k, rows in enumerate(fronts, 1):
        reached = reached.union(ends(rows, k))
    found = reached.groupBy("query_id", "entity_id").agg(F.min("hops").alias("hops"), F.round(F.max("score"), 4).alias("score")).join(start, ["query_id", "entity_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id"))
    found = found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("query_id", "rank", "entity_id", "hops", "score")
    return found if hops < 2 else _nearer(kept(found, "found"), fronts[0], step, hops)


def _nearer(found: DataFrame, first: DataFrame, step: DataFrame, hops: int) -> DataFrame:
    """``found`` with one or two hops where it has more and a trail of so many that was left out leads to the node, too."""
    ends, key = first.select("query_id", "at"), ["query_id", "entity_id"]
    far = kept(found.where("hops > 1").select("query_id", "entity_id", F.col("entity_id").alias("at"), "hops"), "far")
    one = far.join(ends, ["query_id", "at"]).select(*key, F.lit(1).cast("long").alias("less"))
    if hops == 3:
        beside = messages_over(kept(far.where("hops = 3").drop("hops"), "far"), step.select("a", "b")).select(*key, F.col("b").alias("at"))
        one = one.union(beside.join(ends, ["query_id", "at"]).select(*key, F.lit(2).cast("long")))
    # Inner joins, as Spark broadcasts either side of them: there are few rows that may be nearer
    less = kept(one.groupBy(*key).agg(F.min("less").alias("less")), "nearer")
    return found.join(less, key, "left").select("query_id", "rank", "entity_id", F.least("less", "hops").alias("hops"), "score")


def reach(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(entity_id, hop) of all nodes within ``hops`` of the seeds, each at its least hop; seeds at 0."""
    step = both_ways(edges).select("a", "b")
    seen = seeds.select("entity_id", F.lit(0).cast("long").alias("hop"))
    front = seen
    for k in range(1, hops + 1):
        front = front.join(step, front.entity_id == step.a).select(F.col("b").alias("entity_id")).distinct().join(seen, "entity_id", "left_anti").withColumn("hop", F.lit(k).cast("long"))
        seen = seen.union(front)
    return seen


def neighbours_by_hop(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 2, most: int = 50, path: str | None = None) -> DataFrame:
    """(entity_id, hop, score) of up to ``most`` nodes around the seeds, nearest first, scored 1 / hop; ``path`` keeps those of one file in the result, but not on the way."""
    found = reach(seeds, edges, hops).where("hop > 0").join(nodes.select("entity_id", "file_path"), "entity_id")
    if path is not None:
        found = found.where(F.array_contains(F.split("file_path", "<SEP>"), path))
    return found.select("entity_id", "hop", F.try_divide(F.lit(1.0), F.col("hop")).alias("score")).orderBy("hop", "entity_id").limit(most)


def induced(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the ids."""
    return edges.join(ids.select(F.col("entity_id").alias("src")), "src", "left_semi").join(ids.select(F.col("entity_id").alias("tgt")), "tgt", "left_semi").select(*edges.columns)


def top_by_degree(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    return nodes.join(degrees(edges), "entity_id", "left").na.fill(0, ["degree"]).orderBy(F.desc("degree"), "entity_id").limit(most)


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges once the ``gone`` ids and all their edges are deleted."""
    left = edges.join(gone.select(F.col("entity_id").alias("src")), "src", "left_anti").join(gone.select(F.col("entity_id").alias("tgt")), "tgt", "left_anti")
    return nodes.join(gone, "entity_id", "left_anti"), left.select(*edges.columns)


def without_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges but those of the asked pairs (a, b), in either direction."""
    return edges.join(pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("tgt")).distinct(), ["src", "tgt"], "left_anti").select(*edges.columns)


def missing_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends of edges that are no nodes, as nodes of unknown type."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("entity_id")).distinct()
    return ends.join(nodes, "entity_id", "left_anti").withColumn("entity_type", F.lit("UNKNOWN"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("entity_id"))
    return nodes.join(ends, "entity_id", "left_anti")


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Property by property: a new value that is not null wins."""
    n = new.select(F.col("entity_id"), *(F.col(c).alias(f"__{c}") for c in new.columns if c != "entity_id"))
    met = nodes.join(n, "entity_id", "full_outer")
    columns = list(dict.fromkeys([*nodes.columns, *new.columns]))
    pick = lambda c: F.coalesce(*([F.col(f"__{c}")] if c in new.columns else []), *([F.col(c)] if c in nodes.columns else []))
    return met.select("entity_id", *(pick(c).alias(c) for c in columns if c != "entity_id"))


def upsert_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the new ones merged in; a new edge whose ends are not both nodes is ignored."""
    ids = nodes.select("entity_id")
    valid = new.join(ids, new.src == ids.entity_id, "left_semi").join(ids, new.tgt == ids.entity_id, "left_semi")
    keyed = valid.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), F.col("weight").alias("__weight"))
    return edges.join(keyed, ["src", "tgt"], "full_outer").select("src", "tgt", F.coalesce("__weight", "weight").alias("weight"))
