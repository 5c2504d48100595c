"""Graph operators over the supplier-part graph."""

from pyspark.sql import functions as F

from brookwell.functions.vectors import path_score
from brookwell.operators import graph
from brookwell.plans.base import EDGES, NODES, edges, nodes, query, table

BOTH = "two_way AS (SELECT src AS a, tgt AS b, weight FROM edges UNION ALL SELECT tgt, src, weight FROM edges WHERE src <> tgt)"
DEG = "deg AS (SELECT a AS entity_id, count(*) AS degree FROM two_way GROUP BY a)"
G = f"WITH {EDGES}, {NODES}, {BOTH}, {DEG}"
#: Asked ids: a stated set, one of them no node.
ASKED = ("s:1", "s:2", "p:5", "p:77", "p:none")
ASK = "ask AS (SELECT unnest(['s:1', 's:2', 'p:5', 'p:77', 'p:none']) AS entity_id)"
#: Asked pairs in both directions.
PAIRS = "SELECT tgt AS a, src AS b FROM edges WHERE src LIKE 'p:1%' UNION ALL SELECT src, tgt FROM edges WHERE src LIKE 'p:2%'"


def asked_ids(spark, ids=ASKED):
    return spark.createDataFrame([(i,) for i in ids], "entity_id string")


def asked_pairs(e):
    return e.where("src like 'p:1%'").select(F.col("tgt").alias("a"), F.col("src").alias("b")).union(e.where("src like 'p:2%'").select("src", "tgt"))


@query("a20_graph_nodes", f"{G} SELECT entity_id, entity_type, description, file_path FROM nodes")
def a20(spark, d):
    return nodes(spark, d)


@query("a21_graph_edges", f"{G} SELECT src, tgt, weight FROM edges")
def a21(spark, d):
    return edges(spark, d)


@query("c14_undirected_edge", f"{G} SELECT p.a, p.b, weight FROM ({PAIRS}) p JOIN edges ON src = least(p.a, p.b) AND tgt = greatest(p.a, p.b)")
def c14(spark, d):
    e = edges(spark, d)
    return graph.edges_between(asked_pairs(e), e)


@query("c15_edges_batch", f"{G} SELECT a || '->' || b AS pair, weight FROM ({PAIRS}) p JOIN edges ON src = least(p.a, p.b) AND tgt = greatest(p.a, p.b)")
def c15(spark, d):
    e = edges(spark, d)
    return graph.edges_between(asked_pairs(e), e).select(F.concat("a", F.lit("->"), "b").alias("pair"), "weight")


@query("c16_nodes_batch", f"{G}, {ASK} SELECT entity_id, entity_type FROM nodes JOIN ask USING (entity_id)")
def c16(spark, d):
    return nodes(spark, d).join(F.broadcast(asked_ids(spark)), "entity_id").select("entity_id", "entity_type")


@query("c17_node_edges", f"{G}, {ASK} SELECT entity_id, b AS neighbour, weight FROM ask LEFT JOIN two_way ON a = entity_id")
def c17(spark, d):
    return graph.neighbours(asked_ids(spark), edges(spark, d))


@query("c23_endpoint_check", f"{G}, few AS (SELECT * FROM nodes WHERE entity_id NOT LIKE 'p:1%') SELECT DISTINCT e AS entity_id, 'UNKNOWN' AS entity_type FROM (SELECT unnest([src, tgt]) AS e FROM edges) ANTI JOIN few ON e = entity_id")
def c23(spark, d):
    return graph.missing_ends(nodes(spark, d).where("entity_id not like 'p:1%'"), edges(spark, d))


@query("c10_anti_isolated", f"{G} SELECT entity_id FROM nodes ANTI JOIN (SELECT unnest([src, tgt]) AS entity_id FROM edges WHERE weight > 0.4) USING (entity_id)")
def c10(spark, d):
    return graph.isolated(nodes(spark, d), edges(spark, d).where("weight > 0.4")).select("entity_id")


#: Lines of the table for each part that distinct counts are dealt into.
PART_ROWS = 250_000


@query("d09_count_distinct", f"{G} SELECT entity_type, count(DISTINCT b) AS neighbours, count(DISTINCT least(a, b) || greatest(a, b)) AS relations FROM nodes JOIN two_way ON a = entity_id GROUP BY entity_type")
def d09(spark, d):
    """Every step is dealt into parts of about so many rows, by the lines that are counted, so a task holds as much of larger tables."""
    parts = max(1, -(-table(spark, d, "lineitem").count() // PART_ROWS))
    ends = graph.both_ways(edges(spark, d, parts)).repartition(2 * parts, "a")
    met = nodes(spark, d).repartition(2 * parts, "entity_id").join(ends, F.col("entity_id") == F.col("a"))
    counted = lambda what: met.select("entity_type", what.alias("what")).repartition(2 * parts, "entity_type", "what").distinct().groupBy("entity_type").agg(F.count("what").alias("n"))
    none = F.lit(0).cast("long")
    one = counted(F.col("b")).select("entity_type", F.col("n").alias("neighbours"), none.alias("relations"))
    two = counted(F.concat(F.least("a", "b"), F.greatest("a", "b"))).select("entity_type", none, "n")
    return one.union(two).groupBy("entity_type").agg(F.sum("neighbours").alias("neighbours"), F.sum("relations").alias("relations"))


@query("d10_degree", f"{G}, {ASK} SELECT entity_id, coalesce(degree, 0) AS degree FROM ask LEFT JOIN deg USING (entity_id)")
def d10(spark, d):
    return graph.degrees_of(asked_ids(spark), edges(spark, d))


@query("d11_edge_degree", f"{G} SELECT src, tgt, x.degree + y.degree AS degree FROM edges JOIN deg x ON x.entity_id = src JOIN deg y ON y.entity_id = tgt")
def d11(spark, d):
    e = edges(spark, d)
    return graph.edge_degrees(e.select("src", "tgt"), e)


@query("d05_type_counts", f"{G} SELECT coalesce(nullif(entity_type, 'supplier'), '<null>') AS entity_type, count(*) AS n FROM nodes GROUP BY 1")
def d05(spark, d):
    kind = F.coalesce(F.when(F.col("entity_type") != "supplier", F.col("entity_type")), F.lit("<null>"))
    return nodes(spark, d).groupBy(kind.alias("entity_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("f04_top_degree", f"{G} SELECT entity_id, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (entity_id) ORDER BY degree DESC NULLS LAST, entity_id LIMIT 300")
def f04(spark, d):
    return graph.top_by_degree(nodes(spark, d), edges(spark, d), 300).select("entity_id", "degree")


@query("f05_all_labels", f"{G} SELECT entity_id FROM nodes")
def f05(spark, d):
    return nodes(spark, d).select("entity_id").orderBy("entity_id")


@query("b13_contains", f"{G} SELECT entity_id FROM nodes WHERE contains(description, 'ar') ORDER BY entity_id LIMIT 50")
def b13(spark, d):
    return nodes(spark, d).where(F.contains("description", F.lit("ar"))).select("entity_id").orderBy("entity_id").limit(50)


@query("b12_graph_member", f"{G} SELECT entity_id FROM nodes WHERE list_contains(string_split(file_path || '<SEP>other', '<SEP>'), 'nation3')")
def b12(spark, d):
    return nodes(spark, d).where(F.exists(F.split(F.concat("file_path", F.lit("<SEP>other")), "<SEP>"), lambda x: x == "nation3")).select("entity_id")


@query("b25_null_type", f"{G} SELECT entity_id FROM nodes WHERE nullif(entity_type, 'supplier') IS NULL")
def b25(spark, d):
    return nodes(spark, d).withColumn("entity_type", F.when(F.col("entity_type") != "supplier", F.col("entity_type"))).where(F.col("entity_type").isNull()).select("entity_id")


@query("b26_bad_weight", f"{G} SELECT src, tgt FROM edges WHERE weight IS NULL OR weight - 0.5 = 0")
def b26(spark, d):
    return edges(spark, d).withColumn("weight", F.col("weight") - 0.5).where(F.col("weight").isNull() | (F.col("weight") == 0)).select("src", "tgt")


TRAILS = """t1 AS (SELECT entity_id AS seed, b AS entity_id, 1 AS hops, weight AS p1, least(a, b) || '|' || greatest(a, b) AS e1 FROM seed JOIN two_way ON a = entity_id),
t2 AS (SELECT seed, b AS entity_id, 2 AS hops, p1 * weight / 2 AS score FROM t1 JOIN two_way ON a = t1.entity_id WHERE least(a, b) || '|' || greatest(a, b) <> e1),
t AS (SELECT seed, entity_id, hops, p1 AS score FROM t1 UNION ALL SELECT * FROM t2)"""
SEED = "seed AS (SELECT unnest(['s:1', 'p:5']) AS entity_id)"


@query("d25_path_agg", f"{G}, {SEED}, {TRAILS} SELECT seed, entity_id, CAST(min(hops) AS BIGINT) AS hops, round(max(score), 6) AS score FROM t GROUP BY seed, entity_id")
def d25(spark, d):
    found = graph.trails(asked_ids(spark, ("s:1", "p:5")), edges(spark, d), 2)
    return found.groupBy("seed", "entity_id").agg(F.min("hops").alias("hops"), F.round(F.max("score"), 6).alias("score"))


@query("c25_path_join", f"{G}, {SEED}, {TRAILS} SELECT seed, hops::BIGINT AS hops, count(*) AS trails, round(sum(score) + 1e-6, 3) AS total FROM t GROUP BY seed, hops")
def c25(spark, d):
    return graph.trails(asked_ids(spark, ("s:1", "p:5")), edges(spark, d), 2).groupBy("seed", "hops").agg(F.count("*").alias("trails"), F.round(F.sum("score") + 1e-6, 3).alias("total"))


@query("j03_path_score", "SELECT o_orderkey, round(list_product(list_transform(ws, lambda x: coalesce(x, 1.0))) / len(ws) + 1e-9, 6) AS score FROM (SELECT l_orderkey AS o_orderkey, list(CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity / 10 END ORDER BY l_linenumber) AS ws FROM lineitem GROUP BY l_orderkey)")
def j03(spark, d):
    weight = F.when(F.col("l_quantity") > 40, F.lit(None)).otherwise(F.col("l_quantity") / 10)
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", weight.alias("w")))).alias("s"))
    return per.select("o_orderkey", F.round(path_score(F.col("s.w")) + 1e-9, 6).alias("score"))


@query("j04_hop_score", f"{G}, {SEED}, h1 AS (SELECT DISTINCT b AS entity_id FROM seed JOIN two_way ON a = entity_id ANTI JOIN seed s ON s.entity_id = b) SELECT entity_id, 1.0::DOUBLE AS score FROM h1")
def j04(spark, d):
    return graph.reach(asked_ids(spark, ("s:1", "p:5")), edges(spark, d), 1).where("hop > 0").select("entity_id", F.try_divide(F.lit(1.0), F.col("hop")).alias("score"))


REACH = "h1 AS (SELECT DISTINCT b AS entity_id FROM seed JOIN two_way ON a = seed.entity_id ANTI JOIN seed s ON s.entity_id = b), h2 AS (SELECT DISTINCT b AS entity_id FROM h1 JOIN two_way ON a = h1.entity_id ANTI JOIN seed s ON s.entity_id = b ANTI JOIN h1 x ON x.entity_id = b)"


@query("l20_bfs_fallback", f"{G}, {SEED}, {REACH} SELECT entity_id, hop, score FROM (SELECT entity_id, 1::BIGINT AS hop, 1.0::DOUBLE AS score FROM h1 UNION ALL SELECT entity_id, 2, 0.5 FROM h2) JOIN nodes USING (entity_id) WHERE list_contains(string_split(file_path, '<SEP>'), 'Brand#12') OR list_contains(string_split(file_path, '<SEP>'), 'nation3') ORDER BY hop, entity_id LIMIT 50")
def l20(spark, d):
    """Neighbours by hop, of one file; the other files' nodes are passed on the way."""
    seen, e = nodes(spark, d), edges(spark, d)
    tagged = seen.withColumn("file_path", F.when(F.col("file_path").isin("Brand#12", "nation3"), F.concat("file_path", F.lit("<SEP>asked"))).otherwise(F.col("file_path")))
    return graph.neighbours_by_hop(asked_ids(spark, ("s:1", "p:5")), tagged, e, 2, 50, "asked")


@query("l22_subgraph_bfs", f"{G}, {SEED}, {REACH}, near AS (SELECT entity_id FROM seed UNION ALL SELECT entity_id FROM h1) SELECT src, tgt, weight FROM edges WHERE src IN (SELECT entity_id FROM near) AND tgt IN (SELECT entity_id FROM near)")
def l22(spark, d):
    e = edges(spark, d)
    return graph.induced(graph.reach(asked_ids(spark, ("s:1", "p:5")), e, 1).select("entity_id"), e)


@query("l21_subgraph_all", f"{G}, top AS (SELECT entity_id FROM nodes LEFT JOIN deg USING (entity_id) ORDER BY coalesce(degree, 0) DESC, entity_id LIMIT 200) SELECT src, tgt, weight FROM edges WHERE src IN (SELECT entity_id FROM top) AND tgt IN (SELECT entity_id FROM top)")
def l21(spark, d):
    e = edges(spark, d)
    return graph.induced(graph.top_by_degree(nodes(spark, d), e, 200).select("entity_id"), e)


@query("a26_node_upsert", f"{G}, new AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'p:' ELSE 'x:' END || p_partkey AS entity_id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'new ' || p_type END AS entity_type FROM part) SELECT entity_id, coalesce(new.entity_type, nodes.entity_type) AS entity_type, description, file_path FROM nodes FULL JOIN new USING (entity_id)")
def a26(spark, d):
    k = F.col("p_partkey")
    new = table(spark, d, "part").select(F.concat(F.when(k % 2 == 0, "p:").otherwise("x:"), k).alias("entity_id"), F.when(k % 3 != 0, F.concat(F.lit("new "), "p_type")).alias("entity_type"))
    return graph.upsert_nodes(nodes(spark, d), new)


NEW_EDGES = "new AS (SELECT 's:' || s_suppkey AS src, 'p:' || (s_suppkey * 3) AS tgt, 9.5 AS weight FROM supplier UNION ALL SELECT 'p:1', 'nowhere', 1.0)"


@query("a27_edge_upsert", f"{G}, {NEW_EDGES}, ok AS (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, CAST(weight AS DOUBLE) AS w FROM new SEMI JOIN nodes a ON a.entity_id = src SEMI JOIN nodes b ON b.entity_id = tgt) SELECT src, tgt, coalesce(w, weight) AS weight FROM edges FULL JOIN ok USING (src, tgt)")
def a27(spark, d):
    s = F.col("s_suppkey")
    new = table(spark, d, "supplier").select(F.concat(F.lit("s:"), s).alias("src"), F.concat(F.lit("p:"), s * 3).alias("tgt"), F.lit(9.5).alias("weight"))
    lost = spark.createDataFrame([("p:1", "nowhere", 1.0)], "src string, tgt string, weight double")
    return graph.upsert_edges(nodes(spark, d), edges(spark, d), new.union(lost))


@query("o14_graph_delete", f"{G}, {ASK} SELECT src, tgt, weight FROM edges WHERE src NOT IN (SELECT entity_id FROM ask) AND tgt NOT IN (SELECT entity_id FROM ask)")
def o14(spark, d):
    return graph.without_nodes(nodes(spark, d), edges(spark, d), asked_ids(spark))[1]


@query("o14_edge_delete", f"{G} SELECT src, tgt, weight FROM edges WHERE src NOT LIKE 'p:1%' AND src NOT LIKE 'p:2%'")
def o14_edges(spark, d):
    e = edges(spark, d)
    return graph.without_edges(e, asked_pairs(e))


@query("p03_has_node", f"{G}, {ASK} SELECT entity_id, entity_id IN (SELECT entity_id FROM nodes) AS found FROM ask")
def p03(spark, d):
    have = nodes(spark, d).select("entity_id", F.lit(True).alias("found"))
    return asked_ids(spark).join(have, "entity_id", "left").na.fill({"found": False})
