"""Joins, aggregations, windows and top-k over members, threads, messages, quizzes and trees."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.operators import store
from brookwell.plans.base import MESSAGES, messages, query, table
from brookwell.plans.store_queries import KV, STATUS, kv, status


@query("c01_inner_member", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3")
def c01(spark, d):
    mine = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, d, "orders").join(mine, "o_custkey").select("o_orderkey", "c_name")


@query("c02_inner_attempt", "SELECT o_orderkey, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3 ORDER BY o_orderdate DESC, o_orderkey LIMIT 3")
def c02(spark, d):
    mine = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(mine, "o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(3).select("o_orderkey", "o_orderdate")


@query("c03_inner_mentions", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def c03(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query("c04_m2n", "SELECT l_suppkey, count(DISTINCT l_partkey) AS rooms, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey")
def c04(spark, d):
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    met = pairs.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return met.groupBy("l_suppkey").agg(F.count("*").alias("rooms"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


@query("c05_chain_lookup", "SELECT l_orderkey, l_linenumber, n_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def c05(spark, d):
    nations = table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customers = table(spark, d, "customer").join(nations, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "n_name")
    orders = table(spark, d, "orders").join(customers, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "n_name")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(orders, "l_orderkey").select("l_orderkey", "l_linenumber", "n_name")


@query("c06_left_outer", "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def c06(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderstatus")


@query("c07_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def c07(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("c08_anti_notin", "SELECT c_custkey FROM customer WHERE c_nationkey < 5 AND c_custkey <> 7 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def c08(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderpriority")
    people = table(spark, d, "customer").where("c_nationkey < 5 AND c_custkey <> 7").select("c_custkey")
    return store.without(store.without(people, orders.where("o_orderstatus = 'P'"), "c_custkey"), orders.where("o_orderpriority = '1-URGENT'"), "c_custkey")


@query("c09_anti_keys", f"WITH {KV} SELECT DISTINCT k AS key FROM (SELECT 'c:' || (o_custkey * 2) AS k FROM orders) WHERE k NOT IN (SELECT key FROM kv)")
def c09(spark, d):
    return store.new_keys(table(spark, d, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey") * 2).alias("key")), kv(spark, d), "key")


@query("c11_self_reply", f"WITH {MESSAGES} SELECT m.thread, m.seq, r.role AS reply_to_role FROM messages m LEFT JOIN messages r ON r.thread = m.thread AND r.seq = m.seq - 1")
def c11(spark, d):
    m = messages(spark, d)
    replied = m.select("thread", (F.col("seq") + 1).alias("seq"), F.col("role").alias("reply_to_role"))
    return m.join(replied, ["thread", "seq"], "left").select("thread", "seq", "reply_to_role")


@query("c12_nested_load", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations, sum(s)::BIGINT AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey GROUP BY r_name")
def c12(spark, d):
    suppliers = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    nations = table(spark, d, "nation").join(suppliers, "n_nationkey", "left")
    joined = table(spark, d, "region").join(nations, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"), F.sum("s").alias("suppliers"))


ANSWERS = "SELECT d.doc_id, d.doc_id % 20 AS quiz, quality, CASE WHEN quality IS NOT NULL AND doc_id % 3 <> 0 THEN n_chars % 2 END AS answer FROM documents d LEFT JOIN labels USING (doc_id)"


def answered(spark, d):
    """Questions (doc_id) of quizzes with the right answer (quality) and the given one; either may be missing."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 20).alias("quiz"), "n_chars")
    met = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return met.select("doc_id", "quiz", "quality", F.when(F.col("quality").isNotNull() & (F.col("doc_id") % 3 != 0), F.col("n_chars") % 2).alias("answer"))


@query("c13_review_join", f"SELECT doc_id, coalesce(quality = answer, false) AS correct FROM ({ANSWERS})")
def c13(spark, d):
    return answered(spark, d).select("doc_id", F.coalesce(F.col("quality") == F.col("answer"), F.lit(False)).alias("correct"))


@query("d22_grade", f"SELECT quiz, count(quality) AS total, count(CASE WHEN quality = answer THEN 1 END) AS correct, round(coalesce(count(CASE WHEN quality = answer THEN 1 END) / nullif(count(quality), 0)::DOUBLE, 0), 6) AS score FROM ({ANSWERS}) GROUP BY quiz")
def d22(spark, d):
    right = F.count_if(F.col("quality") == F.col("answer"))
    graded = answered(spark, d).groupBy("quiz").agg(F.count("quality").alias("total"), right.alias("correct"))
    return graded.withColumn("score", F.round(F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)), 6))


@query("p19_unanswered", f"SELECT doc_id FROM ({ANSWERS}) WHERE quality IS NOT NULL AND answer IS NULL")
def p19(spark, d):
    rows = answered(spark, d).where("quality IS NOT NULL")
    return store.without(rows.select("doc_id"), rows.where("answer IS NOT NULL"), "doc_id")


@query("c21_page_band", "SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) - length(text) AS BIGINT) AS around FROM conversations")
def c21(spark, d):
    near = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-2, 2)
    return table(spark, d, "conversations").select("conv_id", "turn", (F.sum(F.length("text")).over(near) - F.length("text")).alias("around"))


@query("c22_slide_join", "SELECT p_partkey, s AS first_supplier FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey")
def c22(spark, d):
    first = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("first_supplier"))
    return table(spark, d, "part").select("p_partkey").join(first, "p_partkey", "left")


@query("c26_mismatch", f"WITH {STATUS} SELECT doc_id FROM status LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON l_orderkey = doc_id WHERE status = 'processed' AND coalesce(n, 0) = 0")
def c26(spark, d):
    nodes = table(spark, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n"))
    return status(spark, d).where("status = 'processed'").join(nodes, "doc_id", "left").where(F.coalesce("n", F.lit(0)) == 0).select("doc_id")


@query("d01_count", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def d01(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("d02_cond_count", "SELECT conv_id, count(*) AS total, count(CASE WHEN role = 'user' THEN 1 END) AS user_messages, count(*) - count(CASE WHEN role = 'user' THEN 1 END) AS assistant_messages FROM conversations GROUP BY conv_id")
def d02(spark, d):
    n, users = F.count("*"), F.count_if(F.col("role") == "user")
    return table(spark, d, "conversations").groupBy("conv_id").agg(n.alias("total"), users.alias("user_messages"), (n - users).alias("assistant_messages"))


@query("d03_status_counts", f"WITH {STATUS} SELECT status, count(*) AS n FROM status GROUP BY status")
def d03(spark, d):
    return status(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("d04_box_counts", "SELECT box, count(*) AS n FROM (SELECT user_id, 1 + max(event_id) % 5 AS box FROM events GROUP BY user_id) GROUP BY box")
def d04(spark, d):
    boxes = table(spark, d, "events").groupBy("user_id").agg((1 + F.max("event_id") % 5).alias("box"))
    return boxes.groupBy("box").agg(F.count("*").alias("n"))


@query("p18_box_total", "SELECT count(DISTINCT user_id) AS cards FROM events")
def p18(spark, d):
    return d04(spark, d).agg(F.sum("n").alias("cards"))


@query("d06_ws_status", f"WITH {STATUS} SELECT 'w' || doc_id % 7 AS workspace, status, count(*) AS n FROM status GROUP BY 1, 2")
def d06(spark, d):
    return status(spark, d).groupBy(F.concat(F.lit("w"), F.col("doc_id") % 7).alias("workspace"), "status").agg(F.count("*").alias("n")).orderBy("workspace", "status")


UNREAD = "SELECT thread, greatest(0, coalesce(max(CASE WHEN NOT is_discarded THEN seq END), 0) - thread % 4) AS unread FROM messages GROUP BY thread"


def unread(spark, d):
    read = F.col("thread") % 4
    return messages(spark, d).groupBy("thread").agg(F.coalesce(F.max(F.when(~F.col("is_discarded"), F.col("seq"))), F.lit(0)).alias("seq")).select("thread", F.greatest(F.lit(0), F.col("seq") - read).cast("long").alias("unread"))


@query("d07_max_seq", f"WITH {MESSAGES} {UNREAD}")
def d07(spark, d):
    return unread(spark, d)


@query("p17_unread_header", f"WITH {MESSAGES} SELECT * FROM ({UNREAD}) WHERE unread > 0")
def p17(spark, d):
    return unread(spark, d).where("unread > 0")


@query("d08_next_seq", f"WITH {MESSAGES} SELECT thread, coalesce(max(seq), 0) + 1 AS next_seq FROM messages GROUP BY thread")
def d08(spark, d):
    return messages(spark, d).groupBy("thread").agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


EVAL = r"SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'factual' WHEN 1 THEN 'reasoning' END AS category, length(text) / 1000.0 AS score, len(regexp_extract_all(text, '\S+')) AS tokens FROM benchmark"


def evaluated(spark, d):
    from brookwell.functions.text import word_count

    k = F.col("item_id") % 3
    return table(spark, d, "benchmark").select("item_id", F.when(k == 0, "factual").when(k == 1, "reasoning").alias("category"), (F.length("text") / 1000).alias("score"), word_count(F.col("text")).alias("tokens"))


@query("d16_avg_metrics", f"SELECT round(coalesce(avg(score), 0), 4) AS score, round(coalesce(avg(tokens), 0), 3) AS tokens FROM ({EVAL})")
def d16(spark, d):
    mean = lambda c, n: F.round(F.coalesce(F.avg(c), F.lit(0.0)), n).alias(c)
    return evaluated(spark, d).agg(mean("score", 4), mean("tokens", 3))


@query("d17_by_category", f"SELECT coalesce(category, 'unknown') AS category, count(*) AS n, round(avg(score), 4) AS score FROM ({EVAL}) GROUP BY 1")
def d17(spark, d):
    return evaluated(spark, d).groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("score"))


@query("d18_token_cost", f"SELECT sum(tokens)::BIGINT AS output_tokens, (sum(tokens) * 10)::BIGINT AS input_tokens, round(sum(round(tokens * 15 / 1e6 + tokens * 10 * 5 / 1e6, 6)), 4) AS cost FROM ({EVAL})")
def d18(spark, d):
    from brookwell.functions.scores import answer_cost

    return evaluated(spark, d).agg(F.sum("tokens").alias("output_tokens"), (F.sum("tokens") * 10).alias("input_tokens"), F.round(F.sum(answer_cost(F.col("tokens"))), 4).alias("cost"))


@query("l39_compare", f"SELECT coalesce(a.category, b.category) AS category, coalesce(CAST(a.n AS VARCHAR), 'N/A') AS ours, coalesce(CAST(b.n AS VARCHAR), 'N/A') AS theirs FROM (SELECT category, count(*) AS n FROM ({EVAL}) WHERE category IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT category, count(*) AS n FROM (SELECT CASE item_id % 3 WHEN 0 THEN 'factual' WHEN 2 THEN 'application' END AS category FROM benchmark) WHERE category IS NOT NULL GROUP BY 1) b ON a.category = b.category")
def l39(spark, d):
    k = F.col("item_id") % 3
    one = evaluated(spark, d).where("category IS NOT NULL").groupBy("category").agg(F.count("*").cast("string").alias("ours"))
    other = evaluated(spark, d).withColumn("category", F.when(k == 0, "factual").when(k == 2, "application")).where("category IS NOT NULL").groupBy("category").agg(F.count("*").cast("string").alias("theirs"))
    return one.join(other, "category", "full_outer").na.fill("N/A", ["ours", "theirs"])


@query("d19_type_counter", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def d19(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("d21_source_conf", "SELECT o_custkey, CASE WHEN count(*) >= 3 THEN 'high' WHEN count(*) >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM orders GROUP BY o_custkey")
def d21(spark, d):
    n = F.count("*")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.when(n >= 3, "high").when(n >= 1, "medium").otherwise("low").alias("confidence"))


TREE = "tree AS (SELECT 'root' AS id, NULL AS parent UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"
BELOW = f"WITH RECURSIVE {TREE}, below AS (SELECT id AS top, id FROM tree UNION ALL SELECT top, tree.id FROM below JOIN tree ON parent = below.id)"


def tree(spark, d):
    """(id, parent) of region, nation and customer under one root."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    root = spark.createDataFrame([("root", None)], "id string, parent string")
    regions = table(spark, d, "region").select(name("r", "r_regionkey").alias("id"), F.lit("root").alias("parent"))
    nations = table(spark, d, "nation").select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent"))
    return root.union(regions).union(nations).union(table(spark, d, "customer").select(name("c", "c_custkey").alias("id"), name("n", "c_nationkey").alias("parent")))


def below(nodes, tops, most_depth=4):
    """(top, id, depth): each top and all that is under it; one join a level."""
    now = tops.select(F.col("id").alias("top"), "id", F.lit(0).alias("depth"))
    out = now
    for k in range(1, most_depth + 1):
        now = now.join(nodes.select(F.col("id").alias("child"), "parent"), now.id == F.col("parent")).select("top", F.col("child").alias("id"), F.lit(k).alias("depth"))
        out = out.union(now)
    return out


@query("d23_tree_count", f"{BELOW} SELECT top, count(*) AS n FROM below WHERE top NOT LIKE 'c%' GROUP BY top")
def d23(spark, d):
    t = tree(spark, d)
    return below(t, t.where("id NOT LIKE 'c%'")).groupBy("top").agg(F.count("*").alias("n"))


@query("k05_struct_tree", f"{BELOW} SELECT id FROM below WHERE top = 'r2'")
def k05(spark, d):
    t = tree(spark, d)
    return below(t, t.where("id = 'r2'")).select("id")


@query("k10_expandable", f"WITH {TREE} SELECT DISTINCT parent AS id FROM tree WHERE parent IS NOT NULL")
def k10(spark, d):
    t = tree(spark, d)
    return t.join(t.select(F.col("parent").alias("id")), "id", "left_semi").select("id")


@query("k11_descendants", f"{BELOW} SELECT id FROM below WHERE top = 'n3' AND id <> 'n3'")
def k11(spark, d):
    t = tree(spark, d)
    return below(t, t.where("id = 'n3'")).where("id <> top").select("id")


@query("k09_flatten_visible", f"WITH {TREE}, v AS (SELECT id, parent FROM tree WHERE parent IS NULL OR parent = 'root' OR parent IN ('r1', 'r2')) SELECT id, 'e-' || parent || '-' || id AS edge FROM v")
def k09(spark, d):
    """Nodes whose ancestors are all expanded: the root, r1 and r2."""
    t = tree(spark, d)
    shown = t.where("parent IS NULL")
    level = shown
    expanded = spark.createDataFrame([("root",), ("r1",), ("r2",)], "parent string")
    for _ in range(2):
        level = t.join(expanded, "parent", "left_semi").select("id", "parent").join(level.select(F.col("id").alias("parent")), "parent").select("id", "parent")
        shown = shown.union(level)
    return shown.select("id", F.concat_ws("-", F.lit("e"), "parent", "id").alias("edge")).withColumn("edge", F.when(F.col("id") != "root", F.col("edge")))


@query("d24_outcomes", "SELECT user_id, count(CASE WHEN event_type <> 'error' THEN 1 END) AS processed, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed, coalesce(string_agg(CASE WHEN event_type = 'error' THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY event_id), '') AS errors FROM events GROUP BY user_id")
def d24(spark, d):
    bad = F.col("event_type") == "error"
    failures = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(bad, F.col("event_id")))), lambda x: x.cast("string")), ",")
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(~bad).alias("processed"), F.count_if(bad).alias("failed"), failures.alias("errors"))


@query("d26_human_members", "SELECT conv_id, count(CASE WHEN role = 'user' THEN 1 END) = 0 AS archived FROM conversations GROUP BY conv_id")
def d26(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg((F.count_if(F.col("role") == "user") == 0).alias("archived"))


@query("d27_dedup_rate", "SELECT source, count(*) AS total, count(DISTINCT md5(text)) AS kept FROM documents GROUP BY source")
def d27(spark, d):
    return table(spark, d, "documents").groupBy("source", F.md5("text").alias("h")).agg(F.count("*").alias("n")).groupBy("source").agg(F.sum("n").alias("total"), F.count("*").alias("kept"))


@query("e01_chunk_index", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS chunk_order_index FROM orders")
def e01(spark, d):
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return table(spark, d, "orders").select("o_orderkey", i.cast("long").alias("chunk_order_index"))


@query("e02_last_message", f"WITH {MESSAGES} SELECT thread, max(seq) AS seq, max_by(left(content, 100), seq) AS preview FROM messages GROUP BY thread")
def e02(spark, d):
    return messages(spark, d).groupBy("thread").agg(F.max("seq").alias("seq"), F.max_by(F.substring("content", 1, 100), "seq").alias("preview"))


@query("e05_latest_ready", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r = 1")
def e05(spark, d):
    return store.latest(table(spark, d, "orders").where("o_orderstatus = 'F'"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("e08_delta", "SELECT day, n, n - lag(n) OVER (ORDER BY day) AS growth FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1)")
def e08(spark, d):
    days = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("growth", F.col("n") - F.lag("n").over(Window.orderBy("day")))


TOPICS = "t AS (SELECT conv_id, turn, left(text, 200) AS topic, row_number() OVER (PARTITION BY conv_id, lower(left(text, 200)) ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user'), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM t WHERE r = 1)"


@query("e09_topn_topics", f"WITH {TOPICS} SELECT conv_id, turn, topic FROM n WHERE k <= 8")
def e09(spark, d):
    """Newest distinct user turns (case ignored), at most eight of each conversation, as snippets."""
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.substring("text", 1, 200).alias("topic"))
    newest = store.latest(asked.withColumn("low", F.lower("topic")), ["conv_id", "low"], [F.desc("turn")])
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return newest.withColumn("k", k).where("k <= 8").select("conv_id", "turn", "topic")


@query("e10_running_total", "SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY event_id) AS count_so_far FROM events")
def e10(spark, d):
    """Counted by runs of ids first, so that no task needs all events of a type."""
    rows = table(spark, d, "events").select("event_id", "event_type", F.floor(F.col("event_id") / 4096).alias("run"))
    before = Window.partitionBy("event_type").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("event_type", "run").agg(F.count("*").alias("n")).select("event_type", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("event_type", "run").orderBy("event_id")
    return rows.join(runs, ["event_type", "run"]).select("event_id", "event_type", (F.col("before") + F.row_number().over(inside)).alias("count_so_far"))


@query("f01_order_desc", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7")
def f01(spark, d):
    return table(spark, d, "orders").where("o_custkey = 7").orderBy(F.desc("o_orderdate")).select("o_orderkey", "o_orderdate")


@query("f02_last_n", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def f02(spark, d):
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, d, "conversations").withColumn("r", r).where("r <= 3").orderBy("conv_id", "turn").select("conv_id", "turn", "role")


@query("f06_limit_plus_one", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_custkey = 10) > 3 AS has_more FROM orders WHERE o_custkey = 10 ORDER BY o_orderkey LIMIT 3")
def f06(spark, d):
    return store.page_with_more(table(spark, d, "orders").where("o_custkey = 10"), ["o_orderkey"], 3).select("o_orderkey", "has_more")


@query("f07_two_key", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_totalprice DESC, o_orderkey) AS ids FROM orders GROUP BY o_custkey")
def f07(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("o_orderdate", (-F.col("o_totalprice")).alias("down"), "o_orderkey")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(ordered, lambda x: x["o_orderkey"].cast("string")), ",").alias("ids"))


@query("f08_seq_merge_sort", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'temp' ELSE CAST(event_id AS VARCHAR) END AS BIGINT), -1), CAST(event_id AS VARCHAR)) AS place FROM events")
def f08(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, "temp").otherwise(F.col("event_id").cast("string"))
    order = Window.partitionBy("user_id").orderBy(F.coalesce(text.try_cast("long"), F.lit(-1)), F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", F.row_number().over(order).cast("long").alias("place"))


@query("f09_user_last3", "SELECT event_id, ts FROM events WHERE user_id = 4 ORDER BY ts DESC, event_id LIMIT 3")
def f09(spark, d):
    return table(spark, d, "events").where("user_id = 4").orderBy(F.desc("ts"), "event_id").limit(3).select("event_id", "ts")


@query("f10_recent_fronts", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def f10(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey")


@query("p08_legacy_memory", "SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' WHEN 'system' THEN 'system' ELSE 'human' END, ',' ORDER BY turn) AS kinds FROM conversations GROUP BY conv_id")
def p08(spark, d):
    kind = F.coalesce(F.create_map(*(F.lit(x) for x in ("user", "human", "assistant", "ai", "system", "system")))[F.col("role")], F.lit("human"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", kind.alias("kind"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["kind"]), ",").alias("kinds"))


@query("p11_member_gate", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 8)")
def p11(spark, d):
    members = table(spark, d, "customer").where("c_nationkey = 8").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(members, "o_custkey", "left_semi").select("o_orderkey")


@query("p12_create_thread", "SELECT 'thread' AS kind, source || ' — group' AS name FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT 'owner', source FROM (SELECT DISTINCT source FROM documents)")
def p12(spark, d):
    names = table(spark, d, "documents").select("source").distinct()
    return names.select(F.lit("thread").alias("kind"), F.concat("source", F.lit(" — group")).alias("name")).union(names.select(F.lit("owner"), "source"))


@query("p13_pending_invites", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'")
def p13(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, d, "orders").where("o_orderstatus = 'P'").join(people, "o_custkey").select("o_orderkey", "c_name")


@query("p14_list_children", "SELECT n_name, count(c_custkey) AS files FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def p14(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("files"))


@query("p15_file_status", f"WITH {STATUS} SELECT doc_id, status, updated_at FROM status WHERE doc_id = 33")
def p15(spark, d):
    return status(spark, d).where("doc_id = 33").select("doc_id", "status", "updated_at")


@query("p23_preflight", f"WITH {STATUS} SELECT count(*) AS ready, count(CASE WHEN status <> 'processed' THEN 1 END) = 0 AS passed FROM status JOIN customer ON file_path = 'f' || c_custkey WHERE c_nationkey = 3")
def p23(spark, d):
    people = table(spark, d, "customer").where("c_nationkey = 3").select(F.concat(F.lit("f"), F.col("c_custkey")).alias("file_path"))
    return status(spark, d).join(people, "file_path").agg(F.count("*").alias("ready"), (F.count_if(F.col("status") != "processed") == 0).alias("passed"))
