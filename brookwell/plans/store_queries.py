"""Scans, predicates, pages, upserts, deletes and lifecycles over the standard tables as a keyed store."""

from pyspark.sql import functions as F

from brookwell.operators import store
from brookwell.plans.base import MESSAGES, messages, query, table

KV = "kv AS (SELECT c_mktsegment AS workspace, 'c:' || c_custkey AS key, c_name AS value, c_acctbal AS score FROM customer)"
STATUS = "status AS (SELECT o_orderkey AS doc_id, 'f' || o_custkey AS file_path, CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'processing' ELSE 'pending' END AS status, o_orderdate AS updated_at, o_totalprice AS price FROM orders)"
NOW = "1998-01-01"


def kv(spark, d):
    """Key-value rows: workspace, key, value, score."""
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("workspace"), F.concat(F.lit("c:"), F.col("c_custkey")).alias("key"), F.col("c_name").alias("value"), F.col("c_acctbal").alias("score"))


def status(spark, d):
    """Document status rows: doc_id, file_path, status, updated_at, price."""
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("f"), F.col("o_custkey")).alias("file_path"), F.when(s == "F", "processed").when(s == "O", "processing").otherwise("pending").alias("status"), F.col("o_orderdate").alias("updated_at"), F.col("o_totalprice").alias("price"))


def asked(spark, *keys):
    return spark.createDataFrame(list(enumerate(keys)), "pos long, key string")


@query("a15_kv_get", f"WITH {KV} SELECT key, value FROM kv WHERE workspace = (SELECT workspace FROM kv WHERE key = 'c:7') AND key = 'c:7'")
def a15(spark, d):
    return kv(spark, d).where("key = 'c:7'").select("key", "value")


@query("a16_kv_get_many", f"WITH {KV}, ask AS (SELECT unnest([0, 1, 2, 3])::BIGINT AS pos, unnest(['c:9', 'c:2', 'c:none', 'c:5']) AS key) SELECT pos, key, value FROM ask JOIN kv USING (key)")
def a16(spark, d):
    return store.in_order(asked(spark, "c:9", "c:2", "c:none", "c:5"), kv(spark, d), "key").select("pos", "key", "value").orderBy("pos")


@query("a17_vec_get", "SELECT vec_id, label FROM embeddings WHERE vec_id = 12")
def a17(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 12").select("vec_id", "label")


@query("a18_vec_get_many", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (3, 77, 100000000)")
def a18(spark, d):
    return table(spark, d, "embeddings").where(F.col("vec_id").isin(3, 77, 100000000)).select("vec_id", "label")


@query("a19_vec_raw", "SELECT vec_id, len(embedding)::BIGINT AS dim, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings WHERE vec_id IN (3, 77)")
def a19(spark, d):
    return table(spark, d, "embeddings").where(F.col("vec_id").isin(3, 77)).select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("a22_doc_status_get", f"""WITH {STATUS}, ask AS (SELECT unnest([0, 1, 2])::BIGINT AS pos, unnest([33, 2, 1])::BIGINT AS doc_id) SELECT pos, doc_id, status, status || '-0' || ',' || status || '-1' AS chunks FROM ask JOIN status USING (doc_id)""")
def a22(spark, d):
    ask = spark.createDataFrame([(0, 33), (1, 2), (2, 1)], "pos long, doc_id long")
    raw = F.concat(F.lit('["'), F.col("status"), F.lit('-0", "'), F.col("status"), F.lit('-1"]'))
    return store.in_order(ask, status(spark, d), "doc_id").select("pos", "doc_id", "status", F.array_join(F.from_json(raw, "array<string>"), ",").alias("chunks"))


@query("a23_doc_by_path", f"WITH {STATUS} SELECT doc_id, status FROM status WHERE file_path = 'f7' ORDER BY updated_at DESC, doc_id LIMIT 1")
def a23(spark, d):
    return status(spark, d).where("file_path = 'f7'").orderBy(F.desc("updated_at"), "doc_id").limit(1).select("doc_id", "status")


NEWEST = "newest AS (SELECT * FROM (SELECT 'c:' || o_custkey AS key, o_orderpriority AS value, o_orderdate AS sent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_custkey % 3 = 0) WHERE r = 1)"


@query("a24_kv_upsert", f"WITH {NEWEST}, old AS (SELECT 'c:' || c_custkey AS key, c_name AS value, TIMESTAMP '1990-01-01' AS created_at, TIMESTAMP '1990-01-01' AS updated_at FROM customer WHERE c_custkey % 2 = 0) SELECT key, coalesce(newest.value, old.value) AS value, coalesce(created_at, sent) AS created_at, coalesce(sent, updated_at) AS updated_at FROM old FULL JOIN newest USING (key)")
def a24(spark, d):
    start = F.lit("1990-01-01").cast("timestamp_ntz")
    old = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("key"), F.col("c_name").alias("value"), start.alias("created_at"), start.alias("updated_at"))
    sent = table(spark, d, "orders").where("o_custkey % 3 = 0").select(F.concat(F.lit("c:"), F.col("o_custkey")).alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"), "o_orderkey")
    new = store.latest(sent, ["key"], [F.desc("updated_at"), F.desc("o_orderkey")]).drop("o_orderkey")
    return store.upserted(old, new, "key", keep=("created_at",))


@query("a25_vec_upsert", "SELECT 'v:' || doc_id AS key, coalesce(nullif(source, 'src3'), '') AS file_path, CAST(n_chars AS VARCHAR) AS size FROM documents")
def a25(spark, d):
    docs = table(spark, d, "documents")
    meta = F.create_map(F.lit("file_path"), F.when(F.col("source") != "src3", F.col("source")), F.lit("size"), F.col("n_chars").cast("string"))
    flat = F.transform_values(meta, lambda _, v: F.coalesce(v, F.lit("")))
    return docs.select(F.concat(F.lit("v:"), F.col("doc_id")).alias("key"), flat["file_path"].alias("file_path"), flat["size"].alias("size"))


@query("a28_doc_upsert", f"WITH {STATUS} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN doc_id % 5 = 0 THEN '' ELSE file_path END AS file_path, CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE price END AS price FROM status")
def a28(spark, d):
    old = status(spark, d).select("doc_id", "status", "file_path", "price")
    new = old.where("doc_id % 5 = 0").select("doc_id", F.lit("failed").alias("status"), F.lit("").alias("file_path"), F.lit(0.0).alias("price"))
    return store.upserted(old, new, "doc_id")


@query("a29_set_status", "SELECT user_id, event_type AS status, ts AS since FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def a29(spark, d):
    return store.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("event_type").alias("status"), F.col("ts").alias("since"))


@query("a31_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a31(spark, d):
    return store.new_keys(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("a35_drop_kv", f"WITH {KV} SELECT workspace, count(*) AS n FROM kv WHERE workspace <> 'BUILDING' GROUP BY workspace")
def a35(spark, d):
    return kv(spark, d).where("workspace <> 'BUILDING'").groupBy("workspace").agg(F.count("*").alias("n"))


@query("a37_snapshot_poll", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem ANTI JOIN (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_orderkey < 500) USING (l_suppkey, l_partkey)")
def a37(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    return store.without(li, li.where("l_orderkey < 500"), "l_suppkey", "l_partkey").select("l_suppkey", "l_partkey").distinct()


@query("b01_workspace_filter", f"WITH {KV} SELECT key, value FROM kv WHERE workspace = 'BUILDING'")
def b01(spark, d):
    return kv(spark, d).where("workspace = 'BUILDING'").select("key", "value")


@query("b02_status_in", f"WITH {STATUS} SELECT doc_id, status FROM status WHERE status IN ('processed', 'pending')")
def b02(spark, d):
    return status(spark, d).where(F.col("status").isin("processed", "pending")).select("doc_id", "status")


@query("b03_not_discarded", f"WITH {MESSAGES} SELECT thread, seq FROM messages WHERE NOT is_discarded")
def b03(spark, d):
    return messages(spark, d).where(~F.col("is_discarded")).select("thread", "seq")


@query("b04_keyset_page", "SELECT event_id, event_type FROM events WHERE event_id < 700 ORDER BY event_id DESC LIMIT 50")
def b04(spark, d):
    return store.page_before(table(spark, d, "events"), "event_id", 700, 50).select("event_id", "event_type")


@query("b05_offset_page", "SELECT event_id FROM events WHERE user_id = 3 ORDER BY ts, event_id LIMIT 20 OFFSET 5")
def b05(spark, d):
    return table(spark, d, "events").where("user_id = 3").orderBy("ts", "event_id").offset(5).limit(20).select("event_id")


@query("b06_id_page", "SELECT event_id, (SELECT count(*) FROM events WHERE event_id < 400) > 20 AS has_more FROM events WHERE event_id < 400 ORDER BY event_id LIMIT 20")
def b06(spark, d):
    return store.page_with_more(table(spark, d, "events").where("event_id < 400"), ["event_id"], 20).select("event_id", "has_more")


@query("b07_json_pred", "SELECT event_id, coalesce(json_extract_string(props, '$.k') <> '3', false) AS as_written, json_extract_string(props, '$.k') IS DISTINCT FROM '3' AS as_meant FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{}' ELSE props END AS props FROM events)")
def b07(spark, d):
    props = F.when(F.col("event_id") % 4 == 0, "{}").otherwise(F.col("props"))
    k = F.get_json_object(props, "$.k")
    return table(spark, d, "events").select("event_id", F.coalesce(k != "3", F.lit(False)).alias("as_written"), (~k.eqNullSafe("3")).alias("as_meant"))


@query("b08_or_pred", f"WITH {KV} SELECT key FROM kv WHERE key = 'c:5' OR value = (SELECT c_name FROM customer WHERE c_custkey = 9)")
def b08(spark, d):
    name = table(spark, d, "customer").where("c_custkey = 9").select(F.col("c_name").alias("value"))
    rows = kv(spark, d)
    return rows.where("key = 'c:5'").select("key").union(rows.where("key <> 'c:5'").join(name, "value", "left_semi").select("key"))


@query("b09_due_range", "SELECT event_id, ts FROM events WHERE user_id = 5 AND ts <= TIMESTAMP '2024-01-10'")
def b09(spark, d):
    return table(spark, d, "events").where((F.col("user_id") == 5) & (F.col("ts") <= F.lit("2024-01-10").cast("timestamp_ntz"))).orderBy("ts").select("event_id", "ts")


@query("b14_prefix_ci", f"WITH {KV} SELECT value AS name FROM kv WHERE lower(value) LIKE 'customer#00000001%' AND key <> 'c:1' UNION ALL SELECT 'Customer-agent' WHERE starts_with('customer-agent', 'customer#00000001')")
def b14(spark, d):
    typed = "CUSTOMER#00000001".lower()
    agent = spark.createDataFrame([("Customer-agent",)], "name string").where(F.lower("name").startswith(typed))
    return kv(spark, d).where(F.lower("value").startswith(typed) & (F.col("key") != "c:1")).select(F.col("value").alias("name")).union(agent)


@query("b15_substr_ci", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ar')")
def b15(spark, d):
    return table(spark, d, "part").where(F.contains(F.lower("p_name"), F.lower(F.lit("AR")))).select("p_partkey")


@query("b17_stale_open", f"WITH {STATUS} SELECT doc_id, CASE WHEN status = 'processing' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE THEN 'failed' ELSE status END AS status FROM status")
def b17(spark, d):
    late = F.col("updated_at") < F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 5 MINUTES")
    return status(spark, d).select("doc_id", F.when((F.col("status") == "processing") & late, "failed").otherwise(F.col("status")).alias("status"))


@query("b21_ready_gate", f"WITH {STATUS} SELECT doc_id, status IN ('processed', 'processing') AS chat, status = 'processed' AS quiz FROM status")
def b21(spark, d):
    return status(spark, d).select("doc_id", F.col("status").isin("processed", "processing").alias("chat"), (F.col("status") == "processed").alias("quiz"))


@query("b22_preview", "SELECT doc_id, left(text, 100) AS preview, left(text, 200) AS summary FROM documents")
def b22(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 100).alias("preview"), F.substring("text", 1, 200).alias("summary"))


@query("b23_hide_answers", "SELECT item_id, string_agg('q' || k || ':' || CASE WHEN item_id % 2 = 0 THEN CAST(k % 4 AS VARCHAR) ELSE '?' END, '|' ORDER BY k) AS shown FROM (SELECT item_id, unnest([1, 2, 3]) AS k FROM benchmark) GROUP BY item_id")
def b23(spark, d):
    questions = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.struct(F.concat(F.lit("q"), k).alias("prompt"), (k % 4).alias("answer")))
    submitted = F.col("item_id") % 2 == 0
    shown = F.transform(F.col("q"), lambda q: F.struct(q["prompt"].alias("prompt"), F.when(submitted, q["answer"]).alias("answer")))
    line = F.transform(shown, lambda q: F.concat(q["prompt"], F.lit(":"), F.coalesce(q["answer"].cast("string"), F.lit("?"))))
    return table(spark, d, "benchmark").select("item_id", questions.alias("q")).select("item_id", F.array_join(line, "|").alias("shown"))


@query("b24_modal_types", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error', 'table')")
def b24(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "error", "table")).select("event_id", "event_type")


@query("b27_recovery_scan", f"WITH {STATUS} SELECT doc_id FROM status WHERE status IN ('processing', 'naive_ready')")
def b27(spark, d):
    return status(spark, d).where(F.col("status").isin("processing", "naive_ready")).select("doc_id")


@query("b28_owner_split", "SELECT o_orderkey, o_custkey = 7 AS created FROM orders WHERE o_custkey IN (7, 8, 10)")
def b28(spark, d):
    rows = table(spark, d, "orders").where(F.col("o_custkey").isin(7, 8, 10))
    mine, joined = rows.where("o_custkey = 7"), rows.where("o_custkey <> 7")
    return mine.select("o_orderkey", F.lit(True).alias("created")).union(joined.select("o_orderkey", F.lit(False)))


@query("b29_unarchived", f"WITH {STATUS} SELECT doc_id FROM status WHERE NOT (status = 'pending')")
def b29(spark, d):
    return status(spark, d).withColumn("is_archived", F.col("status") == "pending").where(~F.col("is_archived")).select("doc_id")


@query("b30_contains_path", f"WITH {STATUS} SELECT count(*) AS hits FROM status WHERE contains(file_path, '12')")
def b30(spark, d):
    return status(spark, d).where(F.contains("file_path", F.lit("12"))).agg(F.count("*").alias("hits"))


@query("g05_upsert_union", f"WITH {MESSAGES} SELECT thread, seq, CASE WHEN seq % 2 = 0 THEN 'seen' ELSE role END AS role FROM messages")
def g05(spark, d):
    old = messages(spark, d).select(F.concat_ws("/", "thread", "seq").alias("key"), "thread", "seq", "role")
    new = old.where("seq % 2 = 0").withColumn("role", F.lit("seen"))
    return store.upserted(old, new, "key").drop("key")


@query("g06_difference", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey <> 7 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def g06(spark, d):
    orders = table(spark, d, "orders")
    tagged, online = orders.where("o_orderstatus = 'F' AND o_custkey <> 7"), orders.where("o_orderstatus = 'P'")
    return store.new_keys(tagged, online, "o_custkey")


@query("g08_chunk_merge", "SELECT text, min(o) AS origin FROM (SELECT text, 'graph' AS o FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT text, 'vector' FROM documents WHERE doc_id % 3 = 0) GROUP BY text")
def g08(spark, d):
    docs = table(spark, d, "documents")
    graph, near = (docs.where(f"doc_id % {k} = 0").select("text", F.lit(o).alias("origin"), F.lit(p).alias("p"), "doc_id") for k, o, p in ((2, "graph", 0), (3, "vector", 1)))
    return store.latest(graph.unionByName(near), ["text"], ["p", "doc_id"]).select("text", "origin")


KINDS = ("signup", "view", "click", "purchase", "error")
CODE_SQL = "CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"


class Lifecycle:
    """States and what each event does to them; an event without a legal step from a state leaves it."""

    def __init__(self, states: tuple[str, ...], steps: dict[str, dict[str, str]]):
        self.states = states
        self.moves = [[states.index(steps.get(kind, {}).get(s, s)) for s in states] for kind in KINDS]

    def sql(self) -> str:
        table, names = [s for row in self.moves for s in row], ", ".join(f"'{s}'" for s in self.states)
        return f"SELECT user_id, list_extract([{names}], CAST(list_reduce([0] || list({CODE_SQL} ORDER BY event_id), lambda s, c: list_extract({table}, c * {len(self.states)} + s + 1)) + 1 AS BIGINT)) AS state FROM events GROUP BY user_id"

    def rows(self, spark, d):
        code = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("event_type")) - 1
        found = store.machine(table(spark, d, "events"), "user_id", code, "event_id", len(self.states), self.moves)
        return found.select("user_id", F.element_at(F.array(*(F.lit(s) for s in self.states)), F.col("state") + 1).alias("state"))


#: The tables' events stand for: made or reset, taken up, first result, finished, failed.
LIFECYCLES = {
    "o01_file_state": Lifecycle(
        ("pending", "processing", "naive_ready", "completed", "failed"),
        {"signup": {"failed": "pending"}, "view": {"pending": "processing"}, "click": {"processing": "naive_ready"}, "purchase": {"naive_ready": "completed"}, "error": {"processing": "failed", "naive_ready": "failed"}},
    ),
    "o02_doc_state": Lifecycle(
        ("pending", "processing", "preprocessed", "chunks_ready", "processed", "failed"),
        {"signup": {"failed": "pending"}, "view": {"pending": "processing", "processing": "preprocessed"}, "click": {"preprocessed": "chunks_ready"}, "purchase": {"chunks_ready": "processed"}, "error": {"processing": "failed", "preprocessed": "failed", "chunks_ready": "failed"}},
    ),
    "o03_quiz_state": Lifecycle(("pending", "generating", "ready", "failed", "submitted"), {"view": {"pending": "generating"}, "click": {"generating": "ready"}, "purchase": {"ready": "submitted"}, "error": {"generating": "failed"}, "signup": {"failed": "pending"}}),
    "o04_deck_state": Lifecycle(("pending", "generating", "ready", "failed"), {"view": {"pending": "generating"}, "click": {"generating": "ready"}, "error": {"generating": "failed"}, "signup": {"failed": "pending"}}),
    "o05_mindmap_state": Lifecycle(  # made again only by force, from any state; a ready one is returned as it is
        ("pending", "generating", "ready", "failed"), {"view": {"pending": "generating", "failed": "generating"}, "click": {"generating": "ready"}, "error": {"generating": "failed"}, "purchase": {"pending": "pending", "generating": "pending", "ready": "pending", "failed": "pending"}}
    ),
    "o06_invite_state": Lifecycle(("pending", "accepted", "rejected", "cancelled"), {"click": {"pending": "accepted"}, "error": {"pending": "rejected"}, "view": {"pending": "cancelled"}}),
}
for _name, _life in LIFECYCLES.items():
    query(_name, _life.sql())(lambda spark, d, life=_life: life.rows(spark, d))


@query("o07_send_invites", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'pending' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'member' ELSE 'sent' END AS outcome FROM customer")
def o07(spark, d):
    members = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max((F.col("o_orderstatus") == "P").cast("int")).alias("open"))
    outcome = F.when(F.col("open") == 1, "pending").when(F.col("open") == 0, "member").otherwise("sent")
    return table(spark, d, "customer").select("c_custkey").join(members, "c_custkey", "left").select("c_custkey", outcome.alias("outcome"))


@query("o08_leave", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE NOT (o_custkey % 10 = 7 AND o_orderpriority = '1-URGENT')")
def o08(spark, d):
    members = table(spark, d, "orders").select("o_custkey", "o_orderpriority").distinct()
    gone = members.where("o_custkey % 10 = 7 AND o_orderpriority = '1-URGENT'")
    return store.without(members, gone, "o_custkey", "o_orderpriority")


@query("o10_delete_history", f"WITH {MESSAGES} SELECT thread, seq FROM messages WHERE NOT (thread % 4 = 1 AND role = 'user')")
def o10(spark, d):
    rows = messages(spark, d).select("thread", "seq", "role")
    return store.without(rows, rows.where("thread % 4 = 1 AND role = 'user'"), "thread", "seq", "role").select("thread", "seq")


@query("o11_cascade", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))")
def o11(spark, d):
    gone = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, d, "orders").join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.without(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), orders, "l_orderkey")


@query("o12_explore", "SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NOT NULL AND event_id % 2 = 0 THEN 'answer' ELSE 'pending' END AS shown FROM events")
def o12(spark, d):
    known = table(spark, d, "events").where((F.get_json_object("props", "$.k").isNotNull()) & (F.col("event_id") % 2 == 0)).select("event_id", F.lit("answer").alias("shown"))
    return table(spark, d, "events").select("event_id").join(known, "event_id", "left").na.fill("pending", ["shown"])


@query("o13_vec_delete", "SELECT vec_id FROM embeddings WHERE label <> 3 AND vec_id NOT IN (4, 5)")
def o13(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return store.without(e, e.where((F.col("label") == 3) | F.col("vec_id").isin(4, 5)), "vec_id").select("vec_id")


@query("o15_kv_delete", f"WITH {KV} SELECT key FROM kv WHERE key NOT IN ('c:1', 'c:2', 'c:x')")
def o15(spark, d):
    return store.without(kv(spark, d), asked(spark, "c:1", "c:2", "c:x"), "key").select("key")


@query("o16_partial_unique", f"WITH {STATUS} SELECT file_path, count(*) AS n FROM status WHERE status = 'processing' GROUP BY file_path HAVING count(*) > 1")
def o16(spark, d):
    return store.repeated(status(spark, d).where("status = 'processing'"), "file_path")


@query("o17_checks", "SELECT 'quantity' AS rule, count(*) AS n FROM lineitem WHERE l_quantity NOT IN (5, 10, 15) UNION ALL SELECT 'unique line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def o17(spark, d):
    li = table(spark, d, "lineitem")
    odd = li.where(~F.col("l_quantity").isin(5, 10, 15)).agg(F.count("*").alias("n")).select(F.lit("quantity").alias("rule"), "n")
    return odd.union(store.repeated(li, "l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).select(F.lit("unique line"), "n"))


@query("o18_resume_phase2", f"WITH {STATUS} SELECT doc_id, file_path FROM status WHERE status IN ('processing', 'pending') AND doc_id IN (SELECT l_orderkey FROM lineitem)")
def o18(spark, d):
    have = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    return status(spark, d).where(F.col("status").isin("processing", "pending")).join(have, "doc_id", "left_semi").select("doc_id", "file_path")


@query("o19_join_leave", "SELECT c_custkey FROM customer WHERE c_nationkey = 4 UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def o19(spark, d):
    now = table(spark, d, "customer").where("c_nationkey = 4").select("c_custkey")
    joins = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return now.union(store.new_keys(joins, now, "c_custkey"))


@query("o20_announce", f"WITH {MESSAGES} SELECT thread, seq FROM messages WHERE trim(content) <> '' AND (role = 'assistant' OR thread % 2 = 0)")
def o20(spark, d):
    return messages(spark, d).where((F.trim("content") != "") & ((F.col("role") == "assistant") | (F.col("thread") % 2 == 0))).select("thread", "seq")


@query("p01_doc_status_api", f"WITH {STATUS} SELECT doc_id, coalesce(nullif(status, 'pending'), '') AS status, file_path FROM status WHERE file_path = 'f10'")
def p01(spark, d):
    typed = F.coalesce(F.when(F.col("status") != "pending", F.col("status")), F.lit(""))
    return status(spark, d).where("file_path = 'f10'").select("doc_id", typed.alias("status"), "file_path")


@query("p02_is_empty", f"WITH {KV} SELECT w AS workspace, (SELECT count(*) FROM kv WHERE workspace = w) = 0 AS empty FROM (SELECT unnest(['BUILDING', 'NOWHERE']) AS w)")
def p02(spark, d):
    ask = spark.createDataFrame([("BUILDING",), ("NOWHERE",)], "workspace string")
    have = kv(spark, d).select("workspace").distinct().withColumn("empty", F.lit(False))
    return ask.join(have, "workspace", "left").na.fill({"empty": True})


@query("p04_namespace_suffix", "SELECT DISTINCT event_type, ends_with(event_type, 'ew') OR ends_with(event_type, 'se') AS found FROM events")
def p04(spark, d):
    return table(spark, d, "events").select("event_type", (F.col("event_type").endswith("ew") | F.col("event_type").endswith("se")).alias("found")).distinct()


@query("p05_collection_stats", f"WITH {KV} SELECT workspace || '__chunks' AS name, count(*) AS total FROM kv GROUP BY workspace")
def p05(spark, d):
    return kv(spark, d).groupBy(F.concat_ws("__", "workspace", F.lit("chunks")).alias("name")).agg(F.count("*").alias("total"))


@query("p06_legacy_add", "SELECT 'file_' || o_custkey || '_chunk_' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS id, coalesce(nullif(o_orderkey % 3, 0), -1) AS page FROM orders")
def p06(spark, d):
    from pyspark.sql.window import Window

    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, d, "orders").select(F.concat_ws("_", F.lit("file"), "o_custkey", F.lit("chunk"), i).alias("id"), F.coalesce(F.nullif(F.col("o_orderkey") % 3, F.lit(0)), F.lit(-1)).cast("long").alias("page"))


@query("p07_legacy_delete", "SELECT doc_id FROM documents WHERE source <> 'src3'")
def p07(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return store.without(docs, docs.where("source = 'src3'"), "source").select("doc_id")
