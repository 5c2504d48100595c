"""Batch forms of the event operators over the events and conversations tables."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.functions import text as T
from brookwell.operators import store
from brookwell.plans.base import MESSAGES, messages, query, table
from brookwell.streaming import events as E

RATE = "SELECT user_id, ts, n, n <= {most} AS allowed FROM (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {before} PRECEDING AND CURRENT ROW) AS n FROM (SELECT DISTINCT user_id, ts FROM events))"


@query("m01_rate_msg", RATE.format(most=3, before=6 * 3600 * 10**6 - 1))
def m01(spark, d):
    return E.allowed(table(spark, d, "events"), 6 * 3600, 3)


@query("m02_rate_agent", RATE.format(most=1, before=3600 * 10**6 - 1))
def m02(spark, d):
    return E.allowed(table(spark, d, "events"), 3600, 1)


@query("m04_presence", "SELECT user_id FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('view', 'error')) WHERE r = 1 AND event_type = 'view'")
def m04(spark, d):
    return E.present(table(spark, d, "events"), "view", "error")


@query("m05_broadcast", "SELECT event_id, member FROM events JOIN (SELECT DISTINCT user_id % 10 AS thread, user_id AS member FROM events) ON thread = user_id % 10 WHERE event_type = 'signup' AND member <> user_id")
def m05(spark, d):
    sent = table(spark, d, "events").withColumn("thread", F.col("user_id") % 10)
    members = sent.select("thread", F.col("user_id").alias("member")).distinct()
    signups = sent.where("event_type = 'signup'").select("event_id", "thread", "user_id")
    return E.fan_out_in_cells(signups, members).select("event_id", "member")


@query("m07_pubsub", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'thread' ELSE 'user' END AS kind, user_id AS target FROM events")
def m07(spark, d):
    kind = F.when(F.col("event_id") % 2 == 0, "thread").otherwise("user")
    channel = table(spark, d, "events").select("event_id", F.split(F.concat_ws(":", F.lit("gc"), kind, F.col("user_id")), ":").alias("c"))
    return channel.select("event_id", F.col("c")[1].alias("kind"), F.col("c")[2].cast("long").alias("target"))


@query("m08_idempotent", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def m08(spark, d):
    return E.once(table(spark, d, "events"), "user_id", "event_type", order="event_id").select("user_id", "event_type", "event_id")


@query("m09_sequence", "SELECT event_id, 100 + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def m09(spark, d):
    stored = table(spark, d, "events").select("user_id").distinct().withColumn("last", F.lit(100).cast("long"))
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").join(stored, "user_id").select("event_id", (F.col("last") + r).alias("seq"))


@query("m10_read_receipt", "SELECT event_id, max(event_id % 50) OVER (PARTITION BY user_id ORDER BY event_id) AS last_read FROM events")
def m10(spark, d):
    upto = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.max(F.col("event_id") % 50).over(upto).alias("last_read"))


SESSIONS = "s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events))"


@query("m11_typing_timeout", f"WITH {SESSIONS} SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def m11(spark, d):
    found = E.sessions(table(spark, d, "events"), "2 hours")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


#: Actions by event id modulo 12: set and prepend messages, upsert, replace, discard, agent and user typing, presence, read marks, connected, has more, loading.
ACTIONS = """WITH a AS (SELECT user_id, event_id AS i, event_id % 12 AS k, event_id // 12 % 2 = 1 AS on_, event_id // 12 % 20 AS m, event_id // 12 % 3 AS who FROM events),
msg AS (SELECT user_id, m, min(i) FILTER (k < 4) AS made, max(i) FILTER (k < 4) AS kept, max(i) FILTER (k = 4) AS gone FROM a WHERE k < 5 GROUP BY user_id, m),
n AS (SELECT user_id, count(made) AS messages, count(CASE WHEN gone > kept THEN 1 END) AS discarded FROM msg GROUP BY user_id),
t AS (SELECT user_id, count(*) AS typing FROM (SELECT user_id, who, max_by(on_, i) AS typing FROM a WHERE k = 6 GROUP BY user_id, who) WHERE typing GROUP BY user_id),
s AS (SELECT user_id, max_by(on_, i) FILTER (k = 5) AS agent, max_by(m, i) FILTER (k = 7) AS online, max_by(on_, i) FILTER (k = 9) AS connected, max_by(CASE WHEN k = 10 THEN on_ ELSE m >= 10 END, i) FILTER (k IN (0, 1, 10)) AS has_more, max_by(k = 11 AND on_, i) FILTER (k IN (1, 11)) AS loading FROM a GROUP BY user_id),
r AS (SELECT user_id, string_agg(who || ':' || seq, ',' ORDER BY who) AS read FROM (SELECT user_id, who, max_by(m, i) AS seq FROM a WHERE k = 8 GROUP BY user_id, who) GROUP BY user_id)
SELECT s.*, coalesce(messages, 0) AS messages, coalesce(discarded, 0) AS discarded, coalesce(typing, 0) AS typing, read FROM s LEFT JOIN n USING (user_id) LEFT JOIN t USING (user_id) LEFT JOIN r USING (user_id)"""


@query("m12_client_reducer", ACTIONS)
def m12(spark, d):
    """A thread's state after twelve kinds of actions: the last of each kind wins, messages are merged by id, a discard marks a message that is there until it comes again."""
    step = F.floor(F.col("event_id") / 12)
    a = table(spark, d, "events").select("user_id", F.col("event_id").alias("i"), (F.col("event_id") % 12).alias("k"), (step % 2 == 1).alias("on_"), (step % 20).alias("m"), (step % 3).alias("who"))
    last = lambda value, *kinds: F.max_by(F.when(F.col("k").isin(*kinds), value), F.when(F.col("k").isin(*kinds), F.col("i")))
    on = F.col("on_")
    state = a.groupBy("user_id").agg(
        last(on, 5).alias("agent"), last(F.col("m"), 7).alias("online"), last(on, 9).alias("connected"),
        last(F.when(F.col("k") == 10, on).otherwise(F.col("m") >= 10), 0, 1, 10).alias("has_more"), last((F.col("k") == 11) & on, 1, 11).alias("loading"),
    )
    put, gone = F.max(F.when(F.col("k") < 4, F.col("i"))), F.max(F.when(F.col("k") == 4, F.col("i")))
    merged = a.where("k < 5").groupBy("user_id", "m").agg(put.alias("kept"), gone.alias("gone"))
    counts = merged.groupBy("user_id").agg(F.count("kept").alias("messages"), F.count_if(F.col("gone") > F.col("kept")).alias("discarded"))
    by_who = lambda k, value: a.where(F.col("k") == k).groupBy("user_id", "who").agg(F.max_by(value, "i").alias("v"))
    typing = by_who(6, "on_").where("v").groupBy("user_id").agg(F.count("*").alias("typing"))
    marks = by_who(8, "m").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "who", "v"))), ",").alias("read"))
    out = state.join(counts, "user_id", "left").join(typing, "user_id", "left").join(marks, "user_id", "left")
    return out.na.fill(0, ["messages", "discarded", "typing"])


@query("m13_unread_reducer", "WITH c AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT e.user_id, count(CASE WHEN event_type IN ('view', 'click') AND (last IS NULL OR event_id > last) THEN 1 END) AS n FROM events e LEFT JOIN c ON c.user_id = e.user_id GROUP BY e.user_id")
def m13(spark, d):
    kind = F.col("event_type")
    return E.since_last(table(spark, d, "events"), kind.isin("view", "click"), kind == "signup", "user_id", ["event_id"])


@query("m14_events", "SELECT event_id, event_type AS type, 1 AS v, CASE WHEN event_type = 'purchase' THEN round(value, 4) END AS amount, CASE WHEN event_type <> 'purchase' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def m14(spark, d):
    bought = F.col("event_type") == "purchase"
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("type"), F.lit(1).alias("v"), F.when(bought, F.round("value", 4)).alias("amount"), F.when(~bought, F.from_json("props", "k long")["k"]).alias("k"))


@query("m15_unread_bump", f"WITH {MESSAGES} SELECT thread, seq FROM messages WHERE contains(content, 'e') AND role = 'user' AND thread % 3 <> 0")
def m15(spark, d):
    """Tagged messages of others in threads that are not open."""
    m = messages(spark, d)
    online = m.where("thread % 3 = 0").select("thread").distinct()
    return store.without(m.where(F.contains("content", F.lit("e")) & (F.col("role") == "user")).select("thread", "seq"), online, "thread")


@query("m16_mention_parse", r"""WITH m AS (SELECT conv_id, turn, unnest(w) AS w, unnest(range(len(w))) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM conversations)),
known AS (SELECT DISTINCT lower(event_type) AS name FROM events UNION SELECT DISTINCT regexp_extract(lower(text), '[\p{L}\p{N}_]+') FROM conversations WHERE turn = 1)
SELECT conv_id, turn, w AS name, min(pos) AS pos FROM m JOIN known ON name = w WHERE w <> '' GROUP BY ALL""")
def m16(spark, d):
    """Mentioned members by lower-case name, each once; unknown names are dropped."""
    turns = table(spark, d, "conversations").withColumn("words", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    said = turns.select("conv_id", "turn", F.posexplode(T.mentions(F.concat(F.lit("@"), F.array_join("words", " @")))).alias("pos", "name"))
    opened = turns.where("turn = 1").select(F.get("words", F.lit(0)).alias("name"))
    known = table(spark, d, "events").select(F.lower("event_type").alias("name")).union(opened).where("name <> ''").distinct()
    found = said.join(known, "name", "left_semi")
    return found.groupBy("conv_id", "turn", "name").agg(F.min("pos").cast("long").alias("pos"))


@query("m17_poll_status", "SELECT user_id, event_type, min(ts) AS first_seen FROM events GROUP BY 1, 2")
def m17(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"))


@query("m18_stuck", "SELECT user_id FROM (SELECT user_id, max_by(event_type, event_id) AS s, max(ts) AS t FROM events GROUP BY 1) WHERE s = 'view' AND t < (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE")
def m18(spark, d):
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("s"), F.max("ts").alias("t"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    return last.where("s = 'view'").crossJoin(F.broadcast(now)).where(F.col("t") < F.col("now") - F.expr("INTERVAL 5 MINUTES")).select("user_id")


@query("m19_watermark", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def m19(spark, d):
    return E.counted(table(spark, d, "events"), "6 hours", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))
