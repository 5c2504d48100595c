"""String, date, score and array functions over the standard tables."""

from pyspark.sql import functions as F

from brookwell.functions import arrays, scores, text
from brookwell.plans.base import query, table

#: Python's notion of blank at both ends, in the syntax that both engines share.
STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def strip_sql(x: str) -> str:
    return STRIP.format(x)


@query("h01_md5_id", "SELECT doc_id, 'doc-' || md5(text) AS doc_key FROM documents")
def h01(spark, d):
    return table(spark, d, "documents").select("doc_id", text.hashed_id("doc-", F.col("text")).alias("doc_key"))


@query("h02_args_hash", "SELECT doc_id, md5(lang || source || CAST(doc_id AS VARCHAR)) AS args_hash FROM documents")
def h02(spark, d):
    return table(spark, d, "documents").select("doc_id", text.args_hash(F.col("lang"), F.col("source"), F.col("doc_id")).alias("args_hash"))


@query("h03_multi_split", rf"SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\.|,'), lambda x: {strip_sql('x')}), lambda x: x <> ''), '<SEP>') AS pieces FROM documents")
def h03(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.multi_split(F.col("text"), ".", ","), text.SEP).alias("pieces"))


@query("h04_sanitize", rf"""SELECT doc_id, {strip_sql(r"regexp_replace(regexp_replace(regexp_replace('\"' || chr(7) || text || '\"', '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFE}\x{FFFF}]', '', 'g'), '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')".replace(chr(92) + chr(34), chr(34)))} AS cleaned FROM documents""")
def h04(spark, d):
    marked = F.concat(F.lit('"\x07'), F.col("text"), F.lit('"'))
    return table(spark, d, "documents").select("doc_id", text.sanitize(marked, outer_quotes=True).alias("cleaned"))


@query("h05_delim_fix", "SELECT doc_id, 'entity<|#|>' || source || '<|#|>' || lang AS record FROM documents")
def h05(spark, d):
    broken = F.concat(F.lit("entity< # >"), F.col("source"), F.lit("<#>"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", text.repair_fields(broken).alias("record"))


@query("h06_is_float", r"SELECT o_orderkey, regexp_matches(v, '^[-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?$') AS is_number FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) || '.5' WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE '-' || CAST(o_custkey AS VARCHAR) || 'e-3' END AS v FROM orders)")
def h06(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    v = F.when(k % 3 == 0, F.concat(F.lit(" "), c, F.lit(".5 "))).when(k % 3 == 1, F.col("o_orderstatus")).otherwise(F.concat(F.lit("-"), c, F.lit("e-3")))
    return table(spark, d, "orders").select("o_orderkey", text.is_number(v).alias("is_number"))


@query("h07_think_strip", f"SELECT conv_id, turn, {strip_sql('text')} AS answer FROM conversations")
def h07(spark, d):
    thought = F.concat(F.lit("<think>so\n<b></think> "), F.col("text"), F.lit("<think></think>\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.without_thoughts(thought).alias("answer"))


@query("h08_smart_quotes", "SELECT doc_id, '\"' || source || '\"' || ' ''' || lang || '''' AS plain FROM documents")
def h08(spark, d):
    curly = F.concat(F.lit("„"), F.col("source"), F.lit("“ ‘"), F.col("lang"), F.lit("’"))
    return table(spark, d, "documents").select("doc_id", text.plain_quotes(curly).alias("plain"))


MENTIONED = "'@' || regexp_replace(text, ' ', ' @')"


@query("h09_mentions_re", rf"SELECT conv_id, turn, array_to_string(regexp_extract_all({MENTIONED}, '@([\p{{L}}\p{{N}}_]+)', 1), ',') AS mentioned FROM conversations")
def h09(spark, d):
    c = F.concat(F.lit("@"), F.regexp_replace("text", "^([^ ]*) ", "$1 @"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.mentions(c), ",").alias("mentioned"))


@query("h10_agent_strip", f"SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'How can I help?' ELSE {strip_sql('text')} END AS question FROM conversations")
def h10(spark, d):
    c = F.when(F.col("turn") % 5 == 0, " @Agent ").otherwise(F.concat(F.lit("@aGENT "), F.col("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", text.without_mention(c, "agent", "How can I help?").alias("question"))


@query("h11_fence_strip", "SELECT event_id, props AS body FROM events")
def h11(spark, d):
    c = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", text.without_fence(c).alias("body"))


@query("h12_type_clean", "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN lower(replace(p_type, ' ', '')) END AS entity_type FROM part")
def h12(spark, d):
    k = F.col("p_partkey") % 4
    c = F.when(k == 0, F.concat("p_type", F.lit(" (x)"))).when(k == 1, F.concat(F.lit(" , "), "p_type", F.lit(",other"))).otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", text.entity_type(c).alias("entity_type"))


@query("h13_partition", "SELECT doc_id, split_part(text, chr(10), 1) AS entity_name, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS description FROM documents")
def h13(spark, d):
    return table(spark, d, "documents").select("doc_id", text.head_line(F.col("text")).alias("entity_name"), text.tail_lines(F.col("text")).alias("description"))


@query("h15_media_type", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/webp' ELSE 'image/jpeg' END AS media_type FROM pages")
def h15(spark, d):
    k = F.col("page_id") % 4
    path = F.concat(F.lit("/a.b/"), F.col("page_id"), F.when(k == 0, ".PNG").when(k == 1, ".webp").when(k == 2, ".jpg").otherwise(""))
    return table(spark, d, "pages").select("page_id", text.media_type(path).alias("media_type"))


@query("h16_collection_name", "SELECT DISTINCT 'classroom_' || lang || '__chunks' AS collection FROM documents")
def h16(spark, d):
    return table(spark, d, "documents").select(F.concat_ws("__", F.concat(F.lit("classroom_"), F.col("lang")), F.lit("chunks")).alias("collection")).distinct()


@query("h17_label_escape", "SELECT p_partkey, '`' || replace(p_brand || '`', '`', '``') || '`' AS quoted, regexp_replace(p_name, '[^A-Za-z0-9_]+', '_', 'g') AS safe FROM part")
def h17(spark, d):
    return table(spark, d, "part").select("p_partkey", text.quoted_label(F.concat("p_brand", F.lit("`"))).alias("quoted"), text.safe_label(F.col("p_name")).alias("safe"))


@query("h18_relation_key", "SELECT DISTINCT least('s' || l_suppkey, 'p' || l_partkey) || '<SEP>' || greatest('s' || l_suppkey, 'p' || l_partkey) AS relation_key FROM lineitem")
def h18(spark, d):
    return table(spark, d, "lineitem").select(text.pair_key(F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey"))).alias("relation_key")).distinct()


@query("h19_source_str", "SELECT doc_id, source || '<SEP>' || lang AS joined FROM documents")
def h19(spark, d):
    return table(spark, d, "documents").select("doc_id", text.joined_ids(F.array(F.col("source"), F.lit(""), F.lit(None).cast("string"), F.col("lang"))).alias("joined"))


@query("h20_reserved", "SELECT DISTINCT role, lower(upper(role)) IN ('system', 'assistant') AS reserved FROM conversations")
def h20(spark, d):
    return table(spark, d, "conversations").select("role", F.lower(F.upper("role")).isin("system", "assistant").alias("reserved")).distinct()


@query("h21_strip_whitespace", f"SELECT doc_id, {strip_sql('text')} AS stripped FROM documents")
def h21(spark, d):
    return table(spark, d, "documents").select("doc_id", text.strip(F.concat(F.lit(" \t \n"), F.col("text"), F.lit(" \r\n"))).alias("stripped"))


NOW = "2024-02-01"


@query("i02_add_days", "SELECT event_id, TIMESTAMP '2024-02-01' + to_days(CAST([0, 1, 3, 7, 14][CAST(event_id % 5 AS INTEGER) + 1] AS INTEGER)) AS next_review_at FROM events")
def i02(spark, d):
    return table(spark, d, "events").select("event_id", scores.due(F.lit(NOW).cast("timestamp_ntz"), (F.col("event_id") % 5 + 1).cast("int")).alias("next_review_at"))


@query("i03_cutoff", "SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE AND event_type = 'error'")
def i03(spark, d):
    events = table(spark, d, "events")
    latest = events.agg(F.max("ts").alias("latest"))
    return events.where("event_type = 'error'").crossJoin(F.broadcast(latest)).where(F.col("ts") < F.col("latest") - F.expr("INTERVAL 5 MINUTES")).select("event_id")


@query("i04_elapsed", "SELECT user_id, round(epoch_us(max(ts) - min(ts)) / 1e6, 2) AS elapsed_s FROM events GROUP BY user_id")
def i04(spark, d):
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return table(spark, d, "events").groupBy("user_id").agg(F.round(span, 2).alias("elapsed_s"))


@query("i05_iso", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS cached_at FROM orders")
def i05(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("cached_at"))


@query("j05_embed_cost", "SELECT doc_id, round(len(regexp_extract_all(text, '\\S+')) / 1000.0 * CASE doc_id % 3 WHEN 0 THEN 0.00002 WHEN 1 THEN 0.00013 ELSE 0.0001 END, 9) AS cost FROM documents")
def j05(spark, d):
    k = F.col("doc_id") % 3
    model = F.when(k == 0, "text-embedding-3-small").when(k == 1, "text-embedding-3-large").otherwise("other")
    return table(spark, d, "documents").select("doc_id", F.round(scores.embedding_cost(text.word_count(F.col("text")), model), 9).alias("cost"))


@query("j06_chat_cost", "SELECT doc_id, round(n_chars / 1000.0 * CASE WHEN doc_id % 2 = 0 THEN 0.03 ELSE 0.0015 END + (n_chars // 4) / 1000.0 * CASE WHEN doc_id % 2 = 0 THEN 0.06 ELSE 0.002 END, 9) AS cost FROM documents")
def j06(spark, d):
    model = F.when(F.col("doc_id") % 2 == 0, "gpt-4").otherwise("other")
    return table(spark, d, "documents").select("doc_id", F.round(scores.chat_cost(F.col("n_chars"), text.estimated_tokens(F.col("text")), model), 9).alias("cost"))


@query("j07_eval_cost", "SELECT item_id, round(n * 15 / 1e6 + n * 10 * 5 / 1e6, 6) AS cost FROM (SELECT item_id, len(regexp_extract_all(text, '\\S+')) AS n FROM benchmark)")
def j07(spark, d):
    return table(spark, d, "benchmark").select("item_id", scores.answer_cost(text.word_count(F.col("text"))).alias("cost"))


@query("j08_ocr_coverage", "SELECT p_partkey, p_size * p_size * 2 / 2500.0 > 0.5 AND p_retailprice > 300 AS text_only FROM part")
def j08(spark, d):
    boxes = F.array(F.struct(F.col("p_size").alias("w"), F.col("p_size").alias("h")), F.struct(F.col("p_size").alias("w"), F.col("p_size").alias("h")))
    area = F.aggregate(boxes, F.lit(0.0), lambda s, b: s + b["w"] * b["h"])
    return table(spark, d, "part").select("p_partkey", scores.text_only(area, F.lit(2500.0), F.col("p_retailprice")).alias("text_only"))


@query("j09_box_step", "SELECT event_id, CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN least(b + 1, 5) WHEN event_type IN ('view', 'click') THEN greatest(b - 1, 1) ELSE 1 END AS BIGINT) AS box FROM (SELECT *, event_id % 5 + 1 AS b FROM events)")
def j09(spark, d):
    e = F.col("event_type")
    answer = F.when(e.isin("purchase", "signup"), "know").when(e.isin("view", "click"), "unsure").otherwise("forgot")
    return table(spark, d, "events").select("event_id", scores.next_box(F.col("event_id") % 5 + 1, answer).cast("long").alias("box"))


@query("j10_clamp", "SELECT doc_id, greatest(30000 - n_chars - 8000, 2000) AS chunk_budget FROM documents")
def j10(spark, d):
    return table(spark, d, "documents").select("doc_id", F.greatest(30000 - F.col("n_chars") - 8000, F.lit(2000)).cast("long").alias("chunk_budget"))


@query("j11_len4", "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def j11(spark, d):
    return table(spark, d, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


@query("j12_dim_check", "SELECT vec_id FROM embeddings WHERE len(embedding) <> 64")
def j12(spark, d):
    return table(spark, d, "embeddings").where(F.size("embedding") != 64).select("vec_id")


@query("g01_ordered_union", "SELECT doc_id, array_to_string([source, lang] || CASE WHEN doc_id % 2 = 0 THEN [] ELSE ['x' || doc_id % 5] END, ',') AS ids FROM documents")
def g01(spark, d):
    new = F.array(F.col("lang"), F.lit(""), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.concat(F.lit("x"), F.col("doc_id") % 5)))
    return table(spark, d, "documents").select("doc_id", F.array_join(arrays.ordered_union(F.array("source", "lang"), new), ",").alias("ids"))


@query("g02_keyword_union", "SELECT source, string_agg(DISTINCT k, ',' ORDER BY k) AS keywords FROM (SELECT source, unnest([lang, 'k' || doc_id % 3]) AS k FROM documents) GROUP BY source")
def g02(spark, d):
    words = F.concat(F.col("lang"), F.lit(" ,, k"), F.col("doc_id") % 3)
    return table(spark, d, "documents").groupBy("source").agg(arrays.keyword_union(F.collect_set(words)).alias("keywords"))


@query("g03_source_limit", "SELECT o_custkey, array_to_string(ids[greatest(len(ids) - 2, 1):], ',') AS fifo, array_to_string(ids[:3], ',') AS keep FROM (SELECT o_custkey, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey)")
def g03(spark, d):
    ids = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    return ids.select("o_custkey", F.array_join(arrays.limited(F.col("ids"), 3, "FIFO"), ",").alias("fifo"), F.array_join(arrays.limited(F.col("ids"), 3, "KEEP"), ",").alias("keep"))


@query("g04_file_paths", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || ',' || lang ELSE source || ',' || lang || ',z' END AS paths FROM documents")
def g04(spark, d):
    new = F.array("lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.lit("z")))
    return table(spark, d, "documents").select("doc_id", F.array_join(arrays.merged_paths(F.array("source"), new), ",").alias("paths"))


@query("g07_dict_from_keys", "SELECT o_custkey, array_to_string(list(CAST(p AS VARCHAR) ORDER BY f)[:5], ',') AS ids FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) GROUP BY o_custkey")
def g07(spark, d):
    seen = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("s"))
    return seen.select("o_custkey", F.array_join(arrays.first_distinct(F.col("s.o_orderpriority"), 5), ",").alias("ids"))


@query("k12_chat_pack", "SELECT conv_id, string_agg(CASE WHEN i % 2 = 0 THEN 'user:' ELSE 'assistant:' END || length(text), '|' ORDER BY i) AS packed FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY conv_id")
def k12(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("size")))).alias("t"))
    packed = F.transform(arrays.alternate_roles(F.col("t.size")), lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return turns.select("conv_id", F.array_join(packed, "|").alias("packed"))


@query("k13_meta_flatten", "SELECT event_id, json_extract_string(props, '$.k') AS k, '' AS missing FROM events")
def k13(spark, d):
    meta = F.from_json("props", "map<string,string>")
    flat = F.transform_values(F.map_concat(meta, F.create_map(F.lit("missing"), F.lit(None).cast("string"))), lambda _, v: F.coalesce(v, F.lit("")))
    return table(spark, d, "events").select("event_id", flat["k"].alias("k"), flat["missing"].alias("missing"))


@query("k04_from_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def k04(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("k01_parse_json", "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def k01(spark, d):
    k, p = F.col("event_id") % 4, F.col("props")
    said = F.when(k == 0, F.concat(F.lit("<think>{</think>```json\n"), p, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Sure: "), p, F.lit(" as asked"))).when(k == 2, p).otherwise(F.lit("none {"))
    return table(spark, d, "events").select("event_id", F.from_json(text.json_text(said), "k long")["k"].alias("k"))
