"""Context assembly, injected models, answers, mind maps, the agent and modal items.

The offline model answers with a prompt's first twelve words, so that SQL can state the same rows.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.functions import arrow_text
from brookwell.functions import text as T
from brookwell.operators import context, models, packing, tree, vectors
from brookwell.operators.kept import kept
from brookwell.plans.base import CHUNKS, DOCS, EDGES, NODES, VECTORS, asked, chunks, edges, nodes, query, table
from brookwell.plans.base import vectors as vector_table
from brookwell.plans.fixtures import ITEMS, raw_items
from brookwell.plans.merge_queries import ANY, DESCRIBED, FOUND, STEERED, found_entities, place, refuses, steered
from brookwell.plans.retrieval_queries import L2, MANY, ONE, PREFIX, scored, top
from brookwell.sources import office

TWELVE = r"array_to_string(regexp_extract_all({}, '\S+')[1:12], ' ')"


def in_order(order, *columns):
    """Collected structs of a short ranked list, in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, *columns))), lambda x: F.struct(*(x[c].alias(c) for c in columns)))


# Context assembly

HITS = f"{VECTORS}, {MANY}, {scored()}, {top(5)}, {NODES}, {EDGES}"
JSON_ROW = "'  {{' || chr(10) || {} || chr(10) || '  }}'"
FIELD = "'    \"{0}\": ' || coalesce(CAST(to_json({1}) AS VARCHAR), 'null')"
LISTED = "CASE WHEN count(*) = 0 THEN '[]' ELSE '[' || chr(10) || string_agg({0}, ',' || chr(10) ORDER BY {1}) || chr(10) || ']' END"


def json_row(**fields):
    return JSON_ROW.format(" || ',' || chr(10) || ".join(FIELD.format(k, v) for k, v in fields.items()))


PARTS = f"""e AS (SELECT query_id, {LISTED.format(json_row(name="entity_id", type="entity_type", description="description"), "rank")} AS entities FROM t JOIN nodes ON entity_id = 'p:' || vec_id GROUP BY query_id),
touched AS (SELECT DISTINCT query_id, src, tgt, weight FROM t JOIN edges ON src = 'p:' || vec_id OR tgt = 'p:' || vec_id),
r AS (SELECT query_id, {LISTED.format(JSON_ROW.format(FIELD.format("src", "src") + " || ',' || chr(10) || " + FIELD.format("tgt", "tgt") + " || ',' || chr(10) || '    \"weight\": ' || CAST(CAST(round(weight, 2) AS DECIMAL(18,2)) AS VARCHAR)"), "n")} AS relations FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, src, tgt) AS n FROM touched) WHERE n <= 10 GROUP BY query_id),
f AS (SELECT query_id, content, min(rank) AS rank, arg_min(file_path, rank) AS file_path FROM t WHERE content <> '' GROUP BY query_id, content),
c AS (SELECT query_id, {LISTED.format(json_row(content="content", file_path="file_path"), "rank")} AS chunks FROM f GROUP BY query_id),
p AS (SELECT query_id, string_agg('[' || n || '] ' || file_path, chr(10) ORDER BY n) AS refs, count(*) AS n_refs FROM (SELECT query_id, file_path, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS n FROM f GROUP BY query_id, file_path) GROUP BY query_id)"""
FENCE = "{0} || ':' || chr(10) || chr(10) || '```{1}' || chr(10) || {2} || chr(10) || '```' || chr(10)"
NAIVE_CONTEXT = "chr(10) || " + " || chr(10) || ".join([FENCE.format("'Document Chunks'", "json", "chunks"), FENCE.format("'Reference Document List'", "", "refs")]) + " || chr(10)"
GRAPH_CONTEXT = "chr(10) || " + " || chr(10) || ".join([FENCE.format("'Knowledge Graph Data (Entities)'", "json", "coalesce(entities, '[]')"), FENCE.format("'Knowledge Graph Data (Relationships)'", "json", "coalesce(relations, '[]')"), FENCE.format("'Document Chunks'", "json", "chunks"), FENCE.format("'Reference Document List'", "", "refs")]) + " || chr(10)"


def assembled(spark, d):
    """(query_id, entities, relations, chunks) of every asked vector, each a short list: its nearest nodes, the heaviest edges at them, and their texts. The hits are found once."""
    found = vectors.top_k(vector_table(spark, d), asked(spark, d), 5, "vec_id", threshold=-1.0).select("query_id", "vec_id", "rank", "content", "file_path")
    hits = kept(found.withColumn("entity_id", F.concat(F.lit("p:"), "vec_id")), "hits")
    named = nodes(spark, d).drop("file_path").join(hits.select("query_id", "rank", "entity_id"), "entity_id")
    entities = named.select("query_id", "rank", F.col("entity_id").alias("name"), F.col("entity_type").alias("type"), "description").groupBy("query_id").agg(in_order("rank", "name", "type", "description").alias("entities"))
    both = lambda end: edges(spark, d).join(hits.select("query_id", F.col("entity_id").alias(end)), end).select("query_id", "src", "tgt", "weight")
    touched = both("src").union(both("tgt")).distinct()
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "src", "tgt"))
    most = touched.withColumn("n", n).where("n <= 10").withColumn("weight", F.col("weight").cast("decimal(18,2)"))
    relations = most.groupBy("query_id").agg(in_order("n", "src", "tgt", "weight").alias("relations"))
    texts = hits.groupBy("query_id").agg(context.distinct_chunks(in_order("rank", "content", "file_path")).alias("chunks"))
    out = texts.join(entities, "query_id", "left").join(relations, "query_id", "left")
    return out.withColumn("entities", F.coalesce("entities", F.array().cast(out.schema["entities"].dataType))).withColumn("relations", F.coalesce("relations", F.array().cast(out.schema["relations"].dataType)))


@query("l23_context", f"WITH {HITS}, {PARTS} SELECT query_id, {GRAPH_CONTEXT} AS context FROM c JOIN p USING (query_id) LEFT JOIN e USING (query_id) LEFT JOIN r USING (query_id)")
def l23(spark, d):
    return assembled(spark, d).where(F.size("chunks") > 0).select("query_id", context.graph_context(F.col("entities"), F.col("relations"), F.col("chunks")).alias("context"))


PROMPT = "'Answer from the context only. Response style: Multiple Paragraphs. Additional instructions: n/a' || chr(10) || chr(10) || '---Context---' || chr(10) || chr(10) || {0} || chr(10) || chr(10) || '---User Query---' || chr(10) || chr(10) || 'question ' || query_id"


@query("l26_prompt", f"WITH {HITS}, {PARTS} SELECT query_id, 'context' AS asked_for, {GRAPH_CONTEXT} AS content FROM c JOIN p USING (query_id) LEFT JOIN e USING (query_id) LEFT JOIN r USING (query_id) UNION ALL SELECT query_id, 'prompt', {PROMPT.format(GRAPH_CONTEXT)} FROM c JOIN p USING (query_id) LEFT JOIN e USING (query_id) LEFT JOIN r USING (query_id)")
def l26(spark, d):
    """Early returns: only the context, or the whole prompt."""
    made = kept(l23(spark, d), "contexts")
    asked_for = made.select("query_id", F.lit("context").alias("asked_for"), F.col("context").alias("content"))
    return asked_for.union(made.select("query_id", F.lit("prompt"), context.prompt(F.col("context"), F.concat(F.lit("question "), "query_id"))))


@query("k03_json_dump", f"SELECT n_regionkey, {LISTED.format(JSON_ROW.format(FIELD.format('name', 'n_name') + " || ',' || chr(10) || '    \"key\": ' || n_nationkey || ',' || chr(10) || '    \"note\": null'"), 'n_nationkey')} AS dump FROM nation GROUP BY n_regionkey")
def k03(spark, d):
    """A list of objects as indented JSON; nulls stay."""
    rows = table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("note"))
    listed = rows.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("key", "name", "note"))).alias("rows"))
    return listed.select("n_regionkey", context.indented(F.col("rows"), {"name": False, "key": True, "note": False}).alias("dump"))


# Model output

SAID = """CASE event_id % 6 WHEN 0 THEN 'fine' WHEN 1 THEN 'fenced' WHEN 2 THEN 'commas' WHEN 3 THEN 'quotes' WHEN 4 THEN 'broken' ELSE 'thought' END"""


@query("k02_robust_json", f"SELECT event_id, 'about ' || event_id AS detailed_description, {SAID} AS entity_name, event_type AS entity_type, 'sum {{' || user_id || '}}' AS summary FROM events")
def k02(spark, d):
    """Analyses as models give them: clean, fenced, with trailing commas, smart quotes, cut off, after thoughts."""
    e, k = table(spark, d, "events"), F.col("event_id") % 6
    name = F.element_at(F.array(*(F.lit(x) for x in ("fine", "fenced", "commas", "quotes", "broken", "thought"))), (k + 1).cast("int"))
    info = F.concat(F.lit('{"entity_name": "'), name, F.lit('", "entity_type": "'), F.col("event_type"), F.lit('", "summary": "sum {'), F.col("user_id"), F.lit('}"'))
    clean = F.concat(F.lit('{"detailed_description": "about '), F.col("event_id"), F.lit('", "entity_info": '), info)
    whole = F.concat(clean, F.lit("}}"))
    said = (
        F.when(k == 0, whole).when(k == 1, F.concat(F.lit("Here:\n```json\n"), whole, F.lit("\n```\nDone"))).when(k == 2, F.concat(clean, F.lit(",},\n}")))
        .when(k == 3, F.concat(F.lit("Sure. "), F.translate(whole, '"', "”"))).when(k == 4, F.concat(clean, F.lit(", ..."))).otherwise(F.concat(F.lit("<thinking>{a}</thinking>"), whole))
    )
    return e.select("event_id", arrow_text.analyses(said).alias("a")).select("event_id", "a.*")


@query("n10_structured", "SELECT event_id, length(event_type) BETWEEN 2 AND 120 AND 3 * length(event_type) BETWEEN 20 AND 400 AND user_id % 10 BETWEEN 2 AND 8 AS valid FROM events")
def n10(spark, d):
    """A topic and its children within the bounds of the schema; what doesn't parse is not valid."""
    kind = F.struct(F.col("event_type").alias("topic"), F.repeat("event_type", 3).alias("description"), F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("user_id") % 10).cast("int"))).alias("children"))
    said = table(spark, d, "events").select("event_id", F.to_json(kind).alias("said"), (F.col("user_id") % 10).alias("n"))
    got = F.from_json("said", "topic string, description string, children array<int>")
    fits = F.length(got["topic"]).between(2, 120) & F.length(got["description"]).between(20, 400) & F.size(got["children"]).between(2, 8) & (F.col("n") >= 2)
    return said.select("event_id", F.coalesce(fits, F.lit(False)).alias("valid"))


@query("n01_llm", f"SELECT conv_id, turn, {TWELVE.format("coalesce(before || chr(10), '') || text")} AS answer FROM (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE role = 'user'")
def n01(spark, d):
    """A user's turn with the turn before it, answered by the injected model."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    asked_ = table(spark, d, "conversations").withColumn("before", before).where("role = 'user'")
    return asked_.select("conv_id", "turn", models.answered(F.concat(F.coalesce(F.concat("before", F.lit("\n")), F.lit("")), "text")).alias("answer"))


@query("n03_embedding", "SELECT item_id, length(text)::DOUBLE AS size, 3::BIGINT AS dimensions FROM benchmark")
def n03(spark, d):
    """An injected embedder in batches, its dimensions checked."""
    made = models.embedded(F.col("text"), lambda texts: [[len(t), 1.0, 0.0] for t in texts], 3)
    return table(spark, d, "benchmark").select("item_id", made.alias("v")).select("item_id", F.col("v")[0].cast("double").alias("size"), F.size("v").cast("long").alias("dimensions"))


@query("n05_key_fn", r"SELECT source, doc_id FROM (SELECT source, doc_id, sum(len(regexp_extract_all(coalesce(source, '') || ' ' || text, '\S+'))) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents) WHERE total <= 500")
def n05(spark, d):
    """A prefix of each list by the tokens of a projection that the caller gives."""
    key = F.concat(F.coalesce("source", F.lit("")), F.lit(" "), "text")
    return packing.token_prefix(table(spark, d, "documents"), ["source"], ["doc_id"], T.word_count(key), 500).select("source", "doc_id")


@query("l12_summarise", rf"""WITH {FOUND}, u AS (SELECT name, description, min(o) AS o FROM ents GROUP BY name, description), j AS (SELECT name, o, '{{"Description": ' || CAST(to_json(description) AS VARCHAR) || '}}' AS line FROM u),
b AS (SELECT *, sum(len(regexp_extract_all(line, '\S+'))) OVER (PARTITION BY name ORDER BY o ROWS UNBOUNDED PRECEDING) AS total FROM j), s AS (SELECT name, count(*) AS used, string_agg(line, chr(10) ORDER BY o) AS lines FROM b WHERE total <= 12 GROUP BY name)
SELECT name, used, {TWELVE.format("'Summarise ' || name || ':' || chr(10) || lines")} AS summary FROM s""")
def l12(spark, d):
    """Descriptions of each name as JSON lines within a budget of tokens, summarised by the injected model through a cache."""
    seen = found_entities(spark, d).groupBy("name", "description").agg(F.min(place()).alias("o"))
    lines = seen.select("name", "o", F.concat(F.lit('{"Description": '), T.json_quoted(F.col("description")), F.lit("}")).alias("line"))
    some = packing.token_prefix(lines, ["name"], ["o"], T.word_count(F.col("line")), 12)
    listed = some.groupBy("name").agg(F.count("*").alias("used"), F.array_sort(F.collect_list(F.struct("o", "line"))).alias("l"))
    prompts = listed.select("name", "used", F.concat(F.lit("Summarise "), "name", F.lit(":\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("prompt"))
    cache = spark.createDataFrame([], "key string, content string, create_time long")
    return models.with_cache(prompts, cache, "summary")[0].select("name", "used", F.col("answer").alias("summary"))


@query("l08_extract", rf"WITH {CHUNKS}, u AS (SELECT DISTINCT chunk_id, content FROM chunks WHERE tokens >= 30) SELECT chunk_id, len(regexp_extract_all(content, '[A-Z][a-z]{{3,}}')) AS entities FROM u")
def l08(spark, d):
    """Chunks of enough tokens, each distinct one sent once to the injected extractor, whose records are parsed."""
    import re

    def extractor(texts):
        return ["\n".join(f"entity{T.FIELD}{x}{T.FIELD}thing{T.FIELD}{x} here" for x in re.findall("[A-Z][a-z]{3,}", t)) + f"\n{T.DONE}" for t in texts]

    from brookwell.operators import mentions

    wanted = chunks(spark, d).where("tokens >= 30").select("chunk_id", F.col("content").alias("prompt"))
    cache = spark.createDataFrame([], "key string, content string, create_time long")
    _, new = models.with_cache(wanted, cache, "extract", model=extractor)
    found = mentions.entities(mentions.records(new.select("key", F.col("content").alias("result")))).groupBy("key").agg(F.count("*").alias("entities"))
    keys = wanted.select("chunk_id", F.concat(F.lit("extract:"), F.md5("prompt")).alias("key")).distinct()
    return keys.join(found, "key", "left").select("chunk_id", F.coalesce("entities", F.lit(0)).alias("entities"))


@query("p16_file_summary", f"SELECT doc_id, CASE WHEN trim(substring(text, 1, 4000)) = '' OR text IS NULL THEN 'Document: ' || source ELSE {TWELVE.format("'Summarise: ' || substring(text, 1, 4000)")} END AS summary FROM documents")
def p16(spark, d):
    """A summary of each file's first 4000 characters (the feature's own bound); the file's name where it has no text."""
    head = F.substring("text", 1, 4000)
    prompt = F.when(T.strip(head) != "", F.concat(F.lit("Summarise: "), head))
    return table(spark, d, "documents").select("doc_id", F.coalesce(models.answered(prompt), F.concat(F.lit("Document: "), "source")).alias("summary"))


@query("l36_rouge", None)
def l36(spark, d):
    """ROUGE-L of each benchmark text against the next."""
    b = table(spark, d, "benchmark")
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next")), "item_id")
    return pairs.select("item_id", F.round(arrow_text.rouge_ls(F.col("text"), F.col("next")), 6).alias("rouge_l"))


# Answers

CLOSEST = f"{VECTORS}, {MANY}, {L2}, t AS (SELECT d.*, content, file_path FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) d JOIN vecs USING (vec_id) WHERE rank <= 5)"


@query("l40_legacy_answer", f"WITH {CLOSEST}, h AS (SELECT conv_id AS query_id, count(*) AS history FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5 GROUP BY 1) SELECT query_id, CASE WHEN avg(distance) < 0.3 THEN 'high' WHEN avg(distance) < 0.5 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS chunks_used, any_value(coalesce(history, 0)) AS history, string_agg(file_path || ': ' || left(content, 150) || '...', chr(10) ORDER BY rank) FILTER (rank <= 3) AS sources FROM t LEFT JOIN h USING (query_id) GROUP BY query_id")
def l40(spark, d):
    """Five nearest chunks, previews of the first three as sources, the last five turns as history, and a grade of the mean distance."""
    from brookwell.functions.scores import confidence

    found = vectors.by_distance(vector_table(spark, d), asked(spark, d), 5, "vec_id")
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", F.concat("file_path", F.lit(": "), F.substring("content", 1, 150), F.lit("...")).alias("line"))))), lambda x: x["line"])
    said = found.groupBy("query_id").agg(confidence(F.avg("distance")).alias("confidence"), F.count("*").alias("chunks_used"), F.array_join(lines, "\n").alias("sources"))
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    history = table(spark, d, "conversations").withColumn("r", r).where("r <= 5").groupBy(F.col("conv_id").alias("query_id")).agg(F.count("*").alias("history"))
    return said.join(history, "query_id", "left").select("query_id", "confidence", "chunks_used", F.coalesce("history", F.lit(0)).alias("history"), "sources")


@query("l41_chain_answer", f"SELECT conv_id, turn, CASE WHEN before IS NULL THEN text ELSE {TWELVE.format("'Rephrase: ' || before || chr(10) || text")} END AS question FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role <> 'system') WHERE role = 'user'")
def l41(spark, d):
    """The question that the retriever gets: condensed with the history by the injected model, or as it is without history."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, d, "conversations").where("role <> 'system'").withColumn("before", before).where("role = 'user'")
    condensed = models.answered(F.when(F.col("before").isNotNull(), F.concat(F.lit("Rephrase: "), "before", F.lit("\n"), "text")))
    return turns.select("conv_id", "turn", F.coalesce(condensed, "text").alias("question"))


@query("l45_deck_context", f"WITH {VECTORS}, {ONE}, {scored()}, {top(25)}, {PREFIX.replace('FROM t', 'FROM t WHERE similarity >= 0.2 AND length(content) > 0')} SELECT rank, vec_id, CAST(total AS BIGINT) AS tokens_upto FROM p WHERE total <= 29500")
def l45(spark, d):
    """Naive retrieval of 25 chunks for one broad question."""
    found = vectors.top_k(vector_table(spark, d), asked(spark, d, 7), 25, "vec_id").where(F.length("content") > 0)
    total = F.sum(T.word_count(F.col("content"))).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("tokens_upto", total).where("tokens_upto <= 29500").select("rank", "vec_id", "tokens_upto")


# Mind maps


@query("k08_assemble_tree", "SELECT n_regionkey AS tree, printf('n_%04d', row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, c NULLS FIRST)) AS node_id, topic, CASE WHEN c IS NULL THEN 1 ELSE 2 END::BIGINT AS depth, c IS NULL AND kids > 0 AS has_children FROM (SELECT n_regionkey, n_nationkey, NULL AS c, trim(n_name) AS topic, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS kids FROM nation UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, c_name, 0 FROM nation JOIN customer ON c_nationkey = n_nationkey)")
def k08(spark, d):
    """Numbered nodes of a tree for each region: nations, then customers."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("tree"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("n_nationkey").cast("long").alias("pos"), T.strip(F.col("n_name")).alias("topic"), "n_nationkey")
    c = table(spark, d, "customer").join(n.select("tree", "n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey")).select("tree", F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.col("c_custkey"), F.col("c_name"))
    return tree.preorder(n.drop("n_nationkey").union(c), "tree", "id", "parent", "pos").select("tree", "node_id", "topic", "depth", "has_children")


AGENT = f"WITH s AS (SELECT conv_id, turn, role, '@Helper ' || {STEERED} AS said FROM conversations), c AS (SELECT *, trim(replace(said, '@Helper', '')) AS q FROM s WHERE role = 'user')"


@query("l49_agent", AGENT + " SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 3 THEN 'discarded' WHEN conv_id % 5 = 0 THEN 'indexing' WHEN regexp_matches(q, '" + ANY.replace("'", "''") + "') THEN 'refused' ELSE 'answered' END AS route, CASE WHEN q = '' THEN 'Can you help me understand this document?' ELSE q END AS question FROM c")
def l49(spark, d):
    """What the group's agent does with a mention: nothing for discarded turns, a notice while the file is indexed, a refusal of steering, else an answer."""
    m = steered(spark, d).where("role = 'user'").withColumn("said", F.concat(F.lit("@Helper "), "said"))
    question = T.without_mention(F.col("said"), "Helper", "Can you help me understand this document?")
    route = F.when((F.col("conv_id") + F.col("turn")) % 7 == 3, "discarded").when(F.col("conv_id") % 5 == 0, "indexing").when(question.rlike(ANY), "refused").otherwise("answered")
    return m.select("conv_id", "turn", route.alias("route"), question.alias("question"))


# Modal items

NAMED = "name AS (SELECT *, type || '_' || left(md5(CASE type WHEN 'image' THEN img_path WHEN 'table' THEN table_body ELSE text END), 8) AS entity FROM items WHERE type <> 'text' AND coalesce(trim(CASE type WHEN 'image' THEN img_path WHEN 'table' THEN table_body ELSE text END), '') <> '')"


def modal(spark, d):
    """(doc_id, type, body, caption, entity) of every image, table and equation; equations without text go."""
    body = F.when(F.col("type") == "image", F.col("img_path")).when(F.col("type") == "table", F.col("table_body")).otherwise(F.col("text"))
    rows = office.items(raw_items(spark, d)).where("type <> 'text'").withColumn("body", body).where(T.strip(F.coalesce("body", F.lit(""))) != "")
    return rows.select("doc_id", "type", "body", "caption", F.concat("type", F.lit("_"), F.substring(F.md5("body"), 1, 8)).alias("entity"))


@query("n02_vision", f"WITH {ITEMS} SELECT doc_id, img_path, 'An image ' || img_path || ' ' || caption AS seen FROM items WHERE type = 'image'")
def n02(spark, d):
    """What an injected vision model says of each image; the offline one names the image and its caption."""
    seen = models.answered(F.concat_ws(" ", F.lit("An image"), "body", "caption"), lambda texts: texts)
    return modal(spark, d).where("type = 'image'").select("doc_id", F.col("body").alias("img_path"), seen.alias("seen"))


@query("n09_ocr", f"WITH {ITEMS} SELECT doc_id, caption AS text, length(caption) >= 9 AS is_text_only FROM items WHERE type = 'image'")
def n09(spark, d):
    """What an injected reader finds in each image, and whether it is text only; the offline one reads the caption."""
    read = models.answered(F.col("caption"), lambda texts: texts)
    return modal(spark, d).where("type = 'image'").select("doc_id", read.alias("text")).select("doc_id", "text", (F.length("text") >= 9).alias("is_text_only"))


@query("l32_image", f"WITH {ITEMS} SELECT doc_id, md5(img_path || caption) AS cache_key, CASE WHEN length(caption) >= 9 THEN 'text_only' ELSE 'vision' END AS path, CASE WHEN length(caption) >= 9 THEN caption ELSE 'An image ' || img_path || ' ' || caption END AS description FROM items WHERE type = 'image'")
def l32(spark, d):
    """Images that are text only are taken as their text; the others are described by the vision model, cached by digest."""
    rows = modal(spark, d).where("type = 'image'")
    text_only = F.length("caption") >= 9
    seen = models.answered(F.when(~text_only, F.concat_ws(" ", F.lit("An image"), "body", "caption")), lambda texts: texts)
    return rows.select("doc_id", F.md5(F.concat("body", "caption")).alias("cache_key"), F.when(text_only, "text_only").otherwise("vision").alias("path"), F.coalesce(seen, "caption").alias("description"))


@query("l33_table", f"WITH {ITEMS}, {NAMED} SELECT doc_id, entity, md5(table_body || caption) AS cache_key, 'Table: ' || caption || chr(10) || left(CAST(to_json(table_body) AS VARCHAR), 1000) || chr(10) || {TWELVE.format('left(CAST(to_json(table_body) AS VARCHAR), 2000)')} AS chunk FROM name WHERE type = 'table'")
def l33(spark, d):
    """A table's chunk: caption, its body as JSON cut at 1000 characters, and the model's words on the body cut at 2000."""
    body = T.json_quoted(F.col("body"))
    said = models.answered(F.substring(body, 1, 2000))
    chunk = F.concat(F.lit("Table: "), "caption", F.lit("\n"), F.substring(body, 1, 1000), F.lit("\n"), said)
    return modal(spark, d).where("type = 'table'").select("doc_id", "entity", F.md5(F.concat("body", "caption")).alias("cache_key"), chunk.alias("chunk"))


@query("l34_equation", f"WITH {ITEMS}, {NAMED} SELECT doc_id, entity, 'Equation: ' || text || chr(10) || text AS chunk FROM name WHERE type = 'equation'")
def l34(spark, d):
    said = models.answered(F.col("body"))
    return modal(spark, d).where("type = 'equation'").select("doc_id", "entity", F.concat(F.lit("Equation: "), "body", F.lit("\n"), said).alias("chunk"))


@query("l31_modal_insert", rf"WITH {ITEMS}, {NAMED}, w AS (SELECT doc_id, entity, unnest(list_distinct(regexp_extract_all(body, '[A-Z][a-z]{{3,}}'))) AS found FROM (SELECT doc_id, entity, CASE type WHEN 'image' THEN img_path WHEN 'table' THEN table_body ELSE text END AS body FROM name)) SELECT doc_id, 'node' AS kind, entity AS src, NULL AS tgt, NULL AS weight FROM name UNION ALL SELECT doc_id, 'belongs_to', found, entity, '1.0' FROM w WHERE found <> entity")
def l31(spark, d):
    """Each modal item's root node, and an edge to it from each entity that its description names."""
    rows = modal(spark, d)
    none = F.lit(None).cast("string")
    root = rows.select("doc_id", F.lit("node").alias("kind"), F.col("entity").alias("src"), none.alias("tgt"), none.alias("weight"))
    found = rows.select("doc_id", "entity", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit("[A-Z][a-z]{3,}"), F.lit(0)))).alias("name")).where("name <> entity")
    return root.union(found.select("doc_id", F.lit("belongs_to"), "name", "entity", F.lit("1.0")))


@query("l35_pipeline", f"WITH {ITEMS}, {DOCS}, g AS (SELECT doc_id, count(*) FILTER (type = 'text') AS texts, count(DISTINCT CASE WHEN type <> 'text' THEN type || coalesce(img_path, table_body, text, '') END) AS modal FROM items GROUP BY doc_id) SELECT doc_id, coalesce(texts, 0) AS texts, coalesce(modal, 0) AS modal, CASE WHEN doc_id % 10 = 9 THEN 'whole_text' WHEN g.doc_id IS NULL THEN 'empty' ELSE 'parsed' END AS status FROM docs LEFT JOIN g USING (doc_id)")
def l35(spark, d):
    """Every document's way through parsing: items separated and distinct, or the whole file as text where parsing fails."""
    found = office.items(raw_items(spark, d))
    key = F.when(F.col("type") != "text", F.concat("type", F.coalesce("img_path", "table_body", "text", F.lit(""))))
    counts = found.groupBy("doc_id").agg(F.count_if(F.col("type") == "text").alias("texts"), F.count_distinct(key).alias("modal"))
    out = table(spark, d, "documents").select("doc_id").join(counts, "doc_id", "left")
    status = F.when(F.col("doc_id") % 10 == 9, "whole_text").when(F.col("texts").isNull(), "empty").otherwise("parsed")
    return out.select("doc_id", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("modal", F.lit(0)).alias("modal"), status.alias("status"))


# Expiry and pushes


@query("m03_ttl", "SELECT user_id, max(ts) + INTERVAL 61 SECOND AS expires_at, max(ts) + INTERVAL 61 SECOND > (SELECT max(ts) FROM events) AS alive FROM events GROUP BY user_id")
def m03(spark, d):
    """When each user's rate state goes: a second after its window; ``streaming.events.allowed_stream`` drops it by event time."""
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg((F.max("ts") + F.expr("INTERVAL 61 SECONDS")).alias("expires_at"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    return last.crossJoin(F.broadcast(now)).select("user_id", "expires_at", (F.col("expires_at") > F.col("now")).alias("alive"))


@query("m06_user_push", "SELECT event_id, user_id + 1 AS target, props AS payload FROM events WHERE event_type = 'purchase' AND user_id + 1 IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def m06(spark, d):
    """Events for one user's own channel, to those who have a connection."""
    e = table(spark, d, "events")
    online = e.where("event_type = 'signup'").select(F.col("user_id").alias("target")).distinct()
    return e.where("event_type = 'purchase'").select("event_id", (F.col("user_id") + 1).alias("target"), F.col("props").alias("payload")).join(online, "target", "left_semi").select("event_id", "target", "payload")
