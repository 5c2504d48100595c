"""Extraction, merging, caching, ingestion, deletion and graph retrieval over the documents.

Capitalised words stand in for a model's entities; each document's output text is
rendered as delimiter records and parsed back, so the whole path is exercised.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.functions import text as T
from brookwell.operators import graph, mentions, packing, store, vectors
from brookwell.operators.kept import kept
from brookwell.plans.base import CHUNKS, DOCS, EDGES, VECTORS, asked, chunks, edges, query, table
from brookwell.plans.base import vectors as vector_table
from brookwell.plans.graph_queries import BOTH
from brookwell.plans.retrieval_queries import ONE, scored, top

NAME = "[A-Z][a-z]{3,}"
TYPE = "CASE (doc_id + length(name)) % 3 WHEN 0 THEN 'place' WHEN 1 THEN 'person' ELSE 'thing' END"
FOUND = f"""found AS (SELECT doc_id, source, unnest(names) AS name, unnest(range(len(names))) AS pos FROM (SELECT doc_id, source, regexp_extract_all(text, '{NAME}') AS names FROM documents)),
ents AS (SELECT doc_id, pos, name, {TYPE} AS type, name || ' of ' || source AS description, doc_id % 4 AS ts, doc_id * 1000000 + pos AS o FROM found),
rels AS (SELECT doc_id, pos, name AS src, tgt, CASE WHEN length(name) % 4 = 0 THEN '2.5' ELSE 'links' END AS description, CASE WHEN length(name) % 4 = 0 THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS weight, 'k' || length(name) || ',both' AS keywords
  FROM (SELECT *, coalesce(lead(name) OVER (PARTITION BY doc_id ORDER BY pos), 'none') AS tgt FROM found) WHERE tgt <> name)"""
W = f"WITH {FOUND}"


def place():
    """A mention's place over all documents."""
    return F.col("doc_id") * 1_000_000 + F.col("pos")


def outputs(spark, d):
    """(doc_id, result): for each document the records that a model would return, entities before relations.

    A third of the outputs has its records glued, half of those end in a lower-case mark; delimiters of the others are damaged at the head.
    """
    docs = table(spark, d, "documents").select("doc_id", "source", F.regexp_extract_all("text", F.lit(NAME), F.lit(0)).alias("names"))
    kind = lambda x: F.element_at(F.array(F.lit("place"), F.lit("person"), F.lit("Thing")), ((F.col("doc_id") + F.length(x)) % 3 + 1).cast("int"))
    f = F.lit(T.FIELD)
    one = F.transform("names", lambda x: F.concat(x, f, kind(x), f, x, F.lit(" of "), F.col("source")))
    value = lambda x: F.when(F.length(x) % 4 == 0, "2.5").otherwise("links")
    two = F.transform("names", lambda x, i: F.concat(x, f, F.coalesce(F.get("names", i + 1), F.lit("none")), f, F.lit("k"), F.length(x), F.lit("，both"), f, value(x)))
    lines = F.concat(F.array_join(F.concat(F.transform(one, lambda x: F.concat(F.lit("entity< # >"), x)), F.transform(two, lambda x: F.concat(F.lit("relation"), f, x))), "\n"), F.lit(f"\n{T.DONE}\n"))
    glue = lambda name, rows: F.array_join(F.concat(F.array(F.lit(name)), rows), f"{T.FIELD}{name}{T.FIELD}")
    glued = F.concat(F.lit("entity"), F.substring(glue("entity", one), len(f"entity{T.FIELD}entity") + 1, 1 << 30), F.substring(glue("relationship", two), len("relationship") + 1, 1 << 30), F.when(F.col("doc_id") % 2 == 0, T.DONE).otherwise(T.DONE.lower()))
    return docs.select("doc_id", F.when((F.col("doc_id") % 3 == 1) & (F.size("names") > 0), glued).otherwise(lines).alias("result"))


def parsed(spark, d):
    return mentions.records(outputs(spark, d))


def found_entities(spark, d, records=None):
    """Entity mentions; of ``records`` that are parsed already, if given."""
    return mentions.entities(parsed(spark, d) if records is None else records).withColumnRenamed("record", "pos").withColumn("ts", F.col("doc_id") % 4).withColumn("chunk", F.col("doc_id").cast("string"))


def found_relations(spark, d, records=None):
    return mentions.relations(parsed(spark, d) if records is None else records)


@query(
    "l05_parse_records",
    f"""{W} SELECT doc_id, pos AS record, 'entity' AS kind, name || '|' || CASE (doc_id + length(name)) % 3 WHEN 0 THEN 'place' WHEN 1 THEN 'person' ELSE 'Thing' END || '|' || name || ' of ' || source AS fields FROM found
UNION ALL SELECT doc_id, pos + n, 'relation', name || '|' || coalesce(lead(name) OVER (PARTITION BY doc_id ORDER BY pos), 'none') || '|k' || length(name) || '，both|' || CASE WHEN length(name) % 4 = 0 THEN '2.5' ELSE 'links' END FROM found JOIN (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id) USING (doc_id)""",
)
def l05(spark, d):
    return parsed(spark, d).select("doc_id", F.col("record").cast("long").alias("record"), "kind", F.array_join(F.slice("attrs", 2, 9), "|").alias("fields"))


@query("l06_parse_entity", f"{W} SELECT doc_id, pos, name, type, description FROM ents")
def l06(spark, d):
    return found_entities(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), "name", "type", "description")


@query("l07_parse_relation", f"{W} SELECT doc_id, src, tgt, keywords, weight, count(*) AS n FROM rels GROUP BY ALL")
def l07(spark, d):
    return found_relations(spark, d).groupBy("doc_id", "src", "tgt", "keywords", "weight").agg(F.count("*").alias("n"))


@query("l10_group_mentions", f"{W} SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, count(*) AS n FROM rels GROUP BY 1, 2")
def l10(spark, d):
    return found_relations(spark, d).groupBy(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).agg(F.count("*").alias("n"))


MODE = "mode_type AS (SELECT name, type FROM (SELECT name, type, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, min(o)) AS r FROM ents GROUP BY name, type) WHERE r = 1)"
SOURCES = "src AS (SELECT name, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY f) AS sources FROM (SELECT name, doc_id, min(o) AS f, row_number() OVER (PARTITION BY name ORDER BY min(o) DESC) AS r FROM ents GROUP BY name, doc_id) WHERE r <= 5 GROUP BY name)"
DESCRIBED = "des AS (SELECT name, string_agg(description, '<SEP>' ORDER BY ts, length(description) DESC, o) AS descriptions, count(*) AS n FROM (SELECT name, description, ts, min(o) AS o, row_number() OVER (PARTITION BY name, description ORDER BY ts) AS r FROM ents GROUP BY name, description, ts) WHERE r = 1 GROUP BY name)"


@query("d14_mode", f"{W}, {MODE} SELECT name, type FROM mode_type")
def d14(spark, d):
    return mentions.majority_type(mentions.counted(found_entities(spark, d), place()))


@query("d12_entity_merge", f"{W}, {MODE}, {SOURCES}, {DESCRIBED} SELECT name, type, sources, descriptions FROM mode_type JOIN src USING (name) JOIN des USING (name)")
def d12(spark, d):
    merged = mentions.merged_entities(found_entities(spark, d), place(), most=5)
    return merged.select("name", "type", F.array_join("sources", ",").alias("sources"), F.array_join("descriptions", T.SEP).alias("descriptions"))


PAIRS = "pairs AS (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, round(sum(weight), 6) AS weight, count(*) AS n FROM rels GROUP BY 1, 2), kw AS (SELECT src, tgt, string_agg(DISTINCT k, ',' ORDER BY k) AS keywords FROM (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, unnest(string_split(keywords, ',')) AS k FROM rels) GROUP BY src, tgt)"


@query("d13_edge_merge", f"{W}, {PAIRS} SELECT src, tgt, weight, keywords, n FROM pairs JOIN kw USING (src, tgt)")
def d13(spark, d):
    return mentions.merged_relations(found_relations(spark, d)).drop("description")


@query("d15_doc_index", f"{W} SELECT doc_id, count(DISTINCT name) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM ents GROUP BY doc_id")
def d15(spark, d):
    names = F.array_sort(F.collect_set("name"))
    return found_entities(spark, d).groupBy("doc_id").agg(names.alias("a")).select("doc_id", F.size("a").cast("long").alias("n"), F.array_join("a", ",").alias("names"))


@query("l09_glean_merge", f"{W}, p AS (SELECT name, max_by(description, o) AS d1 FROM ents WHERE doc_id % 2 = 0 GROUP BY name), q AS (SELECT name, max_by(description, o) AS d2 FROM ents WHERE doc_id % 2 = 1 GROUP BY name) SELECT name, CASE WHEN d1 IS NULL OR length(d2) > length(d1) THEN coalesce(d2, d1) ELSE d1 END AS description FROM p FULL JOIN q USING (name)")
def l09(spark, d):
    e = found_entities(spark, d)
    last = lambda k: e.where(F.col("doc_id") % 2 == k).groupBy("name").agg(F.max_by("description", place()).alias("description"))
    return mentions.gleaned(last(0), last(1))


@query("l11_summary_gate", rf"{W}, {DESCRIBED}, t AS (SELECT name, n, len(regexp_extract_all(replace(descriptions, '<SEP>', ' '), '\S+')) AS tokens FROM des) SELECT name, CASE WHEN n = 1 THEN 'single' WHEN (tokens <= 60 OR n <= 2) AND n < 6 AND tokens < 20 THEN 'join' WHEN tokens <= 60 OR n <= 2 THEN 'summarise' ELSE 'map_reduce' END AS action FROM t")
def l11(spark, d):
    texts = mentions.distinct_descriptions(mentions.counted(found_entities(spark, d), place()))
    tokens = T.word_count(F.array_join("descriptions", " "))
    return texts.select("name", mentions.summary_gate(F.size("descriptions"), tokens, force=6, most=20, context=60).alias("action"))


ENDS = "(SELECT DISTINCT unnest([src, tgt]) AS e FROM pairs)"
SAID = "said AS (SELECT src, tgt, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS said FROM (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, description FROM rels) GROUP BY src, tgt)"


@query(
    "l13_merge_graph",
    f"""{W}, {MODE}, {SOURCES}, {DESCRIBED}, {PAIRS}, few AS (SELECT * FROM mode_type WHERE type <> 'thing') SELECT 'node' AS kind, name AS id, type AS label, descriptions AS content, len(string_split(sources, ',')) AS n FROM few JOIN src USING (name) JOIN des USING (name)
UNION ALL SELECT 'node', e, 'UNKNOWN', '', 0 FROM {ENDS} ANTI JOIN few ON e = name UNION ALL SELECT 'edge', src || '>' || tgt, CAST(CAST(weight AS DECIMAL(18,1)) AS VARCHAR), keywords, n FROM pairs JOIN kw USING (src, tgt)
UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), '', string_agg(DISTINCT name, ',' ORDER BY name), count(DISTINCT name) FROM ents GROUP BY doc_id""",
)
def l13(spark, d):
    """Nodes, then edges with the ends that are no nodes yet, then the index of each document's names. Things are left out as nodes, so some ends are unknown."""
    records = kept(parsed(spark, d), "records")
    found = found_entities(spark, d, records).select("doc_id", "pos", "ts", "chunk", "name", "type", "description")
    merged = mentions.merged_entities(found, place(), most=5).where("type <> 'thing'")
    nodes = kept(merged.select(F.col("name").alias("entity_id"), F.col("type").alias("entity_type"), F.array_join("descriptions", T.SEP).alias("content"), F.size("sources").cast("long").alias("n")), "nodes")
    pairs = kept(mentions.merged_relations(found_relations(spark, d, records)), "edges")
    unknown = graph.missing_ends(nodes.select("entity_id"), pairs)
    edges_ = pairs.select(F.lit("edge"), F.concat_ws(">", "src", "tgt"), F.col("weight").cast("decimal(18,1)").cast("string"), "keywords", "n")
    index = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("names")).select(F.lit("document"), F.col("doc_id").cast("string"), F.lit(""), F.array_join("names", ","), F.size("names").cast("long"))
    out = nodes.select(F.lit("node").alias("kind"), F.col("entity_id").alias("id"), F.col("entity_type").alias("label"), "content", "n")
    return out.union(unknown.select(F.lit("node"), "entity_id", "entity_type", F.lit(""), F.lit(0).cast("long"))).union(edges_).union(index)


@query("l14_vdb_payload", f"{W}, {DESCRIBED}, {PAIRS}, {SAID} SELECT 'ent-' || md5(name) AS id, name || chr(10) || descriptions AS content FROM des UNION ALL SELECT 'rel-' || md5(src || tgt), keywords || chr(9) || src || chr(10) || tgt || chr(10) || said FROM pairs JOIN kw USING (src, tgt) JOIN said USING (src, tgt)")
def l14(spark, d):
    texts = mentions.distinct_descriptions(mentions.counted(found_entities(spark, d), place()))
    one = texts.select(T.hashed_id("ent-", F.col("name")).alias("id"), F.concat("name", F.lit("\n"), F.array_join("descriptions", T.SEP)).alias("content"))
    two = mentions.merged_relations(found_relations(spark, d)).select(T.hashed_id("rel-", F.concat("src", "tgt")).alias("id"), F.concat("keywords", F.lit("\t"), "src", F.lit("\n"), "tgt", F.lit("\n"), "description").alias("content"))
    return one.union(two)


@query("c18_entity_chunks", f"{W} SELECT name, min(doc_id) AS first_chunk, count(DISTINCT doc_id) AS chunks FROM ents GROUP BY name")
def c18(spark, d):
    """Chunks of each entity: its own list where it has one, else its joined source ids."""
    e = found_entities(spark, d).select("name", "doc_id").distinct()
    own = e.where("length(name) % 2 = 0").groupBy("name").agg(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))).alias("chunk_ids"))
    joined = e.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), T.SEP).alias("source_id"))
    ids = joined.join(own, "name", "left").select("name", F.explode(F.coalesce("chunk_ids", F.split("source_id", T.SEP))).alias("doc_id")).withColumn("doc_id", F.col("doc_id").cast("long"))
    return ids.groupBy("name").agg(F.min("doc_id").alias("first_chunk"), F.count("*").alias("chunks"))


SEEDS = f"{VECTORS}, {ONE}, {scored()}, {top(5)}, {EDGES}, {BOTH}, seed AS (SELECT 'p:' || vec_id AS entity_id, rank FROM t)"


def seeds(spark, d):
    """The nearest entities of the asked vector, as graph nodes."""
    found = vectors.top_k(vector_table(spark, d), asked(spark, d, 7), 5, "vec_id", threshold=-1.0)
    return kept(found.select(F.concat(F.lit("p:"), F.col("vec_id")).alias("entity_id"), "rank"), "seeds")




@query("c19_relation_edges", f"WITH {SEEDS} SELECT rank, entity_id, src, tgt FROM seed JOIN edges ON tgt = 's:' || rank AND src = entity_id OR src = 's:' || rank AND tgt = entity_id")
def c19(spark, d):
    hits = seeds(spark, d).withColumn("other", F.concat(F.lit("s:"), F.col("rank")))
    keyed = hits.select("rank", "entity_id", F.least("entity_id", "other").alias("src"), F.greatest("entity_id", "other").alias("tgt"))
    return keyed.join(edges(spark, d), ["src", "tgt"]).select("rank", "entity_id", "src", "tgt")


@query("c20_fetch_chunks", rf"WITH {CHUNKS}, p AS (SELECT chunk_id, doc_id, tokens, sum(tokens) OVER (ORDER BY chunk_id) AS upto FROM (SELECT DISTINCT chunk_id, min(doc_id) AS doc_id, max(tokens) AS tokens FROM chunks WHERE file_path = 'src3' AND length(content) > 0 GROUP BY chunk_id ORDER BY chunk_id LIMIT 10)) SELECT chunk_id, doc_id FROM p WHERE upto <= 3000")
def c20(spark, d):
    rows = chunks(spark, d).where((F.col("file_path") == "src3") & (F.length("content") > 0)).groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    some = rows.orderBy("chunk_id").limit(10).withColumn("of", F.lit(0))
    return packing.token_prefix(some, ["of"], ["chunk_id"], F.col("tokens"), 3000).select("chunk_id", "doc_id")


@query("l27_cache", "WITH k AS (SELECT 'default:' || md5(text) AS key, min(doc_id) AS all_first, min(doc_id) FILTER (doc_id % 2 = 0) AS cached FROM documents GROUP BY 1) SELECT key, CASE WHEN cached IS NOT NULL THEN 'answer ' || cached ELSE 'answer ' || all_first END AS content, CASE WHEN cached IS NOT NULL THEN cached ELSE 1717243200 END AS create_time, cached IS NOT NULL AS hit FROM k")
def l27(spark, d):
    """The cache after all texts were asked: answers of the even documents were there with their time, misses are answered once a key and appended."""
    docs = table(spark, d, "documents").select("doc_id", T.hashed_id("default:", F.col("text")).alias("key"))
    answer = F.concat(F.lit("answer "), F.min("doc_id"))
    cache = docs.where("doc_id % 2 = 0").groupBy("key").agg(answer.alias("content"), F.min("doc_id").alias("create_time"))
    misses = docs.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(answer.alias("content"), F.lit(1717243200).cast("long").alias("create_time"))
    return cache.withColumn("hit", F.lit(True)).union(misses.withColumn("hit", F.lit(False)))


@query(
    "l28_insert",
    f"""WITH {CHUNKS}, c AS (SELECT doc_key, count(DISTINCT chunk_id) AS chunks FROM chunks GROUP BY doc_key), k AS (SELECT docs.doc_key, coalesce(any_value(chunks), 0) AS chunks, bool_or(doc_id % 4 = 0) AS known FROM docs LEFT JOIN c USING (doc_key) GROUP BY docs.doc_key)
SELECT doc_key, phase, chunks, CASE WHEN chunks = 0 THEN 'failed' WHEN phase = 'phase1' THEN 'chunks_ready' ELSE 'processed' END AS status FROM k, (SELECT unnest(['full', 'phase1', 'phase2']) AS phase) WHERE CASE phase WHEN 'full' THEN NOT known WHEN 'phase1' THEN true ELSE known AND chunks > 0 END""",
)
def l28(spark, d):
    """What each phase does: the full one skips known documents, the first makes chunks ready, the second goes on with known ones that have them; a document without chunks fails."""
    from brookwell.plans.base import documents

    docs = documents(spark, d).groupBy("doc_key").agg(F.max((F.col("doc_id") % 4 == 0).cast("int")).alias("known"))
    pieces = chunks(spark, d).groupBy("doc_key").agg(F.count_distinct("chunk_id").alias("chunks"))
    phase = F.explode(F.array(*(F.lit(p) for p in ("full", "phase1", "phase2"))))
    rows = docs.join(pieces, "doc_key", "left").na.fill(0, ["chunks"]).withColumn("phase", phase)
    goes = F.when(F.col("phase") == "full", F.col("known") == 0).when(F.col("phase") == "phase1", F.lit(True)).otherwise((F.col("known") == 1) & (F.col("chunks") > 0))
    status = F.when(F.col("chunks") == 0, "failed").when(F.col("phase") == "phase1", "chunks_ready").otherwise("processed")
    return rows.where(goes).select("doc_key", "phase", "chunks", status.alias("status"))


@query(
    "l30_delete",
    f"""WITH {FOUND}, {CHUNKS} SELECT 'entity' AS kind, name AS id, count(DISTINCT doc_id) AS n FROM ents WHERE doc_id % 10 <> 3 GROUP BY name
UNION ALL SELECT 'relation', least(src, tgt) || '>' || greatest(src, tgt), count(DISTINCT doc_id) FROM rels WHERE doc_id % 10 <> 3 GROUP BY 2
UNION ALL SELECT 'chunk', chunk_id, count(DISTINCT doc_id) FROM chunks WHERE doc_id % 10 <> 3 GROUP BY chunk_id UNION ALL SELECT 'document', doc_key, count(*) FROM docs WHERE doc_id % 10 <> 3 GROUP BY doc_key""",
)
def l30(spark, d):
    """All stores once some documents are deleted: entities, relations, chunks and statuses go with their last source, others keep fewer."""
    from brookwell.plans.base import documents

    gone = table(spark, d, "documents").where("doc_id % 10 = 3").select("doc_id")
    e = found_entities(spark, d).select(F.lit("entity").alias("kind"), F.col("name").alias("id"), "doc_id")
    r = found_relations(spark, d).select(F.lit("relation"), F.concat_ws(">", F.least("src", "tgt"), F.greatest("src", "tgt")), "doc_id")
    rows = e.union(r).union(chunks(spark, d).select(F.lit("chunk"), "chunk_id", "doc_id")).union(documents(spark, d).select(F.lit("document"), "doc_key", "doc_id")).distinct()
    return store.without(rows, gone, "doc_id").groupBy("kind", "id").agg(F.count("*").alias("n"))


STEP = "CASE c WHEN 1 THEN least(b + 1, 5) WHEN -1 THEN greatest(b - 1, 1) ELSE 1 END"


@query("o09_review", "SELECT user_id, CAST(list_reduce([1] || list(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type IN ('view', 'click') THEN -1 ELSE 0 END ORDER BY event_id), lambda b, c: " + STEP + ") AS BIGINT) AS box FROM events GROUP BY user_id")
def o09(spark, d):
    """Boxes after all reviews. A run of reviews maps each box to a box; runs are composed in order, so no task needs all of a card's reviews."""
    e = F.col("event_type")
    code = F.when(e.isin("purchase", "signup"), 1).when(e.isin("view", "click"), -1).otherwise(0)
    logged = table(spark, d, "events").select("user_id", F.floor(F.col("event_id") / 4096).alias("run"), F.struct("event_id", code.alias("c")).alias("r"))
    step = lambda box, r: F.when(r["c"] == 1, F.least(box + 1, F.lit(5))).when(r["c"] == -1, F.greatest(box - 1, F.lit(1))).otherwise(F.lit(1))
    boxes = F.array(*(F.lit(i) for i in range(1, 6)))
    runs = logged.groupBy("user_id", "run").agg(F.aggregate(F.array_sort(F.collect_list("r")), boxes, lambda m, r: F.transform(m, lambda b: step(b, r))).alias("m"))
    folded = F.aggregate(F.array_sort(F.collect_list(F.struct("run", "m"))), F.lit(1), lambda b, x: F.element_at(x["m"], b))
    return runs.groupBy("user_id").agg(folded.cast("long").alias("box"))


@query("k06_validate_mcq", "SELECT event_id, event_type <> 'error' AND event_id % 7 BETWEEN 0 AND 3 AND event_id % 5 <> 0 AS valid FROM events")
def k06(spark, d):
    """Four options, an answer from 0 to 3, a prompt and an explanation."""
    k = F.col("event_id")
    prompt, options, answer = F.when(F.col("event_type") != "error", F.col("event_type")), F.slice(F.array(*(F.lit(x) for x in "abcd")), 1, F.when(k % 5 == 0, 3).otherwise(4)), k % 7
    return table(spark, d, "events").select("event_id", (F.coalesce(F.length(prompt) > 0, F.lit(False)) & (F.size(options) == 4) & answer.between(0, 3)).alias("valid"))


@query("k07_validate_cards", "SELECT doc_id, left(trim(text), 300) AS front FROM documents WHERE length(text) BETWEEN 1 AND 1000 AND trim(text) <> '' AND source IN ('src1', 'src2', 'src3', 'src4')")
def k07(spark, d):
    fits = F.length("text").between(1, 1000) & (F.trim("text") != "") & F.col("source").isin("src1", "src2", "src3", "src4")
    return table(spark, d, "documents").where(fits).select("doc_id", F.substring(F.trim("text"), 1, 300).alias("front"))


@query("l43_difficulty", "SELECT s AS source, CASE WHEN a IS NULL THEN 'medium' WHEN a >= 0.8 THEN 'hard' WHEN a < 0.5 THEN 'easy' ELSE 'medium' END AS level FROM (SELECT source AS s, avg(quality) AS a FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)")
def l43(spark, d):
    mean = F.avg("quality")
    level = F.when(mean >= 0.8, "hard").when(mean < 0.5, "easy").otherwise("medium")
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(level.alias("level"))


#: Level -> hops, neighbours, top_k, chunk_top_k.
LEVELS = {"easy": (1, 10, 15, 8), "medium": (2, 20, 25, 12), "hard": (3, 40, 40, 20)}


VALID = "length(text) BETWEEN 1 AND 1000 AND trim(text) <> ''"


@query("l44_gen_validate", f"WITH v AS (SELECT source, doc_id, doc_id % 2 AS attempt, count(*) FILTER (doc_id % 2 = 0) OVER (PARTITION BY source) AS first FROM documents WHERE {VALID}), u AS (SELECT * FROM v WHERE attempt = 0 OR first < 12), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY attempt, doc_id) AS number, least(count(*) OVER (PARTITION BY source), 12) AS made FROM u) SELECT source, doc_id, number, made = 12 AS enough FROM r WHERE number <= 12")
def l44(spark, d):
    """Twelve valid cards a source: a second attempt only where the first falls short, numbered anew; ``enough`` is false where both do."""
    valid = table(spark, d, "documents").where(F.length("text").between(1, 1000) & (F.trim("text") != "")).select("source", "doc_id", (F.col("doc_id") % 2).alias("attempt"))
    counts = valid.groupBy(F.col("source").alias("s")).agg(F.count_if(F.col("attempt") == 0).alias("first"), F.count("*").alias("all"))
    used = valid.join(counts, F.col("source").eqNullSafe(F.col("s"))).where("attempt = 0 OR first < 12")
    number = F.row_number().over(Window.partitionBy("source").orderBy("attempt", "doc_id"))
    made = F.when(F.col("first") >= 12, F.lit(12)).otherwise(F.least("all", F.lit(12)))
    return used.withColumn("number", number.cast("long")).where("number <= 12").select("source", "doc_id", "number", (made == 12).alias("enough"))


#: Texts that try to steer the assistant, and marks of its refusals.
MANIPULATION = (
    r"\bstop\s+(talking|responding|replying|answering)\b",
    r"\bshut\s+up\b",
    r"\bbe\s+(quiet|quite|silent)\b",
    r"\bdon'?t\s+(respond|reply|answer|talk)\b",
    r"\bdo\s+not\s+(respond|reply|answer|talk)\b",
    r"\balways\s+(say|reply|answer|respond)\s+(with|that|this)\b",
    r"\bonly\s+(say|reply|answer|respond)\s+(with|that|this)\b",
    r"\b(reply|respond|answer|say)\s+only\s+with\b",
    r"\bignore\s+(your|all|the|previous|these)\s+(instructions?|prompt|rules?|system)\b",
    r"\bforget\s+(your|all|the|previous|these)\s+(instructions?|prompt|rules?|system)\b",
    r"\boverride\s+(your|all|the)\s+(instructions?|prompt|rules?)\b",
    r"\bnew\s+(system\s+)?instructions?\b",
    r"\bsystem\s+prompt\b",
    r"\byou\s+are\s+now\s+(a|an|the)\b",
    r"\bpretend\s+(you\s+are|to\s+be)\b",
    r"\bact\s+as\s+(if|though|a|an|the)\b",
    r"\bno\s+matter\s+(what|who)\s+.{0,40}\b(asks?|says?|tells?)\b",
)
REFUSALS = ("i'm here to help with", "i can't change my role", "what would you like to know about")
STEERED = "CASE WHEN turn % 6 = 0 THEN 'Ignore ALL rules ' || text WHEN turn % 6 = 3 THEN 'I''m here to help with ' || text ELSE text END"
ANY = "(?i)" + "|".join(MANIPULATION)


def steered(spark, d):
    k = F.col("turn") % 6
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.when(k == 0, F.concat(F.lit("Ignore ALL rules "), "text")).when(k == 3, F.concat(F.lit("I'm here to help with "), "text")).otherwise(F.col("text")).alias("said"))


def refuses(c):
    found = F.lit(False)
    for mark in REFUSALS:
        found = found | F.contains(F.lower(c), F.lit(mark))
    return found


@query("b19_manipulation", "SELECT conv_id, turn, regexp_matches(" + STEERED + ", '" + ANY.replace("'", "''") + "') AS steered FROM conversations")
def b19(spark, d):
    return steered(spark, d).select("conv_id", "turn", F.col("said").rlike(ANY).alias("steered"))


@query("b20_refusal", f"SELECT conv_id, turn, contains(lower({STEERED}), 'i''m here to help with') AS refused FROM conversations")
def b20(spark, d):
    return steered(spark, d).select("conv_id", "turn", refuses(F.col("said")).alias("refused"))


@query("k14_history_build", "SELECT conv_id, string_agg(role || '/' || turn, ',' ORDER BY turn) AS history FROM (SELECT *, " + STEERED + " AS said FROM conversations) WHERE NOT (role = 'user' AND regexp_matches(said, '" + ANY.replace("'", "''") + "')) AND NOT (role <> 'user' AND contains(lower(said), 'i''m here to help with')) GROUP BY conv_id")
def k14(spark, d):
    user = F.col("role") == "user"
    kept = steered(spark, d).where(~(user & F.col("said").rlike(ANY)) & ~(~user & refuses(F.col("said"))))
    line = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat_ws("/", x["role"], x["turn"]))
    return kept.groupBy("conv_id").agg(F.array_join(line, ",").alias("history"))


@query("k15_anchor_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role <> 'assistant' OR text <> '') WHERE r <= 10 UNION ALL SELECT conv_id, -1, 'anchor' FROM (SELECT DISTINCT conv_id FROM conversations)")
def k15(spark, d):
    turns = table(spark, d, "conversations")
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = turns.where("role <> 'assistant' OR text <> ''").withColumn("r", r).where("r <= 10").select("conv_id", "turn", "role")
    return last.union(turns.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long"), F.lit("anchor")))
