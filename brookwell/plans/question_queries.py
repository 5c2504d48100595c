"""Questions over the graph of the documents: every document whose id is divisible by 50 asks for what its text is about.

The graph is the one that extraction and merging make of all documents; a document is a chunk.
"""

import hashlib

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.functions import text as T
from brookwell.operators import context, embedding, graph, keywords, mentions, mindmap, questions
from brookwell.operators.kept import kept
from brookwell.plans.answer_queries import FENCE, FIELD, JSON_ROW, LISTED, json_row
from brookwell.plans.base import EDGES, NODES, edges, nodes, query, table
from brookwell.plans.merge_queries import SAID as SAID_OF
from brookwell.plans.merge_queries import DESCRIBED, MODE, PAIRS, W, found_entities, found_relations, outputs, place

#: Chunks that an entity or a relation keeps, and what the questions ask for.
MOST_SOURCES = 50
ASKED = questions.Parameters(top_k=10, chunk_top_k=5, hops=2, neighbours=15, threshold=0.6)
DIMENSIONS = embedding.DIMENSIONS


def embedded_sql(name: str, source: str) -> str:
    """Table ``{name}`` (id, e) of the word vectors of ``source`` (id, said)."""
    number = "CAST('0x' || h[{0}:{1}] AS BIGINT)"
    return rf"""{name}_w AS (SELECT id, md5(unnest(regexp_extract_all(lower(coalesce(said, '')), '[\p{{L}}\p{{N}}]+'))) AS h FROM {source}),
{name}_s AS (SELECT id, n % {DIMENSIONS} AS slot, sum(1 - 2 * (n // {DIMENSIONS} % 2)) AS v FROM (SELECT id, {number.format(1, 7)} AS n FROM {name}_w UNION ALL SELECT id, {number.format(9, 15)} FROM {name}_w) GROUP BY ALL),
{name} AS (SELECT id, list(coalesce(v, 0)::DOUBLE ORDER BY slot) AS e FROM (SELECT id, slot FROM (SELECT id FROM {source}), range({DIMENSIONS}) g(slot)) LEFT JOIN {name}_s USING (id, slot) GROUP BY id)"""


def near_sql(name: str, queries: str, index: str, k: int, threshold: float) -> str:
    """Table ``{name}`` (query_id, id, similarity, rank) of the nearest of ``index`` (id, e)."""
    sizes = "list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)"
    sim = f"round((1 + CASE WHEN {sizes} > 0 THEN list_dot_product(a.e, b.e) / sqrt({sizes}) ELSE 0 END) / 2, 6)"
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (SELECT b.id AS query_id, a.id, {sim} AS similarity FROM {index} a, {queries} b) WHERE similarity >= {threshold}) WHERE rank <= {k})"


def questions_sql(rows: str, silent: str) -> str:
    """Table v (query_id, text, low, high, failed) of the questions of ``rows``, a SELECT of query_id and text; the model's answer doesn't parse where ``silent``."""
    found = lambda i, t: f"SELECT {i}, 'low' AS kind, unnest(regexp_extract_all(lower(text), '{keywords.LOW}')) AS term FROM {t} UNION ALL SELECT {i}, 'high', unnest(regexp_extract_all(text, '{keywords.HIGH}')) FROM {t}"
    return f"""q AS ({rows}), df AS (SELECT kind, term, count(DISTINCT doc_id) AS df FROM ({found("doc_id", "documents")}) GROUP BY ALL),
qt AS (SELECT query_id, kind, term, count(*) AS tf FROM ({found("query_id", "q")}) GROUP BY ALL),
wt AS (SELECT query_id, kind, term, round(tf * ln((SELECT count(*) FROM documents)::DOUBLE / coalesce(df, 1)), 6) AS weight FROM qt LEFT JOIN df USING (kind, term)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY weight DESC, term) AS r FROM wt),
kw AS (SELECT query_id, list(term ORDER BY r) FILTER (kind = 'low' AND r <= {keywords.MOST_LOW}) AS low, list(term ORDER BY r) FILTER (kind = 'high' AND r <= {keywords.MOST_HIGH}) AS high FROM rk GROUP BY query_id),
k2 AS (SELECT query_id, text, CASE WHEN {silent} OR low IS NULL THEN [] ELSE low END AS low, CASE WHEN {silent} OR high IS NULL THEN [] ELSE high END AS high FROM q LEFT JOIN kw USING (query_id)),
k3 AS (SELECT *, len(low) = 0 AND len(high) = 0 AS nothing, coalesce(text, '') = '' AS empty FROM k2),
v AS (SELECT query_id, text, CASE WHEN nothing AND NOT empty AND length(text) < {questions.SHORT} THEN [text] ELSE low END AS low, high, empty OR nothing AND length(text) >= {questions.SHORT} AS failed FROM k3)"""


QUESTIONS = questions_sql("SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 50 = 0", "query_id // 50 % 5 = 4")
LOW = "l0 AS (SELECT query_id AS id, array_to_string(low, ', ') AS said FROM v WHERE NOT failed AND array_to_string(low, ', ') <> '')"
HIGH = "h0 AS (SELECT query_id AS id, array_to_string(high, ', ') AS said FROM v WHERE NOT failed AND array_to_string(high, ', ') <> '')"
TEXTS = "x0 AS (SELECT query_id AS id, text AS said FROM v WHERE NOT failed AND text <> '')"
GRAPH = f"""{MODE}, {DESCRIBED}, {PAIRS}, {SAID_OF},
es AS (SELECT name, list(CAST(doc_id AS VARCHAR) ORDER BY doc_id) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id DESC) AS r FROM (SELECT DISTINCT name, doc_id FROM ents)) WHERE r <= {MOST_SOURCES} GROUP BY name),
rs AS (SELECT src, tgt, list(CAST(doc_id AS VARCHAR) ORDER BY doc_id) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY doc_id DESC) AS r FROM (SELECT DISTINCT least(src, tgt) AS src, greatest(src, tgt) AS tgt, doc_id FROM rels)) WHERE r <= {MOST_SOURCES} GROUP BY ALL),
ent AS (SELECT name, type, descriptions AS description, sources FROM mode_type JOIN des USING (name) JOIN es USING (name)),
rel AS (SELECT src || '<SEP>' || tgt AS id, src, tgt, weight, keywords, said AS description, sources FROM pairs JOIN kw_ USING (src, tgt) JOIN said USING (src, tgt) JOIN rs USING (src, tgt)),
e0 AS (SELECT name AS id, name || chr(10) || description AS said FROM ent), r0 AS (SELECT id, keywords || chr(9) || src || chr(10) || tgt || chr(10) || description AS said FROM rel),
c0 AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS said FROM documents)""".replace("kw AS (SELECT src", "kw_ AS (SELECT src")


def local_sql(p: questions.Parameters) -> str:
    """Table fe (query_id, rank, id, kind, hops, score): seeds by the low keywords, and their neighbours by the best trails."""
    steps = ["t1 AS (SELECT query_id, a, b, w AS p FROM s JOIN two_way ON a = id)"]
    steps += [f"t{h} AS (SELECT t.query_id, y.a, y.b, t.p * y.w AS p FROM t{h - 1} t JOIN two_way y ON y.a = t.b AND y.b <> t.a)" for h in range(2, p.hops + 1)]
    reached = " UNION ALL ".join(f"SELECT query_id, b, {h} AS hops, p / {h} AS score FROM t{h}" for h in range(1, p.hops + 1))
    return f"""{LOW}, {embedded_sql("lq", "l0")}, {embedded_sql("ee", "e0")}, {near_sql("s", "lq", "ee", p.top_k, p.threshold)},
two_way AS (SELECT src AS a, tgt AS b, weight AS w FROM pairs WHERE src <> tgt UNION ALL SELECT tgt, src, weight FROM pairs WHERE src <> tgt),
{", ".join(steps)},
ar AS (SELECT query_id, b AS id, min(hops) AS hops, round(max(score), 4) AS score FROM ({reached}) GROUP BY ALL),
nb AS (SELECT * FROM (SELECT ar.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ar ANTI JOIN s USING (query_id, id)) WHERE rank <= {p.neighbours}),
fe AS (SELECT query_id, rank, id, 'seed' AS kind, 0 AS hops, similarity AS score FROM s UNION ALL SELECT query_id, rank + {p.top_k}, id, 'neighbour', hops, score FROM nb)"""


def global_sql(p: questions.Parameters) -> str:
    return f"{HIGH}, {embedded_sql('hq', 'h0')}, {embedded_sql('re', 'r0')}, {near_sql('fr', 'hq', 're', p.top_k, p.threshold)}"


def chunks_sql(p: questions.Parameters) -> str:
    return f"{TEXTS}, {embedded_sql('xq', 'x0')}, {embedded_sql('ce', 'c0')}, {near_sql('fc', 'xq', 'ce', p.chunk_top_k, p.threshold)}"


NO_ENTITIES = "fe AS (SELECT 0::BIGINT AS query_id, 0::BIGINT AS rank, '' AS id, '' AS kind, 0 AS hops, 0::DOUBLE AS score WHERE false)"
NO_RELATIONS = "fr AS (SELECT 0::BIGINT AS query_id, '' AS id, 0::DOUBLE AS similarity, 0::BIGINT AS rank WHERE false)"
NO_CHUNKS = "fc AS (SELECT 0::BIGINT AS query_id, '' AS id, 0::DOUBLE AS similarity, 0::BIGINT AS rank WHERE false)"


def found_sql(mode: str, p: questions.Parameters = ASKED, asked: str = QUESTIONS) -> str:
    """Tables fe, fr and cl (query_id, rank, id, origin, content, file_path) of what the questions of ``asked`` find."""
    local = local_sql(p) if mode != "global" else NO_ENTITIES
    global_ = global_sql(p) if mode != "local" else NO_RELATIONS
    chunks = chunks_sql(p) if mode == "mix" else NO_CHUNKS
    listed = f"""un AS (SELECT query_id, 0 AS part, rank, unnest(sources) AS id, unnest(range(len(sources))) AS pos FROM fe JOIN ent ON ent.name = fe.id UNION ALL SELECT query_id, 1, rank, unnest(sources), unnest(range(len(sources))) FROM fr JOIN rel USING (id)),
u1 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY min(row(part, rank, pos))) AS rank FROM un GROUP BY query_id, id),
u2 AS (SELECT query_id, rank, id, text AS content, source AS file_path, sum(len(regexp_extract_all(text, '\\S+'))) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total FROM u1 JOIN documents ON id = CAST(doc_id AS VARCHAR) WHERE rank <= {2 * p.related_chunks} AND text <> ''),
u3 AS (SELECT query_id, rank, id, content, file_path, 'graph' AS origin FROM u2 WHERE total <= {p.chunk_budget} UNION ALL SELECT query_id, rank + {2 * p.related_chunks}, id, text, source, 'vector' FROM fc JOIN documents ON id = CAST(doc_id AS VARCHAR) WHERE text <> ''),
cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, md5(content) ORDER BY rank) AS again FROM u3) WHERE again = 1)"""
    return f"{W}, {asked}, {GRAPH}, {local}, {global_}, {chunks}, {listed}"


def asking(spark, d):
    """(query_id, text, low, high); the model says nothing that parses to a fifth of the questions."""
    docs = table(spark, d, "documents")
    rows = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    silent = F.when(F.floor(F.col("query_id") / 50) % 5 == 4, "I can't say")
    return kept(keywords.extracted(rows, docs, silent), "questions")


def document_index(spark, d):
    """The three indices over what extraction finds; the records are parsed once, and what a mode doesn't read isn't made."""
    records = kept(mentions.records(outputs(spark, d)).select("doc_id", "record", "entity", "relation"), "records")
    rels = found_relations(spark, d, records).select("doc_id", "src", "tgt", "keywords", "description", "weight")
    ends = [F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")]

    def entities():
        merged = mentions.merged_entities(found_entities(spark, d, records), place(), most=MOST_SOURCES)
        return merged.select("name", "type", F.array_join("descriptions", T.SEP).alias("description"), "sources")

    def relations():
        return mentions.merged_relations(rels).drop("n")

    def sources(found):
        some = rels.select("doc_id", *ends).join(found, ["src", "tgt"], "left_semi")
        listed = mentions.first_sources(some.select(F.struct("src", "tgt").alias("name"), F.col("doc_id").cast("string").alias("chunk"), F.col("doc_id").alias("first")), MOST_SOURCES)
        return listed.select("name.*", "sources")

    def edges_():
        return rels.groupBy(*ends).agg(F.round(F.sum("weight"), 6).alias("weight"))

    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"), F.col("source").alias("file_path"), T.word_count(F.col("text")).alias("tokens"))
    return questions.built(entities, relations, docs, edges_, sources)


@query("l15_keywords", f"WITH {QUESTIONS} SELECT query_id, array_to_string(low, ',') AS low, array_to_string(high, ',') AS high FROM k2")
def l15(spark, d):
    """Each question's terms by how rare they are in the documents, as the model's JSON lists them; an answer that doesn't parse gives none."""
    return asking(spark, d).select("query_id", F.array_join("low", ",").alias("low"), F.array_join("high", ",").alias("high"))


def found_by(spark, d, mode):
    return questions.retrieved(asking(spark, d), document_index(spark, d), questions.with_mode(ASKED, mode))


@query("l16_local", f"{found_sql('local')} SELECT query_id, rank, id AS name, kind, hops::BIGINT AS hops, score FROM fe")
def l16(spark, d):
    """Seeds by the low keywords, then their neighbours by the best trails."""
    return found_by(spark, d, "local").entities.select("query_id", "rank", "name", "kind", "hops", "score")


@query("l17_global", f"{found_sql('global')} SELECT query_id, rank, src, tgt, weight, keywords FROM fr JOIN rel USING (id)")
def l17(spark, d):
    """Relations by the high keywords, with their edges' weights."""
    return found_by(spark, d, "global").relations.select("query_id", "rank", "src", "tgt", "weight", "keywords")


def parts_of(found):
    """(query_id, part, rank, id) of all that a mode gives; a question that fails or finds nothing has one row that says so."""
    r = found.relations.select("query_id", F.lit("relation"), "rank", T.pair_key(F.col("src"), F.col("tgt")))
    e = found.entities.select("query_id", F.col("kind").alias("part"), "rank", F.col("name").alias("id"))
    c = found.chunks.select("query_id", F.concat("origin", F.lit(" chunk")), "rank", "chunk_id")
    rows = kept(e.union(r).union(c), "parts")
    failed = found.verdicts.where("failed").select("query_id", F.lit("refused"), F.lit(0).cast("long"), F.lit(context.NO_ANSWER))
    nothing = found.verdicts.where("NOT failed").join(rows.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit("nothing"), F.lit(0).cast("long"), F.lit(context.NOTHING_FOUND))
    return rows.union(failed).union(nothing)


def parts_sql(mode: str) -> str:
    said = context.NOTHING_FOUND.replace("'", "''"), context.NO_ANSWER.replace("'", "''")
    rows = "SELECT query_id, kind AS part, rank, id FROM fe UNION ALL SELECT query_id, 'relation', rank, id FROM fr UNION ALL SELECT query_id, origin || ' chunk', rank, id FROM cl"
    return f"{found_sql(mode)}, al AS ({rows}) SELECT * FROM al UNION ALL SELECT query_id, 'refused', 0, '{said[1]}' FROM v WHERE failed UNION ALL SELECT query_id, 'nothing', 0, '{said[0]}' FROM v WHERE NOT failed AND query_id NOT IN (SELECT query_id FROM al)"


def _register(mode: str) -> None:
    @query(f"l25_kg_{mode}", parts_sql(mode))
    def l25(spark, d):
        return parts_of(found_by(spark, d, mode))

    l25.__doc__ = f"All questions by the {mode} mode: entities, relations, and the chunks that fit the budget."


for _mode in questions.MODES:
    _register(_mode)


LISTS = f"""ej AS (SELECT query_id, {LISTED.format(json_row(name="id", type="coalesce(type, 'UNKNOWN')", description="coalesce(description, '')"), "rank")} AS entities FROM fe LEFT JOIN ent ON ent.name = fe.id GROUP BY query_id),
rj AS (SELECT query_id, {LISTED.format(JSON_ROW.format(FIELD.format("src", "src") + " || ',' || chr(10) || " + FIELD.format("tgt", "tgt") + " || ',' || chr(10) || '    \"weight\": ' || CAST(CAST(weight AS DECIMAL(18,2)) AS VARCHAR)"), "rank")} AS relations FROM fr JOIN rel USING (id) GROUP BY query_id),
cj AS (SELECT query_id, {LISTED.format(json_row(content="content", file_path="file_path"), "rank")} AS chunks FROM cl GROUP BY query_id),
pj AS (SELECT query_id, string_agg('[' || n || '] ' || file_path, chr(10) ORDER BY n) AS refs, count(*) AS n_refs FROM (SELECT query_id, file_path, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS n FROM cl GROUP BY query_id, file_path) GROUP BY query_id)"""
CONTEXT = "chr(10) || " + " || chr(10) || ".join([FENCE.format("'Knowledge Graph Data (Entities)'", "json", "coalesce(entities, '[]')"), FENCE.format("'Knowledge Graph Data (Relationships)'", "json", "coalesce(relations, '[]')"), FENCE.format("'Document Chunks'", "json", "coalesce(chunks, '[]')"), FENCE.format("'Reference Document List'", "", "coalesce(refs, 'N/A')")]) + " || chr(10)"
PROMPT = "'Answer from the context only. Response style: Multiple Paragraphs. Additional instructions: n/a' || chr(10) || chr(10) || '---Context---' || chr(10) || chr(10) || {0} || chr(10) || chr(10) || '---User Query---' || chr(10) || chr(10) || text"


def api_sql(mode: str) -> str:
    found = "entities IS NOT NULL OR relations IS NOT NULL OR chunks IS NOT NULL"
    return f"""{found_sql(mode)}, {LISTS}, an AS (SELECT query_id, text, low, high, failed, n_refs, CASE WHEN NOT failed AND ({found}) THEN md5({PROMPT.format(CONTEXT)}) END AS said FROM v LEFT JOIN ej USING (query_id) LEFT JOIN rj USING (query_id) LEFT JOIN cj USING (query_id) LEFT JOIN pj USING (query_id))
SELECT query_id, '{mode}' AS mode, CASE WHEN failed THEN '{context.NO_ANSWER.replace("'", "''")}' WHEN said IS NULL THEN '{context.NOTHING_FOUND.replace("'", "''")}' ELSE said END AS answer, CASE WHEN said IS NULL THEN 0 ELSE coalesce(n_refs, 0) END AS n_refs,
  said IS NOT NULL AND EXISTS (SELECT 1 FROM an b WHERE b.query_id % 100 = 0 AND b.said IS NOT NULL AND b.text = an.text AND b.low = an.low AND b.high = an.high) AS cached FROM an"""


def digests(prompts: list[str]) -> list[str]:
    """The offline model here: the digest of all that it is told."""
    return [hashlib.md5(p.encode()).hexdigest() for p in prompts]


@query("l29_query_api", api_sql("mix"))
def l29(spark, d):
    """Every question answered by the mix mode, after half of them have been asked before and lie in the cache."""
    made = kept(questions.contexts(found_by(spark, d, "mix"), ASKED), "contexts")
    empty = spark.createDataFrame([], "key string, content string")
    _, cache = questions.answers(made.where("query_id % 100 = 0"), empty, ASKED, digests)
    said, _ = questions.answers(made, cache, ASKED, digests)
    return said.select("query_id", F.lit("mix").alias("mode"), "answer", F.size("paths").cast("long").alias("n_refs"), "cached")


# What is built on the mix mode

LEVELS = ("easy", "medium", "hard")
#: Hops, neighbours, entities and chunks by how hard a quiz is to be.
QUIZ = {level: questions.Parameters(top_k=k, chunk_top_k=c, hops=h, neighbours=n) for level, (h, n, k, c) in zip(LEVELS, ((1, 10, 15, 8), (2, 20, 25, 12), (3, 40, 40, 20)), strict=True)}
SAID = f"CASE WHEN entities IS NOT NULL OR relations IS NOT NULL OR chunks IS NOT NULL THEN {CONTEXT} END"
ALL_LISTS = "LEFT JOIN ej USING (query_id) LEFT JOIN rj USING (query_id) LEFT JOIN cj USING (query_id) LEFT JOIN pj USING (query_id)"


def quiz_sql(level: str) -> str:
    rows = f"SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 50 = 0 AND doc_id // 50 % 3 = {LEVELS.index(level)}"
    p = QUIZ[level]
    return f"SELECT * FROM ({found_sql('mix', p, questions_sql(rows, 'false'))}, {LISTS} SELECT query_id, '{level}' AS difficulty, {p.hops}::BIGINT AS hops, length(said) AS context_chars, md5(said) AS context FROM (SELECT query_id, {SAID} AS said FROM v {ALL_LISTS} WHERE NOT failed) WHERE said IS NOT NULL)"


@query("l42_quiz_context", " UNION ALL ".join(map(quiz_sql, LEVELS)))
def l42(spark, d):
    """The context of a quiz for every question, retrieved as its difficulty asks for; those without any context give none."""
    docs, index = table(spark, d, "documents"), document_index(spark, d)
    rows = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    asked = kept(keywords.extracted(rows, docs), "questions")
    out = None
    for i, (level, p) in enumerate(QUIZ.items()):
        made = questions.contexts(questions.retrieved(asked.where(F.floor(F.col("query_id") / 50) % 3 == i), index, p), p).where("context IS NOT NULL")
        made = made.select("query_id", F.lit(level).alias("difficulty"), F.lit(p.hops).cast("long").alias("hops"), F.length("context").cast("long").alias("context_chars"), F.md5("context").alias("context"))
        out = made if out is None else out.union(made)
    return out


MAP = questions.Parameters(top_k=25, chunk_top_k=30, hops=2, neighbours=40)


def unquoted(c: str) -> str:
    """What the body of a JSON string says."""
    return f"CAST('\"' || {c} || '\"' AS JSON)->>'$'"


def groups_sql(text: str, pattern: str, *names: str) -> str:
    """Each match's groups as strings, with its place ``i``."""
    found = lambda k: f"regexp_extract_all({text}, '{pattern}', {k})"
    inner = ", ".join(f"unnest({found(k)}) AS {n}" for k, n in enumerate(names, 1))
    return f"SELECT query_id, i, {', '.join(f'{unquoted(n)} AS {n}' for n in names)} FROM (SELECT query_id, {inner}, unnest(range(len({found(1)}))) AS i FROM m)"


def described(c: str) -> str:
    return f"left('{mindmap.SAYS}' || {c}, {mindmap.DESCRIPTION[1]})"


TREE = f"left(ctx, {mindmap.TREE_CHARS})"
MAPS = f"""m AS (SELECT query_id, source, CASE WHEN NOT failed THEN {SAID} END AS ctx FROM v {ALL_LISTS} JOIN (SELECT doc_id, source FROM documents) ON doc_id = query_id),
nm AS (SELECT query_id, list(name ORDER BY i) AS names FROM ({groups_sql(f"left(ctx, {mindmap.ROOT_CHARS})", mindmap.NAME, "name")}) WHERE i < 3 GROUP BY query_id),
k AS (SELECT * FROM ({groups_sql(TREE, mindmap.ENTITY, "name", "type", "description")}) WHERE type <> 'UNKNOWN'), rl AS ({groups_sql(TREE, mindmap.RELATION, "src", "tgt")}), ch AS ({groups_sql(TREE, mindmap.CHUNK, "content")}),
one AS (SELECT * FROM (SELECT query_id, type, arg_min(description, i) AS description, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) AS a FROM k GROUP BY query_id, type HAVING count(*) >= 2) WHERE a <= {mindmap.MOST_THEMES}),
two AS (SELECT * FROM (SELECT query_id, type, name, k.description, a, row_number() OVER (PARTITION BY query_id, type ORDER BY i) AS b FROM k JOIN one USING (query_id, type)) WHERE b <= {mindmap.MOST_CHILDREN}),
says AS (SELECT query_id, name, arg_min(array_to_string(regexp_extract_all(content, '{mindmap.WORDS}')[1:12], ' '), i) AS said FROM two JOIN ch USING (query_id) WHERE contains(content, name) GROUP BY query_id, name),
other AS (SELECT query_id, name, a, b, CASE WHEN src = name THEN tgt ELSE src END AS other, min(i) AS i FROM two JOIN rl USING (query_id) WHERE name IN (src, tgt) GROUP BY ALL),
three AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY i) AS c, count(*) OVER (PARTITION BY query_id, name) AS n FROM other) WHERE n >= 2 AND c <= {mindmap.MOST_CHILDREN}),
nodes_ AS (SELECT query_id, type AS topic, {described("split_part(description, '<SEP>', 1)")} AS description, 1 AS depth, true AS has_children, a, 0 AS b, 0 AS c FROM one
  UNION ALL SELECT query_id, name, {described("coalesce(said, split_part(description, '<SEP>', 1))")}, 2, (query_id, name) IN (SELECT (query_id, name) FROM three), a, b, 0 FROM two LEFT JOIN says USING (query_id, name)
  UNION ALL SELECT query_id, other, {described("name || ' and ' || other || ' are related.'")}, 3, false, a, b, c FROM three),
whole AS (SELECT query_id FROM one GROUP BY query_id HAVING count(*) >= 2)"""


@query(
    "l46_mindmap_tree",
    f"""{found_sql('mix', MAP)}, {LISTS}, {MAPS} SELECT query_id, 'n_' || lpad(CAST(row_number() OVER (PARTITION BY query_id ORDER BY a, b, c) AS VARCHAR), 4, '0') AS node_id, trim(left(topic, {mindmap.TOPIC[1]})) AS topic, trim(description) AS description, CAST(depth AS BIGINT) AS depth, has_children FROM nodes_ SEMI JOIN whole USING (query_id)
UNION ALL SELECT query_id, 'n_root', trim(left(array_to_string(names, ' '), {mindmap.TOPIC[1]})), trim({described("array_to_string(names, ', ') || ' in ' || coalesce(source, 'unknown') || '.'")}), 0, true FROM nm JOIN m USING (query_id) SEMI JOIN whole USING (query_id)
UNION ALL SELECT query_id, 'refused', CASE WHEN ctx IS NULL THEN '{mindmap.NO_CONTENT}' ELSE '{mindmap.TOO_SHALLOW}' END, NULL, 0, false FROM m ANTI JOIN whole USING (query_id)""",
)
def l46(spark, d):
    """A mind map for every question from the whole context of the mix mode, entities, relations and chunks, by a call for its root topic and one for the tree below it; maps without two themes are refused."""
    made = questions.contexts(questions.retrieved(asking(spark, d), document_index(spark, d), MAP), MAP).select("query_id", "context")
    files = table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("source").alias("file"))
    return mindmap.maps(kept(made.join(files, "query_id"), "contexts"), "file")


def answered_sql(p: questions.Parameters, asked: str, extra: str = "''") -> str:
    """Table an (query_id, answer): what the offline model, a digest, says to the whole prompt with ``extra`` before it."""
    return f"{found_sql('mix', p, asked)}, {LISTS}, an AS (SELECT query_id, CASE WHEN failed THEN '{context.NO_ANSWER.replace("'", "''")}' WHEN ctx IS NULL THEN '{context.NOTHING_FOUND.replace("'", "''")}' ELSE md5({PROMPT.format('ctx')}) END AS answer FROM (SELECT *, {SAID} AS ctx FROM v {ALL_LISTS}))"


NODE = questions.Parameters(top_k=15, chunk_top_k=20, hops=2, neighbours=30)
NODES_OF = f"SELECT doc_id * 10 + i AS query_id, 'Summarise ' || name || ' within question ' || doc_id || '.' AS text FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS i FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{keywords.HIGH}')) AS name, unnest(range(len(regexp_extract_all(text, '{keywords.HIGH}')))) AS i FROM documents WHERE doc_id % 50 = 0) GROUP BY doc_id, name) WHERE i <= 3"


@query("l47_node_summary", f"{answered_sql(NODE, questions_sql(NODES_OF, 'false'))} SELECT query_id // 10 AS query_id, text AS question, answer FROM an JOIN v USING (query_id)")
def l47(spark, d):
    """A summary of the first three names in every question's text, each answered from a retrieval of its own."""
    docs = table(spark, d, "documents")
    names = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(keywords.HIGH), F.lit(0))), 1, 3)
    rows = docs.where("doc_id % 50 = 0").select("doc_id", F.posexplode(names).alias("i", "name"))
    asked = rows.select((F.col("doc_id") * 10 + F.col("i") + 1).alias("query_id"), F.concat(F.lit("Summarise "), "name", F.lit(" within question "), "doc_id", F.lit(".")).alias("text"))
    return said_to(spark, d, kept(keywords.extracted(asked, docs), "questions"), NODE).select(F.floor(F.col("query_id") / 10).alias("query_id"), F.col("text").alias("question"), "answer")


def said_to(spark, d, asked, p):
    """(query_id, text, answer) of questions by the mix mode."""
    made = kept(questions.contexts(questions.retrieved(asked, document_index(spark, d), p), p), "contexts")
    said, _ = questions.answers(made, spark.createDataFrame([], "key string, content string"), p, digests)
    return made.select("query_id", "text").join(said.select("query_id", "answer"), "query_id")


THREAD = questions.Parameters(top_k=10, chunk_top_k=15, hops=1, neighbours=20)
TURNS = "SELECT conv_id * 1000 + turn AS query_id, CASE WHEN conv_id % 3 = 0 THEN text ELSE '[Currently exploring: topic ' || conv_id % 3 || ']' || chr(10) || chr(10) || text END AS text FROM conversations WHERE role = 'user' AND conv_id % 50 = 0"


@query("l48_ask_thread", f"{answered_sql(THREAD, questions_sql(TURNS, 'false'))}, hs AS (SELECT conv_id * 1000 + turn AS query_id, least(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, 10) AS history FROM conversations) SELECT query_id // 1000 AS conv_id, query_id % 1000 AS turn, text AS question, history, answer FROM an JOIN v USING (query_id) JOIN hs USING (query_id)")
def l48(spark, d):
    """Questions in the threads whose id is divisible by 50, prefixed with the node in view and answered by the mix mode, with up to ten turns of history."""
    before = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    turns = table(spark, d, "conversations").where("conv_id % 50 = 0").withColumn("n", before).where("role = 'user'")
    label = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("[Currently exploring: topic "), F.col("conv_id") % 3, F.lit("]\n\n")))
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(F.coalesce(label, F.lit("")), "text").alias("text"), F.least("n", F.lit(10)).cast("long").alias("history"))
    said = said_to(spark, d, kept(keywords.extracted(rows.drop("history"), table(spark, d, "documents")), "questions"), THREAD)
    return said.join(rows.select("query_id", "history"), "query_id").select(F.floor(F.col("query_id") / 1000).alias("conv_id"), (F.col("query_id") % 1000).alias("turn"), F.col("text").alias("question"), "history", "answer")


# Trails from many seed sets

SETS = """two_way AS (SELECT src AS a, tgt AS b, weight AS w FROM edges UNION ALL SELECT tgt, src, weight FROM edges), seed AS (SELECT p_partkey AS query_id, 'p:' || p_partkey AS id FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT p_partkey, 's:' || (p_partkey // 50) FROM part WHERE p_partkey % 50 = 0),
t1 AS (SELECT query_id, a, b, w AS p FROM seed JOIN two_way ON a = id), t2 AS (SELECT query_id, y.b, p * y.w / 2 AS score FROM t1 JOIN two_way y ON y.a = t1.b AND y.b <> t1.a),
ar AS (SELECT query_id, b AS id, min(hops) AS hops, round(max(score), 4) AS score FROM (SELECT query_id, b, 1 AS hops, p AS score FROM t1 UNION ALL SELECT query_id, b, 2, score FROM t2) GROUP BY ALL),
nb AS (SELECT * FROM (SELECT ar.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ar ANTI JOIN seed USING (query_id, id)) WHERE rank <= 30)"""


def seed_sets(spark, d):
    """(query_id, entity_id): two seeds for each part whose key is divisible by 50."""
    k = F.col("p_partkey")
    ids = F.explode(F.array(F.concat(F.lit("p:"), k), F.concat(F.lit("s:"), F.floor(k / 50))))
    return table(spark, d, "part").where(k % 50 == 0).select(k.alias("query_id"), ids.alias("entity_id"))


@query("l19_bfs_weighted", f"WITH {EDGES}, {SETS} SELECT query_id, rank, id AS entity_id, hops::BIGINT AS hops, score FROM nb")
def l19(spark, d):
    """The 30 best nodes around each seed set: every part whose key is divisible by 50, with a supplier."""
    return graph.expand_sets(seed_sets(spark, d), edges(spark, d), 2, 30)


@query("l18_expand", f"WITH {EDGES}, {NODES}, {SETS} SELECT query_id, rank, entity_id, hops::BIGINT AS hops, score, entity_type, description FROM nb JOIN nodes ON entity_id = id")
def l18(spark, d):
    """The same with what is known of the nodes."""
    return l19(spark, d).join(nodes(spark, d).select("entity_id", "entity_type", "description"), "entity_id")


# Embeddings of texts

DOCUMENTS = "d0 AS (SELECT doc_id AS id, text AS said FROM documents)"


@query("l02_embed", f"WITH {DOCUMENTS}, {embedded_sql('de', 'd0')} SELECT id AS doc_id, array_to_string(list_transform(e, lambda x: CAST(x AS INT)), ' ') AS vector, CAST(list_dot_product(e, e) AS BIGINT) AS n FROM de")
def l02(spark, d):
    """The offline embedding of every text, before it is divided by its length."""
    made = embedding.embedded_texts(table(spark, d, "documents"), F.col("text"))
    return made.select("doc_id", F.array_join(F.transform("v", lambda x: x.cast("string")), " ").alias("vector"), "n")


SIZES = "list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)"


@query("l38_semsim", f"WITH i0 AS (SELECT item_id AS id, text AS said FROM benchmark), {embedded_sql('ie', 'i0')} SELECT a.id AS item_id, round((1 + CASE WHEN {SIZES} > 0 THEN list_dot_product(a.e, b.e) / sqrt({SIZES}) ELSE 0 END) / 2, 6) AS similarity FROM ie a JOIN ie b ON b.id = a.id + 1")
def l38(spark, d):
    """Similarity of the embedded answer and ground truth; each benchmark text stands for the answer to the next."""
    b = embedding.embedded_texts(table(spark, d, "benchmark"), F.col("text")).select("item_id", "v", "n")
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("v").alias("w"), F.col("n").alias("m")), "item_id")
    return pairs.select("item_id", embedding.closeness(F.col("v"), F.col("n"), F.col("w"), F.col("m")).alias("similarity"))
