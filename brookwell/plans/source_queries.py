"""Uploads, text extraction, parsed items, question files, sinks and log lines."""

import uuid

from pyspark.sql import functions as F

from brookwell.functions import arrow_text
from brookwell.functions import text as T
from brookwell.operators.kept import shared_path
from brookwell.plans.base import query, table
from brookwell.plans.fixtures import ITEMS, files, raw_items
from brookwell.sources import files as S
from brookwell.sources import office

PATH = "source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.pptx' WHEN 2 THEN '.txt' ELSE '.exe' END"


@query("a01_upload_scan", f"SELECT {PATH} AS path, 'pending' AS status FROM documents WHERE doc_id % 4 < 3")
def a01(spark, d):
    """Uploads with an accepted extension, as new rows."""
    return S.accepted(files(spark, d)).select("path", F.lit("pending").alias("status"))


@query("a07_docx_text", "SELECT doc_id, i AS paragraph_index, trim(line) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE doc_id % 4 = 0) WHERE trim(line) <> ''")
def a07(spark, d):
    found = office.sections(files(spark, d).where("extension = '.docx'"), {".docx": office.docx_sections}, False)
    return found.select("doc_id", F.col("paragraph_index").cast("long").alias("paragraph_index"), "text")


SLIDES = "SELECT doc_id, (i - 1) // 3 + 1 AS slide_number, string_agg(trim(line), chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE doc_id % 4 = 1) WHERE trim(line) <> '' GROUP BY 1, 2"


@query("a08_pptx_text", SLIDES)
def a08(spark, d):
    found = office.sections(files(spark, d).where("extension = '.pptx'"), {".pptx": office.pptx_sections}, False)
    return found.select("doc_id", F.col("slide_number").cast("long").alias("slide_number"), "text")


@query("a09_txt_text", f"SELECT {PATH} AS path, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM documents WHERE doc_id % 4 = 2 AND trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''")
def a09(spark, d):
    return S.plain_texts(files(spark, d))


@query("a10_extract_dispatch", "SELECT doc_id % 4 AS kind, count(*) AS sections FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE doc_id % 4 = 0 AND trim(line) <> '' GROUP BY 1 UNION ALL SELECT 1, count(*) FROM (" + SLIDES + ") UNION ALL SELECT 2, count(*) FROM documents WHERE doc_id % 4 = 2 AND trim(text) <> ''")
def a10(spark, d):
    """Sections of all files by kind, each extracted by its extension's reader."""
    return office.sections(S.accepted(files(spark, d))).groupBy((F.col("doc_id") % 4).alias("kind")).agg(F.count("*").alias("sections"))


@query("a12_lc_docx", "SELECT doc_id, trim(string_agg(line, chr(10) || chr(10) ORDER BY i), ' ' || chr(10)) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE doc_id % 4 = 0) WHERE line <> '' GROUP BY doc_id")
def a12(spark, d):
    found = office.sections(files(spark, d).where("extension = '.docx'"), {".docx": office.docx_whole}, False)
    return found.where("text <> ''").select("doc_id", "text")


@query("a13_lc_pptx", "SELECT doc_id, string_agg(trim(line), chr(10) || chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE doc_id % 4 = 1) WHERE trim(line) <> '' GROUP BY doc_id")
def a13(spark, d):
    found = office.sections(files(spark, d).where("extension = '.pptx'"), {".pptx": office.pptx_whole}, False)
    return found.where("text <> ''").select("doc_id", "text")


MEDIA = "SELECT doc_id, 'image' || n || CASE WHEN n = 0 THEN '.jpg' ELSE '.PNG' END AS name, greatest(n - 1, 0) AS page_idx FROM (SELECT doc_id, unnest(list_filter(range(0, (len(string_split(text, chr(10))) + 2) // 3 + 1), lambda x: x % 2 = 0)) AS n FROM documents WHERE doc_id % 4 = 1)"


@query("a05_pptx_media", MEDIA)
def a05(spark, d):
    """Raster images of the presentations, each with the first slide that refers to it."""
    found = files(spark, d).where("extension = '.pptx'").select("doc_id", F.explode(office.parsed(F.col("content"), office.media, office.MEDIA)).alias("m"))
    return found.select("doc_id", "m.name", F.col("m.page_idx").cast("long").alias("page_idx"))


TYPED = "SELECT doc_id, 'text' AS type, i - 1 AS page_idx, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, 1 AS i FROM documents WHERE doc_id % 4 = 0) WHERE trim(line) <> '' UNION ALL SELECT doc_id, 'text', slide_number - 1, text FROM (" + SLIDES + ")"


@query("a02_parse_bytes", f"SELECT doc_id, type, page_idx, text FROM ({TYPED.replace('line AS text', 'trim(line) AS text')}) UNION ALL SELECT doc_id, 'image', page_idx, name FROM ({MEDIA})")
def a02(spark, d):
    """Typed items of office files with pages from 0; presentations get their images, too."""
    some = files(spark, d).where("extension in ('.docx', '.pptx')")
    said = office.sections(some, whole_text=False).select("doc_id", F.lit("text").alias("type"), (F.coalesce("slide_number", F.lit(1)) - 1).cast("long").alias("page_idx"), "text")
    return said.union(a05(spark, d).select("doc_id", F.lit("image"), "page_idx", "name"))


@query("a04_parse_file", f"SELECT doc_id, type, page_idx, text FROM ({TYPED.replace('line AS text', 'trim(line) AS text')})")
def a04(spark, d):
    """The same from files at a path, without the pass over images."""
    some = files(spark, d).where("extension in ('.docx', '.pptx')")
    found = office.sections(some, whole_text=False)
    return found.select("doc_id", F.lit("text").alias("type"), (F.coalesce("slide_number", F.lit(1)) - 1).cast("long").alias("page_idx"), "text")


@query("a03_item_convert", f"WITH {ITEMS} SELECT doc_id, pos, type, text, table_body, img_path, caption, page_idx FROM items")
def a03(spark, d):
    return office.items(raw_items(spark, d))


@query("a14_separate_content", f"WITH {ITEMS} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (type = 'text') AS text, count(*) FILTER (type <> 'text') AS modal FROM items GROUP BY doc_id")
def a14(spark, d):
    texts, modal = S.separated(office.items(raw_items(spark, d)))
    counts = modal.groupBy("doc_id").agg(F.count("*").alias("modal"))
    return texts.join(counts, "doc_id", "full_outer").select("doc_id", "text", F.coalesce("modal", F.lit(0)).alias("modal"))


@query("a30_json_source", "SELECT item_id AS id, text AS question, 'a' || item_id AS ground_truth, CASE WHEN item_id % 3 = 0 THEN 'factual' ELSE 'reasoning' END AS category FROM benchmark")
def a30(spark, d):
    """Questions written as JSON files and read back with their checks."""
    path = shared_path(spark, f"questions-{uuid.uuid4().hex}")
    items = table(spark, d, "benchmark")
    kind = F.when(F.col("item_id") % 3 == 0, "factual").otherwise("reasoning")
    items.select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.concat(F.lit("a"), "item_id").alias("ground_truth"), kind.alias("category")).write.json(path)
    return S.questions(spark, path, lines=True).select("id", "question", "ground_truth", "category")


@query("a32_atomic_sink", "SELECT item_id, length(text) AS n FROM benchmark")
def a32(spark, d):
    """Saved twice to one place: readers see the last whole save."""
    path, items = shared_path(spark, f"saved-{uuid.uuid4().hex}"), table(spark, d, "benchmark")
    S.save(items.select("item_id", F.lit(0).alias("n")), path)
    S.save(items.select("item_id", F.length("text").cast("long").alias("n")), path)
    return spark.read.parquet(path)


#: What is looked for in log lines.
PATTERNS = {"error": r"(?i)\berror\b", "click": r"(?i)\bclick\b", "even": r"user=\d*[02468]\b", "slow": r"took=[1-9]\d{2,}"}
LOGGED = "event_id, event_type || ' user=' || user_id || ' took=' || CAST(floor(value) AS BIGINT) AS line"


@query("a33_log_tail", f"WITH l AS (SELECT {LOGGED} FROM events), h AS (SELECT event_id, 'error' AS pattern FROM l WHERE line LIKE 'error %' UNION ALL SELECT event_id, 'click' FROM l WHERE line LIKE 'click %' UNION ALL SELECT event_id, 'even' FROM l WHERE regexp_matches(line, 'user=\\d*[02468]\\b') UNION ALL SELECT event_id, 'slow' FROM l WHERE regexp_matches(line, 'took=[1-9]\\d{{2,}}')) SELECT event_id, pattern, row_number() OVER (PARTITION BY pattern ORDER BY event_id) AS count_so_far FROM h")
def a33(spark, d):
    """Each line's hits with the running count of their pattern; ``streaming.events.log_counts_stream`` is the form over a stream."""
    line = F.concat_ws(" ", "event_type", F.concat(F.lit("user="), "user_id"), F.concat(F.lit("took="), F.floor("value")))
    return S.running_counts(table(spark, d, "events").select("event_id", line.alias("line")), PATTERNS, "event_id", "line")


@query("e07_sentence_pack", None)
def e07(spark, d):
    """Sentences of each text packed into chunks of up to 200 tokens that share their last two sentences."""
    packed = arrow_text.sentence_packs(200)
    return table(spark, d, "documents").select("doc_id", F.posexplode(packed("text")).alias("chunk", "c")).select("doc_id", "chunk", "c.content", "c.tokens")


@query("h22_recursive_split", None)
def h22(spark, d):
    split = arrow_text.recursive_splits(120, 30)
    return table(spark, d, "documents").select("doc_id", F.posexplode(split("text")).alias("chunk", "content"))


@query("p10_token_count", r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS tokens FROM documents")
def p10(spark, d):
    """With the offline tokenizer, white space; ``p10_bpe_count`` counts by a vocabulary file."""
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("tokens"))


@query("n04_tokenizer", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\S+'), ' ') AS decoded, len(regexp_extract_all(text, '\S+')) AS tokens FROM documents")
def n04(spark, d):
    """Each whole text encoded and decoded by the offline tokenizer; ``n04_bpe_roundtrip`` does so by a vocabulary file."""
    return table(spark, d, "documents").select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), " ").alias("decoded"), T.word_count(F.col("text")).alias("tokens"))


@query("i01_now", "SELECT event_id, TIMESTAMP '2024-06-01 12:00:00' AS created_at, 1717243200::BIGINT AS create_time FROM events")
def i01(spark, d):
    """The time is a parameter, so that a rerun gives the same rows."""
    now = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", now.alias("created_at"), F.unix_timestamp(now.cast("timestamp")).alias("create_time"))

