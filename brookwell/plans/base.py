"""The query registry, and the logical tables that the queries derive from the standard ones, in Spark and in SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwell.functions.text import hashed_id
from brookwell.functions.vectors import unit
from brookwell.operators.chunking import token_chunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under ``name``, with the SQL of the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workspace, doc_key, file_path and text of each document."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("workspace"), "doc_id", hashed_id("doc-", F.col("text")).alias("doc_key"), F.col("source").alias("file_path"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_chunks(documents(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk vectors: the embeddings of document ids, with the document's text and path."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("file_path"), F.col("text").alias("content"))
    return table(spark, sf_dir, "embeddings").join(docs, "vec_id").withColumn("unit", unit(F.col("embedding")))


def asked(spark: SparkSession, sf_dir: str, only: int | None = None) -> DataFrame:
    """Query vectors: every vector whose id is divisible by 50, or one question."""
    chosen = F.col("vec_id") % 50 == 0 if only is None else F.col("vec_id") == only
    return table(spark, sf_dir, "embeddings").where(chosen).select(F.col("vec_id").alias("query_id"), "embedding", unit(F.col("embedding")).alias("unit"))


def edges(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Undirected supplier-part graph: src <= tgt, weight is the quantity moved in hundreds. With ``parts``, lines are dealt into so many before they are grouped."""
    lines = table(spark, sf_dir, "lineitem")
    if parts:
        lines = lines.repartition(parts, "l_suppkey", "l_partkey")
    li = lines.groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum("l_quantity") / 100, 6).alias("weight"))
    p, s = F.concat(F.lit("p:"), F.col("l_partkey")), F.concat(F.lit("s:"), F.col("l_suppkey"))
    return li.select(F.least(p, s).alias("src"), F.greatest(p, s).alias("tgt"), "weight")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p:"), F.col("p_partkey")).alias("entity_id"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("description"), F.col("p_brand").alias("file_path"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey")).alias("entity_id"), F.lit("supplier").alias("entity_type"), F.col("s_name").alias("description"), F.concat(F.lit("nation"), F.col("s_nationkey")).alias("file_path"))
    return parts.union(suppliers)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threaded messages: every seventh turn is discarded."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), ((F.col("conv_id") + F.col("turn")) % 7 == 3).alias("is_discarded"))


#: The same tables as common table expressions.
DOCS = "docs AS (SELECT lang AS workspace, doc_id, 'doc-' || md5(text) AS doc_key, source AS file_path, text FROM documents)"
CHUNKS = DOCS + r""", toks AS (SELECT *, regexp_extract_all(text, '\S+') AS t FROM docs),
chunks AS (SELECT workspace, doc_id, doc_key, file_path, CAST(i AS BIGINT) AS chunk_order_index, CAST(len(p) AS BIGINT) AS tokens, array_to_string(p, ' ') AS content, 'chunk-' || md5(array_to_string(p, ' ')) AS chunk_id
  FROM (SELECT *, t[i * 700 + 1:i * 700 + 800] AS p FROM (SELECT *, unnest(range(0, CAST(ceil(len(t) / 700.0) AS BIGINT))) AS i FROM toks WHERE len(t) > 0)))"""
VECTORS = "vecs AS (SELECT vec_id, source AS file_path, text AS content, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN documents ON vec_id = doc_id)"
EDGES = """edges AS (SELECT least('p:' || l_partkey, 's:' || l_suppkey) AS src, greatest('p:' || l_partkey, 's:' || l_suppkey) AS tgt, round(sum(l_quantity) / 100, 6) AS weight FROM lineitem GROUP BY l_partkey, l_suppkey)"""
NODES = """nodes AS (SELECT 'p:' || p_partkey AS entity_id, p_type AS entity_type, p_name AS description, p_brand AS file_path FROM part UNION ALL SELECT 's:' || s_suppkey, 'supplier', s_name, 'nation' || s_nationkey FROM supplier)"""
MESSAGES = "messages AS (SELECT conv_id AS thread, turn AS seq, role, text AS content, (conv_id + turn) % 7 = 3 AS is_discarded FROM conversations)"
