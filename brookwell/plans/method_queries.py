"""Queries of methods beside the plain forms: an approximate index, byte pairs, rounds of summaries, buckets that change in place, measures of ranked lists."""

import uuid

from pyspark.sql import functions as F

from brookwell.operators import bpe, buckets, ivf, metrics, store, summaries, vectors
from brookwell.operators.kept import kept, shared_path
from brookwell.plans import store_queries  # noqa: F401  whose SQL is used here, too
from brookwell.plans.base import SQL, VECTORS, asked, query, table
from brookwell.plans.base import vectors as vector_table
from brookwell.plans.merge_queries import W, found_entities, place
from brookwell.plans.retrieval_queries import MANY, scored, top

#: A public vocabulary of ranks, which lies beside the tokenizer libraries on every machine.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("c24_knn_index", None)
def c24_index(spark, d):
    """The nearest ten of every question by the inverted file; recall is measured against ``c24_knn_cross``."""
    index = ivf.build(vector_table(spark, d).drop("unit", "content"), "vec_id")
    return ivf.search(index, asked(spark, d), 10).select("query_id", "vec_id", "rank", "similarity")


@query("l12_reduce", None)
def l12_reduce(spark, d):
    """Every name's descriptions brought down to one, in as many rounds as they need."""
    seen = found_entities(spark, d).groupBy("name", "description").agg(F.min(place()).alias("pos"))
    return summaries.summarised(seen, context=60, force=6, most=20)


@query("p10_bpe_count", None)
def p10_bpe(spark, d):
    return bpe.token_counts(table(spark, d, "documents"), RANKS)


@query("n04_bpe_roundtrip", "SELECT doc_id, md5(text) AS digest FROM documents")
def n04_bpe(spark, d):
    """Whole texts encoded and decoded."""
    ids = kept(bpe.encoded(table(spark, d, "documents"), RANKS), "ids")
    return bpe.decoded(ids, RANKS).select("doc_id", F.md5("text").alias("digest"))


LISTS = f"WITH {VECTORS}, {MANY}, {scored('v.vec_id <> q.query_id')}, {top(20)}, r AS (SELECT query_id, rank, t.label = e.label AS relevant, e.label FROM t JOIN embeddings e ON e.vec_id = query_id)"


@query("l39_ranked_metrics", f"{LISTS}, m AS (SELECT query_id, label, max(CASE WHEN relevant AND rank <= 5 THEN 1 ELSE 0 END) AS hit, coalesce(1 / min(CASE WHEN relevant THEN rank END), 0) AS rr, count(*) FILTER (relevant AND rank <= 5) / 5 AS p FROM r GROUP BY query_id, label) SELECT label, count(*) AS queries, round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr, round(avg(p), 6) AS precision FROM m GROUP BY label")
def l39_metrics(spark, d):
    """Hit@5, mean reciprocal rank and precision@5 of the 20 nearest of each question; a vector of the question's label is relevant."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    found = vectors.top_k(vector_table(spark, d), asked(spark, d), 21, "vec_id", threshold=-1.0).where("vec_id <> query_id")
    lists = vectors.ranked(found.drop("rank"), "vec_id", 20).join(labels, "query_id").select("query_id", "rank", (F.col("label") == F.col("own")).alias("relevant"), "own")
    measures = metrics.of_lists(lists).join(labels, "query_id").withColumnRenamed("own", "label")
    return metrics.averaged(measures, "label")


@query("a24_bucket_upsert", SQL["a24_kv_upsert"])
def a24_buckets(spark, d):
    """The same upsert in place: only buckets with a changed key are written anew."""
    start = F.lit("1990-01-01").cast("timestamp_ntz")
    old = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("key"), F.col("c_name").alias("value"), start.alias("created_at"), start.alias("updated_at"))
    sent = table(spark, d, "orders").where("o_custkey % 3 = 0").select(F.concat(F.lit("c:"), F.col("o_custkey")).alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"), "o_orderkey")
    new = store.latest(sent, ["key"], [F.desc("updated_at"), F.desc("o_orderkey")]).drop("o_orderkey")
    kept_in = buckets.Buckets(shared_path(spark, f"kv-{uuid.uuid4().hex}"), "key", 32).create(old)
    kept_in.upsert(new, keep=("created_at",))
    return kept_in.read(spark)


@query("l30_bucket_delete", f"{W} SELECT name, count(DISTINCT doc_id) AS n FROM ents WHERE doc_id % 10 <> 3 GROUP BY name")
def l30_buckets(spark, d):
    """Entities once some documents are deleted: an entity goes with its last source, buckets without such an entity stay as they are."""
    found = found_entities(spark, d).select("name", F.col("doc_id").cast("string").alias("source")).distinct()
    held = kept(found.groupBy("name").agg(F.array_sort(F.collect_list("source")).alias("sources")), "entities")
    kept_in = buckets.Buckets(shared_path(spark, f"entities-{uuid.uuid4().hex}"), "name", 32).create(held)
    gone = table(spark, d, "documents").where("doc_id % 10 = 3").select(F.col("doc_id").cast("string").alias("source"))
    holders = held.select("name", F.explode("sources").alias("source")).join(gone, "source", "left_semi").select("name")
    kept_in.drop_sources(gone, holders)
    return kept_in.read(spark).select("name", F.size("sources").cast("long").alias("n"))
