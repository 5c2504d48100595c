"""A training corpus from raw documents: five stages, each one operator.

Every stage reads the Parquet table that the one before has written. All but the
last return the columns of ``documents``; the last returns them with ``copies``
and ``taken``. Decisions take effect: rejected documents and near-duplicates but
one of each class go, contaminated documents go, common lines and secrets leave
the texts (``n_chars`` is counted anew), and the mix drops documents of no copies.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwell.llm import decontaminate, mixing, nearjoin, quality, secret_scan
from brookwell.llm.work import fresh, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents by the quality rules; remove lines above their host's limit."""
    return quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates: the one of least id.

    Rows of equal id and text count as copies of each other; of those that differ in other
    columns the one stays whose other columns, written as JSON, come first.
    """
    i, h, own, rest, row = (fresh(docs, c) for c in ("__id", "__hash", "__own", "__rest", "__row"))
    keepers = nearjoin.near_duplicates(docs).where("keeps").select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct()
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    single = docs.select("doc_id", F.xxhash64("text").alias(own), F.to_json(F.struct(*others)).alias(rest) if others else F.lit("").alias(rest), every.alias(row))
    single = single.groupBy("doc_id", own).agg(F.min_by(row, rest).alias(row))
    return single.join(keepers, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(h)), "left_semi").select(f"{row}.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that have a window of a benchmark item: ten of its words, or all of a shorter one."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    i, h = fresh(docs, "__id"), fresh(docs, "__hash")
    hit = decontaminate.phrase_matches(docs, benchmark).where("n_hit > 0").select(F.col("doc_id").alias(i), F.col("text_hash").alias(h))
    return docs.join(hit, docs.doc_id.eqNullSafe(F.col(i)) & (F.xxhash64(docs.text) == F.col(h)), "left_anti")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts."""
    return secret_scan.redact_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each document the copies that bring its source near its target."""
    return mixing.mix_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixing),
]

#: The rates of the last stage come from an iteration, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
