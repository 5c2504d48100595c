"""Keywords of questions: the offline extractor weighs terms by how rare they are in the documents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.functions import text as T

#: What is a low-level and a high-level term, and how many of them a question keeps.
LOW, HIGH = "[a-z]{4,}", "[A-Z][a-z]{3,}"
MOST_LOW, MOST_HIGH = 8, 4


def _listed(rows: DataFrame, text: Column, *keep: str, once: bool = False) -> DataFrame:
    """(keep..., kind, term), one row an occurrence or, with ``once``, one a row and term.

    Low terms are what is left of a text that is split at all else, which makes no
    object for each match; shorter words go once they are rows.
    """
    some = F.array_distinct if once else lambda x: x
    low = some(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"))
    high = some(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(HIGH), F.lit(0)))
    both = F.array(F.struct(F.lit("low").alias("kind"), low.alias("t")), F.struct(F.lit("high").alias("kind"), high.alias("t")))
    return rows.select(*keep, F.explode(both).alias("b")).select(*keep, "b.kind", F.explode("b.t").alias("term")).where(F.length("term") >= 4)


def terms(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep..., kind, term, tf): low terms in lower case, high terms as they are written."""
    return _listed(rows, text, *keep).groupBy(*keep, "kind", "term").agg(F.count("*").alias("tf"))


def weighted(questions: DataFrame, documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(query_id, kind, term, weight, rank): of each question the terms of most tf * ln(N / df) over the ``documents``; ties by term.

    Only terms that a question has are counted in the documents, each once in the
    document's own row, so no terms are shuffled by document.
    """
    asked = terms(questions, F.col(text_col), "query_id")
    wanted = asked.select("kind", "term").distinct()
    total = documents.count()
    known = _listed(documents, F.col(text_col), once=True)
    df = known.groupBy("kind", "term").agg(F.count("*").alias("df")).join(wanted, ["kind", "term"], "left_semi")
    met = asked.join(df, ["kind", "term"], "left").withColumn("weight", F.round(F.col("tf") * F.ln(F.lit(float(total)) / F.coalesce("df", F.lit(1))), 6))
    rank = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.desc("weight"), "term"))
    most = F.when(F.col("kind") == "low", MOST_LOW).otherwise(MOST_HIGH)
    return met.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "kind", "term", "weight", "rank")


def extracted(questions: DataFrame, documents: DataFrame, answer: Column | None = None, text_col: str = "text") -> DataFrame:
    """The questions with ``low`` and ``high``, arrays of keywords as read from a model's JSON; an answer that doesn't parse gives none.

    The offline model's answer lists the weighted terms; ``answer`` may replace it
    (null where the offline one stands).
    """
    lists = weighted(questions, documents, text_col).groupBy("query_id", "kind").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    both = lists.groupBy("query_id").agg(*(F.first(F.when(F.col("kind") == k, F.col("t.term")), ignorenulls=True).alias(f"__{k}") for k in ("low", "high")))
    none = F.array().cast("array<string>")
    met = questions.join(both, "query_id", "left")
    offline = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.coalesce("__high", none).alias("high_level_keywords"), F.coalesce("__low", none).alias("low_level_keywords"))), F.lit("\n```"))
    said = offline if answer is None else F.coalesce(answer, offline)
    got = F.from_json(T.json_text(said), "high_level_keywords array<string>, low_level_keywords array<string>")
    read = lambda c: F.coalesce(got[c], none)
    return met.select(*questions.columns, read("low_level_keywords").alias("low"), read("high_level_keywords").alias("high"))
