"""Files as tables: uploads, plain texts, question sets, parsed content items."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.functions.text import strip

#: Extensions of files that are taken in, and fields that a question must have.
EXTENSIONS = (".pdf", ".docx", ".pptx", ".txt")
QUESTION_FIELDS = ("id", "question", "ground_truth", "category")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, extension, length, content) of the files below ``path`` that have an accepted extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), extension.alias("extension"), "length", "content").where(F.col("extension").isin(*EXTENSIONS))


def accepted(files: DataFrame) -> DataFrame:
    return files.where(F.col("extension").isin(*EXTENSIONS))


def plain_texts(files: DataFrame) -> DataFrame:
    """(path, text) of the text files, decoded and stripped; empty ones are dropped."""
    return files.where(F.col("extension") == ".txt").select("path", strip(F.decode("content", "UTF-8")).alias("text")).where("text <> ''")


def questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON list of questions, or with ``lines`` one a line; raises if a field is missing or an id is there twice."""
    found = spark.read.option("multiLine", str(not lines).lower()).json(path)
    missing = [f for f in QUESTION_FIELDS if f not in found.columns]
    if missing:
        raise ValueError(f"questions without {', '.join(missing)}")
    bad = F.lit(False)
    for f in QUESTION_FIELDS:
        bad = bad | F.col(f).isNull()
    if found.where(bad).limit(1).count():
        raise ValueError("a question lacks a field")
    if found.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("a question id is there twice")
    return found


def separated(items: DataFrame, doc: str = "doc_id", pos: str = "pos", kind: str = "type", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Content items of documents as (doc, text), non-blank texts joined by blank lines in order, and the rows of all other types."""
    said = items.where((F.col(kind) == "text") & (strip(F.col(text)) != ""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text])
    return said.groupBy(doc).agg(F.array_join(parts, "\n\n").alias("text")), items.where(F.col(kind) != "text")


def running_counts(lines: DataFrame, patterns: dict[str, str], order: str, line: str, run: int = 4096) -> DataFrame:
    """(order, pattern, count_so_far): each line's hits with the running count of their pattern, by runs of the whole-number ``order`` first, so no task needs all lines of a pattern."""
    hits = F.filter(F.array(*(F.when(F.col(line).rlike(p), F.lit(name)) for name, p in patterns.items())), lambda x: x.isNotNull())
    found = lines.select(order, F.explode(hits).alias("pattern")).withColumn("run", F.floor(F.col(order) / run))
    before = Window.partitionBy("pattern").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = found.groupBy("pattern", "run").agg(F.count("*").alias("n")).select("pattern", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("pattern", "run").orderBy(order)
    return found.join(runs, ["pattern", "run"]).select(order, "pattern", (F.col("before") + F.row_number().over(inside)).alias("count_so_far"))


def save(rows: DataFrame, path: str) -> None:
    """Replace what is at ``path``; the committer shows the new files only once all are written."""
    rows.write.mode("overwrite").parquet(path)
