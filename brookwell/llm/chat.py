"""Chat formatting: multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that
speaker as the assistant, the others as named users and system turns as they are.
The result has one row per turn and perspective: the rendered segment, where it
stands in the perspective's text (characters, end exclusive), and the span that
the training loss covers: the assistant's own words with their end mark. Joined
in ``position`` order, the segments are the rendered dialogue. It stays in rows
because a conversation may hold any share of all turns.

All turns are sorted once, by conversation and order, over ranges (equal rows
too can lie in several). Runs of up to ``RUN`` neighbours of that order carry the
rest: perspectives meet turns by run, and offsets are prefix sums over the runs
and then inside them, so no task needs a whole conversation, whatever its turn
numbers are.

Defined cases: a null or blank speaker is a named user ``unknown`` and no
participant; a null text is empty; turns are ordered by number (null last), then
speaker and text, so ties and repeated rows have a place each; a null
conversation id is one conversation; a conversation without participants gives no
rows; marks inside a text or name are defused by a space; a very long text is one
segment; an empty table gives an empty one; other columns are not looked at,
whatever their names.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.llm.work import written

RUN_BITS = 10
RUN = 1 << RUN_BITS
SYSTEM = "system"


def _defused(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _in_order(turns: DataFrame, id_col: str, turn_col: str, speaker_col: str, text_col: str) -> DataFrame:
    """Written table (c, turn, speaker, text, place, run): place grows in the order of a conversation's turns, run numbers up to RUN neighbours."""
    speaker = F.when(F.trim(F.col(speaker_col).cast("string")) != "", F.col(speaker_col).cast("string"))
    said = turns.select(F.col(id_col).alias("c"), F.col(turn_col).cast("long").alias("turn"), speaker.alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("c"), F.col("turn").asc_nulls_last(), F.col("speaker").asc_nulls_last(), F.col("text"), F.col("row")]
    said = said.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    said = said.drop("row").withColumn("place", F.monotonically_increasing_id())
    return written(said.withColumn("run", F.shiftright("place", RUN_BITS)), "turns")


def rotate(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """Columns: id, perspective, position, turn, role, name, segment, seg_start, seg_end, mask_start, mask_end."""
    said = _in_order(turns, id_col, turn_col, speaker_col, text_col)
    views = said.where(F.col("speaker").isNotNull() & (F.col("speaker") != SYSTEM)).select(F.col("c").alias("vc"), F.col("speaker").alias("perspective")).distinct()
    runs = said.select("c", "run").distinct().join(views, F.col("c").eqNullSafe(F.col("vc"))).select("vc", F.col("run").alias("vr"), "perspective")
    seen = said.join(runs, F.col("c").eqNullSafe(F.col("vc")) & (F.col("run") == F.col("vr"))).drop("vc", "vr")
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    role = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    seen = seen.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.coalesce("speaker", F.lit("unknown"))))
    head = F.when(F.col("role") == "user", F.concat(F.lit("<|user name="), _defused(F.col("name")), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n")))
    body = F.concat(_defused(F.col("text")), F.lit("<|end|>\n"))
    seen = seen.withColumn("head", head).withColumn("body", body).withColumn("segment", F.concat("head", "body")).withColumn("len", F.length("segment").cast("long"))
    sums = seen.groupBy("c", "perspective", "run").agg(F.sum("len").alias("chars"), F.count("*").alias("rows"))
    before = Window.partitionBy("c", "perspective").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select(F.col("c").alias("rc"), F.col("perspective").alias("rp"), F.col("run").alias("rr"), F.coalesce(F.sum("chars").over(before), zero).alias("chars_before"), F.coalesce(F.sum("rows").over(before), zero).alias("rows_before"))
    placed = seen.join(sums, F.col("c").eqNullSafe(F.col("rc")) & (F.col("perspective") == F.col("rp")) & (F.col("run") == F.col("rr")))
    inside = Window.partitionBy("c", "perspective", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("seg_end", F.col("chars_before") + F.sum("len").over(inside)).withColumn("position", F.col("rows_before") + F.count("*").over(inside) - 1)
    start = F.col("seg_end") - F.col("len")
    masked = F.col("role") == "assistant"
    return placed.select(
        F.col("c").alias(id_col), "perspective", "position", "turn", "role", "name", "segment", start.alias("seg_start"), "seg_end",
        F.when(masked, start + F.length("head")).alias("mask_start"), F.when(masked, F.col("seg_end") - 1).alias("mask_end"),
    )
