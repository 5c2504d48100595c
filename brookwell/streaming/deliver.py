"""Delivery of a stream's rows once: each micro-batch has a folder of its own, so a batch that is run again replaces what it had written."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brookwell.streaming.events import fan_out


def delivered(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows, **trigger: object) -> StreamingQuery:
    """Write ``prepare(batch)`` of each micro-batch to ``path``/batch=N. Static sides that ``prepare`` reads are read anew for each batch."""

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def broadcast(stream: DataFrame, members: Callable[[], DataFrame], gone: Callable[[], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each event of ``stream`` (thread, user_id, ...) to every member (thread, member) but its sender; connections that are ``gone`` (member) get nothing."""
    return delivered(stream, path, checkpoint, lambda rows: fan_out(rows, members().join(gone(), "member", "left_anti")))


def pushed(stream: DataFrame, online: Callable[[], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each event of ``stream`` (target, ...) to its target, if it is ``online`` (target)."""
    return delivered(stream, path, checkpoint, lambda rows: rows.join(online().select("target").distinct(), "target", "left_semi"))


def received(spark, path: str) -> DataFrame:
    """All that was delivered, with its ``batch``."""
    return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("long"))
