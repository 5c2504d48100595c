"""A Spark session with the settings that the library is tuned for."""

from pyspark.sql import SparkSession


def session(name: str = "brookwell", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive plans, UTC and Arrow; shuffle partitions stay with the cluster unless given in ``conf``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
