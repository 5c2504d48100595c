"""Written tables that cut lineage, for operators outside ``brookwell.llm``."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """``name`` in the folder in ``spark.checkpoint.dir``; removed when the program ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        local = spark.sparkContext.master.startswith("local[")
        top = "file://" + tempfile.mkdtemp(prefix="brookwell-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    path = f"{top.rstrip('/')}/brookwell/{name}"

    def clean() -> None:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone by then
            pass

    atexit.register(clean)
    return path


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = shared_path(df.sparkSession, f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
