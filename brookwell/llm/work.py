"""Shared folders and written tables that cut lineage."""

import atexit
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: A key is hot beyond this many rows, or beyond a share of the rows that at most MOST_HOT keys can have.
LEAST_HOT, MOST_HOT = 100, 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a local
    master gets a temporary folder (tests) and a cluster gets its warehouse.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if spark.sparkContext.master.startswith("local["):
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="brookwell-")
        else:
            _OWN[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return _OWN[app]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder by Hadoop's file system, whatever store it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/brookwell/{label}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by then
            pass

    atexit.register(clean)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A lost executor then costs at most the tasks of one step; the readers see
    file sizes, so Spark decides on broadcasts by measured size.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop(*tables: DataFrame) -> None:
    """Remove written tables whose last reader has been written itself."""
    for table in tables:
        delete(table.sparkSession, table.written_to)


def attach(rows: DataFrame, unique: DataFrame, on: list[str], n: str, total: int, reduce_hot: Callable[[DataFrame], DataFrame] | None = None, merge: bool = True) -> DataFrame:
    """Inner join of ``rows`` with the one row of ``unique`` for each key (nulls match), however many rows a key has.

    Column ``n`` of ``unique``, a written table, is at least the number of ``rows``
    with the key, and its sum at most about ``total``. Keys of more than ``total /
    MOST_HOT`` rows (``LEAST_HOT`` at least) are hot; there are fewer than
    ``MOST_HOT`` of them, so hashes of them come to the driver, they are broadcast
    and their rows stay where they are (``reduce_hot`` may shrink them). The other
    keys are joined by a shuffle, or with ``merge`` off as Spark decides by size.
    With hot keys ``rows`` is read twice, so it should be a written table or cheap.
    """
    keys = {c: f"__on_{c}" for c in on}
    right = unique.withColumnsRenamed(keys)
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(F.col(k)) for c, k in keys.items()])
    key_hash = F.xxhash64(*keys.values())
    hot = [r[0] for r in right.where(F.col(n) > max(LEAST_HOT, total // MOST_HOT)).select(key_hash).collect()]
    plain = lambda rows, unique: rows.join(unique.hint("merge") if merge else unique, same).drop(*keys.values())
    if not hot:
        return plain(rows, right)
    is_hot, key_is_hot = F.xxhash64(*(rows[c] for c in on)).isin(hot), key_hash.isin(hot)
    hot_rows = rows.where(is_hot).join(F.broadcast(right.where(key_is_hot)), same).drop(*keys.values())
    return plain(rows.where(~is_hot), right.where(~key_is_hot)).unionByName(reduce_hot(hot_rows) if reduce_hot else hot_rows)


def meet(rows: DataFrame, others: DataFrame, on: list[str], n: str, total: int, spread: list[str]) -> DataFrame:
    """Inner join of ``rows`` with all ``others`` of their key (no nulls), however many rows a key has.

    Both have column ``n``, at least the number of ``rows`` with the key, whose sum over
    the keys is at most about ``total``. A hot key's rows are spread by their columns ``spread``
    over one shard for each ``total / MOST_HOT`` of them, and its others are repeated for
    each shard: at most ``MOST_HOT`` times in all for one other a key.
    """
    keys = {c: f"__on_{c}" for c in on}
    shards = F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(max(LEAST_HOT, total // MOST_HOT)))).cast("long")
    left = rows.withColumn("__shard", F.pmod(F.xxhash64(*spread), shards)).drop(n)
    right = others.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1))).drop(n).withColumnsRenamed(keys)
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(k) for c, k in keys.items()])
    return left.join(right, same & (F.col("__shard") == F.col("__part"))).drop("__shard", "__part", *keys.values())
