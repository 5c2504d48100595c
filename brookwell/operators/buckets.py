"""Keyed tables on disk that change in place: rows are dealt into buckets by a hash of the key, and a change rewrites the buckets it touches, no others."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwell.operators import store
from brookwell.operators.kept import kept


@dataclass(frozen=True)
class Buckets:
    """A folder by ``bucket``; ``n`` is fixed when it is made, so it should suit the size that the table will have."""

    path: str
    key: str
    n: int

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int"))

    def create(self, rows: DataFrame) -> "Buckets":
        self._dealt(rows).repartition("bucket").write.partitionBy("bucket").parquet(self.path)
        return self

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("bucket")

    def _change(self, touched: DataFrame, merge) -> list[int]:
        """Rewrite the buckets of ``touched`` (with the key) by ``merge(their rows)``; their numbers."""
        spark = touched.sparkSession
        numbers = sorted(r[0] for r in self._dealt(touched.select(self.key)).select("bucket").distinct().collect())  # at most n
        if numbers:
            old = spark.read.parquet(self.path)
            merged = kept(self._dealt(merge(old.where(F.col("bucket").isin(numbers)).drop("bucket"))), "merged")
            merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
            emptied = set(numbers) - {r[0] for r in merged.select("bucket").distinct().collect()}
            for number in emptied:
                target = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={number}")
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        return numbers

    def upsert(self, new: DataFrame, keep: tuple[str, ...] = ()) -> list[int]:
        """Rows of equal key are replaced as a whole but for the ``keep`` columns; one new row a key. The numbers of the buckets that were rewritten."""
        new = kept(new, "changes")
        return self._change(new, lambda old: store.upserted(old, new, self.key, keep))

    def delete(self, keys: DataFrame) -> list[int]:
        keys = kept(keys.select(self.key).distinct(), "gone")
        return self._change(keys, lambda old: store.without(old, keys, self.key))

    def drop_sources(self, gone: DataFrame, holders: DataFrame, sources: str = "sources") -> list[int]:
        """Take the ``gone`` sources (source) off the rows of ``holders`` (the key of each row that has one of them); a row goes with its last source."""
        holders = kept(holders.select(self.key).distinct(), "holders")
        listed = kept(gone.select("source").distinct(), "gone")

        def merge(old: DataFrame) -> DataFrame:
            hit = old.join(holders, self.key, "left_semi")
            left = hit.select(self.key, F.posexplode(sources).alias("pos", "source")).join(listed, "source", "left_anti")
            left = left.groupBy(self.key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]).alias("__left"))
            kept_rows = hit.join(left, self.key).withColumn(sources, F.col("__left")).select(*old.columns)
            return old.join(holders, self.key, "left_anti").select(*old.columns).union(kept_rows)

        return self._change(holders, merge)
