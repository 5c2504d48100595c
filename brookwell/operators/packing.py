"""Budgets over ordered lists."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.operators.kept import kept


def token_prefix(rows: DataFrame, by: list[str], order: list[Column | str], tokens: Column, budget: int) -> DataFrame:
    """Of each list (``by``) in its order the longest prefix whose tokens add up to at most ``budget``."""
    if budget <= 0:
        return rows.limit(0)
    total = F.sum(tokens).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__total", total).where(F.col("__total") <= budget).drop("__total")


def first_seen(rows: DataFrame, by: list[str], value: str, order: list[Column | str]) -> DataFrame:
    """Of equal values in a list the first in its order."""
    rank = F.row_number().over(Window.partitionBy(*by, value).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def greedy_bins(sizes: Column, most: int) -> Column:
    """Bin number of each item: a bin is closed when the next item would exceed ``most``, but one item alone absorbs the next."""

    def step(acc: Column, size: Column) -> Column:
        full = (acc["filled"] + size > most) & (acc["n"] > 1)
        bin_ = acc["bin"] + full.cast("int")
        return F.struct(bin_.alias("bin"), F.when(full, 1).otherwise(acc["n"] + 1).alias("n"), F.when(full, size.cast("long")).otherwise(acc["filled"] + size).alias("filled"), F.concat(acc["out"], F.array(bin_)).alias("out"))

    start = F.struct(F.lit(0).alias("bin"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("filled"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def _upto(rows: DataFrame, by: str, run: str, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Running sums of ``sums`` in the order of ``run`` and ``order``, by adding up runs first, so no task needs a whole list."""
    runs = rows.groupBy(by, run).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = Window.partitionBy(by).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col(by).alias("__b"), F.col(run).alias("__r"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    inside = Window.partitionBy(by, run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(runs, (F.col(by) == F.col("__b")) & (F.col(run) == F.col("__r")))
    return placed.withColumns({n: F.col(f"__{n}") + F.sum(c).over(inside) for n, c in sums.items()}).drop("__b", "__r", *(f"__{n}" for n in sums))


def greedy_bin_rows(items: DataFrame, by: str, id_col: str, size_col: str, most: int, run: int = 1024) -> DataFrame:
    """(by, id, bin): ``greedy_bins`` of each list in the order of the whole-number ids, one row an item.

    With P the running sum of sizes, the bin that starts after item k ends at the
    last item with P up to P(k) + most, two items on at least. That item has its P
    in the next piece of ``most`` after P(k)'s, or is the last in P(k)'s own. From
    the first item on, the real starts are marked by pointer doubling.
    """
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    rows = items.select(F.coalesce(F.concat(F.lit("="), F.col(by)), F.lit("")).alias("g"), F.col(by).alias("key"), F.col(id_col).alias("id"), size.alias("size"))
    rows = rows.withColumn("run", F.coalesce(F.floor(F.col("id") / run), F.lit(2**62)))
    rows = kept(_upto(rows, "g", "run", [F.col("id").asc_nulls_last(), "size"], {"k": F.lit(1), "p": F.col("size")}).drop("run", "size"), "placed")
    ends = rows.select("g", "k", "p").union(rows.select("g", F.lit(0).cast("long"), F.lit(0).cast("long")).distinct()).withColumn("piece", F.floor(F.col("p") / most))
    ends = ends.withColumn("own", F.max("k").over(Window.partitionBy("g", "piece")))
    asked = ends.select("g", (F.col("piece") + 1).alias("piece"), (F.col("p") + most).alias("p"), F.lit(None).cast("long").alias("seen"), "k", "own")
    there = ends.select("g", "piece", "p", F.col("k").alias("seen"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("own"))
    upto = Window.partitionBy("g", "piece").orderBy("p").rangeBetween(Window.unboundedPreceding, 0)
    ahead = asked.union(there).withColumn("last", F.max("seen").over(upto)).where("k IS NOT NULL")
    after = ahead.select("g", (F.col("k") + 1).alias("k"), F.greatest(F.coalesce("last", "own") + 1, F.col("k") + 3).alias("next"))
    total = rows.groupBy(F.col("g").alias("tg")).agg(F.max("k").alias("n"))
    starts = after.join(total, F.col("g") == F.col("tg")).where("k <= n").select("g", "k", F.when(F.col("next") <= F.col("n"), F.col("next")).alias("next"), (F.col("k") == 1).alias("real"))
    starts = kept(starts, "starts")
    while starts.where("real AND next IS NOT NULL").limit(1).count():
        there = starts.select(F.col("g").alias("tg"), F.col("k").alias("tk"), F.col("next").alias("then"))
        hit = starts.where("real AND next IS NOT NULL").select(F.col("g").alias("hg"), F.col("next").alias("hk")).distinct().withColumn("hit", F.lit(True))
        jumped = starts.join(there, (F.col("g") == F.col("tg")) & (F.col("next") == F.col("tk")), "left").join(hit, (F.col("g") == F.col("hg")) & (F.col("k") == F.col("hk")), "left")
        starts = kept(jumped.select("g", "k", F.col("then").alias("next"), (F.col("real") | F.coalesce("hit", F.lit(False))).alias("real")), "starts")
    numbered = _upto(starts.withColumn("run", F.floor(F.col("k") / run)), "g", "run", ["k"], {"bin": F.col("real").cast("int")})
    found = rows.join(numbered.select("g", "k", "bin"), ["g", "k"])
    return found.select(F.col("key").alias(by), F.col("id").alias(id_col), (F.col("bin") - 1).cast("int").alias("bin"))
