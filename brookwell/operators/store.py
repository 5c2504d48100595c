"""Keyed rows as a store: lookups, upserts by version, deletes, pages and constraint reports, all as joins and windows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def in_order(ids: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Asked ids (pos, key) with their rows; unknown ids are dropped, ``pos`` keeps the order asked in."""
    return ids.join(store, key)


def new_keys(ids: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Asked ids that the store doesn't have."""
    return ids.select(key).distinct().join(store, key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Old rows replaced by new ones of equal key as a whole; ``keep`` columns stay as they were first."""
    n = new.select(F.col(key), F.lit(True).alias("__new"), *(F.col(c).alias(f"__{c}") for c in old.columns if c != key))
    fresh = lambda c: F.coalesce(F.col(c), F.col(f"__{c}")) if c in keep else F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c))
    return old.join(n, key, "full_outer").select(key, *(fresh(c).alias(c) for c in old.columns if c != key))


def without(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Rows but those whose keys are in ``gone``."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(*rows.columns)


def page_before(rows: DataFrame, order: str, before, size: int) -> DataFrame:
    """The ``size`` newest rows below ``before``, oldest first."""
    older = rows if before is None else rows.where(F.col(order) < before)
    return older.orderBy(F.desc(order)).limit(size).orderBy(order)


def page_with_more(rows: DataFrame, order: list[Column | str], size: int) -> DataFrame:
    """The first ``size`` rows with ``has_more``: whether another follows."""
    some = rows.orderBy(*order).limit(size + 1)
    rank = F.row_number().over(Window.orderBy(*order))
    counted = some.withColumn("__n", F.count("*").over(Window.partitionBy(F.lit(1)))).withColumn("__rank", rank)
    return counted.where(F.col("__rank") <= size).withColumn("has_more", F.col("__n") > size).drop("__n", "__rank")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Violations of a unique constraint: keys with their number of rows, where over one."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def transitions(log: DataFrame, key: str, state: str, order: list[Column | str]) -> DataFrame:
    """(key, before, after) of each step in an entity's log of states; ``before`` of the first is null."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return log.select(key, before.alias("before"), F.col(state).alias("after"))


def illegal(steps: DataFrame, allowed: dict[str | None, tuple[str, ...]]) -> DataFrame:
    """Steps that ``allowed`` (state before -> states after) doesn't have."""
    legal = F.lit(False)
    for before, after in allowed.items():
        legal = legal | ((F.col("before").isNull() if before is None else F.coalesce(F.col("before") == before, F.lit(False))) & F.col("after").isin(*after))
    return steps.where(~legal)


def machine(log: DataFrame, key: str, code: Column, order: str, states: int, moves: list[list[int]], start: int = 0, run: int = 4096) -> DataFrame:
    """(key, state): where a state machine stands after all events of a key.

    ``moves[code][state]`` is the state that an event leads to. A run of events maps
    each state to a state; runs of the whole-number ``order`` are composed in turn,
    so no task needs all events of a key.
    """
    table = F.array(*(F.lit(s) for row in moves for s in row))
    step = lambda m, r: F.transform(m, lambda s: F.element_at(table, r["code"] * states + s + 1))
    rows = log.select(key, F.floor(F.col(order) / run).alias("run"), F.struct(F.col(order), code.cast("int").alias("code")).alias("r"))
    every = F.array(*(F.lit(i) for i in range(states)))
    runs = rows.groupBy(key, "run").agg(F.aggregate(F.array_sort(F.collect_list("r")), every, step).alias("m"))
    folded = F.aggregate(F.array_sort(F.collect_list(F.struct("run", "m"))), F.lit(start), lambda s, x: F.element_at(x["m"], s + 1))
    return runs.groupBy(key).agg(folded.alias("state"))
