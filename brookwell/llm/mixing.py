"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Sources get target words by weight, capped at ``most`` times what they hold; what
a cap cuts off is shared again by weight. Within a source the document rates r
maximise the entropy of r and most - r against rates of most / 2 under one
constraint: the expected words equal the target. The solution is an exponential
tilt of the odds, r / (most - r) = exp(lambda * size / mean size), and lambda is
found for all sources at once by Newton steps on the convex dual. A step is a
join and a grouped sum over (source, size) cells, so its cost depends on the
number of distinct sizes, not documents; a bracket falls back to bisection where
a Newton step would leave it.

Rates become whole copies from long to short documents: the copies of a source's
cells up to any size are the nearest whole number to the copies due, by prefix
sums over ranges of ``RANGE`` sizes and then over the ranges. What that leaves
owed or overpaid, half of the longest document at most, goes to the source's
``TAIL`` shortest sizes, where each cell takes the copies that keep the words
taken nearest to the words due; the error at the end is about half of a short
document. Which documents of a cell get one copy more goes by a hash, cell parts
of about ``PART`` documents each taking their share. Sums that decide are exact
decimals, so a rerun gives the same whatever the order of its rows.

Defined cases: a null text has size 0; null sources form one source, last in
order; a null id is carried through; repeated rows are documents of their own
(equal rows may differ in copies, the set of results stays the same); a source
without words has target 0 and takes nothing; a very long text is a cell of its
own; an empty table gives an empty one; other columns are not looked at, whatever
their names. An iteration that doesn't converge raises an error.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.llm.work import attach, drop, fresh, written

WORD = r"[^\x20\x09-\x0D]+"
PART, RANGE, TAIL = 1000, 1024, 1024


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _exact(c: Column) -> Column:
    """A sum that doesn't depend on the order of its terms."""
    return F.sum(c.cast("decimal(38,20)")).cast("double")


def _ranked(totals: DataFrame) -> DataFrame:
    """``totals`` with ``rank``, from 0 in the order of source (null last): places within sorted ranges, and the rows of the ranges before."""
    order = F.col("source").asc_nulls_last()
    ordered = written(totals.repartitionByRange(order).sortWithinPartitions(order).withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    ranges = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return ordered.withColumn("part", part).join(ranges, "part").withColumn("rank", F.col("before") + F.col("place") - F.shiftleft("part", 33)).drop("part", "place", "before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, docs, source_size, target) from (source, size, n) cells."""
    totals = sizes.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    totals = written(_ranked(totals).withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double")), "sources")
    total = lambda c: F.coalesce(_exact(c), F.lit(0.0))
    whole, caps = totals.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * float(share), total(F.col("cap"))).first()
    due, level, full = min(float(whole), caps), 0.0, -1
    while True:  # each round caps more sources; three numbers come back from each
        capped = F.col("cap") <= level * F.col("weight")
        n, taken, left = totals.agg(F.count_if(capped), total(F.when(capped, F.col("cap"))), total(F.when(~capped, F.col("weight")))).first()
        if n == full or not left:
            break
        full, level = n, (due - taken) / left
    return totals.select("source", "docs", "source_size", F.least("cap", level * F.col("weight")).alias("target") if left else F.col("cap").alias("target"))


def _rate(lam: Column, x: Column, most: float) -> Column:
    return most / (1 + F.exp(-lam * x))


def solve_tilts(cells: DataFrame, targets: DataFrame, most: float = 2.0, tolerance: float = 1e-7, most_rounds: int = 80) -> DataFrame:
    """(source, lam, fixed): fixed is the rate of a source whose target is nothing or all it may take."""
    same = F.col("source").eqNullSafe(F.col("s"))
    state = targets.select(
        F.col("source").alias("s"), "target", (F.col("source_size") / F.col("docs")).alias("mean"),
        F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= most * F.col("source_size") * (1 - 1e-12), float(most)).alias("fixed"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("error"),
    )

    def step(state: DataFrame) -> DataFrame:
        x = F.col("size") / F.col("mean")
        r = _rate(F.col("lam"), x, most)
        sums = cells.join(state.where("fixed IS NULL"), same).groupBy("s").agg(
            _exact(F.col("n") * F.col("size") / F.col("target") * r).alias("words"), _exact(F.col("n") * F.col("size") / F.col("target") * x * r * (1 - r / most)).alias("slope")
        ).withColumnRenamed("s", "k")
        met = state.join(sums, F.col("s").eqNullSafe(F.col("k")), "left").withColumn("gap", F.col("words") - 1)
        met = met.withColumn("high", F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("high"))).withColumn("low", F.when(F.col("gap") <= 0, F.col("lam")).otherwise(F.col("low")))
        reach = 2 + F.abs("lam")
        newton = F.col("lam") - F.when(F.col("slope") > 0, F.col("gap") / F.col("slope")).otherwise(F.signum("gap") * reach)
        newton = F.greatest(F.least(newton, F.col("lam") + reach), F.col("lam") - reach)
        outside = (newton <= F.col("low")) | (newton >= F.col("high"))
        new = F.when(F.coalesce(outside, F.lit(False)), F.coalesce((F.col("low") + F.col("high")) / 2, newton)).otherwise(newton)
        error = F.coalesce(F.abs("gap"), F.lit(0.0))
        return met.select("s", "target", "mean", "fixed", F.when(error > tolerance, new).otherwise(F.col("lam")).alias("lam"), "low", "high", error.alias("error"))

    state = written(state, "tilts")
    for _ in range(0, most_rounds, 2):  # two steps are written at a time
        if state.where(F.col("fixed").isNull() & (F.col("error") > tolerance)).isEmpty():
            return state.select(F.col("s").alias("source"), "mean", "lam", "fixed")
        old, state = state, written(step(step(state)), "tilts")
        drop(old)
    raise RuntimeError(f"the tilts have not converged after {most_rounds} rounds")


def _copies(cells: DataFrame, tilts: DataFrame, most: float) -> DataFrame:
    """(source, size, rate, n, base, extra): copies that all documents of a cell get, and how many of them get one more."""
    t = tilts.withColumnRenamed("source", "s")
    rated = cells.join(t, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", F.coalesce("fixed", _rate(F.col("lam"), F.col("size") / F.col("mean"), most)).alias("rate"))
    rated = written(rated.select("source", "size", "n", "rate", (F.col("n") * F.col("rate")).cast("decimal(28,12)").alias("due"), F.floor(F.col("size") / RANGE).alias("range")), "rated")
    by_range = rated.groupBy("source", "range").agg(F.count("*").alias("cells"), F.sum("due").alias("due"))
    shorter = F.coalesce(F.sum("cells").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_range = by_range.select(F.col("source").alias("s"), F.col("range").alias("r"), shorter.alias("shorter"))
    rated = rated.join(by_range, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    place = F.col("shorter") + F.row_number().over(Window.partitionBy("source", "range").orderBy("size"))
    rated = written(rated.withColumn("in_tail", place <= TAIL).drop("shorter"), "rated")
    most_of_cell = F.floor(F.col("n") * F.lit(float(most))).cast("long")

    head = rated.where("NOT in_tail")
    ranges = head.groupBy("source", "range").agg(F.sum("due").alias("due"))
    zero = F.lit(0).cast("decimal(38,12)")
    before = F.coalesce(F.sum("due").over(Window.partitionBy("source").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)), zero)
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), before.alias("before"))
    head = head.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    upto = F.col("before") + F.sum("due").over(Window.partitionBy("source", "range").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
    nearest = lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    head = head.withColumn("upto", upto).withColumn("copies", F.least(nearest(F.col("upto")) - nearest(F.col("upto") - F.col("due")), most_of_cell))
    head = written(head.select("source", "size", "rate", "n", "due", "copies"), "head")
    owed = head.groupBy(F.col("source").alias("s")).agg(F.sum((F.col("due") - F.col("copies")).cast("decimal(18,12)") * F.col("size").cast("decimal(19,0)")).cast("double").alias("owed"))

    kind = "array<struct<size:bigint,rate:double,n:bigint,copies:bigint>>"

    def step(acc: Column, c: Column) -> Column:
        due = c["n"] * c["rate"]
        wanted = F.round(due + F.when(c["size"] > 0, acc["owed"] / c["size"]).otherwise(F.lit(0.0)))
        copies = F.greatest(F.lit(0), F.least(F.floor(c["n"] * F.lit(float(most))), wanted)).cast("long")
        row = F.struct(c["size"].alias("size"), c["rate"].alias("rate"), c["n"].alias("n"), copies.alias("copies"))
        return F.struct((acc["owed"] + (due - copies) * c["size"]).cast("double").alias("owed"), F.concat(acc["out"], F.array(row)).cast(kind).alias("out"))

    # At most TAIL sizes a source
    tail = rated.where("in_tail").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "n", "rate")), asc=False).alias("cells"))
    tail = tail.join(owed, F.col("source").eqNullSafe(F.col("s")), "left")
    folded = F.aggregate("cells", F.struct(F.coalesce("owed", F.lit(0.0)).alias("owed"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])
    tail = tail.select("source", F.explode(folded).alias("c")).select("source", "c.*")
    cell = tail.unionByName(head.drop("due"))
    base = F.floor(F.col("copies") / F.col("n"))
    return cell.withColumn("base", base).withColumn("extra", F.col("copies") - F.col("base") * F.col("n")).drop("copies")


def _allotted(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Written table (id, source, text_hash, size, rows, rate, source_size, target, base, more): of ``rows`` equal rows, ``more`` get base + 1 copies and the others base."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("text_hash"), size_of(F.col(text_col)).alias("size"))
    sized = written(sized.groupBy("id", "source", "text_hash", "size").agg(F.count("*").alias("rows")), "sizes")
    cells = written(sized.groupBy("source", "size").agg(F.sum("rows").alias("n"), F.count("*").alias("n_rows")), "cells")
    targets = written(source_targets(cells.drop("n_rows"), weights, share, most), "targets")
    plan = _copies(cells.drop("n_rows"), solve_tilts(cells.drop("n_rows"), targets, most), most)
    aims = targets.select(F.col("source").alias("s"), "source_size", "target")
    plan = plan.join(aims, F.col("source").eqNullSafe(F.col("s"))).drop("s").join(cells.select(F.col("source").alias("s"), F.col("size").alias("z"), "n_rows").hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    plan = written(plan.withColumn("parts", F.ceil(F.col("n") / PART)), "plan")

    placed = attach(sized, plan, ["source", "size"], "n_rows", sized.count()).drop("n_rows")
    placed = placed.withColumn("h", F.xxhash64("id", "text_hash", F.lit("copies"))).withColumn("part", F.pmod("h", "parts"))
    placed = written(placed, "placed")
    counts = placed.groupBy("source", "size", "part").agg(F.sum("rows").alias("in_part"))
    upto = F.sum("in_part").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), "in_part", upto.alias("upto"))
    placed = placed.join(counts.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p"))).drop("s", "z", "p")
    quota = F.floor(F.col("extra") * F.col("upto") / F.col("n")) - F.floor(F.col("extra") * (F.col("upto") - F.col("in_part")) / F.col("n"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("source", "size", "part").orderBy("h", "id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("rows"), quota - before)).cast("long")
    return written(placed.select("id", "source", "text_hash", "size", "rows", "rate", "source_size", "target", "base", more.alias("more")), "allotted")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, text_hash, source, size, source_size, target, rate, copies, taken."""
    each = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    out = _allotted(docs, weights, share, most, id_col, text_col, source_col).withColumn("row", each)
    out = out.withColumn("copies", F.col("base") + (F.col("row") <= F.col("more")).cast("long"))
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("source").alias(source_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The documents of the mix in their own columns, with ``copies`` and ``taken``; equal rows become one with their copies added up. Columns of those names are replaced."""
    docs = docs.drop("copies", "taken")
    plan = _allotted(docs, weights, share, most, id_col, text_col, source_col)
    i, s, h = (fresh(docs, c) for c in ("__id", "__source", "__hash"))
    plan = plan.select(F.col("id").alias(i), F.col("source").alias(s), F.col("text_hash").alias(h), "rows", "base", "more", "size").where("base > 0 OR more > 0")
    names = {c: fresh(docs, f"__{c}") for c in ("rows", "base", "more", "size")}
    plan = plan.withColumnsRenamed(names)
    rows, base, more, size = (F.col(names[c]) for c in ("rows", "base", "more", "size"))
    keyed = docs.withColumns({i: F.col(id_col), s: F.col(source_col).cast("string"), h: F.xxhash64(text_col)})
    met = attach(keyed, plan, [i, s, h], names["rows"], plan.count())
    kept = [F.col(f"`{c}`") for c in docs.columns]
    single = met.where(rows == 1).select(*kept, (base + more).alias("copies"), ((base + more) * size).alias("taken"))
    equal, first = fresh(docs, "__equal"), fresh(docs, "__before")
    repeated = met.where(rows > 1).groupBy(*met.columns).agg(F.count("*").alias(equal))
    order = Window.partitionBy(i, s, h).orderBy(F.xxhash64(*kept)).rowsBetween(Window.unboundedPreceding, -1)
    repeated = repeated.withColumn(first, F.coalesce(F.sum(equal).over(order), F.lit(0)))
    copies = base * F.col(equal) + F.greatest(F.lit(0), F.least(F.col(equal), more - F.col(first)))
    repeated = repeated.select(*kept, copies.cast("long").alias("copies"), (copies * size).cast("long").alias("taken")).where("copies > 0")
    return single.unionByName(repeated)
