"""Descriptions of a name brought down to one text: gates by token sums, then rounds of bins and summaries over written tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookwell.functions import text as T
from brookwell.operators import mentions, models, packing
from brookwell.operators.kept import kept


def _gathered(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n, texts): the texts of a group in order. A group's tokens are bounded before this."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "description"))), lambda x: x["description"])
    return rows.groupBy(*by).agg(F.count("*").alias("n"), listed.alias("texts"))


def _prompt(name: Column, texts: Column, budget: int) -> Column:
    """Texts as JSON lines, as many as the budget of tokens admits."""
    lines = F.transform(texts, lambda x: F.concat(F.lit('{"Description": '), T.json_quoted(x), F.lit("}")))
    sizes = F.transform(lines, T.word_count)
    fits = F.filter(lines, lambda x, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0).cast("long"), lambda s, y: s + y) <= budget)
    return F.concat(F.lit("Summarise "), name, F.lit(":\n"), F.array_join(fits, "\n"))


def summarised(rows: DataFrame, context: int = 12_000, force: int = 30, most: int = 1200, rounds: int = 8, model: models.Model = models.first_words, separator: str = T.SEP) -> DataFrame:
    """(name, description, used_model, rounds) from (name, pos, description), one row a name; ``pos`` is a whole number that orders a name's texts.

    Each round first adds up the tokens of a name, in partial sums, and gathers nothing.
    A name with one text is done; one whose texts fit in ``context`` tokens, or are two,
    is joined (fewer than ``force`` texts and ``most`` tokens) or summarised as a whole.
    The others' texts are dealt into bins of about ``context`` tokens, each bin of two or
    more becomes its summary, and the next round goes on with those. After ``rounds``
    what is left is summarised from the texts that fit. So no row holds more than a bin.
    """
    now = kept(rows.select("name", "pos", "description", F.lit(False).alias("used"), T.word_count(F.col("description")).alias("tokens")), "descriptions")
    out = None

    def done(found: DataFrame) -> None:
        nonlocal out
        found = kept(found.select("name", "description", "used_model", "rounds"), "summaries")
        out = found if out is None else out.union(found)

    for k in range(1, rounds + 1):
        sums = now.groupBy("name").agg(F.count("*").alias("n"), F.sum("tokens").alias("total"), F.max(F.col("used").cast("int")).alias("used_before"))
        gated = kept(sums.withColumn("action", mentions.summary_gate(F.col("n"), F.col("total"), force, most, context)), "gates")
        last = k == rounds
        ready = gated.where("action <> 'map_reduce'")
        met = _gathered(now.join(ready.select("name"), "name", "left_semi"), "name").join(ready.select("name", "action", "used_before"), "name")
        said = models.answered(F.when(F.col("action") == "summarise", _prompt(F.col("name"), F.col("texts"), context)), model)
        done(met.select("name", F.coalesce(said, F.array_join("texts", separator)).alias("description"), ((F.col("used_before") == 1) | (F.col("action") == "summarise")).alias("used_model"), F.lit(k).alias("rounds")))
        left = gated.where("action = 'map_reduce'").select("name")
        if left.isEmpty():
            return out
        more = kept(now.join(left, "name", "left_semi"), "descriptions")
        if last:
            some = packing.token_prefix(more, ["name"], ["pos"], F.col("tokens"), context)
            some = some.union(more.join(some.select("name").distinct(), "name", "left_anti").groupBy("name").agg(F.min_by(F.struct("pos", "description", "used", "tokens"), "pos").alias("x")).select("name", "x.*"))
            done(_gathered(some, "name").select("name", models.answered(_prompt(F.col("name"), F.col("texts"), max(context, 1)), model).alias("description"), F.lit(True).alias("used_model"), F.lit(k).alias("rounds")))
            return out
        bins = packing.greedy_bin_rows(more.select("name", "pos", "tokens"), "name", "pos", "tokens", context)
        binned = _gathered(more.join(bins, ["name", "pos"]), "name", "bin")
        new = binned.select("name", F.col("bin").cast("long").alias("pos"), F.when(F.col("n") == 1, F.col("texts")[0]).otherwise(models.answered(F.when(F.col("n") > 1, _prompt(F.col("name"), F.col("texts"), context)), model)).alias("description"))
        now = kept(new.select("name", "pos", "description", F.lit(True).alias("used"), T.word_count(F.col("description")).alias("tokens")), "descriptions")
    return out
