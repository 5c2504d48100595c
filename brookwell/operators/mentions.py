"""Extraction records to mentions, and mentions merged into entities and relations.

Merging never gathers all mentions of a name in one place: counts, first places
and distinct texts are grouped on their own keys first, so a name that holds a
third of all mentions shuffles a row for each of its distinct values only.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.functions import text
from brookwell.operators.kept import kept
from brookwell.operators.store import latest


def _literal(*marks: str) -> str:
    return "|".join("".join("\\" + x if not x.isalnum() else x for x in m) for m in marks)


def _pieces(c: Column, marks: str) -> Column:
    return F.filter(F.transform(F.split(c, marks), text.strip), lambda x: x != "")


def _any(c: Column, *marks: str) -> Column:
    """Whether a mark is there, without the work of splitting."""
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(m)) for m in marks))


def records(outputs: DataFrame, result: str = "result") -> DataFrame:
    """Each output's columns with record (0-based), attrs, kind, entity and relation, one row a record.

    Lines and end marks (in either case) part the records. Records that are glued
    by a field delimiter, the kind and another delimiter are parted there, and get
    the kind at their head; damaged delimiters are repaired; blank records go.
    ``entity`` is (name, type, description) of an entity record of four fields,
    ``relation`` (src, tgt, keywords, description, weight) of a relation record of
    five, else null. A record is worked out whole before the rows are made, as what
    is computed after that would be computed again by each filter on it.
    """
    f = text.FIELD
    headed = lambda kind: lambda x: F.when(x.startswith("entity") | x.startswith("relation"), x).otherwise(F.concat(F.lit(kind + f), x))
    lines = _pieces(F.col(result), _literal("\n", text.DONE, text.DONE.lower()))
    glued = lambda lists, kind, *marks: F.flatten(F.transform(lists, lambda x: F.when(_any(x, *marks), F.transform(_pieces(x, _literal(*marks)), headed(kind))).otherwise(F.array(headed(kind)(x)))))
    by_entity = glued(lines, "entity", f"{f}entity{f}")
    by_relation = glued(by_entity, "relation", f"{f}relationship{f}", f"{f}relation{f}")
    attrs = F.transform(by_relation, lambda x: _pieces(text.repair_fields(x), _literal(f)))
    rows = outputs.select(*(c for c in outputs.columns if c != result), F.posexplode(F.transform(attrs, _read)).alias("record", "__r"))
    return rows.where(F.size("__r.attrs") > 0).select(*(c for c in rows.columns if c != "__r"), "__r.*")


def _read(attrs: Column) -> Column:
    """One record as a struct."""
    a = lambda i: F.get(attrs, F.lit(i))
    kind = F.when(F.contains(a(0), F.lit("relation")), "relation").when(F.contains(a(0), F.lit("entity")), "entity")
    named = lambda c: text.sanitize(c, outer_quotes=True)
    entity = F.struct(named(a(1)).alias("name"), text.entity_type(a(2)).alias("type"), text.sanitize(a(3)).alias("description"))
    weight = F.when(text.is_number(a(4)), text.strip(a(4)).try_cast("double")).otherwise(F.lit(1.0))
    relation = F.struct(named(a(1)).alias("src"), named(a(2)).alias("tgt"), F.replace(a(3), F.lit("，"), F.lit(",")).alias("keywords"), text.sanitize(a(4)).alias("description"), weight.alias("weight"))
    is_entity, is_relation = kind.eqNullSafe("entity") & (F.size(attrs) == 4), kind.eqNullSafe("relation") & (F.size(attrs) == 5)
    return F.struct(attrs.alias("attrs"), kind.alias("kind"), F.when(is_entity, entity).alias("entity"), F.when(is_relation, relation).alias("relation"))


def entities(parsed: DataFrame) -> DataFrame:
    """Valid entity records as name, type, description: four fields, a name, a clean type and a description."""
    kept = [c for c in parsed.columns if c not in ("attrs", "kind", "entity", "relation")]
    return parsed.where((F.col("entity.name") != "") & F.col("entity.type").isNotNull() & (F.col("entity.description") != "")).select(*kept, "entity.*")


def relations(parsed: DataFrame) -> DataFrame:
    """Valid relation records as src, tgt, keywords, description, weight: five fields and two different ends; the weight is the description if that is a number, else 1."""
    kept = [c for c in parsed.columns if c not in ("attrs", "kind", "entity", "relation")]
    return parsed.where((F.col("relation.src") != "") & (F.col("relation.tgt") != "") & (F.col("relation.src") != F.col("relation.tgt"))).select(*kept, "relation.*")


def counted(mentions: DataFrame, order: Column) -> DataFrame:
    """(name, type, chunk, description, n, first, seen): mentions that are alike as one row; what merging needs, so that it parses nothing twice."""
    return mentions.groupBy("name", "type", "chunk", "description").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min(F.struct(F.col("ts"), order.alias("o"))).alias("seen"))


def majority_type(rows: DataFrame) -> DataFrame:
    """(name, type) from counted mentions: the most frequent type, of equally frequent ones the first seen."""
    types = rows.groupBy("name", "type").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return latest(types, ["name"], [F.desc("n"), "first"]).select("name", "type")


def first_sources(rows: DataFrame, most: int = 300, method: str = "FIFO") -> DataFrame:
    """(name, sources): distinct chunks in the order first seen; KEEP holds on to the first ``most``, FIFO to the last."""
    seen = rows.groupBy("name", "chunk").agg(F.min("first").alias("first"))
    by = F.col("first").asc() if method == "KEEP" else F.col("first").desc()
    some = seen.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(by))).where(F.col("r") <= most)
    return some.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "chunk"))), lambda x: x["chunk"]).alias("sources"))


def distinct_descriptions(rows: DataFrame) -> DataFrame:
    """(name, descriptions): by time, then longest first, then place."""
    seen = rows.groupBy("name", "description").agg(F.min("seen").alias("f"))
    row = F.struct(F.col("f.ts").alias("ts"), (-F.length("description")).alias("long"), F.col("f.o").alias("o"), "description")
    return seen.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["description"]).alias("descriptions"))


def merged_entities(mentions: DataFrame, order: Column, most: int = 300) -> DataFrame:
    """(name, type, sources, descriptions) of each name; the mentions are read once."""
    rows = kept(counted(mentions, order), "mentions")
    return majority_type(rows).join(first_sources(rows, most), "name").join(distinct_descriptions(rows), "name")


def merged_relations(found: DataFrame) -> DataFrame:
    """(src, tgt, weight, keywords, n, description) of each unordered pair: weights added up, keywords as one sorted set, distinct descriptions in order; the relations are read once."""
    pair = found.groupBy(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), "keywords", "description").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    pair = kept(pair, "pairs")
    sums = pair.groupBy("src", "tgt").agg(F.round(F.sum("weight"), 6).alias("weight"), F.collect_set("keywords").alias("k"), F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("description")), text.SEP).alias("description"))
    words = F.array_sort(F.array_distinct(_pieces(F.array_join("k", ","), ",")))
    return sums.select("src", "tgt", "weight", F.array_join(words, ",").alias("keywords"), "n", "description")


def gleaned(first: DataFrame, second: DataFrame) -> DataFrame:
    """(name, description) after a second pass: a name's text is replaced only if the new one is longer; new names are added."""
    s = second.select("name", F.col("description").alias("__d"))
    longer = F.when(F.col("description").isNull() | (F.length("__d") > F.length("description")), F.col("__d")).otherwise(F.col("description"))
    return first.select("name", "description").join(s, "name", "full_outer").select("name", F.coalesce(longer, "description").alias("description"))


def summary_gate(n: Column, tokens: Column, force: int = 30, most: int = 1200, context: int = 12_000) -> Column:
    """What happens to a name's descriptions: empty, single, join, summarise or map_reduce."""
    small = (tokens <= context) | (n <= 2)
    return F.when(n == 0, "empty").when(n == 1, "single").when(small & (n < force) & (tokens < most), "join").when(small, "summarise").otherwise("map_reduce")
