"""Ordered set operations on array columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from brookwell.functions.text import strip


def ordered_union(old: Column, new: Column) -> Column:
    """Old order kept, new distinct values appended, empty strings dropped."""
    return F.array_distinct(F.filter(F.concat(old, new), lambda x: x != ""))


def keyword_union(lists: Column) -> Column:
    """Comma-separated lists to one sorted list of distinct keywords."""
    words = F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, ","), strip)))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(words, lambda x: x != ""))), ",")


def limited(ids: Column, most: int, method: str = "FIFO") -> Column:
    """KEEP holds on to the first ids, any other method to the last."""
    return F.when(F.size(ids) <= most, ids).otherwise(F.slice(ids, 1, most) if method == "KEEP" else F.slice(ids, -most, most))


def merged_paths(old: Column, new: Column, most: int = 100) -> Column:
    return F.slice(F.array_distinct(F.concat(old, new)), 1, most)


def first_distinct(ids: Column, most: int) -> Column:
    return F.slice(F.array_distinct(ids), 1, most)


def alternate_roles(turns: Column) -> Column:
    """Texts as user and assistant messages in turn."""
    return F.transform(turns, lambda x, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), x.alias("content")))
