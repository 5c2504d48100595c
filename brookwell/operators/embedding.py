"""Offline embeddings: signed feature hashing with a sparse random projection."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookwell.functions.vectors import dot, similarity
from brookwell.operators import pairs, vectors
from brookwell.operators.kept import kept

DIMENSIONS, SPREAD = 64, 2


def word_vector(text: Column, dimensions: int = DIMENSIONS, spread: int = SPREAD) -> Column:
    """Whole numbers: each lower-case word adds 1 or -1 to ``spread`` (at most 4) of the ``dimensions`` slots, by its digest.

    That is the word's row of a sparse random projection, so no vocabulary is kept
    and dot products estimate those of the word counts. A null or blank text is all zeros.
    """
    if not 1 <= spread <= 4:
        raise ValueError("spread must be 1 to 4")
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def added(lists: pa.Array) -> pa.Array:
        return _added(dimensions, spread, lists)

    return F.arrow_udf(added, "array<int>")(words)


def _added(dimensions: int, spread: int, words: pa.Array) -> pa.Array:
    """The vectors of lists of words; each distinct word of a batch is digested once."""
    coded = words.flatten().dictionary_encode()
    digests = [hashlib.md5(w.encode()).hexdigest() for w in coded.dictionary.to_pylist()]
    numbers = np.array([[int(h[8 * j : 8 * j + 7], 16) for j in range(spread)] for h in digests], dtype=np.int64).reshape(len(digests), spread)
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    word = coded.indices.to_numpy(zero_copy_only=False)
    out = np.zeros(len(words) * dimensions, dtype=np.int64)
    for j in range(spread):
        n = numbers[word, j]
        at = row * dimensions + n % dimensions
        signs = 1 - 2 * (n // dimensions % 2)
        out += np.bincount(at[signs > 0], minlength=len(out)) - np.bincount(at[signs < 0], minlength=len(out))
    return pa.ListArray.from_arrays(np.arange(len(words) + 1, dtype=np.int32) * dimensions, pa.array(out, pa.int32()))


def embedded_texts(rows: DataFrame, text: Column, dimensions: int = DIMENSIONS, spread: int = SPREAD) -> DataFrame:
    """``rows`` with ``v``, the word vector of ``text``, and ``n``, its squared length."""
    rows = rows.withColumn("v", word_vector(text, dimensions, spread))
    return rows.withColumn("n", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x))


def closeness(v: Column, n: Column, w: Column, m: Column) -> Column:
    """Similarity of two word vectors with their squared lengths; one half where a length is zero."""
    size = F.sqrt(n.cast("double") * m)
    return F.round(similarity(F.when(size > 0, dot(v, w) / size).otherwise(F.lit(0.0))), 6)


def nearest(index: DataFrame, queries: DataFrame, k: int, id_col: str, threshold: float) -> DataFrame:
    """The nearest ``k`` rows of ``index`` (v, n and more) for each query (query_id, v, n) with ``similarity`` and ``rank``, those at the threshold or above. Queries of equal vectors are one search."""
    cut = lambda rows, name, id_: rows.select(F.col(id_).alias(name), "v", F.col("n").cast("double").alias("n"))
    asked = kept(queries.groupBy("v", "n").agg(F.min("query_id").alias("search")), "searches")
    met = pairs.best(cut(index, "id", id_col), cut(asked, "query_id", "search"), pairs.WORDS, k, threshold, vectors.MOST_BROADCAST_QUERIES)
    found = vectors.ranked(met.withColumnRenamed("score", "similarity").where(F.col("similarity") >= threshold), "id", k)
    of = queries.select("query_id", "v").join(asked.select("v", "search"), "v").drop("v")
    found = found.withColumnRenamed("query_id", "search").join(of, "search").select("query_id", *(c for c in found.columns if c != "query_id"))
    return vectors.with_columns(found, index, id_col, "v", "n")
