"""Token windows over documents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookwell.functions.text import hashed_id


def windows(tokens: Column, size: int = 800, overlap: int = 100) -> Column:
    """Token windows that start every ``size - overlap`` tokens; an empty text has none, the last may be short."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(size - overlap)), lambda i: i < F.size(tokens))
    return F.transform(starts, lambda i: F.slice(tokens, i + 1, size))


def token_chunks(docs: DataFrame, text: str = "text", size: int = 800, overlap: int = 100, separator: str | None = None, only_separator: bool = False) -> DataFrame:
    """Each document's columns (but the text) with chunk_order_index, tokens, content and chunk_id.

    With a separator the text is first split at it: pieces of up to ``size`` tokens
    stay whole, empty ones included, and longer ones become windows (or stay whole,
    with ``only_separator``). Tokens are runs without white space, joined by a space.
    """
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+"), F.lit(0))
    if separator is None:
        pieces = windows(F.col("__t"), size, overlap)
        docs = docs.withColumn("__t", tokens)
    else:
        quoted = "".join("\\" + x if not x.isalnum() else x for x in separator)
        split = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), quoted), lambda p: F.regexp_extract_all(p, F.lit(r"\S+"), F.lit(0)))
        whole = lambda p: F.array(p)
        pieces = F.flatten(F.transform(F.col("__t"), whole if only_separator else lambda p: F.when(F.size(p) > size, windows(p, size, overlap)).otherwise(F.array(p))))
        docs = docs.withColumn("__t", split)
    kept = [c for c in docs.columns if c not in (text, "__t")]
    out = docs.select(*kept, F.posexplode(pieces).alias("chunk_order_index", "__p"))
    content = F.array_join("__p", " ")
    return out.select(*kept, F.col("chunk_order_index").cast("long").alias("chunk_order_index"), F.size("__p").cast("long").alias("tokens"), content.alias("content"), hashed_id("chunk-", content).alias("chunk_id"))
