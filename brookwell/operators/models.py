"""Injected models: any function from a list of texts to a list of answers or vectors, called in batches inside tasks.

The defaults are deterministic stand-ins that need no network. A model is called
once for each distinct text that is not in the cache.
"""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[str]]
BATCH = 256


def first_words(texts: list[str], n: int = 12) -> list[str]:
    """The offline model: a text's first words."""
    import re

    return [" ".join(re.findall(r"[^ \t\n\v\f\r]+", t)[:n]) for t in texts]


def answered(prompt: Column, model: Model = first_words, batch: int = BATCH, tries: int = 3) -> Column:
    """``model`` over batches of prompts; a null prompt has a null answer. A batch that fails is tried again, then the task fails (and is retried by Spark)."""

    def call(texts: list[str]) -> list[str]:
        for left in range(tries - 1, -1, -1):
            try:
                out = model(texts)
                if len(out) != len(texts):
                    raise ValueError(f"{len(out)} answers to {len(texts)} prompts")
                return out
            except Exception:
                if not left:
                    raise
        return []

    def run(prompts: pd.Series) -> pd.Series:
        asked = prompts.dropna()
        said = [x for at in range(0, len(asked), batch) for x in call(asked.iloc[at : at + batch].tolist())]
        return pd.Series(said, index=asked.index, dtype="object").reindex(prompts.index)

    return F.pandas_udf(run, "string")(prompt)


def with_cache(prompts: DataFrame, cache: DataFrame, kind: str, prompt: str = "prompt", model: Model = first_words) -> tuple[DataFrame, DataFrame]:
    """(prompts with ``answer``, new cache rows): ``cache`` has key, content and create_time; the key is the kind and the prompt's digest, and only distinct misses are sent to the model. The new rows should be written before they are used twice."""
    keyed = prompts.withColumn("key", F.concat(F.lit(f"{kind}:"), F.md5(prompt)))
    missing = keyed.select("key", prompt).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti").where(F.col("key").isNotNull())
    new = missing.select("key", answered(F.col(prompt), model).alias("content"))
    known = cache.select("key", "content").unionByName(new)
    return keyed.join(known, "key", "left").withColumnRenamed("content", "answer"), new


def embedded(text: Column, embedder: Callable[[list[str]], list[list[float]]], dimensions: int, batch: int = BATCH) -> Column:
    """``embedder`` over batches of texts; a null text has a null vector. Raises where a vector has not ``dimensions`` numbers."""

    def run(texts: pd.Series) -> pd.Series:
        asked = texts.dropna()
        found = [v for at in range(0, len(asked), batch) for v in embedder(asked.iloc[at : at + batch].tolist())]
        if len(found) != len(asked) or any(len(v) != dimensions for v in found):
            raise ValueError(f"the embedder gave vectors of other lengths than {dimensions}, or not one a text")
        rest = iter(found)
        return pd.Series([list(map(float, next(rest))) if there else None for there in texts.notna()], index=texts.index, dtype="object")

    return F.pandas_udf(run, "array<float>")(text)
