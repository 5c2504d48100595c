"""The stages of the pipeline, one by one, on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from brookwell.llm import nearjoin, secret_scan

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (docs, out)
        assert out.columns[: len(columns)] == columns
        docs = out
    before, after = seen["n-gram Jaccard join"]
    classes = nearjoin.brute_force([tuple(r) for r in before.select("doc_id", "text").collect()])
    assert {r.doc_id for r in after.collect()} == {c for _, c, _ in classes}
    before, after = seen["secret scans"]
    assert after.count() == before.count()
    assert not any(secret_scan.find_spans(r.text) for r in after.collect())
    before, after = seen["mixing sources to target weights"]
    assert after.agg(F.sum("taken")).first()[0] > before.count() and after.where("copies not in (1, 2)").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == after.count()


WORDS = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}word" for i in range(80))
LONG = " ".join(f"long{i}" for i in range(120_000))
ODD = [
    (1, None, "a"), (None, WORDS, None), (None, WORDS, None), (2, "", "a"), (3, WORDS + " and more", "a"), (3, WORDS + " and more", "a"), (4, LONG, "b"), (5, WORDS.upper() + " PASSWORD=abcdefgh1", "b"),
    (6, " ".join(f"x{i}y" for i in range(90)) + " token: zyxwvut99", "b"), (7, " ".join(f"{i}q" for i in range(60)) + " b1 b2 b3 b4 b5 b6 b7 b8 b9 b10", "b"),
]
CLASH = ["__id", "__hash", "__own", "__h", "__s", "__k", "rows", "id", "key", "bands", "copies", "taken", "source_size", "lines"]


def odd_documents(spark, folder, rows=ODD):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    spark.createDataFrame([(1, "B1 b2, b3 b4 b5 b6 b7 b8 b9 b10"), (2, None), (None, "nowhere to be found at all in these few documents")], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return docs.withColumns({c: F.lit(f"clash {c}") for c in CLASH})


def test_each_stage_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing names: every stage keeps its columns and gives the stated rows."""
    docs = odd_documents(spark, tmp_path)
    stage = dict(corpus_pipeline.STAGES)
    run = lambda name, docs: stage[name](spark, docs, str(tmp_path))
    ids = lambda df: sorted((r.doc_id is None, r.doc_id) for r in df.select("doc_id").collect())
    clean = run("quality rules", docs)
    assert clean.columns == docs.columns and ids(clean) == [(False, i) for i in (3, 3, 4, 5, 6, 7)] + [(True, None)] * 2
    single = run("n-gram Jaccard join", docs)
    assert single.columns == docs.columns and ids(single) == [(False, i) for i in (1, 2, 3, 4, 6, 7)]
    assert {r[c] for r in single.collect() for c in CLASH} == {f"clash {c}" for c in CLASH}
    found = run("benchmark decontamination", docs)
    assert found.columns == docs.columns and 7 not in [r.doc_id for r in found.collect()] and found.count() == len(ODD) - 1
    hidden = run("secret scans", docs)
    texts = {r.doc_id: r for r in hidden.collect()}
    assert hidden.columns == docs.columns and hidden.count() == len(ODD) and texts[5].text.endswith("[SECRET]") and texts[5].n_chars == len(texts[5].text) and texts[1].text is None
    mixed = run("mixing sources to target weights", docs)
    assert set(mixed.columns) == set(docs.columns) and mixed.where("copies < 1 or copies > 4").count() == 0 and mixed.where("doc_id = 4").first().taken in (120_000, 240_000)


def test_each_stage_on_an_empty_table(spark, tmp_path):
    docs = odd_documents(spark, tmp_path).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []


def test_the_survivor_does_not_depend_on_the_partitions(spark, tmp_path):
    rows = [(1, WORDS, f"s{i}") for i in (3, 1, 4, 0, 5, 2)] + [(2, WORDS, "a"), (None, "alone in here", "z"), (None, "alone in here", None)]
    for n in (1, 2, 3, 5):
        docs = odd_documents(spark, tmp_path, rows).repartition(n)
        kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        assert sorted((r.doc_id or 0, r.source) for r in kept.collect()) == [(0, None), (1, "s0")]
