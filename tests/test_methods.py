"""The approximate index, byte pairs, rounds of summaries, buckets and measures, each against a plain form."""

import os
import random

import pytest
from pyspark.sql import functions as F

from brookwell.operators import bpe, buckets, ivf, metrics, summaries, vectors
from brookwell.plans.base import asked
from brookwell.plans.base import vectors as vector_table
from brookwell.registry import QUERIES

SF = "/root/testdata/sf0.1"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_recall_of_the_index(spark):
    """Of the exact ten nearest of all questions over 2,000 vectors at least nine tenths; every row is in the index; all cells give the exact result."""
    rows = vector_table(spark, SF).drop("unit", "content")
    index = ivf.build(rows, "vec_id")
    exact = vectors.top_k(vector_table(spark, SF), asked(spark, SF), 10, "vec_id", threshold=-1.0).cache()
    found = ivf.search(index, asked(spark, SF), 10)
    assert ivf.recall(found, exact, "vec_id").agg(F.avg("recall")).first()[0] >= 0.9
    assert index.read(spark, "codes").count() == rows.count() and index.centroids.count() > 20
    whole = ivf.search(index, asked(spark, SF), 10, probes=10_000, rescored=1000)
    same = lambda df: sorted((r.query_id, r.vec_id, r.rank) for r in df.collect())
    assert same(whole) == same(exact)
    some = ivf.search(index, asked(spark, SF), 5, probes=10_000, rescored=1000, keep=F.col("label") == 3)
    want = vectors.top_k(vector_table(spark, SF), asked(spark, SF), 5, "vec_id", threshold=-1.0, keep=F.col("label") == 3)
    assert same(some) == same(want)


def test_blocks_of_queries_and_few_rows(spark, monkeypatch):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(40)] + [(99, [0.0] * 8)], "id long, embedding array<double>")
    index = ivf.build(rows, "id", cells=3)
    queries = vectors.prepared(rows.where("id < 9").withColumnRenamed("id", "query_id"))
    whole = lambda: sorted((r.query_id, r.id) for r in ivf.search(index, queries, 3, probes=3, rescored=20).collect())
    one = whole()
    monkeypatch.setattr(ivf, "BLOCK", 4)
    assert whole() == one and {(q, q) for q in range(9)} <= set(one)


TEXTS = [(1, None), (2, ""), (3, "Hello world, it's 2024!\n\n  done  "), (4, "naïve Straße 東京 ...  x y"), (5, "a" * 3000 + " " + "ab" * 900), (6, "\t tab\r\n'll 've can't"), (3, "Hello again")]


def test_byte_pairs_equal_a_library_and_come_back(spark):
    tiktoken = pytest.importorskip("tiktoken")
    if not os.path.exists(RANKS):
        pytest.skip("no vocabulary file here")
    library = tiktoken.Encoding("file", pat_str=bpe.WORDS.removeprefix("(?U)"), mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})
    rows = TEXTS + [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = lambda t: library.encode_ordinary(t or "")
    assert sorted((r.doc_id, r.tokens) for r in bpe.token_counts(docs, RANKS).collect()) == sorted((i, len(plain(t))) for i, t in rows)
    ids = bpe.encoded(docs, RANKS)
    assert sorted((r.doc_id, r.ids) for r in ids.collect()) == sorted((i, plain(t)) for i, t in rows)
    assert sorted((r.doc_id, r.text) for r in bpe.decoded(ids, RANKS).collect()) == sorted((i, t or "") for i, t in rows)
    assert bpe.token_counts(docs.limit(0), RANKS).collect() == []


def plain_summary(texts, context, force, most, rounds, model):
    """The loop over one name's texts: (text, model used, rounds)."""
    size, used = lambda t: len(t.split()), False

    def said(name, texts):
        lines, total = [], 0
        for t in texts:
            line = '{"Description": "' + t + '"}'
            total += size(line)
            if total > context:
                break
            lines.append(line)
        return model([f"Summarise {name}:\n" + "\n".join(lines)])[0]

    name, texts = texts
    for k in range(1, rounds + 1):
        total = sum(map(size, texts))
        if len(texts) == 1:
            return texts[0], used, k
        if total <= context or len(texts) <= 2:
            if len(texts) < force and total < most:
                return "<SEP>".join(texts), used, k
            return said(name, texts), True, k
        bins, filled = [[]], 0
        for t in texts:
            if filled + size(t) > context and len(bins[-1]) > 1:
                bins.append([])
                filled = 0
            bins[-1].append(t)
            filled += size(t)
        texts, used = [b[0] if len(b) == 1 else said(name, b) for b in bins], True
    raise AssertionError("more rounds")


def test_summaries_take_the_rounds_they_need_and_no_prompt_is_above_the_budget(spark):
    rng = random.Random(4)
    names = {"one": 1, "two": 2, "few": 4, "many": 40, "most": 400}
    texts = {n: [f"{n}{i} " + " ".join(rng.choice("abcdef") * 2 for _ in range(rng.randrange(1, 9))) for i in range(k)] for n, k in names.items()}
    prompts = []

    def model(asked):
        return [" ".join(p.split()[2:])[:40].replace('"', "").replace("{", "").replace("}", "") for p in asked]

    rows = spark.createDataFrame([(n, i * 3, t) for n, ts in texts.items() for i, t in enumerate(ts)], "name string, pos long, description string")
    got = {r.name: (r.description, r.used_model, r.rounds) for r in summaries.summarised(rows, 60, 6, 30, 8, model).collect()}
    want = {n: plain_summary((n, ts), 60, 6, 30, 8, lambda p: prompts.extend(p) or model(p)) for n, ts in texts.items()}
    assert got == want and got["most"][2] >= 3 and got["two"][1] is False
    assert max(len(p.split()) for p in prompts) <= 60 + 2
    cut = {r.name: r.rounds for r in summaries.summarised(rows, 60, 6, 30, 1, model).collect()}
    assert set(cut) == set(names) and set(cut.values()) == {1}


def files_by_bucket(path):
    return {b: sorted((f, os.stat(f"{path}/{b}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{b}") if f.startswith("part-")) for b in os.listdir(path) if b.startswith("bucket=")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "kv")
    rows = spark.createDataFrame([(f"k{i}", i, [f"d{i}", f"d{i % 3}"]) for i in range(200)], "key string, value long, sources array<string>")
    held = buckets.Buckets(path, "key", 16).create(rows)
    before = files_by_bucket(path)
    numbers = held.upsert(spark.createDataFrame([("k7", 70, ["new"]), ("extra", 1, [])], "key string, value long, sources array<string>"))
    after = files_by_bucket(path)
    assert len(numbers) in (1, 2) and {b for b in before if before[b] != after[b]} == {f"bucket={n}" for n in numbers}
    got = {r.key: r.value for r in held.read(spark).collect()}
    assert len(got) == 201 and got["k7"] == 70 and got["extra"] == 1 and got["k8"] == 8
    numbers = held.delete(spark.createDataFrame([("k8",), ("nobody",)], "key string"))
    assert {b for b in after if after[b] != files_by_bucket(path).get(b)} <= {f"bucket={n}" for n in numbers} and held.read(spark).count() == 200
    assert held.upsert(rows.limit(0)) == [] and held.delete(rows.limit(0)) == []
    held.drop_sources(spark.createDataFrame([("d1",), ("new",)], "source string"), spark.createDataFrame([("k1",), ("k4",), ("k7",)], "key string"))
    left = {r.key: r.sources for r in held.read(spark).where("key in ('k1', 'k4', 'k7', 'k10')").collect()}
    assert left == {"k4": ["d4"], "k10": ["d10", "d1"]}  # k1 had d1 twice, k7 only the new one; k10 was not asked for
    for i in range(0, 200, 50):
        held.delete(rows.where(F.col("value").between(i, i + 49)))
    assert {r.key for r in held.read(spark).collect()} == {"extra"}


def test_measures_of_hand_worked_lists(spark):
    rows = [(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, True), (3, 6, True), (3, 1, False), (4, 1, None), (4, 2, False)]
    got = {r.query_id: (r.hit, r.reciprocal_rank, r.precision) for r in metrics.of_lists(spark.createDataFrame(rows, "query_id long, rank long, relevant boolean")).collect()}
    assert got == {1: (1, 0.5, 0.4), 2: (1, 1.0, 0.2), 3: (0, pytest.approx(1 / 6), 0.0), 4: (0, 0.0, 0.0)}
    one = metrics.averaged(metrics.of_lists(spark.createDataFrame(rows, "query_id long, rank long, relevant boolean"))).first()
    assert (one.queries, one.hit_rate, one.mrr, one.precision) == (4, 0.5, round((0.5 + 1 + 1 / 6) / 4, 6), 0.15)


def test_registered_index_query_has_all_questions(spark):
    found = QUERIES["c24_knn_index"](spark, "/root/testdata/sf0.001")
    assert found.groupBy("query_id").count().where("count = 10").count() == asked(spark, "/root/testdata/sf0.001").count()
