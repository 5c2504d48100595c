"""Questions over the graph: seed sets, keywords, embeddings, budgets, refusals and the cache."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from brookwell.operators import context, embedding, graph, keywords, questions


def brute_expand(sets, edges, hops, most):
    """(query, entity, hops, score) over all trails, edge by edge."""
    around = {}
    for i, (a, b, w) in enumerate(edges):
        around.setdefault(a, []).append((b, w, i))
        around.setdefault(b, []).append((a, w, i))
    out = []
    for query, seeds in sets.items():
        best = {}

        def walk(at, product, used):
            if used:
                least, score = best.get(at, (9, -math.inf))
                best[at] = min(least, len(used)), max(score, product / len(used))
            if len(used) < hops:
                for b, w, i in around.get(at, ()):
                    if i not in used:
                        walk(b, product * w, (*used, i))

        for s in seeds:
            walk(s, 1.0, ())
        rows = sorted(((-round(score, 4), e, least) for e, (least, score) in best.items() if e not in seeds))[:most]
        out += [(query, e, least, -score) for score, e, least in rows]
    return sorted(out)


@pytest.mark.parametrize("hops", [1, 2, 3])
@pytest.mark.parametrize("hub", [10_000, 3])
def test_seed_sets_expand_as_all_trails_do(spark, monkeypatch, hops, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    rng = random.Random(hops)
    pairs = rng.sample(list(itertools.combinations([f"n{i:02d}" for i in range(14)], 2)), 34)
    edges = [(a, b, rng.choice([0.5, 2.0, 1.5, -3.0, 0.25])) for a, b in pairs]
    sets = {1: {"n00"}, 2: {"n00", "n03"}, 3: {"n05", "n06", "n07"}, 4: {"nowhere"}}
    seeds = spark.createDataFrame([(q, s) for q, found in sets.items() for s in found], "query_id long, entity_id string")
    table = spark.createDataFrame(edges + [("n00", "n00", 9.0)], "src string, tgt string, weight double")
    got = sorted((r.query_id, r.entity_id, r.hops, r.score) for r in graph.expand_sets(seeds, table, hops, 8).collect())
    assert [(q, e, h, pytest.approx(s, abs=1e-4)) for q, e, h, s in brute_expand(sets, edges, hops, 8)] == got
    assert graph.expand_sets(seeds, table, 0, 8).collect() == []


def test_near_copies_are_closer_than_other_texts(spark):
    """Cosine of near copies is above that of every other pair."""
    rng = random.Random(7)
    words = [f"word{i}" for i in range(400)]
    texts = [rng.sample(words, 60) for _ in range(12)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join(t[:55] + ["new"] * 5)) for i, t in enumerate(texts)]
    made = embedding.embedded_texts(spark.createDataFrame(rows, "id long, text string"), F.col("text"), 256, 3).select("id", "v", "n").collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a.v, b.v, strict=True)) / math.sqrt(a.n * b.n)
    copies = [cos(a, b) for a in made for b in made if b.id == a.id + 100]
    others = [cos(a, b) for a, b in itertools.combinations(made, 2) if abs(a.id - b.id) != 100]
    assert min(copies) > max(others) and len(made[0].v) == 256 and all(r.n == sum(x * x for x in r.v) for r in made)


def test_embeddings_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " .,; "), (4, "a A a")], "id long, text string")
    got = {r.id: r for r in embedding.embedded_texts(rows, F.col("text"), 16).collect()}
    assert [got[i].n for i in (1, 2, 3)] == [0, 0, 0] and got[4].n in (9 * 2, 9 * 4, 0)
    near = embedding.nearest(embedding.embedded_texts(rows, F.col("text"), 16), embedding.embedded_texts(rows.withColumnRenamed("id", "query_id"), F.col("text"), 16), 2, "id", 0.9)
    assert sorted((r.query_id, r.id) for r in near.collect()) == ([(4, 4)] if got[4].n else [])


DOCS = [(1, "Alpha sees beta rocks and beta rivers"), (2, "Gamma sees rivers"), (3, "rivers rivers rivers run"), (4, None), (5, "")]


def test_keywords_weigh_rare_terms(spark):
    docs = spark.createDataFrame(DOCS, "query_id long, text string")
    got = {(r.query_id, r.term): (r.weight, r.rank) for r in keywords.weighted(docs.where("query_id in (1, 3, 4, 5)"), docs).where("kind = 'low'").collect()}
    assert got[1, "beta"] == (round(2 * math.log(5), 6), 1) and got[1, "rivers"][0] == round(math.log(5 / 3), 6) and got[3, "rivers"] == (round(3 * math.log(5 / 3), 6), 1)
    read = {r.query_id: r for r in keywords.extracted(docs, docs, F.when(F.col("query_id") == 2, "no JSON here")).collect()}
    assert read[1].high == ["Alpha"] and read[1].low[0] == "beta" and read[2].low == [] and read[2].high == [] and read[4].low == []


def test_short_questions_stand_for_themselves_and_long_ones_fail(spark):
    rows = [(1, "what now", [], []), (2, "x" * 50, [], []), (3, "", ["a"], []), (4, None, [], []), (5, "y" * 60, ["k"], [])]
    got = {r.query_id: (r.low, r.failed) for r in questions.judged(spark.createDataFrame(rows, "query_id long, text string, low array<string>, high array<string>")).collect()}
    assert got == {1: (["what now"], False), 2: ([], True), 3: (["a"], True), 4: ([], True), 5: (["k"], False)}


def small_index(spark):
    entities = spark.createDataFrame([("Alpha", "person", "Alpha of one", ["1", "2"]), ("Beta", "place", "Beta of two", ["2", "3"]), ("Gamma", "thing", "Gamma of far", ["4"])], "name string, type string, description string, sources array<string>")
    relations = spark.createDataFrame([("Alpha", "Beta", 2.0, "rock,river", "links", ["5"]), ("Beta", "Gamma", 1.0, "sky", "links", ["6"])], "src string, tgt string, weight double, keywords string, description string, sources array<string>")
    chunks = [(str(i), f"text {'same' if i in (2, 3) else i} " + "w " * 3, f"f{i % 2}", 5) for i in range(1, 7)] + [("7", "", "f", 0)]
    return questions.built(entities, relations, spark.createDataFrame(chunks, "chunk_id string, content string, file_path string, tokens long"))


def test_modes_budgets_and_refusals(spark):
    asked = spark.createDataFrame([(1, "Alpha of one", ["Alpha", "one"], ["rock"]), (2, "z" * 60, [], []), (3, "", ["a"], ["b"]), (4, "zzz", ["qqqq"], [])], "query_id long, text string, low array<string>, high array<string>")
    p = questions.Parameters(top_k=1, chunk_top_k=2, hops=1, neighbours=5, threshold=0.7)
    index = small_index(spark)
    local = questions.retrieved(asked, index, questions.with_mode(p, "local"))
    assert [(r.query_id, r.name, r.kind, r.hops) for r in local.entities.orderBy("query_id", "rank").collect()] == [(1, "Alpha", "seed", 0), (1, "Beta", "neighbour", 1)]
    # Chunks of the seed, then of the neighbour, each content once
    assert [r.chunk_id for r in local.chunks.orderBy("rank").collect()] == ["1", "2"] and local.relations.collect() == []
    few = questions.retrieved(asked, index, questions.with_mode(questions.Parameters(top_k=1, hops=1, threshold=0.7, total_tokens=0, related_chunks=1), "local"))
    assert [r.chunk_id for r in few.chunks.orderBy("rank").collect()] == ["1", "2"]
    found = questions.retrieved(asked, index, p)
    assert {(r.src, r.tgt) for r in found.relations.where("query_id = 1").collect()} <= {("Alpha", "Beta")}
    made = questions.contexts(found, p)
    calls = []

    def model(prompts):
        calls.extend(prompts)
        return ["<think>hm</think>said" for _ in prompts]

    empty = spark.createDataFrame([], "key string, content string")
    said, new = questions.answers(made, empty, p, model)
    got = {r.query_id: r.answer for r in said.collect()}
    assert got[1] == "said" and got[2] == got[3] == context.NO_ANSWER and got[4] in ("said", context.NOTHING_FOUND)
    again, none = questions.answers(made, new, p, lambda prompts: ["another"] * len(prompts))
    assert {r.query_id: r.answer for r in again.collect()} == got and none.count() == 0 and again.where("cached").count() == new.count() > 0
