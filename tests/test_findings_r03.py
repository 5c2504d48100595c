"""Cases of the findings of round 3."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brookwell.operators import embedding, pairs, vectors
from brookwell.plans.base import asked
from brookwell.plans.base import vectors as vector_table
from brookwell.registry import QUERIES

SF = "/root/testdata/sf0.001"


def table_of(rows, name):
    return pa.table({name: pa.array([r[0] for r in rows], pa.int64()), "v": pa.array([r[1] for r in rows], pa.list_(pa.float64())), "n": pa.array([float(sum(x * x for x in r[1] or [])) for r in rows])})


@pytest.mark.parametrize("kind", [pairs.COSINE, pairs.WORDS, pairs.DISTANCE])
def test_cells_keep_the_best_of_every_query(kind, monkeypatch):
    """Small blocks, many copies (ties by id), a null and a zero vector against a plain sort of all pairs."""
    monkeypatch.setattr(pairs, "ROWS", 16)
    monkeypatch.setattr(pairs, "COLUMNS", 3)
    rng = random.Random(3)
    whole = [[float(rng.randrange(-3, 4)) for _ in range(4)] for _ in range(150)]
    rows = [(i, whole[i % 70] if i % 5 else whole[0]) for i in range(150)] + [(900, None), (901, [0.0] * 4)]
    rng.shuffle(rows)
    left, right = table_of(rows, "id"), table_of([(q, whole[q]) for q in range(8)], "query_id")
    got = pairs.best_of(kind, 7, None, left, right).to_pylist()
    every = [r for r in pairs.all_of(kind, None, left, right).to_pylist() if r["score"] is not None]
    assert len(every) == 8 * 151
    sign = 1 if kind == pairs.DISTANCE else -1
    want = [r for q in range(8) for r in sorted((r for r in every if r["query_id"] == q), key=lambda r: (sign * r["score"], r["id"]))[:7]]
    assert got == want


def test_scores_are_those_of_the_column_functions(spark):
    from brookwell.functions.vectors import dot, similarity, squared_distance

    v, q = vector_table(spark, SF).select("vec_id", "unit", "embedding"), asked(spark, SF)
    met = v.crossJoin(q.select("query_id", F.col("unit").alias("qu"), F.col("embedding").alias("qe")))
    want = {(r.query_id, r.vec_id): r.s for r in met.select("query_id", "vec_id", F.round(similarity(dot(F.col("unit"), F.col("qu"))), 6).alias("s")).collect()}
    assert {(r.query_id, r.vec_id): r.similarity for r in vectors.scored(v, q, "vec_id").collect()} == want
    far = {(r.query_id, r.vec_id): r.s for r in met.select("query_id", "vec_id", F.round(squared_distance(F.col("embedding"), F.col("qe")), 6).alias("s")).collect()}
    got = vectors.by_distance(v, q, 4, "vec_id").collect()
    assert got and all(far[r.query_id, r.vec_id] == r.distance for r in got)


def test_rounding_is_half_up_by_the_shortest_decimal():
    x = np.array([0.1234565, 0.12345649999, 0.5000005, 2.0000015, 0.0])
    assert pairs.millionths(x).tolist() == [123457.0, 123456.0, 500001.0, 2000002.0, 0.0]


def test_searches_shuffle_no_texts_by_pair(spark):
    """Of F1, F2, F3, F6: pairs with whole texts went into the ranking's shuffle."""
    for found in (vectors.top_k(vector_table(spark, SF), asked(spark, SF), 5, "vec_id"), vectors.by_distance(vector_table(spark, SF), asked(spark, SF), 5, "vec_id")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan and "Join Inner\n" not in plan
        ranking = plan[plan.index("Window") :]
        assert "content" not in ranking.split("\n")[0]


def test_nearest_texts_in_blocks_are_those_in_one(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text")
    index = embedding.embedded_texts(docs, F.col("text"))
    asking = index.where("CAST(id AS INT) % 20 = 0").select(F.col("id").cast("long").alias("query_id"), "v", "n")
    ask = lambda: sorted((r.query_id, r.rank, r.id, r.similarity, len(r.text or "")) for r in embedding.nearest(index, asking, 6, "id", 0.6).collect())
    one = ask()
    monkeypatch.setattr(vectors, "MOST_BROADCAST_QUERIES", 3)
    monkeypatch.setattr(pairs, "SEARCHED", (40, 3))
    assert ask() == one and len(one) > 20


def test_word_vectors_digest_each_word_once(spark, monkeypatch):
    """Of F7 to F17: each of 64 slots went over all words of a text by lambdas."""
    import hashlib
    import re

    texts = ["The the cat, THE 42 ÄPFEL äpfel " * 3, None, "", "...", "a" * 50, "x\ny z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")

    def plain(t):
        out = [0] * 64
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            h = hashlib.md5(w.encode()).hexdigest()
            for n in (int(h[:7], 16), int(h[8:15], 16)):
                out[n % 64] += 1 - 2 * (n // 64 % 2)
        return out

    made = embedding.embedded_texts(docs, F.col("text"))
    assert {r.id: (list(r.v), r.n) for r in made.collect()} == {i: (plain(t), sum(x * x for x in plain(t))) for i, t in enumerate(texts)}
    assert "lambda" not in made.select("v")._jdf.queryExecution().optimizedPlan().toString()


def test_trees_of_five_digits(spark, tmp_path):
    """Of F18: the SQL cut the number of a node beyond 9999 to its first four digits."""
    import duckdb
    from oracle import differences

    from brookwell.registry import SQL

    con = duckdb.connect()
    con.execute("CREATE TABLE nation AS SELECT 3 AS n_nationkey, ' A ' AS n_name, 1 AS n_regionkey")
    con.execute("CREATE TABLE customer AS SELECT i AS c_custkey, 3 AS c_nationkey, 'c' || i AS c_name FROM range(10005) g(i)")
    for t in ("nation", "customer"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    made = QUERIES["k08_assemble_tree"](spark, str(tmp_path))
    assert differences(made, con, SQL["k08_assemble_tree"]) is None
    assert made.where("node_id = 'n_10006'").count() == 1


def test_last_steps_below_the_bar_stay_where_they_are(spark, monkeypatch):
    """Of F4 and F5: every trail of two edges was shuffled. Three hubs with 300 leaves each, in part with equal and negative weights, against all trails."""
    from brookwell.operators import graph

    rng = random.Random(8)
    rows = [(f"a{h}", f"l{i:03d}", rng.choice([0.1, 0.25, 0.5, 0.50004, -0.75, None])) for h in range(3) for i in range(300)] + [("a0", "a1", 1.5), ("a1", "a2", 0.9)]
    step = {}
    for a, b, w in rows:
        for x, y in ((a, b), (b, a)):
            step.setdefault(x, {})[y] = 1.0 if w is None else w
    want = []
    for q, seeds in ((1, ["a0"]), (2, ["a1", "l007"]), (3, ["l003"])):
        found = {}
        for s in seeds:
            for b, w in step[s].items():
                found.setdefault(b, []).append((1, w))
                for c, v in step[b].items():
                    if c != s:
                        found.setdefault(c, []).append((2, w * v / 2))
        some = [(round(max(x[1] for x in t) + 1e-12, 4), e, min(x[0] for x in t)) for e, t in found.items() if e not in seeds]
        want += [(q, i + 1, e, h, s) for i, (s, e, h) in enumerate(sorted(some, key=lambda x: (-x[0], x[1]))[:30])]
    written = {}
    plain = graph.kept

    def counting(df, label):
        out = plain(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(graph, "kept", counting)
    sets = spark.createDataFrame([(1, "a0"), (2, "a1"), (2, "l007"), (3, "l003")], "query_id long, entity_id string")
    got = sorted(tuple(r[c] for c in ("query_id", "rank", "entity_id", "hops", "score")) for r in graph.expand_sets(sets, spark.createDataFrame(rows, "src string, tgt string, weight double"), 2, 30).collect())
    assert got == [(q, i, e, h, pytest.approx(s)) for q, i, e, h, s in want]
    assert written["last"] < 400


def test_few_files_are_objects_at_a_time(spark, monkeypatch):
    """Of F32, F33 and F36: all sections of a batch of 10,000 files were Python objects before any was Arrow's."""
    from brookwell.plans.fixtures import office_file
    from brookwell.sources import office

    contents = pa.array([office_file(4 * i, f"one {i}\n\ntwo") for i in range(200)] + [None, b"broken"], pa.binary())
    sizes = []
    plain = pa.array
    monkeypatch.setattr(office.pa, "array", lambda x, *a, **b: sizes.append(len(x)) or plain(x, *a, **b))
    made = {}
    monkeypatch.setattr(office.F, "arrow_udf", lambda f, kind: made.setdefault("f", f) and (lambda c: c))
    office.parsed(F.lit(None), office.docx_sections)
    got = made["f"](contents).to_pylist()
    assert max(sizes) <= office.AT_ONCE and len(got) == 202 and got[200:] == [None, None]
    assert [x["text"] for x in got[7]] == ["one 7", "two"] and [x["paragraph_index"] for x in got[7]] == [1, 3]


def test_few_rows_of_tokens_are_objects_at_a_time():
    """Of F37: the ids of a whole batch of 10,000 texts were Python numbers together."""
    from brookwell.operators import bpe

    batch = pa.RecordBatch.from_pydict({"id": list(range(300))})
    pieces = list(bpe._pieces(iter([batch, batch.slice(0, 0)])))
    assert [p.num_rows for p in pieces] == [128, 128, 44] and pa.Table.from_batches(pieces).column("id").to_pylist() == list(range(300))


def test_a_mode_makes_what_it_reads(spark, monkeypatch):
    """Of F8 to F16: every mode built and embedded all three indices and looked for all that it could find."""
    from brookwell.operators import graph, questions

    labels = []
    plain = questions.kept
    for module in (questions, graph):
        monkeypatch.setattr(module, "kept", lambda df, label: labels.append(label) or plain(df, label))
    entities = spark.createDataFrame([("Alpha", "person", "Alpha of one", ["1"]), ("Beta", "place", "Beta of two", ["2"])], "name string, type string, description string, sources array<string>")
    relations = spark.createDataFrame([("Alpha", "Beta", 2.0, "rock,river", "links", ["2"])], "src string, tgt string, weight double, keywords string, description string, sources array<string>")
    chunks = spark.createDataFrame([("1", "one", "f", 1), ("2", "two", "f", 1)], "chunk_id string, content string, file_path string, tokens long")
    asked = spark.createDataFrame([(1, "Alpha of one", ["Alpha"], ["rock"])], "query_id long, text string, low array<string>, high array<string>")
    p = questions.Parameters(top_k=1, chunk_top_k=1, hops=1, neighbours=5, threshold=0.1)
    found = questions.retrieved(asked, questions.built(entities, relations, chunks), questions.with_mode(p, "global"))
    assert found.relations.count() == 1 and found.entities.count() == 0
    assert "relation-index" in labels and not {"entity-index", "chunk-index", "seeds", "found-chunks"} & set(labels)
    assert [r.chunk_id for r in found.chunks.collect()] == ["2"] and "chunk-index" not in labels
    labels.clear()
    found = questions.retrieved(asked, questions.built(entities, relations, chunks), questions.with_mode(p, "local"))
    assert [r.name for r in found.entities.orderBy("rank").collect()] == ["Alpha", "Beta"] and "relation-index" not in labels
    labels.clear()
    found = questions.retrieved(asked, questions.built(entities, relations, chunks), p)
    assert found.chunks.count() == 2 and {"entity-index", "relation-index", "chunk-index"} <= set(labels)


def test_documents_count_a_term_in_their_own_row(spark):
    """Of F8 to F16: all terms of all documents were shuffled by document to be counted once in it."""
    from brookwell.operators import keywords

    docs = spark.createDataFrame([("Rock rock rock river",), ("rock",), (None,), ("Rock Rock sand",)], "text string")
    asked = spark.createDataFrame([(1, "Rock rock sand moon")], "query_id long, text string")
    made = keywords.weighted(asked, docs)
    got = {(r.kind, r.term): r.weight for r in made.collect()}
    want = {("low", "rock"): (2, 3), ("low", "sand"): (1, 1), ("low", "moon"): (1, 1), ("high", "Rock"): (1, 2)}
    assert got == {k: pytest.approx(tf * np.log(4 / df), abs=1e-6) for k, (tf, df) in want.items()}
    assert "monotonically_increasing_id" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_three_hops_pass_on_what_may_count(spark, monkeypatch):
    """Of F15: after two edges every (set, node) passed on four rows. Heavy edges lead to the best nodes; nodes of two and of three edges keep their least hops."""
    from test_questions import brute_expand

    from brookwell.operators import graph

    rng = random.Random(5)
    edges = [("hub", f"m{i:02d}", 0.5 + i / 100) for i in range(40)] + [(f"m{i:02d}", f"n{(i * 7 + j) % 90:02d}", rng.choice([0.1, 0.5, 0.75, -0.2])) for i in range(40) for j in range(12)]
    edges += [("m39", f"top{j}", 9.0 + j) for j in range(6)] + [(f"top{j}", f"n{j:02d}", 8.0) for j in range(6)] + [("hub", "top0", 0.01)]
    written = {}
    plain = graph.kept

    def counting(df, label):
        out = plain(df, label)
        written.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(graph, "kept", counting)
    seeds = spark.createDataFrame([(1, "hub"), (2, "m00")], "query_id long, entity_id string")
    got = sorted((r.query_id, r.entity_id, r.hops, r.score) for r in graph.expand_sets(seeds, spark.createDataFrame(edges, "src string, tgt string, weight double"), 3, 6).collect())
    assert [(q, e, h, pytest.approx(s, abs=1e-4)) for q, e, h, s in brute_expand({1: {"hub"}, 2: {"m00"}}, edges, 3, 6)] == got
    assert any(h == 2 for q, _, h, _ in got if q == 1) and written["front"][1] < 100


def test_a_merged_graph_parses_its_records_once(spark, monkeypatch):
    """Of F38: the outputs were rendered and parsed for the entities, and again for the relations."""
    import duckdb
    from oracle import differences

    from brookwell.plans import merge_queries
    from brookwell.registry import SQL

    calls = []
    plain = merge_queries.outputs
    monkeypatch.setattr(merge_queries, "outputs", lambda *a: calls.append(a) or plain(*a))
    made = QUERIES["l13_merge_graph"](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert len(calls) == 1 and differences(made, con, SQL["l13_merge_graph"]) is None


@pytest.mark.parametrize("kind", [pairs.COSINE, pairs.WORDS, pairs.DISTANCE])
def test_near_ties_survive_single_precision(kind):
    """Of F20 to F29: vectors that differ by less than single precision tells are ranked by their scores, nulls among the first ones."""
    rng = np.random.default_rng(5)
    near = rng.normal(size=64) + rng.normal(size=(3000, 64)) * 1e-6
    near /= np.linalg.norm(near, axis=1)[:, None]
    rows = [(i, None if i % 7 == 0 else v.tolist()) for i, v in enumerate(near)]
    left, right = table_of(rows, "id"), table_of([(q, near[q].tolist()) for q in range(5)], "query_id")
    got = pairs.best_of(kind, 9, None, left, right).to_pylist()
    sign = 1 if kind == pairs.DISTANCE else -1
    every = [r for r in pairs.all_of(kind, None, left, right).to_pylist() if r["score"] is not None]
    assert got == [r for q in range(5) for r in sorted((r for r in every if r["query_id"] == q), key=lambda r: (sign * r["score"], r["id"]))[:9]]


@pytest.mark.parametrize("kind", [pairs.COSINE, pairs.WORDS, pairs.DISTANCE])
def test_a_block_of_pairs_is_held_once(kind):
    """Of F20 to F29: each product was copied several times in double precision before it was compared."""
    import tracemalloc

    rng = np.random.default_rng(6)
    v = rng.normal(size=(pairs.ROWS, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    left, right = table_of(rows, "id"), table_of(rows[: pairs.COLUMNS], "query_id")
    tracemalloc.start()
    pairs.best_of(kind, 5, None, left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.2 * 8 * pairs.ROWS * pairs.COLUMNS


def test_a_unit_vector_works_its_length_out_once(spark):
    """Of F20 to F31: the length stood inside the lambda over the elements, and was added up anew for each of them."""
    from brookwell.functions.vectors import unit

    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [])], "id int, v array<float>").select("id", unit(F.col("v")).alias("u"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 1
    assert {r.id: r.u for r in rows.collect()} == {1: [3 / 5.0, 4 / 5.0], 2: [0.0, 0.0], 3: None, 4: []}


def test_sources_are_listed_for_found_relations_alone(spark):
    """Of F9 to F15: each relation's sources were ranked and joined, found or not."""
    from brookwell.operators import questions

    asked_for = []

    def sources(found):
        asked_for.extend(sorted(tuple(r) for r in found.collect()))
        return found.withColumn("sources", F.array(F.lit("1")))

    entities = spark.createDataFrame([("A", "t", "d", ["1"])], "name string, type string, description string, sources array<string>")
    relations = spark.createDataFrame([("A", "B", 1.0, "red", "one"), ("C", "D", 1.0, "blue", "two")], "src string, tgt string, weight double, keywords string, description string")
    chunks = spark.createDataFrame([("1", "text", "f", 1)], "chunk_id string, content string, file_path string, tokens long")
    asking = spark.createDataFrame([(50, "some text", [], ["red", "A", "B", "one"])], "query_id long, text string, low array<string>, high array<string>")
    found = questions.retrieved(asking, questions.built(entities, relations, chunks, None, sources), questions.Parameters(mode="global", top_k=1))
    assert [(r.chunk_id, r.origin) for r in found.chunks.collect()] == [("1", "graph")] and asked_for == [("A", "B")]


def test_words_by_splitting_are_those_by_matching(spark):
    """Of F9 to F15: an object was made for each match of each text."""
    from brookwell.operators import keywords

    texts = [None, "", " ", "abc", "abcd", "ABCdefgh xyz9four Élan voilà", "  lead and trail  ", "a-b c_d ⅷ 中文 Ünder12 x²", "same Same same four FOUR Fouré"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    plain = lambda c, p: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(p), F.lit(0))
    want = sorted((r.id, r.t) for r in rows.select("id", F.explode(plain(F.col("text"), keywords.LOW)).alias("t")).collect())
    listed = keywords._listed(rows, F.col("text"), "id").where("kind = 'low'")
    assert sorted((r.id, r.term) for r in listed.collect()) == want
    assert "regexp_extract_all(lower" not in listed._jdf.queryExecution().optimizedPlan().toString()
    words = {r.id: r.w for r in rows.select("id", plain(F.col("text"), r"[\p{L}\p{N}]+").alias("w")).collect()}
    split = embedding.embedded_texts(rows, F.col("text")).select("id", "v").collect()
    alone = embedding._added(embedding.DIMENSIONS, embedding.SPREAD, pa.array([words[r.id] for r in split], pa.list_(pa.string()))).to_pylist()
    assert [r.v for r in split] == alone


def test_distinct_counts_are_dealt_by_the_lines(spark, monkeypatch):
    """Of F35: the parts were as many whatever the tables held, and a task's memory grew with them."""
    from brookwell.operators import graph
    from brookwell.plans import graph_queries
    from brookwell.plans.base import edges, nodes

    monkeypatch.setattr(graph_queries, "PART_ROWS", 500)
    got = QUERIES["d09_count_distinct"](spark, SF)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500)
    assert n > 8 and "RepartitionByExpression [entity_type" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and f", {2 * n}" in plan and "Expand" not in plan
    met = nodes(spark, SF).join(graph.both_ways(edges(spark, SF)), F.col("entity_id") == F.col("a"))
    want = met.groupBy("entity_type").agg(F.countDistinct("b"), F.countDistinct(F.concat(F.least("a", "b"), F.greatest("a", "b"))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_codes_of_probed_cells_are_ranked_in_groups():
    """Of F31: each code met each query by lambdas; now a group of cells passes on the best of each query, of the cells it probes alone."""
    from brookwell.operators import ivf

    rng = np.random.default_rng(7)
    codes, cell, asking = rng.integers(-127, 128, (90, 6)), rng.integers(0, 5, 90), rng.normal(size=(4, 6))
    left = pa.table({"cell": pa.array(cell, pa.int32()), "id": pa.array(range(90), pa.int64()), "code": pa.array(codes.tolist(), pa.list_(pa.int8()))})
    probed = [[{"cell": c, "scale": 0.1 * (c + 1), "base": float(q - c)} for c in (q % 5, (q + 2) % 5, 9)] for q in range(4)]
    right = pa.table({"query_id": pa.array(range(4), pa.int64()), "q": pa.array(asking.tolist()), "cells": pa.array(probed)})
    got = ivf._nearest_codes("id", 8, left, right).to_pylist()
    for q in range(4):
        by = {x["cell"]: x for x in probed[q]}
        every = sorted((-(by[c]["base"] + by[c]["scale"] * float(codes[i] @ asking[q])), i) for i, c in enumerate(cell) if c in by)
        assert [r["id"] for r in got if r["query_id"] == q] == [i for _, i in every[:8]]


def test_threads_meet_in_cells_as_in_a_join(spark, monkeypatch):
    """Small cells and blocks, equal rows, a null sender, thread and member, threads without members or events, and none at all."""
    from collections import Counter

    from brookwell.streaming import events as E

    rng = random.Random(5)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), rng.randrange(60)) for i in range(300)]
    rows += [rows[0]] * 40 + [(900, 0, None), (901, None, 3), (902, 7, 3)]
    sent = spark.createDataFrame(rows, "event_id long, thread long, user_id long")
    members = spark.createDataFrame([(t, m) for t in (0, 1, 2, 8) for m in range(40)] + [(0, None), (None, 5)], "thread long, member long")
    monkeypatch.setattr(E, "CELL", (50, 7))
    for block in (8, 24, 168):
        monkeypatch.setattr(E, "BLOCK", block)
        got, want = E.fan_out_in_cells(sent, members), E.fan_out(sent, members)
        assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert E.fan_out_in_cells(sent.where("false"), members).collect() == E.fan_out_in_cells(sent, members.where("false")).collect() == []


def test_a_broadcast_is_laid_out_by_pairs(spark, tmp_path):
    """Of F27: a row of an event and a member took about two bytes of a file, and one task had all pairs."""
    events = spark.range(8000).selectExpr("id AS event_id", "10 * pmod(xxhash64(id), 400) AS user_id", "if(id % 2 = 0, 'signup', 'view') AS event_type")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    QUERIES["m05_broadcast"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert (n := spark.read.parquet(f"{tmp_path}/out").distinct().count()) == 4000 * (spark.read.parquet(f"{tmp_path}/events.parquet").select("user_id").distinct().count() - 1) > 1_500_000
    files = list(tmp_path.glob("out/*.parquet"))
    assert sum(f.stat().st_size for f in files) < n / 2 and len(files) > 1
