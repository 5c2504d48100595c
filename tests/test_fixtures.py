"""Unit inputs: chunks, extraction records, id lists, JSON answers, trees, packing, models, searches in blocks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from brookwell.functions import arrays, arrow_text
from brookwell.functions import text as T
from brookwell.operators import bpe, chunking, context, graph, mentions, models, tree, vectors
from brookwell.sources import office
from brookwell.streaming import events


def chunked(spark, text, **how):
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return sorted(chunking.token_chunks(docs, **how).collect(), key=lambda r: r.chunk_order_index)


@pytest.mark.parametrize(
    ("text", "how", "sizes"),
    [
        ("word " * 2000, {}, [800, 800, 600]), ("", {}, []), ("Hello world.", {}, [2]), ("a " * 3000, {}, [800, 800, 800, 800, 200]), ("x " * 800, {}, [800, 100]),
        ("one two\n\n\n\nthree", {"separator": "\n\n"}, [2, 0, 1]), ("a " * 50 + "\n\nb", {"separator": "\n\n", "size": 40, "overlap": 10}, [40, 20, 1]), ("a " * 50 + "\n\nb", {"separator": "\n\n", "size": 40, "only_separator": True}, [50, 1]),
    ],
)
def test_chunks(spark, text, how, sizes):
    got = chunked(spark, text, **how)
    assert [r.tokens for r in got] == sizes and [r.chunk_order_index for r in got] == list(range(len(sizes)))


def test_chunks_share_their_overlap(spark):
    a, b, *_ = chunked(spark, " ".join(f"w{i}" for i in range(1600)))
    assert a.content.split()[-100:] == b.content.split()[:100]


def parsed(spark, *lines):
    return mentions.records(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "chunk int, result string"))


def line(*fields):
    return T.FIELD.join(fields)


def test_entity_records(spark):
    rows = [line("entity", "Newton", "person", "English physicist"), line("entity", "Newton"), line("relationship", "a", "b", "c"), line("entity", "X", "ty(pe", "d"), line("entity", "'Y'", "First Type, b", "d"), line("entity", "Z", "person", " ")]
    assert [tuple(r) for r in mentions.entities(parsed(spark, *rows)).orderBy("chunk").collect()] == [(0, 0, "Newton", "person", "English physicist"), (4, 0, "Y", "firsttype", "d")]


def test_relation_records(spark):
    rows = [line("relation", "Newton", "Gravity", "discovered，found", "He found it"), line("relation", "a", "b"), line("relation", "a", "a", "k", "d"), line("relation", "a", "b", "k", "2.5")]
    got = [tuple(r) for r in mentions.relations(parsed(spark, *rows)).orderBy("chunk").collect()]
    assert got == [(0, 0, "Newton", "Gravity", "discovered,found", "He found it", 1.0), (3, 0, "a", "b", "k", "2.5", 2.5)]


def test_raw_records(spark):
    e = [line("entity", n, "person", f"about {n}") for n in ("A", "B", "C")]
    r = [line("relation", "A", "B", "k", "d"), line("relation", "B", "C", "k", "d")]
    clean = "\n".join([*e, *r, T.DONE])
    glued = T.FIELD.join(e + [x.replace("relation", "relationship", 1) for x in r]) + T.DONE.lower()
    damaged = clean.replace(T.FIELD, "< # >").replace("entity< # >", "entity<#>")
    noise = f"\n\n{T.DONE}\n  {clean}\nsome words of the model\n"
    for text in (clean, glued, damaged, noise):
        rows = parsed(spark, text)
        assert sorted(x.name for x in mentions.entities(rows).collect()) == ["A", "B", "C"]
        assert sorted((x.src, x.tgt) for x in mentions.relations(rows).collect()) == [("A", "B"), ("B", "C")]


def test_id_lists(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), (["x", "y"], ["z"]), (list("abcde"), [])], "old array<string>, new array<string>")
    assert [r.u for r in rows.select(arrays.ordered_union(F.col("old"), F.col("new")).alias("u")).collect()] == [["a", "b", "c"], ["x", "y", "z"], list("abcde")]
    keep, last, odd = (rows.select(arrays.limited(F.col("old"), 3, m).alias("l")).collect()[2].l for m in ("KEEP", "FIFO", "other"))
    assert (keep, last, odd) == (list("abc"), list("cde"), list("cde"))
    assert rows.select(arrays.limited(F.col("old"), 3, "other").alias("l")).first().l == ["a", "b"]


def test_hashes(spark):
    one, two, other, content = spark.range(1).select(*(T.hashed_id(p, F.lit(c)).alias(n) for n, p, c in (("a", "x-", "t"), ("b", "x-", "t"), ("c", "y-", "t"), ("d", "x-", "u")))).first()
    assert one == two and one[2:] == other[2:] and one != other and content != one


GOOD = {"detailed_description": "d", "entity_info": {"entity_name": "n", "entity_type": "t", "summary": "s"}}
WANT = {"detailed_description": "d", "entity_name": "n", "entity_type": "t", "summary": "s"}


@pytest.mark.parametrize(
    "raw",
    [
        json.dumps(GOOD), f"```json\n{json.dumps(GOOD)}\n```", json.dumps(GOOD).replace("}}", ",},}"), f"<think>{{no}}</think> {json.dumps(GOOD)}", json.dumps(GOOD).replace('"', "”"), f"first {{x}} then {json.dumps(GOOD)} end", json.dumps(GOOD)[:-2] + ", oops",
    ],
)
def test_json_answers(raw):
    assert arrow_text.robust_json(raw) == WANT


def test_json_without_fields():
    assert arrow_text.robust_json("nothing") == {"detailed_description": "", "entity_name": "unknown_entity", "entity_type": "unknown", "summary": ""}
    assert arrow_text.robust_json('"detailed_description": "long"') == {"detailed_description": "long", "entity_name": "unknown_entity", "entity_type": "unknown", "summary": "long"}


def test_nested_objects_are_found(spark):
    rows = ['{"a": {"b": 1}}', 'Sure: {"a": {"b": 1}} done', "```json\n{\"a\": {\"b\": 1}}\n```", "<think>{</think>{\"a\": {\"b\": 1}}", "none {"]
    got = spark.createDataFrame([(r,) for r in rows], "r string").select(F.get_json_object(T.json_text(F.col("r")), "$.a.b").alias("b"))
    assert [r.b for r in got.collect()] == ["1", "1", "1", "1", None]


def test_indented_json_is_pythons(spark):
    rows = [{"name": 'qu"ote \\ é\n\t', "key": 1, "note": None}, {"name": "b", "key": 2, "note": "x"}]
    df = spark.createDataFrame([(rows,), ([],)], "r array<struct<name:string,key:int,note:string>>")
    got = [r[0] for r in df.select(context.indented(F.col("r"), {"name": False, "key": True, "note": False})).collect()]
    assert got == [json.dumps(rows, ensure_ascii=False, indent=2), "[]"]


def test_triangle_diamond_and_chain(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.5), ("a", "c", None), ("c", "d", 2.0), ("d", "e", 1.0)], "src string, tgt string, weight double")
    seeds = spark.createDataFrame([("a",)], "entity_id string")
    got = {r.entity_id: (r.hops, r.score) for r in graph.expand(seeds, edges, 2, 30).collect()}
    assert got == {"b": (1, 1.0), "c": (1, 1.0), "d": (2, 1.0)}
    assert {r.entity_id: r.hop for r in graph.reach(seeds, edges, 3).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}


def test_best_trails_are_the_best_of_all(spark):
    """Random edges with negative, missing and equal weights, parallel ones and loops."""
    rng = random.Random(4)
    rows = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.choice([None, -2.0, -1.0, 0.0, 0.5, 1.0, 3.0])) for _ in range(30)]
    edges = spark.createDataFrame(rows, "src string, tgt string, weight double")
    seeds = spark.createDataFrame([("n1",), ("n2",)], "entity_id string")
    best = {(r.entity_id, r.hops): r.score for r in graph.best_trails(seeds, edges).collect()}
    every = {}
    for r in graph.trails(seeds, edges, 2).collect():
        every[r.entity_id, r.hops] = max(r.score, every.get((r.entity_id, r.hops), r.score))
    assert best == every and len(best) > 8


def test_preorder(spark):
    rows = [("t", "r1", None, 2, "one"), ("t", "r0", None, 1, "zero"), ("t", "x", "r0", 1, "x"), ("t", "y", "r0", 2, "y"), ("t", "z", "x", 1, "z"), ("u", "r0", None, 1, "other")]
    got = tree.preorder(spark.createDataFrame(rows, "tree string, id string, parent string, pos int, topic string"), "tree", "id", "parent", "pos")
    assert {(r.tree, r.node_id, r.topic, r.depth, r.has_children) for r in got.collect()} == {
        ("t", "n_0001", "zero", 1, True), ("t", "n_0002", "x", 2, True), ("t", "n_0003", "z", 3, False), ("t", "n_0004", "y", 2, False), ("t", "n_0005", "one", 1, False), ("u", "n_0001", "other", 1, False),
    }


def test_common_subsequences():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert arrow_text.lcs(a, b) == table[-1][-1]
    assert arrow_text.rouge_l("The cat sat", "the CAT, then sat!") == pytest.approx(6 / 7) and arrow_text.rouge_l(None, "x") == 0.0


def test_sentences_are_packed():
    text = ". ".join(f"s{i} a b c" for i in range(10))
    got = arrow_text.pack_sentences(text, 12)
    assert [c["content"] for c in got[:2]] == ["s0 a b c. s1 a b c. s2 a b c.", "s1 a b c. s2 a b c. s3 a b c."]
    assert all(c["tokens"] == len(c["content"].split()) for c in got) and got[-1]["content"].endswith("s9 a b c.")
    assert arrow_text.pack_sentences("", 5) == [] and arrow_text.pack_sentences("a b c d e f g", 5)[0]["tokens"] == 7


def test_texts_are_split_recursively():
    text = "\n\n".join(" ".join(f"p{k}w{i}" for i in range(30)) + ". " + " ".join(f"q{k}w{i}" for i in range(30)) for k in range(3))
    got = arrow_text.split_recursively(text, 25, 5)
    assert all(len(c.split()) <= 25 for c in got) and set(" ".join(got).replace(".", "").split()) == set(text.replace(".", "").split())
    assert any(set(a.split()) & set(b.split()) for a, b in zip(got, got[1:], strict=False))
    assert arrow_text.split_recursively("short", 25, 5) == ["short"]


def test_models_are_called_once_a_text(spark, tmp_path):
    cache = spark.createDataFrame([("s:" + "0" * 32, "old", 1)], "key string, content string, create_time long")
    prompts = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None), (4, "three")], "id int, prompt string")
    known = spark.createDataFrame([("three",)], "p string").select(F.concat(F.lit("s:"), F.md5("p")).alias("key"), F.lit("cached").alias("content"), F.lit(2).cast("long").alias("create_time"))
    out, new = models.with_cache(prompts, cache.unionByName(known), "s")
    assert sorted((r.id, r.answer) for r in out.collect()) == [(1, "one two"), (2, "one two"), (3, None), (4, "cached")] and new.count() == 1
    with pytest.raises(Exception, match="embedder"):
        prompts.select(models.embedded(F.col("prompt"), lambda texts: [[1.0]] * len(texts), 2)).collect()


@pytest.mark.parametrize("parts", [1, 4])
def test_a_null_text_has_a_null_vector(spark, parts):
    texts = spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (4, "abc")], "id int, text string").repartition(parts)
    vector = models.embedded(F.col("text"), lambda some: [[len(t), 0.5] for t in some], 2)
    assert sorted((r.id, r.v) for r in texts.select("id", vector.alias("v")).collect()) == [(1, [2.0, 0.5]), (2, None), (3, [0.0, 0.5]), (4, [3.0, 0.5])]


def test_searches_in_blocks_are_the_search_in_one(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    table = vectors.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    asked = table.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id")
    one = [sorted(map(tuple, f().select("query_id", "vec_id", "rank").collect())) for f in (lambda: vectors.top_k(table, asked, 3, "vec_id"), lambda: vectors.by_distance(table, asked, 3, "vec_id"))]
    monkeypatch.setattr(vectors, "MOST_BROADCAST_QUERIES", 4)
    many = [sorted(map(tuple, f().select("query_id", "vec_id", "rank").collect())) for f in (lambda: vectors.top_k(table, asked, 3, "vec_id"), lambda: vectors.by_distance(table, asked, 3, "vec_id"))]
    assert one == many and len(one[0]) == 45


def test_tokens_by_a_vocabulary_file(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}  # noqa: SIM115
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello  world's 123 é\n\n x", "", "   ", "don't"]
    got = bpe.token_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), path, "i", "t").orderBy("i").collect()
    assert [r.tokens for r in got] == [len(own.encode_ordinary(t)) for t in texts]


def test_files_without_a_reader_raise(spark):
    rows = [(1, ".docx", b"not a zip"), (2, ".docx", None)]
    assert office.sections(spark.createDataFrame(rows, "id int, extension string, content binary")).collect() == []
    with pytest.raises(Exception, match="no reader"):
        office.sections(spark.createDataFrame([(1, ".odt", b"x")], "id int, extension string, content binary")).collect()


def test_mentions_and_refusals(spark):
    rows = spark.createDataFrame([("@Sam what is @x_1? @@y",), ("none",), ("@Sam",)], "t string")
    assert [r.m for r in rows.select(T.mentions(F.col("t")).alias("m")).collect()] == [["Sam", "x_1", "y"], [], ["Sam"]]
    assert [r.q for r in rows.select(T.without_mention(F.col("t"), "sam", "help?").alias("q")).collect()] == ["what is @x_1? @@y", "none", "help?"]


def test_socket_events_fan_out(spark):
    sent = spark.createDataFrame([(1, 10, "a"), (1, None, "b")], "thread int, user_id int, type string")
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "thread int, member int")
    assert sorted((r.type, r.member) for r in events.fan_out(sent, members).collect()) == [("a", 11), ("b", 10), ("b", 11)]
