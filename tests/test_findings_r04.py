"""Cases of the findings of round 4."""

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_first_edges_leave_little_to_go_on_with(spark, monkeypatch):
    """Of F2 and F3: all edges were written with what lies ahead, and all ends of the first edges went over all heavy edges, to find a bar that the first edges give alone."""
    from brookwell.operators import graph

    rows = [(f"a{h}", f"l{h}{i:03d}", 0.3 + i / 1000) for h in range(4) for i in range(200)] + [(f"a{h}", f"a{h + 1}", 0.9) for h in range(3)]
    rows += [(f"l{h}{i:03d}", f"l{h + 1}{i:03d}", 0.2) for h in range(3) for i in range(200)]
    written, plain = {}, graph.kept

    def counting(df, label):
        out = plain(df, label)
        written[label] = written.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(graph, "kept", counting)
    sets = spark.createDataFrame([(h, f"a{h}") for h in range(4)], "query_id long, entity_id string")
    got = graph.expand_sets(sets, spark.createDataFrame(rows, "src string, tgt string, weight double"), 2, 10).collect()
    step, want = {}, []
    for a, b, w in rows:
        step.setdefault(a, {})[b] = step.setdefault(b, {})[a] = w
    for q in range(4):
        found = {}
        for b, w in step[f"a{q}"].items():
            found.setdefault(b, []).append((1, w))
            for c, v in step[b].items():
                if c != f"a{q}":
                    found.setdefault(c, []).append((2, w * v / 2))
        some = sorted((-round(max(x[1] for x in t), 4), e, min(x[0] for x in t)) for e, t in found.items())[:10]
        want += [(q, i + 1, e, h, pytest.approx(-s)) for i, (s, e, h) in enumerate(some)]
    assert sorted((r.query_id, r.rank, r.entity_id, r.hops, r.score) for r in got) == want
    assert sum(n for label, n in written.items() if label not in ("edges", "start", "front", "found")) < 300


def test_questions_of_equal_vectors_are_one_search(spark, monkeypatch):
    """Of F4 to F8: every question met every vector, though many ask with the same words."""
    from brookwell.operators import embedding, pairs

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text")
    index = embedding.embedded_texts(docs, F.col("text"))
    one = index.where("CAST(id AS INT) % 40 = 0").select(F.col("id").cast("long").alias("query_id"), "v", "n")
    searches, plain = [], pairs.best

    def counting(vectors, queries, *rest):
        searches.append(queries.count())
        return plain(vectors, queries, *rest)

    monkeypatch.setattr(pairs, "best", counting)
    find = lambda queries: {(r.query_id, r.rank, r.id, r.similarity, r.text) for r in embedding.nearest(index, queries, 4, "id", 0.6).collect()}
    want = find(one)
    got = find(one.unionAll(one.select((F.col("query_id") + 1000).alias("query_id"), "v", "n")))
    assert want and got == want | {(q + 1000, *rest) for q, *rest in want}
    assert searches[1] == searches[0] > 2


def test_whole_products_are_read_off_cosines(monkeypatch):
    """Of F4 to F8: the products of each candidate were added up again, slot by slot. Long texts, whose cosines don't tell them, still are."""
    from brookwell.operators import pairs

    rng = np.random.default_rng(4)
    v = np.vstack([rng.integers(-4, 5, (80, 64)), rng.integers(-40_000, 40_001, (40, 64)), np.zeros((1, 64))]).astype(float)
    n = (v * v).sum(axis=1)
    i, q = np.divmod(np.arange(len(v) ** 2), len(v))
    near = (pairs.ready(pairs.WORDS, v, n, query=True) @ pairs.ready(pairs.WORDS, v, n).T)[q, i]
    want, added, plain = pairs.pair_scores(pairs.WORDS, v, v, n, n, i, q), [], pairs.pair_scores
    monkeypatch.setattr(pairs, "pair_scores", lambda kind, v, w, n, m, i, q: added.append(len(i)) or plain(kind, v, w, n, m, i, q))
    assert (pairs.word_scores(near, v, v, n, n, i, q) == want).all()
    assert 40 * 40 <= added[0] < len(i) - 80 * 80 + 1


def test_a_mind_map_reads_the_whole_context(spark, monkeypatch):
    """Of F9: relations and chunks were not retrieved, no model was called, and maps of one theme were given out."""
    from brookwell.operators import questions
    from brookwell.registry import QUERIES

    made, plain = set(), questions.kept
    monkeypatch.setattr(questions, "kept", lambda df, label: made.add(label) or plain(df, label))
    rows = QUERIES["l46_mindmap_tree"](spark, SF).collect()
    assert {"found-relations", "found-chunks", "neighbours"} <= made
    for q in {r.query_id for r in rows}:
        own = [r for r in rows if r.query_id == q]
        assert [r.node_id for r in own] == ["refused"] or sum(r.node_id == "n_root" for r in own) == 1 and sum(r.depth == 1 for r in own) >= 2


def test_mind_maps_by_injected_models(spark):
    """Of F9: the heads of the context that the calls see, all levels, and what is refused."""
    import json

    from brookwell.operators import mindmap

    node = lambda topic, *children: {"topic": topic, "description": "d" * 20, "children": list(children)}
    deep = node("a1", node("b1", node("c1", node("d1", node("e1")))), node("b2"))
    trees = {"good": [deep, node("a2")], "flat": [node("a1")], "many": [node(f"a{i}") for i in range(9)], "wide": [node("a1", *(node(f"b{i}") for i in range(8))), node("a2")], "odd": None, "short": [node("a"), node("a2")]}

    def outlined(prompts):
        return [json.dumps({"children": trees[p.partition(mindmap.SHOWN)[2].split()[0]]}) for p in prompts]

    def named(prompts):
        return [json.dumps({"topic": " Root ", "description": "r" * 20}) for _ in prompts]

    rows = [(i, f"{kind} " + "x" * 40_000, f"file{i}") for i, kind in enumerate(trees)] + [(9, None, "none")]
    contexts = spark.createDataFrame(rows, "query_id long, context string, file string")
    got = mindmap.maps(contexts, "file", named, outlined).collect()
    assert sorted((r.node_id, r.topic, r.depth, r.has_children) for r in got if r.query_id == 0) == [("n_0001", "a1", 1, True), ("n_0002", "b1", 2, True), ("n_0003", "c1", 3, True), ("n_0004", "d1", 4, True), ("n_0005", "e1", 5, False), ("n_0006", "b2", 2, False), ("n_0007", "a2", 1, False), ("n_root", "Root", 0, True)]
    refused = {r.query_id: r.topic for r in got if r.node_id == "refused"}
    assert refused[1] == refused[4] == mindmap.TOO_SHALLOW and refused[9] == mindmap.NO_CONTENT and refused[2] == refused[3] == refused[5] and len(refused) == 6
    prompts = contexts.select(mindmap.root_prompt(F.col("context"), F.col("file")), mindmap.tree_prompt(F.col("context"))).first()
    assert [len(p.partition(mindmap.SHOWN)[2]) for p in prompts] == [mindmap.ROOT_CHARS, mindmap.TREE_CHARS] and "file0" in prompts[0]


def test_the_offline_outline_reads_entities_relations_and_chunks():
    """Of F9: what two relations of an entity lead to stands below it, and chunks describe it."""
    import json

    from brookwell.operators import mindmap

    entity = lambda name, kind: f'  {{\n    "name": "{name}",\n    "type": "{kind}",\n    "description": "{name} of one<SEP>{name} of two"\n  }}'
    relation = lambda a, b: f'  {{\n    "src": "{a}",\n    "tgt": "{b}",\n    "weight": 1.00\n  }}'
    chunk = '  {\n    "content": "A \\"Beta\\" is\\nwhat it is",\n    "file_path": "f"\n  }'
    context = "\n".join([entity("Alpha", "place"), entity("Beta", "place"), entity("Gamma", "thing"), entity("Some", "UNKNOWN"), relation("Alpha", "Gamma"), relation("Beta", "Alpha"), chunk])
    (said,) = mindmap.outlined([f"rules\n\n{mindmap.SHOWN}{context}"])
    (theme,) = json.loads(said)["children"]
    assert theme["topic"] == "place" and [(x["topic"], [y["topic"] for y in x["children"]]) for x in theme["children"]] == [("Alpha", ["Gamma", "Beta"]), ("Beta", [])]
    assert [x["description"] for x in theme["children"]] == [f"{mindmap.SAYS}Alpha of one", f'{mindmap.SAYS}A "Beta" is what it is']
    assert json.loads(mindmap.named([f"x\n\n{mindmap.FILE}file\n\n{mindmap.SHOWN}{context}"])[0])["topic"] == "Alpha Beta Gamma"
