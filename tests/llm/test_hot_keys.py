"""One passage, line, text or row in a large share of all rows, with broadcasts by size switched off and a low bar for hot keys."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brookwell.llm import decontaminate, quality, work


@pytest.fixture
def few_are_hot(spark, monkeypatch):
    """Any key with over 2 rows and a tenth of all rows is hot."""
    monkeypatch.setattr(work, "LEAST_HOT", 2)
    monkeypatch.setattr(work, "MOST_HOT", 10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plain_matches(docs, items, width):
    """{(doc_id, text): (n_words, n_hit, items)} by comparing every window of every document."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(len(w) - width + 1, 1) if w else 0):
            windows[tuple(w[k : k + width])].add(str(item))
    sizes, out = {len(x) for x in windows}, {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                met = windows.get(tuple(w[k : k + n]))
                if met:
                    hit.update(range(k, k + n))
                    found |= met
        out[doc, text] = (len(w), len(hit), sorted(found))
    return out


def test_a_passage_in_most_documents_and_items(spark, few_are_hot):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(14))
    noise = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    docs = [(i, f"{noise(9)} {passage if i % 3 == 0 else ''} {noise(6)} {passage.upper() if i % 9 == 0 else ''}") for i in range(60)]
    docs += [(100, passage)] * 20 + [(101, None), (102, ""), (103, "p0 p1 p2")]
    items = [(i, passage if i % 2 else f"{passage} {noise(3)}") for i in range(12)] + [(50, "p1 p2"), (51, noise(12)), (52, "a b"), (53, None)]
    got = decontaminate.phrase_matches(
        spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "term", "phrase", "__shard", "__part")}),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    want = plain_matches(docs, items, 10)
    hashes = {r.h: r.text for r in spark.createDataFrame(docs, "doc_id long, text string").select("text", F.xxhash64("text").alias("h")).collect()}
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in docs)
    assert all((r.n_words, r.n_hit, r.items) == want[r.doc_id, hashes[r.text_hash]] for r in got)
    assert sum(r.n_hit > 0 for r in got) > 40


def test_meeting_keeps_every_pair(spark, few_are_hot):
    rows = spark.createDataFrame([("hot", i, 90) for i in range(90)] + [("cold", 1000, 1), ("alone", 1001, 1)], "k string, at long, n long")
    others = spark.createDataFrame([("hot", "x", 90), ("hot", "y", 90), ("cold", "x", 1), ("none", "z", 5)], "k string, v string, n long")
    got = work.meet(rows, others, ["k"], "n", 92, ["at"])
    assert got.columns == ["k", "at", "v"]
    assert sorted(map(tuple, got.collect())) == sorted([("hot", i, v) for i in range(90) for v in "xy"] + [("cold", 1000, "x")])


def test_a_line_a_text_and_a_row_in_a_third_of_all(spark, few_are_hot):
    """30 different texts and 40 rows of one text share a line; so does a host of null. Copies count once, so their own lines stay."""
    own = lambda i, k: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}{chr(97 + j)}" for j in range(12))
    shared = "Subscribe to our letters today"
    rows = [(i, "\n".join([own(i, k) for k in range(6)] + [shared]), "h") for i in range(30)]
    rows += [(500, rows[0][1], "h")] * 40
    rows += [(600 + i, "\n".join([own(i, 7 + k) for k in range(6)] + [shared.upper()]), None) for i in range(25)]
    rows += [(700, shared, "other"), (701, None, "h"), (702, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("n", "copies", "lines", "__n", "doc")})
    got = quality.assess(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {r.doc_id: (r.removed_words, r.kept) for r in got} == {i: (5, True) if i < 700 else (0, False) for i, _, _ in rows}
    clean = quality.clean_documents(docs)
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((i, t[: t.rindex("\n")]) for i, t, _ in rows if i < 700)
