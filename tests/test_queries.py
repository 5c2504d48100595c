"""Every query over the smallest tables against DuckDB's rows."""

import re

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from brookwell import registry
from brookwell.operators import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", registry.SQL)
def test_query_matches_sql(spark, con, name):
    assert differences(registry.QUERIES[name](spark, SF), con, registry.SQL[name]) is None


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.SQL])
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_bins_hold_what_fits(spark):
    sizes = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bins = {}
    for r in registry.QUERIES["e06_greedy_pack"](spark, SF).collect():
        bins.setdefault((r.source, r.bin), []).append(sizes[r.doc_id])
    assert sum(map(len, bins.values())) == len(sizes)
    assert all(sum(b) <= 12_000 or len(b) <= 2 for b in bins.values())


def test_mentions_of_the_whole_text(spark):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    known = {r.event_type.lower() for r in spark.read.parquet(f"{SF}/events.parquet").select("event_type").distinct().collect()}
    known |= {words(r.text)[0] for r in turns if r.turn == 1 and words(r.text)}
    want = {}
    for r in turns:
        for pos, w in enumerate(words(r.text)):
            if w in known:
                want[r.conv_id, r.turn, w] = min(pos, want.get((r.conv_id, r.turn, w), pos))
    got = {(r.conv_id, r.turn, r.name): r.pos for r in registry.QUERIES["m16_mention_parse"](spark, SF).collect()}
    assert got == want and max(got.values()) >= 5


def test_dump_has_the_chunks_of_all_documents(spark):
    dumped = registry.QUERIES["a36_chunk_dump"](spark, SF).select("doc_id", "chunk_order_index").collect()
    assert len(dumped) == registry.QUERIES["l01_token_chunk"](spark, SF).count()
    assert dumped == sorted(dumped) and max(r.doc_id for r in dumped) >= 100


@pytest.mark.parametrize("most", [1, 7, 40, 10_000])
def test_bins_by_rows_are_the_fold(spark, most):
    rows = [(i * 3 % 997, (i * i * 7 + i) % 11 * (i % 5 > 0), "abc"[i % 7 % 3]) for i in range(400)] + [(2000, 90, "a"), (2001, 80, "a"), (1, 5, None)]
    items = spark.createDataFrame(rows, "doc_id long, n_chars int, source string")
    got = packing.greedy_bin_rows(items, "source", "doc_id", "n_chars", most, run=16)
    lists = items.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "n_chars"))).alias("t"))
    folded = lists.select("source", F.col("t.doc_id").alias("ids"), packing.greedy_bins(F.col("t.n_chars"), most).alias("bins")).collect()
    assert {(r.source, r.doc_id): r.bin for r in got.collect()} == {(r.source, i): b for r in folded for i, b in zip(r.ids, r.bins, strict=True)}
    assert "collect_list" not in got._jdf.queryExecution().toString()
