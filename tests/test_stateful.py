"""State machines, the tail source and delivery against their batch forms, on shuffled files, after restarts and replays."""

import datetime as dt
import os
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.streaming import deliver, stateful, tail
from brookwell.streaming import events as E

KIND = "event_id long, ts timestamp, user_id long, event_type string, thread long, target long"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


@pytest.fixture(scope="module")
def parts():
    """120 events in three files; a tenth of them comes a file later than its time. Then two late markers in files of their own."""
    rng, at, rows = random.Random(3), START, []
    for i in range(120):
        at += dt.timedelta(seconds=rng.choice([0, 1, 2, 5, 9, 30]))
        rows.append((i, at, rng.randrange(4), rng.choice(["view", "error", "click"]), i % 3, rng.randrange(4)))
    out = [[] for _ in range(3)]
    for i, r in enumerate(rows):
        out[min(2, i // 40 + (rng.random() < 0.1))].append(r)
    return out, [[(1000 + d, START + dt.timedelta(days=d), 9, "end", 0, 0)] for d in (3, 4)]


def add(spark, path, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, name, build, checkpoint, mode="append", sink=None):
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)
    out = sink or f"{checkpoint}-out"
    query = build(stream).writeStream.format("parquet").option("path", out).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    return out


def us(at):
    return int(at.replace(tzinfo=dt.UTC).timestamp() * 1e6)


def test_machines_equal_their_batch_forms_also_after_a_restart(spark, parts, tmp_path):
    """Sequence, receipts, typing, stuck keys and expiry at once, with a stop and a restart from the checkpoint after the second file."""
    real, ends = parts
    src = f"{tmp_path}/in"
    machines = {
        "sequence": lambda s: stateful.ordered(s, stateful.sequence("event_id", 100), "user_id", "event_id", delay="20 minutes"),
        "receipts": lambda s: stateful.ordered(s.withColumn("mark", F.col("event_id") % 50), stateful.receipts("event_id", "mark"), "user_id", "event_id", "mark", delay="20 minutes"),
        "typing": lambda s: stateful.ordered(s, stateful.typing(40_000_000), "user_id", "event_id", delay="20 minutes"),
        "stuck": lambda s: stateful.ordered(s, stateful.stuck("event_type", "view", 60_000_000), "user_id", "event_id", "event_type", delay="20 minutes"),
        "expiry": lambda s: stateful.ordered(s, stateful.expiry(61_000_000), "user_id", "event_id", delay="20 minutes"),
    }
    add(spark, src, real[0])
    add(spark, src, real[1])
    for name, build in machines.items():
        run(spark, src, name, build, f"{tmp_path}/{name}")
    add(spark, src, real[2])
    for end in ends:
        add(spark, src, end)
    got = {name: spark.read.parquet(run(spark, src, name, build, f"{tmp_path}/{name}")).where("user_id <> 9") for name, build in machines.items()}

    table = spark.createDataFrame([r for p in real for r in p], KIND)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got["sequence"]) == rows(table.select("user_id", "event_id", (F.row_number().over(order) + 100).alias("seq")))
    upto = F.max(F.col("event_id") % 50).over(order.rowsBetween(Window.unboundedPreceding, 0))
    assert rows(got["receipts"]) == rows(table.select("user_id", "event_id", upto))
    runs = E.sessions(table, "40 seconds").select("user_id", E.micros(F.col("start")), E.micros(F.col("end")), "n")
    assert rows(got["typing"]) == rows(runs)
    following = table.select("user_id", E.micros(F.col("ts")).alias("us"), "event_type", F.lead(E.micros(F.col("ts"))).over(order).alias("next"))
    waited = following.where("event_type = 'view' AND (next IS NULL OR next - us >= 60000000)")
    assert rows(got["stuck"]) == rows(waited.select("user_id", "us"))
    lapsed = following.where("next IS NULL OR next - us >= 61000000").select("user_id", F.col("us") + 61_000_000)
    assert rows(got["expiry"]) == rows(lapsed)


def test_state_of_the_limiter_is_dropped_after_its_time(spark, tmp_path):
    src, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    at = lambda ids: [(i, START, 1, "x", 0, 0) for i in ids]

    def step(ids):
        add(spark, src, at(ids))
        stream = spark.readStream.schema(KIND).parquet(src)
        query = stateful.limited(stream, 3, 2).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{sink}/batch={n}")).option("checkpointLocation", f"{tmp_path}/c").trigger(once=True).start()
        assert query.awaitTermination(100)

    step([1, 2, 3])
    time.sleep(5)
    step([4])
    got = {r.event_id: (r.n, r.allowed) for r in spark.read.parquet(sink).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, False), 4: (1, True)}


def test_the_tail_seeks_to_the_end_and_goes_on_at_its_offset(spark, tmp_path):
    spark.dataSource.register(tail.Tail)
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("old error\n")
    counted = lambda s: stateful.findings(s, {"error": "error", "gone": "^gone"})

    def step():
        stream = spark.readStream.format("tail").option("path", str(folder)).option("part", "16").load()
        query = counted(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert query.awaitTermination(200)

    step()
    with open(folder / "a.log", "a") as f:
        f.write("error one\nfine\nerror two\nhalf an err")
    (folder / "b.log").write_text("gone away\r\n\nerror here in a line longer than a part\n")
    step()
    with open(folder / "a.log", "a") as f:
        f.write("or\ngone\n")
    step()
    got = sorted((r.pattern, r.count_so_far, os.path.basename(r.path), r.line) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("error", 1, "a.log", "error one"), ("error", 2, "a.log", "error two"), ("error", 3, "b.log", "error here in a line longer than a part"), ("error", 4, "a.log", "half an error"), ("gone", 1, "b.log", "gone away"), ("gone", 2, "a.log", "gone")]


def test_parts_of_a_file_hold_each_line_once(tmp_path):
    text = b"".join(b"x" * (i * 7 % 23) + b"\n" for i in range(60)) + b"no end"
    path = tmp_path / "f.log"
    path.write_bytes(text)
    end = tail.whole_lines(str(path), len(text))
    assert end == len(text) - len(b"no end")
    for size in (1, 2, 5, 17, 1000):
        got = [x for at in range(0, end, size) for x in tail.lines_from(str(path), at, min(end, at + size), at == 0)]
        assert [x for _, x in got] == text[:end].split(b"\n")[:-1] and [a for a, _ in got] == sorted({a for a, _ in got})


def test_messages_are_routed_by_their_channel(spark):
    rows = [("gc:thread:7", "a"), ("gc:user:3", "b"), ("gc:other:1", "c"), ("x", "d"), ("gc:thread:no", "e"), (None, "f")]
    got = stateful.routed(spark.createDataFrame(rows, "channel string, payload string"), F.col("channel"))
    assert sorted((r.kind, r.target, r.payload) for r in got.collect()) == [("thread", 7, "a"), ("user", 3, "b")]


def test_a_replayed_batch_delivers_nothing_twice(spark, parts, tmp_path):
    real, _ = parts
    src = f"{tmp_path}/in"
    for p in real:
        add(spark, src, p)
    members = spark.createDataFrame([(t, m) for t in range(3) for m in range(4)], "thread long, member long")
    gone = spark.createDataFrame([(3,)], "member long")
    stream = lambda: spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(src)
    send = lambda: deliver.broadcast(stream(), lambda: members, lambda: gone, f"{tmp_path}/sent", f"{tmp_path}/c")
    push = lambda: deliver.pushed(stream(), lambda: gone.select(F.col("member").alias("target")), f"{tmp_path}/pushed", f"{tmp_path}/d")
    for start in (send, push):
        assert start().awaitTermination(200)
    sent = lambda: sorted((r.event_id, r.member) for r in deliver.received(spark, f"{tmp_path}/sent").collect())
    pushed = lambda: sorted(r.event_id for r in deliver.received(spark, f"{tmp_path}/pushed").collect())
    every = [r for p in real for r in p]
    want = sorted((r[0], m) for r in every for m in range(3) if m != r[2])
    assert sent() == want and pushed() == sorted(r[0] for r in every if r[5] == 3)
    # As after a failure between the sink and the commit: the last batch is run again
    for c in ("c", "d"):
        commits = sorted(f for f in os.listdir(f"{tmp_path}/{c}/commits") if f.isdigit())
        for f in (commits[-1], f".{commits[-1]}.crc"):
            shutil.move(f"{tmp_path}/{c}/commits/{f}", f"{tmp_path}/{c}-{f}") if os.path.exists(f"{tmp_path}/{c}/commits/{f}") else None
    for start in (send, push):
        assert start().awaitTermination(200)
    assert sent() == want and pushed() == sorted(r[0] for r in every if r[5] == 3)
