"""State machines over event streams with ``transformWithState``: typed state, event-time timers, time to live.

The session needs the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass`` =
``org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.

``ordered`` runs a machine over each key's rows in the order of event time, whatever
the order of arrival: a row waits in the state until the watermark has passed it. So
the output equals the batch form's, also after a restart from the checkpoint.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brookwell.streaming.events import micros

State = tuple | None


def _rows(schema: str, rows: list[tuple]) -> Iterator[Row]:
    """Tuples as rows with the names of ``schema``."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return (Row(**dict(zip(names, x, strict=True))) for x in rows)


@dataclass(frozen=True)
class Machine:
    """``step(state, row)`` gives (new state, output tuples); rows come in the order of ``us`` and the tie column.

    ``deadline(state)`` is the event time in microseconds at which ``expire(state)``
    takes the place of a step, None for never; a step at that very time comes after it.
    State is a tuple of ``state`` (a schema), or None where there is none.
    """

    state: str
    output: str
    step: Callable[[State, Any], tuple[State, list[tuple]]]
    deadline: Callable[[tuple], int | None] = lambda state: None
    expire: Callable[[tuple], tuple[State, list[tuple]]] = lambda state: (None, [])


class _Ordered(StatefulProcessor):
    def __init__(self, machine: Machine, output: str, waiting: str, tie: str, names: list[str]):
        self.machine, self.output, self.schema, self.tie, self.names = machine, output, waiting, tie, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.now = handle.getValueState("now", self.machine.state)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        rows = list(rows)
        self.waiting.appendList([tuple(r[c] for c in self.names) for r in rows])
        for ms in {r["us"] // 1000 + 1 for r in rows}:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [Row(**dict(zip(self.names, x, strict=True))) for x in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r["us"] < passed), key=lambda r: (r["us"], r[self.tie]))
        left = [r for r in rows if r["us"] >= passed]
        state, out = (tuple(self.now.get()) if self.now.exists() else None), []

        def lapse(upto: int) -> None:
            nonlocal state, out
            while state is not None and (at := self.machine.deadline(state)) is not None and at <= upto:
                state, more = self.machine.expire(state)
                out += more

        for r in due:
            lapse(r["us"])
            state, more = self.machine.step(state, r)
            out += more
        lapse(passed)
        if due:
            if left:
                self.waiting.put([tuple(r[c] for c in self.names) for r in left])
            else:
                self.waiting.clear()
        if state is None:
            self.now.clear()
        else:
            self.now.update(state)
            if (at := self.machine.deadline(state)) is not None:
                self.handle.registerTimer(at // 1000 + 1)
        return _rows(self.output, [(*key, *x) for x in out])

    def close(self) -> None:
        pass


def ordered(events: DataFrame, machine: Machine, key: str, tie: str, *columns: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """(key, output columns of ``machine``) over a stream; steps see ``us``, ``tie`` and ``columns``. Rows later than ``delay`` are dropped."""
    names = list(dict.fromkeys(["us", tie, *columns]))
    timed = events.withWatermark(ts, delay).select(key, ts, micros(F.col(ts)).alias("us"), *(c for c in names if c != "us"))
    kind = lambda c: timed.schema[c].dataType.simpleString()
    waiting = ", ".join(f"{c} {kind(c)}" for c in names)
    output = f"{key} {kind(key)}, {machine.output}"
    return timed.groupBy(key).transformWithState(_Ordered(machine, output, waiting, tie, names), output, "Append", "EventTime")


def sequence(id_col: str, start: int = 0) -> Machine:
    """Gapless numbers of a thread's messages, from ``start`` + 1."""

    def step(state: State, row: Any) -> tuple[State, list[tuple]]:
        n = (state[0] if state else start) + 1
        return (n,), [(row[id_col], n)]

    return Machine("n long", f"{id_col} long, seq long", step)


def receipts(id_col: str, value: str) -> Machine:
    """What each event leaves as the highest number read, which never goes back."""

    def step(state: State, row: Any) -> tuple[State, list[tuple]]:
        n = max(state[0], row[value]) if state else row[value]
        return (n,), [(row[id_col], n)]

    return Machine("n long", f"{id_col} long, last_read long", step)


def typing(gap_us: int) -> Machine:
    """(start_us, end_us, n) of each run of events; it ends ``gap_us`` after its last one, and an event at that very time still belongs to it, as in Spark's session windows."""

    def step(state: State, row: Any) -> tuple[State, list[tuple]]:
        return (state[0], row["us"], state[2] + 1) if state else (row["us"], row["us"], 1), []

    return Machine("start long, last long, n long", "start_us long, end_us long, n long", step, lambda s: s[1] + gap_us + 1, lambda s: (None, [(s[0], s[1] + gap_us, s[2])]))


def stuck(kind: str, working: str, after_us: int) -> Machine:
    """(since_us): a key whose last event is ``working`` and ``after_us`` old. It is told once for that event."""

    def step(state: State, row: Any) -> tuple[State, list[tuple]]:
        return (row["us"], row[kind] == working), []

    return Machine("since long, working boolean", "since_us long", step, lambda s: s[0] + after_us if s[1] else None, lambda s: ((s[0], False), [(s[0],)]))


def expiry(after_us: int) -> Machine:
    """(expires_us): a key's state goes ``after_us`` after its last event, unless another comes before."""

    def step(state: State, row: Any) -> tuple[State, list[tuple]]:
        return (row["us"],), []

    return Machine("last long", "expires_us long", step, lambda s: s[0] + after_us, lambda s: (None, [(s[0] + after_us,)]))


class _Limiter(StatefulProcessor):
    def __init__(self, output: str, id_col: str, window_ms: int, most: int):
        self.output, self.id_col, self.window, self.most = output, id_col, window_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tries = handle.getListState("tries", "ms long", ttlDurationMs=self.window + 1000)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        kept = [x[0] for x in self.tries.get() if x[0] > now - self.window] if self.tries.exists() else []
        out = []
        for r in sorted(rows, key=lambda r: r[self.id_col]):
            kept.append(now)
            out.append((*key, r[self.id_col], len(kept), len(kept) <= self.most))
        self.tries.put([(x,) for x in kept])
        return _rows(self.output, out)

    def close(self) -> None:
        pass


def limited(events: DataFrame, window_s: float, most: int, key: str = "user_id", id_col: str = "event_id") -> DataFrame:
    """(key, id, n, allowed) of attempts as they arrive, by the clock: refused ones count too. A key's state lives a second longer than the window, then the store drops it."""
    kind = lambda c: events.schema[c].dataType.simpleString()
    output = f"{key} {kind(key)}, {id_col} {kind(id_col)}, n long, allowed boolean"
    return events.select(key, id_col).groupBy(key).transformWithState(_Limiter(output, id_col, int(window_s * 1000), most), output, "Update", "ProcessingTime")


class _Tally(StatefulProcessor):
    def __init__(self, output: str, order: tuple[str, ...], columns: tuple[str, ...]):
        self.output, self.order, self.columns = output, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n = self.n.get()[0] if self.n.exists() else 0
        out = []
        for r in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            n += 1
            out.append((*key, n, *(r[c] for c in self.columns)))
        self.n.update((n,))
        return _rows(self.output, out)

    def close(self) -> None:
        pass


def findings(lines: DataFrame, patterns: dict[str, str], most: int = 500) -> DataFrame:
    """(pattern, count_so_far, path, line): each match of each pattern in lines (path, position, value), numbered as they come; lines are cut at ``most``, as reports are."""
    hits = F.filter(F.array(*(F.when(F.col("value").rlike(p), F.lit(name)) for name, p in patterns.items())), lambda x: x.isNotNull())
    found = lines.select(F.explode(hits).alias("pattern"), "path", "position", F.substring("value", 1, most).alias("line"))
    output = "pattern string, count_so_far long, path string, line string"
    return found.groupBy("pattern").transformWithState(_Tally(output, ("path", "position"), ("path", "line")), output, "Append", "None")


def routed(messages: DataFrame, channel: Column, prefix: str = "gc") -> DataFrame:
    """Messages of the channels ``prefix:thread:N`` and ``prefix:user:N`` with ``kind`` and ``target``; others are dropped."""
    parts = F.split(channel, ":")
    kind, target = F.get(parts, F.lit(1)), F.get(parts, F.size(parts) - 1).try_cast("long")
    known = channel.startswith(f"{prefix}:thread:") | channel.startswith(f"{prefix}:user:")
    return messages.where(known & target.isNotNull()).withColumns({"kind": kind, "target": target})
