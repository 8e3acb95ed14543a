"""Streams with state of their own for each key: decisions, folded runs and next polls, in event order whatever order events come in.

Each stream takes a log ``key, ts, kind, id`` and equals its batch query over all events that the
watermark has passed: a processor keeps a key's events until it has, then folds them in order of (ts, id). Timers
wake it, so nothing waits for a key's next event. A fold holds little: what is kept for a key is the events of the watermark's delay and one short text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Folds a key's events in order once the watermark has passed them; subclasses say how. ``columns`` are the names of what comes out."""

    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events string")  # those of a batch in one text: a row of state for each would cost more than its fold
        self.folded = handle.getValueState("folded", "state string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        events = [(r["us"], r["kind"], r["id"]) for r in rows]
        self.waiting.appendValue((json.dumps(events),))
        self.handle.registerTimer(min(events)[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """Folds all that the watermark has passed, and asks to be woken for the first event that it hasn't."""
        until, state = timerValues.getCurrentWatermarkInMs(), self.folded.get()
        state = json.loads(state[0]) if state else {}
        events = sorted((us, id_, kind) for packed in self.waiting.get() for us, kind, id_ in json.loads(packed[0]))
        left = [(us, kind, id_) for us, id_, kind in events if us // 1000 >= until]
        if len(left) < len(events):
            self.waiting.put([(json.dumps(left),)]) if left else self.waiting.clear()
        out: list[tuple] = []
        for us, id_, kind in events[: len(events) - len(left)]:
            out += self.step(state, us, kind, id_)
        out += self.at(state, until)
        self.folded.update((json.dumps(state),))
        wakes = ([left[0][0] // 1000] if left else []) + self.wakes(state)
        if wakes:
            self.handle.registerTimer(min(wakes) + 1)  # one timer a key: what is settled or replaced needs none
        return iter([Row(**dict(zip(self.columns, (*key, *row)))) for row in out])

    def step(self, state: dict, us: int, kind: str, id_: int) -> list[tuple]:
        """Folds one event into ``state``; returns rows that it settles."""
        raise NotImplementedError

    def at(self, state: dict, ms: int) -> list[tuple]:
        """Rows that are settled because all before ``ms`` has passed."""
        return []

    def wakes(self, state: dict) -> list[int]:
        """When ``at`` has to be asked again (ms), if ever."""
        return []

    def close(self) -> None:
        pass


class Decisions(InOrder):
    """The first time of each kind sticks; ``clears`` ends an earlier ``queues``. A row for each change, the whole decision in it."""

    def __init__(self, sticks: dict[str, str], queues: str, clears: str) -> None:
        self.sticks, self.queues, self.clears = sticks, queues, clears

    def step(self, state: dict, us: int, kind: str, id_: int) -> list[tuple]:
        before = dict(state)
        if kind in self.sticks:
            state.setdefault(self.sticks[kind], us // 1_000_000)
        elif kind == self.queues:
            state.setdefault("queued", us // 1_000_000)
        elif kind == self.clears:
            state.pop("queued", None)
        if {k: v for k, v in state.items() if k != "n"} == {k: v for k, v in before.items() if k != "n"}:
            return []
        state["n"] = state.get("n", 0) + 1
        return [(*(state.get(c) for c in self.sticks.values()), state.get("queued"), state["n"])]


class Runs(InOrder):
    """Runs of equal kinds, each a row once another kind follows: number, kind, first event, how many."""

    def step(self, state: dict, us: int, kind: str, id_: int) -> list[tuple]:
        if state.get("kind") == kind:
            state["n"] += 1
            return []
        done = [(state["run"], state["kind"], state["first"], state["n"])] if state else []
        state.update(run=state.get("run", 0) + 1, kind=kind, first=id_, n=1)
        return done


class Polls(InOrder):
    """When a source is due: an interval after its last sync, once until it is synced again; not while it is paused."""

    def __init__(self, interval_ms: int, pauses: str) -> None:
        self.interval_ms, self.pauses = interval_ms, pauses

    def step(self, state: dict, us: int, kind: str, id_: int) -> list[tuple]:
        found = self.at(state, us // 1000)
        state["due"] = None if kind == self.pauses else us // 1000 + self.interval_ms
        return found

    def at(self, state: dict, ms: int) -> list[tuple]:
        due = state.get("due")
        if due is None or due >= ms:
            return []
        state["due"] = None
        return [(due,)]

    def wakes(self, state: dict) -> list[int]:
        return [state["due"]] if state.get("due") is not None else []


def _run(log: DataFrame, processor: InOrder, columns: str, late: str) -> DataFrame:
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    key = f"key {log.schema['key'].dataType.simpleString()}"
    processor.columns = ["key", *(c.split()[0] for c in columns.split(", "))]
    events = log.withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("us"), "kind", "id")
    return events.groupBy("key").transformWithState(processor, f"{key}, {columns}", "append", "eventTime")


def decisions(log: DataFrame, sticks: dict[str, str], queues: str, clears: str, late: str = "2 days") -> DataFrame:
    """Changes of each key's decision: ``key``, the values of ``sticks``, ``queued`` (seconds), ``version``; the highest version holds."""
    names = ", ".join(f"{c} long" for c in sticks.values())
    return _run(log, Decisions(sticks, queues, clears), f"{names}, queued long, version long", late)


def latest(changes: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """The last change of each key."""
    row = F.struct(*[F.col(c) for c in changes.columns])
    return changes.groupBy(key).agg(F.max_by(row, version).alias("row")).select("row.*").drop(version)


def runs(log: DataFrame, late: str = "2 days") -> DataFrame:
    """``key, run, kind, first, n``: runs of equal kinds in order, but for the one that is still open."""
    return _run(log, Runs(), "run long, kind string, first long, n long", late)


def polls(log: DataFrame, interval_ms: int, pauses: str, late: str = "2 days") -> DataFrame:
    """``key, due_ms``: when each source became due. Any kind but ``pauses`` counts as a sync."""
    return _run(log, Polls(interval_ms, pauses), "due_ms long", late)


# The same over a whole table


def passed(log: DataFrame, late_ms: int) -> DataFrame:
    """The events that a watermark of ``late_ms`` has passed at the end, with ``until`` (ms), the watermark."""
    until = log.agg((F.unix_millis(F.max("ts")) - late_ms).alias("until"))
    return log.join(F.broadcast(until)).filter(F.unix_millis("ts") < F.col("until"))


def batch_runs(log: DataFrame) -> DataFrame:
    order = Window.partitionBy("key").orderBy("ts", "id")
    new = (~F.lag("kind").over(order).eqNullSafe(F.col("kind"))).cast("int")
    marked = log.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    grouped = marked.groupBy("key", "run", "kind").agg(F.min_by("id", F.struct("ts", "id")).alias("first"), F.count("*").alias("n"))
    open_run = F.max("run").over(Window.partitionBy("key"))
    return grouped.withColumn("open", open_run).filter("run < open").drop("open")


def batch_polls(log: DataFrame, interval_ms: int, pauses: str) -> DataFrame:
    order = Window.partitionBy("key").orderBy("ts", "id")
    due = F.unix_millis("ts") + interval_ms
    ends = F.coalesce(F.unix_millis(F.lead("ts").over(order)), F.col("until"))
    return log.withColumn("due_ms", due).withColumn("ends", ends).filter((F.col("kind") != pauses) & (F.col("due_ms") < F.col("ends"))).select("key", "due_ms")


def batch_decisions(log: DataFrame, sticks: dict[str, str], queues: str, clears: str) -> DataFrame:
    second = F.floor(F.unix_micros("ts") / 1_000_000)
    at = F.struct("ts", "id")
    first = [F.min(F.when(F.col("kind") == kind, second)).alias(name) for kind, name in sticks.items()]
    cleared = log.groupBy("key").agg(*first, F.max(F.when(F.col("kind") == clears, at)).alias("cleared"), F.count_if(F.col("kind").isin(*sticks, queues)).alias("any"))
    after = log.filter(F.col("kind") == queues).withColumn("at", at).join(cleared.select("key", "cleared"), "key").filter(F.col("cleared").isNull() | (F.col("at") > F.col("cleared")))
    queued = after.groupBy("key").agg(F.floor(F.unix_micros(F.min("at")["ts"]) / 1_000_000).alias("queued"))
    return cleared.filter("any > 0").join(queued, "key", "left").select("key", *sticks.values(), "queued")
