import random
import time

import pytest

from papershed.streaming import library as S
from papershed.streaming import stateful as T


def test_first_seen_over_a_long_log_in_batches(spark, tmp_path):
    path = tmp_path / "log"
    for day in ("2024-01-01", "2024-03-15", "2024-07-01", "2024-02-01"):  # months apart, the last file out of order
        user = 2 if day == "2024-02-01" else 1
        spark.sql(f"SELECT {user}L AS user_id, 'view' AS event_type, TIMESTAMP '{day} 00:00:00' AS ts").coalesce(1).write.mode("append").parquet(str(path))
    log = spark.readStream.schema("user_id long, event_type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(path))
    assert sorted(map(tuple, S.drained(spark, S.first_seen(log)).collect())) == [(1, "view"), (2, "view")]


@pytest.fixture
def log(spark, tmp_path):
    """A log of 40 keys in nine files that come out of order by hours, and as a whole table."""
    rng = random.Random(3)
    rows = [(k % 40, 1_700_000_000 + t * 3600 + rng.randint(0, 9), rng.choice(["view", "purchase", "error", "click", "signup"]), k * 1000 + t) for k in range(40) for t in sorted(rng.sample(range(400), 25))]
    rows.sort(key=lambda r: r[1] + rng.randint(-12, 12) * 3600)
    rows.append((77, 1_700_000_000 + 900 * 3600, "view", 1))
    for n in range(9):
        part = rows[len(rows) * n // 9 : len(rows) * (n + 1) // 9]
        frame = spark.createDataFrame(part, "key long, s long, kind string, id long").selectExpr("key", "timestamp_seconds(s) as ts", "kind", "id")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return str(tmp_path / "log")


def rows_of(frame, columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


SCHEMA = "key long, ts timestamp, kind string, id long"
STICKS = {"view": "opened", "purchase": "kept", "error": "dismissed"}
STREAMS = {
    "runs": (lambda log: T.runs(log), lambda whole: T.batch_runs(whole), ["key", "run", "kind", "first", "n"]),
    "polls": (lambda log: T.polls(log, 10 * 3_600_000, "error"), lambda whole: T.batch_polls(whole, 10 * 3_600_000, "error"), ["key", "due_ms"]),
    "decisions": (lambda log: T.decisions(log, STICKS, "click", "signup"), lambda whole: T.batch_decisions(whole, STICKS, "click", "signup"), ["key", "opened", "kept", "dismissed", "queued"]),
}


@pytest.mark.parametrize("name", STREAMS)
def test_streams_equal_their_batch_queries_after_batches_and_a_restart(spark, log, tmp_path, name):
    stream, batch, columns = STREAMS[name]
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(log)

    def drain(n_files):
        query = stream(source).writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state")
        running = query.trigger(processingTime="0 seconds").start() if n_files else query.trigger(availableNow=True).start()
        if n_files:
            while running.isActive and (running.lastProgress is None or running.lastProgress["batchId"] < n_files):
                time.sleep(0.2)
            running.stop()
        else:
            running.awaitTermination()

    drain(3)  # stopped after some batches, whatever they were at
    drain(None)
    found = spark.read.schema(stream(source).schema).parquet(f"{tmp_path}/rows")
    found = T.latest(found) if name == "decisions" else found
    whole = T.passed(spark.read.schema(SCHEMA).parquet(log), 2 * 86_400_000)
    expect = rows_of(batch(whole), columns)
    assert rows_of(found, columns) == expect and len(expect) >= 40


class Handle:
    """A key's state and timers in plain Python, with counts of what went in."""

    def __init__(self):
        self.rows, self.value, self.timers = [], None, []
        self.getListState = self.getValueState = lambda *a: self
        self.put_in = 0

    def appendValue(self, row):
        self.appendList([row])

    def appendList(self, rows):
        self.rows += rows
        self.put_in += len(rows)

    def put(self, rows):
        self.rows = []
        self.appendList(rows)

    def clear(self):
        self.rows = []

    def update(self, value):
        self.value = value

    def registerTimer(self, ms):
        self.timers.append(ms)


class Watermark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_fold_costs_few_rows_of_state_and_one_timer():
    handle, polls = Handle(), T.Polls(1000, "error")
    polls.columns = ["key", "due_ms"]
    handle.get = lambda: handle.value
    polls.init(handle)
    polls.waiting = type("L", (), {"get": lambda self: iter(handle.rows), **{n: (lambda self, *a, n=n: getattr(handle, n)(*a)) for n in ("appendList", "appendValue", "put", "clear")}})()
    polls.handleInputRows((1,), iter([{"us": t * 500_000, "kind": None if t == 7 else "view" if t < 300 else "click", "id": t} for t in range(400, -1, -1)]), None)
    assert handle.put_in == 1 and handle.timers == [1]
    assert list(polls.handleExpiredTimer((1,), Watermark(150_250), None)) == []
    assert handle.timers == [1, 150_501] and handle.put_in == 2  # not one for each event
    found = list(polls.handleExpiredTimer((1,), Watermark(999_999), None))
    assert [r["due_ms"] for r in found] == [201_000] and handle.timers == [1, 150_501] and handle.rows == []
