"""Runs on a stream: equal to those of a batch, over a restart, with late rows and silence, and with no state left behind."""

import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA

from dyadspark.streaming.segments import PROVIDER, Runs, live_runs, state_store

IDLE = 3_600_000


def batch(rows):
    """(user, state, start, end, n) by ms, in plain Python."""
    out, open_ = [], {}
    for u, t, s in sorted(rows):
        r = open_.get(u)
        if r and r[1] == s and t - r[3] <= IDLE:
            open_[u] = (u, s, r[2], t, r[4] + 1)
        else:
            out += [r] if r else []
            open_[u] = (u, s, t, t, 1)
    return sorted(out + list(open_.values()))


@pytest.fixture
def run(spark, tmp_path):
    def once(rows=None):
        source = str(tmp_path / "in")
        if rows is not None:
            df = spark.createDataFrame(rows, "u long, ms long, s string").select("u", F.timestamp_millis("ms").alias("t"), "s")
            df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("u long, t timestamp, s string").option("maxFilesPerTrigger", 1).parquet(source)
        with state_store(spark):
            q = live_runs(stream, ["u"], "t", "s", IDLE / 1000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
            q.awaitTermination()
        got = spark.read.schema("u long, state string, start timestamp, end timestamp, n bigint").parquet(str(tmp_path / "out"))
        state = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None
        return sorted(map(tuple, got.select("u", "state", F.unix_millis("start"), F.unix_millis("end"), "n").collect())), state

    return once


def test_restart_gives_the_batch_result(spark, run):
    e = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")), "event_type").collect()
    rows = sorted(map(tuple, e), key=lambda r: (r[1], r[0]))
    first, _ = run(rows[:400])
    assert set(first) < set(batch(rows))
    run(rows[400:700])  # a new query from the same checkpoint
    got, state = run(rows[700:] + [(-1, rows[-1][1] + 10 * IDLE, "end")])
    assert [r for r in got if r[0] >= 0] == batch(rows)
    assert state <= 4  # the last row's own: it waits, has a timer, and the index of timers
    assert spark.conf.get(PROVIDER, None) is None


def test_silence_ties_gaps_and_late_rows(run):
    a = [(1, 1, "x"), (1, 10, "x"), (1, 10, "y"), (1, 20, "y"), (2, 5, "x"), (2, 5 + IDLE, "x"), (3, 7, None), (1, None, "x")]
    kept = [r for r in a if None not in r]
    got, _ = run(a)
    later = [(2, 6 + 2 * IDLE, "x"), (9, 10 * IDLE, "z")]
    run(later)
    run([(1, 30, "y"), (2, 6 + IDLE, "x"), (9, 20 * IDLE, "z")])  # the first two are too late
    got, _ = run([(9, 40 * IDLE, "z")])
    assert [r for r in got if r[0] < 9] == [r for r in batch(kept + later) if r[0] < 9]
    assert (2, "x", 5, 5 + IDLE, 2) in got and (2, "x", 6 + 2 * IDLE, 6 + 2 * IDLE, 1) in got  # a gap of one over


class _Kept:
    """A state in memory that counts what it is asked to keep."""

    def __init__(self):
        self.has, self.puts = [], 0

    def appendValue(self, x):
        self.has, self.puts = [*self.has, x], self.puts + 1

    appendList = put = lambda self, x: [self.appendValue(v) for v in x]

    def update(self, x):
        self.has, self.puts = [x], self.puts + 1

    def clear(self):
        self.has = []

    def exists(self):
        return bool(self.has)

    def get(self):
        return self.has


def test_cost_of_an_entity_follows_batches_not_rows():
    """Of one entity with 1000 rows in two batches: two elements of state, two timers, and one row of runs."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    waiting, timers, at = _Kept(), [], SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    opened = _Kept()
    opened.get = lambda: opened.has[-1] if opened.has else None
    p = Runs(["u"], IDLE)
    p.init(SimpleNamespace(getListState=lambda *_: waiting, getValueState=lambda *_: opened, registerTimer=timers.append))
    rows = [(7, 10 * t, "ab"[t // 3 % 2]) for t in range(1000)]
    for part in (rows[1::2], rows[::2]):
        assert list(p.handleInputRows((7,), iter([Row(u=u, ms=t, state=s) for u, t, s in part]), at)) == []
    assert (waiting.puts, timers) == (2, [10, 0])
    (out,) = p.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 5000), None)
    assert (waiting.puts, opened.puts) == (3, 1) and timers[2:] == [5000, 4990 + IDLE]
    (rest,) = p.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**9), None)
    assert sorted((r.u, *x) for r in (out, rest) for x in zip(r.state, r.start, r.end, r.n, strict=True)) == sorted(batch(rows))
    assert not waiting.has and not opened.has
