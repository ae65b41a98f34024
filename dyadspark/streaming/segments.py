"""Runs of equal states on a stream, with state that ends: rows wait for the watermark, runs close by change, by gap or by silence."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FIELDS = ("state", "start", "end", "n")


class Runs(StatefulProcessor):
    """Of one entity: `waiting`, rows that the watermark hasn't reached, and `open`, the run that may go on.

    Timers stand at the earliest row of each batch, at the earliest that still waits after a timer, and where the open run's
    silence is long enough to end it. A timer that finds nothing to do does no harm; behind the last nothing is left of the entity.
    What waits is kept as one element a batch, not one a row, and the runs that are over leave as arrays in one row: every use of
    the state is a message to the JVM, and a pandas frame an entity, in and out, costs more than the entity's rows.
    """

    def __init__(self, names: list[str], idle: int):
        self.out, self.idle = Row(*names, *FIELDS), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t array<bigint>, state array<string>")
        self.open = handle.getValueState("open", "state string, first bigint, last bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        fresh = [(r[-2], r[-1]) for r in rows if r[-2] >= mark]
        if fresh:
            self._wait(fresh)
            self.handle.registerTimer(min(fresh)[0])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(x for times, states in self.waiting.get() for x in zip(times, states, strict=True))
        cut = bisect_left(waiting, (mark,))
        due, later = waiting[:cut], waiting[cut:]
        before, closed = self.open.get(), []
        run = before
        for t, s in due:
            if run and s == run[0] and t - run[2] <= self.idle:
                run = (s, run[1], t, run[3] + 1)
            else:
                closed += [run] if run else []
                run = (s, t, t, 1)
        if run and mark > run[2] + self.idle:
            closed, run = [*closed, run], None
        if due:
            self.waiting.clear()
            if later:
                self._wait(later)
        if later:
            self.handle.registerTimer(later[0][0])
        if run:
            self.open.update(run)
            self.handle.registerTimer(run[2] + self.idle)
        elif before:
            self.open.clear()
        return iter([self.out(*key, *map(list, zip(*closed, strict=True)))] if closed else [])

    def _wait(self, rows: list) -> None:
        self.waiting.appendValue(tuple(map(list, zip(*rows, strict=True))))

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that typed state needs, for streams that start inside; the setting of before comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def live_runs(stream: DataFrame, entity: list[str], time: str, state: str, idle_seconds: float, late: str = "0 seconds") -> DataFrame:
    """entity, state, start, end, n of runs of equal states, each once it is over: append mode.

    A run ends with another state, or with over idle_seconds without a row. Rows later than the watermark are dropped; rows
    without time or state are left out, as in a batch. Times count in milliseconds; of rows of one time the lesser state is first.
    Start the stream inside `state_store`.
    """
    rows = stream.select(*entity, F.col(time).cast("timestamp").alias("t"), F.col(state).cast("string").alias("state")).where("t IS NOT NULL AND state IS NOT NULL")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in entity], "state array<string>, start array<bigint>, end array<bigint>, n array<bigint>"])
    marked = rows.withWatermark("t", late).select(*entity, F.unix_millis("t").alias("ms"), "state").groupBy(*entity)
    runs = marked.transformWithState(Runs(entity, int(idle_seconds * 1000)), schema, "append", "EventTime")
    runs = runs.select(*entity, F.explode(F.arrays_zip(*FIELDS)).alias("__r"))
    return runs.select(*entity, "__r.state", F.timestamp_millis("__r.start").alias("start"), F.timestamp_millis("__r.end").alias("end"), "__r.n")
