"""Streams: the watch loop as micro-batches, first and last sightings, and the failure machine with its pause."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULTS
from ..shipping import ship_package


def run_cycles(stream: DataFrame, cycle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Run cycle on each micro-batch: all that is there, then stop; or every so often until stopped."""
    writer = stream.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def first_sightings(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key, over the whole stream; state is kept for good, as late duplicates may come at any time."""
    return stream.dropDuplicates(keys)


def sightings(stream: DataFrame, keys: list[str], at: str) -> DataFrame:
    """First and last time and number of rows of each key, for update mode."""
    return stream.groupBy(*keys).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.count(F.lit(1)).alias("n"))


def windowed(stream: DataFrame, at: str, length: str, *keys: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts in tumbling or sliding event-time windows under a watermark (beyond what listings need)."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return stream.withWatermark(at, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"))


class FailureMachine(StatefulProcessor):
    """Per source: consecutive failures and the end of a pause. Events during a pause are skipped, which recorded events alone cannot say.

    Input: source, at (timestamp), outcome (ok, blocked or error). Output: source, at, outcome, skipped, failure_count, paused_until.
    """

    after, pause = DEFAULTS.failures_before_pause, pd.Timedelta(hours=DEFAULTS.pause_hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("failures", "n int, until timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, until = self.state.get() if self.state.exists() else (0, None)
        until = pd.Timestamp(until) if until is not None else None
        every = pd.concat(list(rows)).sort_values(["at", "outcome"], kind="stable")
        out = []
        for at, outcome in zip(every["at"], every["outcome"], strict=True):
            skipped = until is not None and until > at
            if not skipped:
                if outcome == "ok":
                    n, until = 0, None
                elif outcome == "blocked":
                    n += 1
                    if n >= self.after:
                        until = at + self.pause
            out.append((key[0], at, outcome, bool(skipped), n, until))
        self.state.update((n, until.to_pydatetime() if until is not None else None))
        yield pd.DataFrame(out, columns=["source", "at", "outcome", "skipped", "failure_count", "paused_until"]).astype({"paused_until": "datetime64[ns]"})

    def close(self) -> None:
        pass


RESUMED = "resumed"


class TimedFailures(FailureMachine):
    """The same with event-time timers. A pause that begins sets a timer for its end; when the watermark has passed it, a row of outcome resumed says so. A source
    without failures has no state, so state is held for failing sources alone."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for told in super().handleInputRows(key, rows, timerValues):
            for until in told["paused_until"].dropna().unique():
                end = int(pd.Timestamp(until).timestamp() * 1000)
                if end > timerValues.getCurrentWatermarkInMs():
                    self.handle.registerTimer(end)
            yield told
        n, until = self.state.get()
        if n == 0 and until is None:
            self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        n, until = self.state.get() if self.state.exists() else (0, None)
        row = pd.DataFrame([(key[0], at, RESUMED, False, n, pd.Timestamp(until) if until is not None else None)], columns=["source", "at", "outcome", "skipped", "failure_count", "paused_until"])
        yield row.astype({"at": "datetime64[ns]", "paused_until": "datetime64[ns]"})

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle


def failure_stream(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The machine over a stream of (source, at, outcome), with timers; for append mode, on a state store of RocksDB. Events may be late by as much as the watermark allows, but
    count in the order of their micro-batches."""
    ship_package(stream.sparkSession)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.withWatermark("at", late).groupBy("source").transformWithStateInPandas(TimedFailures(), MACHINE_OUTPUT, "Append", "EventTime")


MACHINE_OUTPUT = "source string, at timestamp, outcome string, skipped boolean, failure_count int, paused_until timestamp"


def failure_machine(stream: DataFrame) -> DataFrame:
    """The machine over a stream or a table of (source, at, outcome)."""
    return stream.groupBy("source").transformWithStateInPandas(FailureMachine(), MACHINE_OUTPUT, "Append", "None")


def simulate_failures(events: DataFrame) -> DataFrame:
    """The same over a recorded table, in batch: sources in sorted partitions, whose events are streamed; of a source only its state is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, n, until, begun = None, 0, None, False
        for batch in batches:
            out = []
            for name, at, outcome in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or name != source:
                    source, n, until, begun = name, 0, None, True
                skipped = until is not None and until > at
                if not skipped:
                    n, until = (0, None) if outcome == "ok" else (n + (outcome == "blocked"), until)
                    if outcome == "blocked" and n >= DEFAULTS.failures_before_pause:
                        until = at + dt.timedelta(hours=DEFAULTS.pause_hours)
                out.append((skipped, n, until))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(cols, (pa.bool_(), pa.int32(), pa.timestamp("us", "UTC")), strict=True))], ["source", "at", "outcome", "skipped", "failure_count", "paused_until"])

    rows = events.select("source", "at", "outcome")
    return rows.repartition("source").sortWithinPartitions("source", "at", "outcome").mapInArrow(run, MACHINE_OUTPUT)
