"""Alerts on keyed state: evaluations may come in any order within a delay.

Keys are dealt to buckets by hash, and a bucket is what Spark keeps state and a timer for: a call of its
store costs more than several rows, so calls are made for a bucket's rows together and not for each key.
Evaluations wait for the watermark in chunks of one slice of time each, and the bucket keeps since when
the condition of its keys holds. An event-time timer wakes the bucket once the watermark has passed the
earliest evaluation that waits; those that are due are then taken in order of time, slice by slice, and
chunks of which none is due are not read. A micro-batch touches the buckets that it has rows or due
timers of and no others. State is Spark's own, in the checkpoint, so a batch that runs again gives the
same rows, and a quiet key whose condition doesn't hold has no state at all.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.columns import is_true

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 2048
SLICES = 16  # of a delay
CHUNK = 2_000  # rows


class Held(StatefulProcessor):
    """Evaluations at which a key's condition has held for at least `hold` seconds.

    names: columns of a row of a bucket: an evaluation's, ts among them, and last whether its condition
    holds; more may follow. width: seconds of a slice.
    """

    def __init__(self, keys: Sequence[str], names: Sequence[str], hold: float, width: float):
        self.names, self.hold, self.width = list(names), hold, width
        self.at = self.names.index("ts")
        self.key = itemgetter(*map(self.names.index, keys))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "number long", "rows binary")
        #: Slice and first millisecond of each chunk.
        self.index = handle.getValueState("index", "entries binary")
        self.since = handle.getValueState("since", "keys binary")

    def _ms(self, row: tuple) -> int:
        return math.ceil(row[self.at] * 1000)

    def _load(self, state) -> dict:
        kept = state.get()
        return pickle.loads(kept[0]) if kept else {}

    def _save(self, state, entries: dict) -> None:
        if entries:
            state.update((pickle.dumps(entries),))
        else:
            state.clear()

    def _wait(self, index: dict, rows: Iterable[tuple]) -> None:
        """Puts rows into new chunks of one slice each."""
        open_: dict[int, list[tuple]] = {}

        def close(slice_: int) -> None:
            part = open_.pop(slice_)
            number = max(index, default=-1) + 1
            self.chunks.updateValue((number,), (pickle.dumps(part),))
            index[number] = slice_, min(map(self._ms, part))

        for r in rows:
            slice_ = math.floor(r[self.at] / self.width)
            part = open_.setdefault(slice_, [])
            part.append(r)
            if len(part) >= CHUNK:
                close(slice_)
        for slice_ in [*open_]:
            close(slice_)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        width = len(self.names)
        index = self._load(self.index)
        before = min((first for _, first in index.values()), default=None)
        self._wait(index, (r[:width] for r in rows))
        self._save(self.index, index)
        # One timer a bucket: that of its earliest evaluation.
        first = min(first for _, first in index.values())
        if first != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        index, held = self._load(self.index), self._load(self.since)
        due = sorted((slice_, number) for number, (slice_, first) in index.items() if first <= passed)
        make = Row(*self.names[:-1], "active_since")
        # Of evaluations at the same time those that don't hold are first, as in `metrics.alert_for`.
        order = itemgetter(self.at, -1)
        for _, numbers in groupby(due, itemgetter(0)):
            rows = []
            for _, number in numbers:
                rows += pickle.loads(self.chunks.getValue((number,))[0])
                self.chunks.removeKey((number,))
                del index[number]
            rest = [r for r in rows if self._ms(r) > passed]
            if rest:
                self._wait(index, rest)
                rows = [r for r in rows if self._ms(r) <= passed]
            rows.sort(key=order)
            for r in rows:
                of = repr(self.key(r))
                if not r[-1]:
                    held.pop(of, None)
                    continue
                since = held.setdefault(of, r[self.at])
                if r[self.at] - since >= self.hold:
                    yield make(*r[:-1], since)
        self._save(self.index, index)
        self._save(self.since, held)
        if index:
            self.handle.registerTimer(min(first for _, first in index.values()))

    def close(self) -> None:
        pass


@contextmanager
def _provider(spark: SparkSession):
    """Keyed state with timers needs a store that finds keys by time; a query keeps the one it starts with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _seconds(spark: SparkSession, delay: str) -> float:
    """Length of an interval as the watermark reads it."""
    end = F.timestamp_seconds(F.lit(0)) + F.lit(delay).cast("interval")
    return spark.range(1).select(F.unix_micros(end)).first()[0] / 1e6


def firing(
    evaluations: DataFrame, keys: Sequence[str], condition: Column, hold: float, delay: str,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The firing evaluations of a stream, with active_since; the rows that `metrics.alert_for` gives.

    evaluations: keys, ts (seconds) and any columns. delay: how late an evaluation may come, as in
    `10 minutes`; later ones are dropped and counted by the query's progress. buckets: among which keys
    are dealt, the same for all runs on a checkpoint; a task holds a slice of one of them at a time.
    """
    names = evaluations.columns
    width = max(_seconds(evaluations.sparkSession, delay) / SLICES, 1.0)
    held = Held(keys, [*names, "_holds"], float(hold), width)
    out = StructType([*evaluations.schema.fields, StructField("active_since", DoubleType())])
    timed = evaluations.select(
        "*", is_true(condition).alias("_holds"),
        F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint")).alias("_at"),
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"),
    )
    return timed.withWatermark("_at", delay).groupBy("_bucket").transformWithState(
        statefulProcessor=held, outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


def stream_alerts(
    evaluations: DataFrame, keys: Sequence[str], condition: Column, hold: float, delay: str,
    out: str, checkpoint: str, trigger: dict | None = None,
) -> StreamingQuery:
    """Firing evaluations appended as files, each once."""
    with _provider(evaluations.sparkSession):
        return (
            firing(evaluations, keys, condition, hold, delay)
            .writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
