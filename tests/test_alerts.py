"""Alerts of a stream whose evaluations come in any order."""

import datetime
import decimal
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cistern.operators import metrics
from cistern.streaming import alerts

SCHEMA = "pod STRING, ts DOUBLE, value DOUBLE, note STRING"


def run(spark, tmp_path, hold, delay):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    query = alerts.stream_alerts(source, ["pod"], F.col("value") > 1, hold, delay, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    query.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("pod", "ts", "value", "note", "active_since").collect()))


def write(spark, tmp_path, rows, files=1):
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(f"{tmp_path}/in")


@pytest.mark.parametrize("hold", [0.0, 60.0])
def test_shuffled_evaluations_give_the_batch_result(spark, tmp_path, hold):
    draw = random.Random(1)
    rows = [(f"p{draw.randint(0, 3)}", t + draw.random() / 3, draw.choice([0.0, 5.0, 5.0, 5.0]), None if t % 2 else "n") for t in range(0, 3000, 11)]
    want = metrics.alert_for(spark.createDataFrame(rows, SCHEMA), ["pod"], F.col("value") > 1, hold)
    want = sorted(map(tuple, want.select("pod", "ts", "value", "note", "active_since").collect()))
    for i in range(3):
        part = [r for r in rows if i * 1000 <= r[1] < (i + 1) * 1000]
        draw.shuffle(part)
        write(spark, tmp_path, part, 2)
    assert run(spark, tmp_path, hold, "1000 seconds") != want or not want  # the last ones still wait for the watermark
    write(spark, tmp_path, [(None, 90_000.0, 0.0, None)])
    assert run(spark, tmp_path, hold, "1000 seconds") == want


def test_state_goes_on_over_runs(spark, tmp_path):
    at = lambda *rows: write(spark, tmp_path, [(p, 1000.0 + t, v, n) for p, t, v, n in rows])
    at(("p", 0.0, 5.0, "a"), ("q", 0.0, 0.0, "a"))
    run(spark, tmp_path, 10.0, "1 second")
    at(("p", 11.0, 5.0, "b"), ("q", 11.0, 5.0, "b"))
    at(("p", 30.0, 0.0, "c"), ("q", 22.0, 5.0, "c"))
    run(spark, tmp_path, 10.0, "1 second")
    at(("x", 99.0, 0.0, None))
    assert run(spark, tmp_path, 10.0, "1 second") == [("p", 1011.0, 5.0, "b", 1000.0), ("q", 1022.0, 5.0, "c", 1011.0)]


class Kept:
    """A state store that counts its calls."""

    def __init__(self):
        self.values, self.maps, self.timers, self.calls, self.read = {}, {}, [], 0, []

    def getValueState(self, name, schema):
        outer = self

        class Value:
            def get(self):
                outer.calls += 1
                return outer.values.get(name)

            def update(self, value):
                outer.calls += 1
                outer.values[name] = value

            def clear(self):
                outer.calls += 1
                outer.values.pop(name, None)

        return Value()

    def getMapState(self, name, key, value):
        outer = self

        class Map:
            def getValue(self, k):
                outer.calls += 1
                outer.read.append(k)
                return outer.maps.get(k)

            def updateValue(self, k, v):
                outer.calls += 1
                outer.maps[k] = v

            def removeKey(self, k):
                outer.calls += 1
                del outer.maps[k]

        return Map()

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.append(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)


class Passed:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def held(rows, hold=10.0, width=1000.0):
    """A bucket that waits with these (pod, ts, note, holds)."""
    held, kept = alerts.Held(["pod"], ["pod", "ts", "note", "_holds"], hold, width), Kept()
    held.init(kept)
    assert list(held.handleInputRows((0,), (Row(*r, "more") for r in rows), Passed(0))) == []
    return held, kept


def wake(held, kept, ms):
    (timer,) = kept.timers
    assert timer <= ms
    found = list(held.handleExpiredTimer((0,), Passed(ms), None))
    kept.timers.remove(timer)  # Spark deletes the one that expired
    return sorted((tuple(r) for r in found), key=str)


def test_state_calls_do_not_grow_with_keys():
    """one call of the state for a bucket's rows, not for each key or row."""
    calls = []
    for keys in (2, 500):
        bucket, kept = held([(f"p{k}", float(t), None, True) for k in range(keys) for t in (0, 20, 40)])
        assert len(wake(bucket, kept, 50_000)) == 2 * keys
        calls.append(kept.calls)
    assert calls[0] == calls[1] < 20


def test_only_due_slices_are_read():
    rows = [("p", t + 0.5, str(t), True) for t in (3500, 2500, 1500, 500)]
    bucket, kept = held(rows)
    assert [r[1] for r in wake(bucket, kept, 1_500_500)] == [1500.5] and len(kept.read) == 2
    bucket.handleInputRows((0,), [Row("p", 2450.0, "c", True, "more"), Row("p", 2400.0, "b", False, "more")], Passed(1_500_500))
    assert wake(bucket, kept, 2_420_000) == [] and len(kept.read) == 3 and len(kept.maps) == 3  # "c" is put back
    assert wake(bucket, kept, 9_000_000) == [("p", 2500.5, "2500", 2450.0), ("p", 3500.5, "3500", 2450.0)]
    assert not kept.maps and not kept.timers and "index" not in kept.values
    bucket.handleInputRows((0,), [Row("p", 9500.0, None, False, "more")], Passed(9_000_000))
    assert wake(bucket, kept, 9_600_000) == [] and not kept.values and not kept.maps  # a quiet key has no state


def test_chunks_are_cut(monkeypatch):
    monkeypatch.setattr(alerts, "CHUNK", 7)
    bucket, kept = held([("p", float(t), None, True) for t in reversed(range(100))])
    assert len(kept.maps) == 15
    assert [r[1] for r in sorted(wake(bucket, kept, 99_000), key=lambda r: r[1])] == [float(t) for t in range(10, 100)]


def test_ties_are_as_in_the_batch_form(spark):
    rows = [("p", 0.0, "a", True), ("p", 50.0, "b", True), ("p", 50.0, "c", False), ("p", 60.0, "d", True)]
    frame = spark.createDataFrame(rows, "pod STRING, ts DOUBLE, note STRING, holds BOOLEAN")
    want = metrics.alert_for(frame, ["pod"], F.col("holds"), 10.0).select("pod", "ts", "note", "active_since").collect()
    for some in (rows, rows[::-1]):
        assert wake(*held(some), 99_000) == sorted((tuple(r) for r in want), key=str) == [("p", 60.0, "d", 50.0)]


def test_keys_and_columns_of_any_type(spark, tmp_path):
    schema = "a DOUBLE, b STRING, ts DOUBLE, n BIGINT, day TIMESTAMP, price DECIMAL(20, 4), more STRUCT<x: INT, y: ARRAY<STRING>>, v DOUBLE"
    days = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    keys = [(float("nan"), None), (None, None), (None, "None"), (1.5, "x"), (1.5, "y")]
    rows = [
        (a, b, 1000.0 + t, None if t % 20 else 2**60 + t, days if t % 40 else None, decimal.Decimal(t) / 16, (None, ["q", None]) if t % 30 else None, float("nan") if t == 70 else None if t == 80 else 3.0)
        for a, b in keys for t in range(0, 200, 10)
    ]
    frame = spark.createDataFrame(rows, schema)
    frame.repartition(3).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(None, "end", 9e5, None, None, None, None, 0.0)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    alerts.stream_alerts(source, ["a", "b"], F.col("v") > 1, 30.0, "2 days", f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    shown = lambda df: sorted(map(str, df.select(*frame.columns, "active_since").collect()))
    got = shown(spark.read.parquet(f"{tmp_path}/out"))
    assert got == shown(metrics.alert_for(frame, ["a", "b"], F.col("v") > 1, 30.0)) and len(got) > 50
