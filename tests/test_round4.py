"""Details of jobs that cross few shuffles, files that only tasks list, timings that are kept once, runs that are read without pairs of rows."""

import bz2
import gzip
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_golden import samples, windows
from test_streams import TIMING, stored
from test_windows import SAMPLE, WINDOWS, job_scrapes, node_scrapes, place, scrapes

from cistern.functions import fixed
from cistern.operators import details, facts, metrics
from cistern.operators import runs as vectors
from cistern.plans import q_metrics, q_sources
from cistern.sources import readers, scratch
from cistern.streaming import streams


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_occupancy_is_worked_out_once_for_shares_and_rejects(spark):
    data = [("a", t, 1) for t in range(0, 9000, 50)] + [("b", t, 1) for t in range(3000, 6000, 50)]
    given = samples(spark, data), windows(spark, (0, 4000), (0, 1000), (3550, 3650), (7150, 7250), (9500, 9600), (50, 50))
    good, rejects = metrics.node_occupancy(*given, parts=100, lookback=60, width=3600)
    assert "Window" not in plan(good) and "Window" not in plan(rejects)
    got = {r["window_id"]: r["node_occupancy"] for r in good.collect()}
    # 40 seconds a point: points 75 to 100 of the first window have two series.
    assert got == {0: pytest.approx((74 + 26 / 2) / 100), 2: 0.5}
    assert sorted(r["key"] for r in rejects.collect()) == ["1", "3", "5"]


def test_presence_shuffles_once(spark):
    rows = samples(spark, [("a", t, 1) for t in range(0, 8000, 70)])
    held = metrics.presence(rows, "node", 300.0, 3600.0)
    text = plan(held)
    assert text.count("Exchange hashpartitioning") == 1
    one = sorted((r["ts"], r["until"], r["closed"]) for r in held.collect())
    assert one == [(0.0, 3640.0, False), (3640.0, 7210.0, False), (7210.0, 8280.0, True)]
    other = metrics.presence(rows, "node", 300.0, 4000.0)
    assert sorted((r["ts"], r["until"]) for r in other.collect()) == [(0.0, 4060.0), (4060.0, 8280.0)]


def test_labels_that_are_not_read_still_make_a_series(spark):
    rows = place("p", "a", 0, 600) + scrapes("kube_pod_info", {"pod": "p", "node": "a", "pod_ip": "10.0.0.2"}, 0, 600) + place("q", "b", 0, 600)
    given = spark.createDataFrame(rows, SAMPLE).withColumn("key", metrics.label("pod"))
    asked = metrics.questions(spark.createDataFrame([(1, "p", 0.0, 500.0), (2, "q", 0.0, 500.0)], WINDOWS), "pod", ["kube_pod_info"])
    got = {r["window_id"]: (r["labels"], r["problem"]) for r in metrics.one_series(given, asked, names=["node"]).collect()}
    assert got == {1: (None, "more than one series"), 2: ({"node": "b"}, None)}


def test_records_are_written_once_and_nothing_else_is_left(spark, tmp_path):
    rows = node_scrapes("a", 0, 2000) + job_scrapes(1, "p", "a", 0, 1200) + job_scrapes(2, "q", "a", 0, 1200)
    rows += scrapes(fixed.PRICE_METRIC, {"capacity_type": "spot", "instance_type": "m1", "zone": "z"}, 0, 2000, 0.5)
    jobs = spark.createDataFrame([(1, "x", "success", True, 0.0, 1200.0), (3, "x", "success", True, 0.0, 10.0)],
                                 "job_id BIGINT, name STRING, status STRING, is_build BOOLEAN, start_ts DOUBLE, end_ts DOUBLE")
    given = {c: "a" for c in (*details.PACKAGE, "stack", "job_size")}
    artifacts = spark.createDataFrame([], f"job_id BIGINT, missing_variable STRING, {', '.join(f'{c} STRING' for c in given)}, build_jobs INT")
    made, put = [], details.stage
    details.stage = lambda df, name: made.append(put(df, name)) or made[-1]
    try:
        records, rejects = details.job_details(spark.createDataFrame(rows, SAMPLE), jobs, artifacts)
    finally:
        details.stage = put
    for out in (records, rejects):
        assert "Exchange" not in plan(out) and "Aggregate" not in plan(out)
    assert [(r["job_id"], r["node_name"], r["pod_node_occupancy"]) for r in records.collect()] == [(1, "a", 0.5)]
    assert [(r["key"], r["reason"]) for r in rejects.collect()] == [("3", "no artifacts")]
    assert [df._scratch is not None for df in made] == [False] * (len(made) - 1) + [True]


NODED = "metric STRING, labels MAP<STRING, STRING>, ts DOUBLE, value DOUBLE, node STRING"


def draws(spark, seed):
    draw = random.Random(seed)
    at = lambda far: draw.randrange(0, far, 5) + draw.choice((0, 0, 0.1, 1 / 3))
    rows = [("cpu", {"pod": f"p{draw.randrange(6)}"}, at(4000), draw.choice((None, 1.5, 2.0)), draw.choice(("m", "n", "n", None))) for _ in range(400)]
    asked = [(i % 50, draw.choice(("m", "n", "o", None)), a, a + draw.choice((0, 7, 90.5, 800, 2500, -20))) for i, a in enumerate(at(5000) for _ in range(60))]
    asked += [(None, "n", 100.0, 900.0), (None, "n", 100.0, 900.0), (99, "n", None, 9.0), (98, "n", 9.0, None)]
    window = "window_id INT, node STRING, start_ts DOUBLE, end_ts DOUBLE"
    asked = [(w, n, a if a is None else float(a), b if b is None else float(b)) for w, n, a, b in asked]
    return spark.createDataFrame([(m, k, float(t), v, n) for m, k, t, v, n in rows], NODED), spark.createDataFrame(asked, window)


@pytest.mark.parametrize("lookback, width", [(60, 500), (900, 333), (900, 100_000)])
def test_rows_by_window_are_the_runs(spark, lookback, width):
    given = *draws(spark, lookback + width), "node"
    want = metrics.range_sample(*given, parts=10, lookback=lookback, width=width, runs=True)
    read = metrics.range_sample(*given, parts=10, lookback=lookback, width=width, by_window=True)
    each = read.select("window_id", "node", "start_ts", "step", "series", F.inline("runs").alias("place", "first", "last", "value"))
    at = lambda k: F.col("start_ts") + F.col(k) * F.col("step")
    each = each.select("window_id", "node", F.get("series", F.col("place")).alias("series"), "step", at("first").alias("ts"), "value",
                       at("last").alias("last_ts"), (F.col("last") - F.col("first") + 1).alias("points"))
    rows = lambda df: sorted((tuple(r) for r in df.select(*each.columns).collect()), key=repr)
    assert want.count() > 100 and rows(each) == rows(want)
    assert all(len(set(r["series"])) == len(r["series"]) == len({x["series"] for x in r["runs"]}) for r in read.collect())


def test_totals_of_ids_that_repeat(spark):
    given = *draws(spark, 8), "node"
    runs = metrics.range_sample(*given, parts=10, lookback=300, width=500, runs=True)
    want = runs.groupBy("window_id").agg(
        F.sum("points"), F.count_distinct("series"), F.round(F.sum(F.col("value") * F.col("points")), 2),
        F.round(F.min("ts"), 3), F.round(F.max("last_ts"), 3))
    read = metrics.range_sample(*given, parts=10, lookback=300, width=500, by_window=True)
    repeated = given[1].groupBy("window_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    got = q_metrics.totals(read, repeated)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert repeated.count() > 5 and rows(got) == rows(want)


def test_runs_do_not_depend_on_batches(monkeypatch):
    draw = random.Random(4)
    names = ["node", "_group", "is_window", "window_id", "series", "at", "until", "closed", "value"]
    rows = []
    for node, group in (("a", 0), ("a", 1), ("b", 1)):
        spans = [(float(t), float(t + draw.randrange(1, 60))) for t in draw.sample(range(600), 80)]
        rows += [(node, group, False, None, f"s{draw.randrange(9)}", a, b, draw.random() < 0.5, a) for a, b in spans]
        rows += [(node, group, True, i, None, float(t), float(t + 150), None, None) for i, t in enumerate(range(0, 700, 20))]
    rows.insert(0, ("0", 0, True, 7, None, 0.0, 9.0, None, None))  # a group without spans
    whole = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema([
        ("node", pa.string()), ("_group", pa.int64()), ("is_window", pa.bool_()), ("window_id", pa.int64()), ("series", pa.string()),
        ("at", pa.float64()), ("until", pa.float64()), ("closed", pa.bool_()), ("value", pa.float64())]))
    read = lambda batches: [r for b in vectors.reader("node", 10)(batches) for r in b.to_pylist()]
    want = read([whole])
    assert len(want) > 60 and {r["node"] for r in want} == {"a", "b"}
    for pairs, cells, size in ((1, 1 << 20, 1000), (40, 1 << 20, 7), (1 << 18, 20, 1)):
        monkeypatch.setattr(vectors, "PAIRS", pairs)
        monkeypatch.setattr(vectors, "CELLS", cells)
        assert read([whole.slice(i, size) for i in range(0, len(rows), size)]) == want


def test_traces_are_listed_and_read_by_tasks_as_spark_reads_them(spark, tmp_path):
    top = tmp_path / "a b%c+\u00e9"
    files = {
        "1.log": b"one\ntwo", "job=2/part-0.txt": b"\xff\xfe bad \xc3", "job=3/_x/9.log": b"no", "job=4/_k=v/10.log": "d\u00e9j\u00e0\r\n".encode(),
        "job=5/.hid": b"no", "_SUCCESS": b"no", "x/y/z/11.log": b"\0deep", "x/12.log": b"", "13.log._COPYING_": b"no", "13.log": b"",
        "x/14.log.gz": gzip.compress(b"packed") + gzip.compress(b" twice"), "15.bz2": bz2.compress(b"more"), "q?[1]#/16.log": b"odd", "_metadata": b"meta",
        "big.log": b"x" * 9_000_000,
    }
    for name, content in files.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(content)
    (tmp_path / "empty").mkdir()
    for job_id in (readers.FILE_STEM, r"job=([0-9]+)/", r"b%25c(.)"):
        text = spark.read.text(str(top), wholetext=True, recursiveFileLookup=True)
        want = text.select(readers.from_path(job_id).try_cast("bigint").alias("job_id"), F.col("value").alias("trace"))
        for path in (f"{top}", f"{top}/", f"file:{top}"):
            got = readers.read_job_traces(spark, path, job_id)
            assert got.schema == want.schema
            rows = lambda df: sorted((r.job_id or 0, r.h, r.m, r.n) for r in df.select(
                "job_id", F.substring(F.hex("trace"), 1, 50).alias("h"), F.md5("trace").alias("m"), F.length("trace").alias("n")).collect())
            assert len(rows(got)) == 8 and rows(got) == rows(want)
    # No index of files is held by the driver: the plan scans none.
    assert got.inputFiles() == [] and "Scan text" not in plan(got)
    assert readers.read_job_traces(spark, f"{tmp_path}/empty").count() == 0
    assert [r.trace for r in readers.read_job_traces(spark, f"{tmp_path}/a*/j*/*.txt", r"job=([0-9]+)/").collect()]


def test_timings_meet_their_jobs_in_one_join(spark):
    jobs = spark.createDataFrame(
        [(1, "success", "build", "h", "20240101", "010203"), (2, "failed", "build", "h", "20240101", "010203"), (3, "success", None, "h", "20240101", "1"),
         (4, "success", "build", None, "20240102", "1"), (5, "success", "build", "h", "20240101", "1"), (None, "success", "build", "h", "20240101", "1")],
        "job_id LONG, status STRING, job_type STRING, spec_hash STRING, start_date_key STRING, start_time_key STRING")
    rows = [(j, "p", h, c, 1.0, [("build", 1.0)]) for j in (1, 2, 3, 4, 5, 9, None) for h in ("h", "g", None) for c in (True, False, None)]
    timings = spark.createDataFrame(rows + rows[:9], TIMING)
    both = facts.select_timings(timings, jobs, unknown=True)
    listed = lambda df: sorted(map(tuple, df.collect()), key=repr)
    chosen = facts.select_timings(timings, jobs)
    assert listed(both.where("known").drop("known")) == listed(chosen) and chosen.columns == [*timings.columns, "date_key", "time_key"]
    rest = both.where("NOT known").select(*timings.columns)
    assert listed(rest) == listed(timings.join(jobs, "job_id", "left_anti")) and rest.count() == 18
    want = [r for r in rows + rows[:9] if r[0] in (1, 4, 5) and (r[3] or (r[0] != 4 and r[2] == "h"))]
    assert sorted((r[:4] for r in listed(chosen)), key=repr) == sorted((r[:4] for r in want), key=repr)


def test_waiting_timings_are_read_from_what_was_written(spark, tmp_path):
    path = f"{tmp_path}/w"
    stored(spark, path)
    rows = [(1, "p", "own", False, 4.0, [("build", 3.0)]), (1, "zz", "own", True, 4.0, []), (9, "p", "own", True, 1.0, [])]
    chosen, rest = streams._stored_timings(spark.createDataFrame(rows, TIMING), None, path)
    try:
        assert sorted((r["job_id"], r["name"]) for r in rest.collect()) == [(1, "zz"), (9, "p")]
        assert "(job_id" not in plan(rest)  # the timings met their jobs before
        written = rest._scratch
        assert os.path.isdir(written)
        scratch.discard(rest)
        assert not os.path.exists(written)
    finally:
        chosen.unpersist()


def test_events_are_packed_files(spark):
    path = q_sources.write_events(spark, "/root/testdata/sf0.001")
    assert all(f.endswith(".json.gz") for f in os.listdir(path) if f.startswith("part"))
    want = q_sources.event_rows(spark, "/root/testdata/sf0.001")
    got = readers.read_job_events(spark, path)
    assert got.count() == want.count() and got.agg(F.sum("build_id")).first() == want.agg(F.sum("build_id")).first()
