"""Work that is done once: runs of points, rows of repeated keys, tables and batches that are read again."""

import random

from pyspark.sql import functions as F
from test_golden import samples, windows
from test_streams import TIMING, stored
from test_versions import days, names

from cistern import schemas
from cistern.operators import facts, metrics
from cistern.plans import q_sources
from cistern.sources import writers
from cistern.streaming import streams


def test_runs_of_points_are_the_points(spark):
    draw = random.Random(3)
    data = [(f"p{draw.randrange(4)}", draw.randrange(0, 4000, 5), i) for i in range(250)]
    spans = [(a, a + draw.randrange(0, 2500, 5)) for a in draw.sample(range(0, 4000, 5), 30)] + [(50, 50), (90, 40)]
    given = samples(spark, data), windows(spark, *spans), "node"
    points = metrics.range_sample(*given, parts=10, lookback=60, width=500)
    runs = metrics.range_sample(*given, parts=10, lookback=60, width=500, runs=True)
    each = runs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("points") - 1)))
    each = each.withColumn("at", F.col("ts") + F.col("i") * F.col("step"))
    rows = lambda df, at: sorted(map(tuple, df.select("window_id", "series", "step", at, "value").collect()))
    want = rows(points, "ts")
    assert want and rows(each, "at") == want
    assert runs.count() < len(want)
    assert runs.where(F.col("ts") + (F.col("points") - 1) * F.col("step") != F.col("last_ts")).isEmpty()


def test_only_rows_of_repeated_keys_are_gathered(spark, tmp_path):
    def staged(name, *rows):
        spark.createDataFrame(rows, "k LONG, a STRING, b INT").write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    def fresh(rows):
        return facts.new_facts(rows, ["k"], None, facts.repeated_facts(rows, ["k"]))

    rows = staged("odd", (1, "x", 2), (1, "x", 1), (1, "y", 0), (2, None, 5), (None, "b", 1), (None, "a", 9), (3, "z", None), (3, "z", None))
    got = sorted(map(tuple, fresh(rows).collect()), key=repr)
    assert got == sorted(map(tuple, facts.new_facts(rows, ["k"], None).collect()), key=repr)
    assert got == sorted([(1, "x", 1), (2, None, 5), (None, "a", 9), (3, "z", None)], key=repr)
    once = fresh(staged("once", (1, "x", 2), (2, "y", 1), (None, "z", 0)))
    assert len(once.collect()) == 3
    final = once._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning" not in final and "SortAggregate" not in final


def test_tables_that_are_written_twice_are_computed_once(spark, monkeypatch):
    tables, rows = {"dim_package": names(spark, "a", "b")}, {"fact_job": days(spark, (1, "20240101", 1))}
    given, write = [], writers.write_warehouse
    monkeypatch.setattr(q_sources, "_warehouse", lambda *_: (tables, rows))
    monkeypatch.setattr(writers, "write_warehouse", lambda d, f, path: (given.extend([*d.values(), *f.values()]), write(d, f, path))[1])
    out = q_sources.write_warehouse(spark, "")
    assert sorted(map(tuple, out.collect())) == [("dim_package", 2), ("fact_job", 1)]
    assert len(given) == 4 and all(hasattr(df, "_scratch") for df in given)


def test_finished_builds_of_a_batch_are_kept(spark, tmp_path):
    one = '{"object_kind":"build","build_id":1,"build_status":"success","build_name":"a"}'
    spark.createDataFrame([(one,)], "value STRING").write.text(f"{tmp_path}/in")
    kept = []

    def enrich(jobs):
        kept.append(jobs.is_cached)
        raise RuntimeError("seen")

    source = spark.readStream.schema(schemas.BUILD_EVENTS).json(f"{tmp_path}/in")
    run = streams.stream_jobs(source, f"{tmp_path}/w", f"{tmp_path}/ckpt", enrich, None, job_url_prefix="x/")
    try:
        run.awaitTermination()
    except Exception as error:
        assert "seen" in str(error)
    assert kept == [True]


def test_chosen_timings_are_kept(spark, tmp_path):
    path = f"{tmp_path}/w"
    stored(spark, path)
    rows = [(1, "p", "own", False, 4.0, [("build", 3.0)]), (9, "p", "own", True, 1.0, [])]
    chosen, rest = streams._stored_timings(spark.createDataFrame(rows, TIMING), None, path)
    try:
        assert chosen.is_cached and [r["job_id"] for r in chosen.collect()] == [1]
        assert [r["job_id"] for r in rest.collect()] == [9]
    finally:
        chosen.unpersist()
