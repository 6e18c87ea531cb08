"""Warehouse tables that become visible together, whatever becomes of a run."""

import threading

import pytest
from pyspark.sql import functions as F

from cistern.sources import versions, writers

FACT = "job_id BIGINT, start_date_key STRING, v INT"


def days(spark, *rows):
    return spark.createDataFrame(rows, FACT)


def names(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "name STRING")


def read(spark, path, name, *cols):
    df = writers.read_table(spark, path, name)
    return None if df is None else sorted(map(tuple, df.select(*cols).collect()))


def test_a_killed_run_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "w")
    writers.write_warehouse({"dim_package": names(spark, "a")}, {"fact_job": days(spark, (1, "20240101", 1))}, path)
    broken = days(spark, (2, "20240102", 2)).withColumn("v", F.raise_error(F.lit("killed")).cast("int"))
    with pytest.raises(Exception, match="killed"):
        writers.write_warehouse({"dim_package": names(spark, "a", "b")}, {"fact_job": broken}, path)
    assert read(spark, path, "dim_package", "name") == [("a",)] and read(spark, path, "fact_job", "job_id") == [(1,)]
    # Run again, it adds what is missing; once more, nothing.
    rows = days(spark, (2, "20240102", 2), (1, "20240101", 1))
    for _ in range(2):
        writers.write_warehouse({"dim_package": names(spark, "a", "b")}, {"fact_job": rows}, path)
        assert read(spark, path, "dim_package", "name") == [("a",), ("b",)] and read(spark, path, "fact_job", "job_id") == [(1,), (2,)]
    gone = versions.vacuum(spark, path)
    assert gone and read(spark, path, "dim_package", "name") == [("a",), ("b",)] and len(versions.numbers(spark, path)) == 2


def test_small_folders_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "COMPACT", 4)
    path = str(tmp_path)
    for k in range(9):
        writers.write_warehouse({}, {"fact_job": days(spark, (k, f"2024010{k % 3}", k))}, path)
    number, tables = versions.latest(spark, path)
    assert number == 9 and len(tables["fact_job"]) < 4
    assert read(spark, path, "fact_job", "job_id") == [(k,) for k in range(9)]


def test_runs_that_commit_at_the_same_time(spark, tmp_path):
    path = str(tmp_path)
    errors = []

    def run(k):
        try:
            writers.write_warehouse({"dim_package": names(spark, "a", f"p{k}")}, {}, path)
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and versions.latest(spark, path)[0] == 3
    assert read(spark, path, "dim_package", "name") == [("a",), ("p0",), ("p1",), ("p2",)]


def test_a_number_is_taken_once(spark, tmp_path):
    path = str(tmp_path)
    versions.commit(spark, path, 1, {"t": ["x"]})
    with pytest.raises(versions.Taken):
        versions.commit(spark, path, 1, {"t": ["y"]})
    assert versions.latest(spark, path) == (1, {"t": ["x"]})


def test_only_touched_days_are_read(spark, tmp_path):
    path = str(tmp_path)
    writers.write_warehouse({}, {"fact_job": days(spark, *[(k, f"202401{k:02d}", k) for k in range(1, 29)])}, path)
    plan = writers._fresh(spark, path, "fact_job", days(spark, (3, "20240103", 3), (40, "20240104", 4)), writers._latest(spark, path))
    assert sorted(r["job_id"] for r in plan.collect()) == [40]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "start_date_key" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_plain_folders_are_taken_over(spark, tmp_path):
    path = str(tmp_path)
    names(spark, "old").write.parquet(f"{path}/dim_package")
    days(spark, (1, "20240101", 1)).write.partitionBy("start_date_key").parquet(f"{path}/fact_job")
    writers.write_warehouse({"dim_package": names(spark, "old", "new")}, {}, path)
    assert read(spark, path, "dim_package", "name") == [("new",), ("old",)] and read(spark, path, "fact_job", "job_id") == [(1,)]


def test_a_filter_on_dates_reads_only_its_days(spark, tmp_path):
    from cistern.operators import facts

    path = str(tmp_path)
    rows = [(k, f"202401{k:02d}", k) for k in range(1, 29)]
    dates = spark.createDataFrame([(f"202401{k:02d}", k) for k in range(1, 29)], "date_key STRING, day INT")
    writers.write_warehouse({"dim_date": dates}, {"fact_job": days(spark, *rows)}, path)
    joined = facts.star_join(writers.read_table(spark, path, "fact_job"), {"dim_date": writers.read_table(spark, path, "dim_date")})
    one = joined.where("date_day = 7").select("job_id", "start_date_key")
    assert [tuple(r) for r in one.collect()] == [(7, "20240107")]
    assert "dynamicpruning" in joined.where("date_day = 7").join(spark.range(1)).select("job_id")._jdf.queryExecution().optimizedPlan().toString() or "dynamicpruning" in one._jdf.queryExecution().optimizedPlan().toString()
