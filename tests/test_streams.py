"""Streams that get several events of a build, batches out of order and batches again; stored spec versions; rejects."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cistern.functions.columns import mandatory_text, one_per, text_matches
from cistern.operators import dims
from cistern.sources import readers, writers
from cistern.streaming import streams


def test_substring_shortcut_of_generated_patterns(spark):
    draw = random.Random(3)
    atoms = ["a", "b", "foo", r"\.", ".", "[ab]", r"\s", "-", "b+", "a{2}", "o?", "a*", "^", "$", r"\+", "[^a]+", r"\d"]
    patterns = {"".join(draw.choice(atoms) for _ in range(draw.randint(1, 5))) for _ in range(150)}
    patterns = sorted(p for p in patterns if _compiles(p)) + ["abcdefb+", r"foofoo\.bar", r"ab\x41c"]
    texts = ["".join(draw.choice(["a", "b", "foo", ".", "-", " ", "+", "1", "o"]) for _ in range(draw.randint(0, 9))) for _ in range(120)]
    texts += ["abcdef", "abcdefbb", "foofoo.bar", "foofooxbar", "abAc"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for i in range(0, len(patterns), 40):
        part = patterns[i : i + 40]
        rows = df.select("t", *[text_matches("t", p).alias(f"c{k}") for k, p in enumerate(part)]).collect()
        for r in rows:
            for k, p in enumerate(part):
                assert r[f"c{k}"] == (re.search(p, r.t) is not None), (p, r.t, mandatory_text(p))


def _compiles(p):
    try:
        re.compile(p)
    except re.error:
        return False
    return not re.search(r"[\^$][*+?{]|[*+?}][*+?{]", p)


def test_one_row_per_key_whatever_the_order(spark):
    rows = [(1, "b", 2.0), (1, "a", 3.0), (1, "a", 1.0), (2, None, None)]
    for k in range(3):
        df = spark.createDataFrame(rows[k:] + rows[:k], "k INT, s STRING, v DOUBLE").repartition(3)
        assert sorted(map(tuple, one_per(df, ["k"]).collect())) == [(1, "a", 1.0), (2, None, None)]


def spec_rows(spark, *rows):
    return spark.createDataFrame([(h, "p", v, c, cv, "x86", "") for h, v, c, cv in rows], "hash STRING, name STRING, version STRING, compiler_name STRING, compiler_version STRING, arch STRING, variants STRING")


def test_stored_specs_keep_their_first_values(spark, tmp_path):
    path = str(tmp_path)
    for rows in ([("h", "1", "gcc", "12"), ("e", "1", "", "")], [("h", "2", "gcc", "13"), ("e", "1", "gcc", "9")], [("h", "2", "gcc", "13")]):
        writers.write_warehouse({"dim_package_spec": spec_rows(spark, *rows)}, {}, path)
    got = {r["hash"]: (r["version"], r["compiler_version"]) for r in writers.read_table(spark, path, "dim_package_spec").collect()}
    assert got == {"h": ("1", "12"), "e": ("1", "9")}


def stored(spark, path):
    spark.createDataFrame([(1, "own", "20240101", "000000", "r")], "job_id BIGINT, spec_hash STRING, start_date_key STRING, start_time_key STRING, job_result_id STRING").write.parquet(f"{path}/fact_job")
    spark.createDataFrame([("r", "success", "build")], "job_result_id STRING, status STRING, job_type STRING").write.parquet(f"{path}/dim_job_result")
    writers.write_warehouse({"dim_package": spark.createDataFrame([("p",)], "name STRING"), "dim_package_spec": spec_rows(spark, ("own", "1", "gcc", "12"))}, {}, path)


TIMING = "job_id BIGINT, name STRING, hash STRING, cache BOOLEAN, total DOUBLE, phases ARRAY<STRUCT<path STRING, seconds DOUBLE>>"


def test_early_timings_and_those_of_dependencies_are_kept(spark, tmp_path):
    path, source, nodes_path = str(tmp_path / "w"), str(tmp_path / "in"), str(tmp_path / "nodes")
    rows = [(1, "p", "own", False, 4.0, [("build", 3.0)]), (1, "dep", "d", True, 2.0, [("build", 1.0)]), (9, "p", "own", True, 1.0, [])]
    df = spark.createDataFrame(rows, TIMING)
    nodes = spec_rows(spark, ("d", "1", "gcc", "12")).withColumns({"job_id": F.lit(1).cast("long"), "name": F.lit("dep")})
    nodes.write.parquet(nodes_path)
    nodes = spark.read.parquet(nodes_path)

    def run(part):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        streams.stream_timings(stream, path, str(tmp_path / "ckpt"), nodes).awaitTermination()
        fact = writers.read_table(spark, path, "fact_timer")
        return sorted((r["job_id"], r["package"]) for r in fact.collect()) if fact else []

    assert run(df) == []  # before there is a warehouse
    stored(spark, path)
    assert run(df.where("job_id = 1")) == [(1, "dep"), (1, "p")]  # with the same rows once more
    assert run(df.where("job_id = 1")) == [(1, "dep"), (1, "p")]
    assert writers.read_table(spark, path, "dim_timer_phase").count() == 1


def test_finished_event_survives_among_earlier_ones(spark):
    from cistern import schemas
    from cistern.operators import warehouse

    one = '{{"object_kind":"build","build_id":{},"build_status":"{}","build_name":"a"}}'
    lines = [one.format(i, s) for i, s in ((1, "running"), (1, "success"), (2, "pending"), (2, "failed"), (2, "failed"), (3, "running"))]
    df = spark.createDataFrame([(x,) for x in lines], "value STRING").select(F.from_json("value", schemas.BUILD_EVENTS).alias("e")).select("e.*")
    got = one_per(warehouse.flatten_events(df), ["build_id"]).select("build_id", "build_status").collect()
    assert sorted(map(tuple, got)) == [(1, "success"), (2, "failed")]


def test_lost_alert_state_is_an_error(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")

    def run(ts, value):
        spark.createDataFrame([("p", ts, value)], "pod STRING, ts DOUBLE, value DOUBLE").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("pod STRING, ts DOUBLE, value DOUBLE").parquet(source)
        streams.stream_alerts(stream, ["pod"], F.col("value") > 1, 10.0, str(tmp_path / "out"), state, str(tmp_path / "ckpt")).awaitTermination()

    run(0.0, 2.0)
    run(11.0, 2.0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    writers.remove(spark, state)
    with pytest.raises(Exception, match="state of batch"):
        run(12.0, 2.0)


def test_rejects_of_pipeline_variables(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yml").write_text("variables: {}\njob:\n  script: x\n")
    (tmp_path / "b.yml").write_text("a: [" + "x" * 400)
    rejects = readers.pipeline_var_rejects(readers.read_pipeline_vars(spark, str(tmp_path))).collect()
    assert sorted(r["operator"] for r in rejects) == ["job_variables", "read_pipeline_vars"]


def test_spec_nodes_keep_their_first(spark):
    nodes = spec_rows(spark, ("d", "1", "gcc", "12"))
    assert dims.add_spec_nodes(nodes.select("name").limit(0), nodes.limit(0), nodes)[1].count() == 1
