"""Plans and layouts that keep memory, shuffles and passes in step with the input."""

import uuid
from contextlib import redirect_stdout
from datetime import datetime
from io import StringIO

import pandas as pd
from pyspark.sql import functions as F

from cistern.functions import fixed
from cistern.operators import buildcache, metrics, pipelines
from cistern.plans import q_details, q_sources
from cistern.sources import readers


def plan(df) -> str:
    out = StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def _manifests(spark):
    blob = "checksumAlgorithm STRING, checksum STRING, mediaType STRING"
    tail = "/v3/manifests/spec/p/p-1-h{}.spec.manifest.json"

    def data(spec, tar):
        return [("sha256", spec, fixed.SPEC_MEDIA_TYPE), ("sha256", tar, fixed.TARBALL_MEDIA_TYPE)]

    rows = [
        ("develop/s1" + tail.format(1), data("aa1", "bb1")),
        ("develop/s1" + tail.format(1), data("aa1", "bb1")),
        ("x/develop/s2" + tail.format(1), data("aa2", "bb2")),
        ("develop/s1" + tail.format(2), data(None, "bb2")),
        ("develop/s1" + tail.format(3), data("aa3", "bb3")),
        ("develop" + tail.format(3), data("aa3", "bb3")),
    ]
    return spark.createDataFrame(rows, f"key STRING, data ARRAY<STRUCT<{blob}>>")


def test_missing_by_hash_shuffles_rows_as_read(spark):
    missing = buildcache.missing_by_hash(_manifests(spark), "develop")
    got = {tuple(r) for r in buildcache.entries_of(missing).collect()}
    tail = "/v3/manifests/spec/p/p-1-h1.spec.manifest.json"
    assert got == {
        ("h1", p.rsplit("/", 1)[1], f"{p}/blobs/sha256/aa/aa{i}", f"{p}/blobs/sha256/bb/bb{i}", p + tail)
        for i, p in ((1, "develop/s1"), (2, "x/develop/s2"))
    }
    # Nothing is gathered, and so sorted, before the shuffle.
    text = plan(missing)
    assert text.count("Exchange") == 1
    assert "Aggregate" not in text.split("Exchange")[1]


def test_migration_plan_reads_several_mirrors_at_once(spark):
    old = "/build_cache/linux-h1"
    keys = [f"{p}{old}{s}" for p in ("develop", "develop/s1") for s in fixed.V2_SUFFIXES]
    catalog = buildcache.catalog_v2(spark.createDataFrame([(k, 5) for k in keys], "key STRING, size BIGINT"))
    done = [("develop/s1/v3/manifests/spec/p/p-1-h1.spec.manifest.json", 1)]
    listing = spark.createDataFrame(done, "key STRING, size BIGINT")
    specs = spark.createDataFrame(
        [("h1", "sha256", "aa1", "p", "1", "h1", 3, "bb1")],
        "hash STRING, hash_algorithm STRING, checksum STRING, name STRING, version STRING, "
        "spec_hash STRING, meta_size BIGINT, meta_checksum STRING",
    )
    got = buildcache.migration_plan(catalog, listing, specs, None)
    assert {(r.prefix, r.skip_reason, r.archive_path) for r in got.collect()} == {
        ("develop", None, "develop/blobs/sha256/aa/aa1"),
        ("develop/s1", "previously migrated", None),
    }


def test_documents_are_written_by_as_many_tasks_as_shuffles_have(spark, tmp_path):
    rows = spark.range(600).selectExpr(
        "case when id < 597 then cast(id % 199 as string) when id = 597 then 'a/b' when id = 598 then '' "
        "end as doc", "-id as ord", "if(id = 3, null, cast(id as string)) as value",
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    tasks = spark.sparkContext.defaultParallelism + 5
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        put = q_sources.write_files
        q_sources.write_files = lambda folder, by, part: open(
            f"{folder}/.task-{uuid.uuid4().hex}", "w").close() or put(folder, by, part)
        path = q_sources.write_documents(rows, "doc", f"{tmp_path}/docs")
    finally:
        q_sources.write_files = put
        spark.conf.set("spark.sql.shuffle.partitions", before)
    seen = [p for p in (tmp_path / "docs").iterdir() if p.name.startswith(".task-")]
    assert len(seen) == tasks
    text = {r.job_id: r.trace for r in readers.read_job_traces(spark, path, r"doc=([0-9]+)/").collect()}
    assert len(text) == 200 and text[3] == "401\n202\n\n" and text[1] == "399\n200\n1\n"
    assert (tmp_path / "docs" / "doc=a%2Fb" / "part-0.txt").read_text() == "597\n"


def test_classify_prs_gathers_checks_without_sorts(spark):
    day = datetime(2024, 1, 2)
    cols = ("number BIGINT, draft BOOLEAN, updated_at TIMESTAMP_NTZ, head_ref STRING, head_sha STRING, "
            "base_ref STRING, base_sha STRING, merge_base_sha STRING, repo_head_sha STRING, "
            "merge_conflict BOOLEAN, merge_commit_sha STRING")
    prs = spark.createDataFrame(
        [(n, False, day, "f", f"head{n}", "main", "b", "m", "other" if n == 4 else f"head{n}", False, "c")
         for n in range(1, 6)], cols)
    checks = spark.createDataFrame(
        [(f"head{n}", c, "failure" if (n, c) == (1, "style") else "success", 1)
         for n in range(1, 6) for c in ("style", "build") if (n, c) != (2, "build")],
        "head_sha STRING, name STRING, conclusion STRING, pos BIGINT")
    labels = spark.createDataFrame([(n, "ci") for n in (1, 2, 4, 5)], "number BIGINT, label STRING")
    heads = spark.createDataFrame([("pr9_f", "t")], "pr_string STRING, title STRING")
    reach = spark.createDataFrame([("m",)], "commit STRING")
    out, bad = pipelines.classify_prs(
        prs, checks, labels, heads, reach, day, ["style", "build"], "ci", "main")
    assert {r.number: r.backlogged for r in out.collect()} == {
        1: "waiting for style check to succeed", 2: "waiting for build check to succeed",
        3: fixed.LABEL_REASON, 4: "GitHub HEAD shas out of sync (repo=other, API=head4)", 5: None,
    }
    assert bad.count() == 0
    # The checks are gathered without sorts.
    text = plan(out)
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_pipeline_vars_are_given_on_while_a_file_is_read():
    class Files:  # what the reader asks of a session, to get at its function over batches
        read = property(lambda self: self)
        format = load = select = lambda self, *_: self
        mapInPandas = lambda self, parse, schema: parse

    parse = readers.read_pipeline_vars(Files(), "")
    jobs = "".join(f'"j{i}":\n  variables: {{A: "{i}"}}\n' for i in range(12_000))
    texts = [jobs + "variables: {S: last}\n", "j: {variables: {A: 1}}\nk: [1\n", "j: {}\nj: {variables: {A: 2}}\n"]
    batch = pd.DataFrame({"path": list("abc"), "content": [t.encode() for t in texts]})
    parts = list(parse([batch]))
    assert max(map(len, parts)) <= readers.PARSED_ROWS
    rows = pd.concat(parts)
    a = rows[rows.path == "a"]
    assert len(a) == 12_000 and all(v == {"S": "last"} for v in a.pipeline_variables)
    assert a.variables.iloc[-1] == {"A": "11999"}
    b = rows[rows.path == "b"]
    assert list(b.job_name) == [None] and "did not find expected" in b.problem.iloc[0]
    assert list(rows[rows.path == "c"].variables) == [{"A": "2"}]


def test_spot_price_sorts_sums_and_joins_in_stages_of_their_own(spark):
    kind = {"capacity_type": "spot", "instance_type": "m1", "zone": "z"}
    samples = spark.createDataFrame(
        [(fixed.PRICE_METRIC, kind, float(ts), v) for ts, v in ((0, 1.0), (10, 2.0), (10, 4.0), (35, 8.0), (47, 16.0))]
        + [(fixed.PRICE_METRIC, {**kind, "zone": "y"}, 20.0, 100.0)],
        "metric STRING, labels MAP<STRING, STRING>, ts DOUBLE, value DOUBLE")
    asked = spark.createDataFrame(
        [(w, "spot", "m1", z, float(a), float(b)) for w, z, a, b in (
            (1, "z", 0, 10), (2, "z", 10, 47), (2, "z", 10, 47), (3, "z", 11, 34), (4, "y", 0, 50), (5, "x", 0, 50),
            (None, "z", 0, 50), (6, None, 0, 50))],
        "window_id BIGINT, capacity_type STRING, instance_type STRING, zone STRING, start_ts DOUBLE, end_ts DOUBLE")
    out = metrics.spot_price(samples, asked, width=20.0)
    got = sorted(((r.window_id, r.zone, r.spot_price) for r in out.collect()), key=str)
    assert got == sorted([(1, "z", 7 / 3), (2, "z", 7.5), (2, "z", 7.5), (3, "z", None), (4, "y", 100.0), (5, "x", None),
                          (None, "z", None), (6, None, None)], key=str)
    # What is left to do at the end is the join: no sums or running sums share its tasks.
    text = plan(out)
    assert "Window" not in text and "HashAggregate" not in text and "BroadcastHashJoin" not in text


def test_windows_ask_for_the_kinds_they_need_once(spark):
    sf = "/root/testdata/sf0.001"
    samples = q_details.metric_samples(spark, sf)
    one = plan(metrics.select_series(samples, "kube_pod_info"))
    assert "Generate" not in one and "Union" not in one
    assert {r["metric"] for r in samples.select("metric").distinct().collect()} >= {"kube_pod_info", fixed.PRICE_METRIC}
    windows = q_details.job_windows(spark, sf).withColumnRenamed("job_id", "window_id")
    # Windows and rejects are read from what was found once.
    for out in metrics.pod_node(samples, windows):
        assert "Window" not in plan(out) and "Aggregate" not in plan(out)
