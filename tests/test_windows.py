"""Labels, nodes, limits and whole records of jobs by what is valid in their window."""

import pytest
from pyspark.sql import functions as F

from cistern.functions import fixed
from cistern.operators import buildcache, details, dims, logs, metrics
from cistern.sources import readers

SAMPLE = "metric STRING, labels MAP<STRING, STRING>, ts DOUBLE, value DOUBLE"
NODE = {
    "label_karpenter_sh_initialized": "true", "label_topology_ebs_csi_aws_com_zone": "z",
    fixed.NODE_LABELS["cpu"]: "4", fixed.NODE_LABELS["memory"]: "1000",
    fixed.NODE_LABELS["capacity_type"]: "spot", fixed.NODE_LABELS["instance_type"]: "m1", fixed.NODE_LABELS["zone"]: "z",
}


def scrapes(metric, labels, start, end, value=1.0, every=60):
    return [(metric, labels, float(t), float(value) if not callable(value) else value(t)) for t in range(start, end + 1, every)]


def node_scrapes(node, start, end, uuid=None):
    return scrapes("kube_node_info", {"node": node, "system_uuid": uuid or f"uuid-{node}"}, start, end) + scrapes("kube_node_labels", {"node": node, **NODE}, start, end)


def place(pod, node, start, end):
    return scrapes("kube_pod_info", {"pod": pod, "node": node, "pod_ip": "10.0.0.1"}, start, end)


WINDOWS = "window_id BIGINT, pod STRING, start_ts DOUBLE, end_ts DOUBLE"


def test_a_pod_name_used_again_gives_each_job_its_own_node(spark):
    rows = place("p", "a", 0, 1000) + place("p", "b", 5000, 6000) + node_scrapes("a", 0, 9000) + node_scrapes("b", 0, 9000)
    rows += node_scrapes("c", 0, 3000, "one") + node_scrapes("c", 3600, 9000, "two") + place("q", "c", 0, 9000)
    rows += place("r", "a", 0, 600) + place("r", "b", 300, 900) + place("s", "ghost", 0, 900)
    windows = [(1, "p", 100.0, 900.0), (2, "p", 5100.0, 5900.0), (3, "p", 100.0, 5900.0), (4, "q", 0.0, 2000.0), (5, "q", 4000.0, 8000.0),
               (6, "q", 2000.0, 8000.0), (7, "r", 0.0, 600.0), (8, "nobody", 0.0, 10.0), (9, "p", 2500.0, 3000.0), (10, "s", 0.0, 600.0)]
    good, rejects = metrics.pod_node(spark.createDataFrame(rows, SAMPLE), spark.createDataFrame(windows, WINDOWS))
    got = {r["window_id"]: (r["node"], r["system_uuid"], r["cpu"], r["memory"]) for r in good.collect()}
    assert got == {1: ("a", "uuid-a", 4, 10**9), 2: ("b", "uuid-b", 4, 10**9), 4: ("c", "one", 4, 10**9), 5: ("c", "two", 4, 10**9)}
    assert {r["key"]: r["reason"] for r in rejects.collect()} == {
        "3": "kube_pod_info: more than one series", "6": "kube_node_info: more than one series", "7": "kube_pod_info: more than one series",
        "8": "kube_pod_info: no series", "9": "kube_pod_info: no series", "10": "kube_node_info: no series",
    }


def test_windows_meet_series_at_their_grid_points_only(spark):
    # One sample at 1000 holds up to 1300; grid points of the window are 200 apart.
    rows = place("p", "a", 1000, 1000)
    asked = lambda start: spark.createDataFrame([(1, "p", start, start + 2000)], WINDOWS)
    samples = spark.createDataFrame(rows, SAMPLE).withColumn("key", metrics.label("pod"))
    for start, found in ((-900.0, True), (1299.0, True), (1300.0, True), (1301.0, False), (-1001.0, False), (-1000.0, True)):
        out = metrics.one_series(samples, metrics.questions(asked(start), "pod", ["kube_pod_info"]))
        assert (out.first()["problem"] is None) is found, start


def test_limits_of_the_window(spark):
    build = {"container": "build", "pod": "p"}
    rows = scrapes("kube_pod_container_resource_requests", {**build, "resource": "cpu"}, 0, 600, 2.0)
    rows += scrapes("kube_pod_container_resource_requests", {**build, "resource": "cpu"}, 5000, 6000, 3.0)
    rows += scrapes("kube_pod_container_resource_limits", {**build, "resource": "memory"}, 5000, 6000, lambda t: float(t))
    rows += scrapes("kube_pod_container_resource_limits", {**build, "container": "helper", "resource": "cpu"}, 0, 6000, 9.0)
    windows = spark.createDataFrame([(1, "p", 0.0, 500.0), (2, "p", 5050.0, 5900.0), (3, "p", 2000.0, 2100.0)], WINDOWS)
    got = {r["window_id"]: tuple(r)[2:] for r in metrics.pod_requests_limits(spark.createDataFrame(rows, SAMPLE), windows).collect()}
    assert got == {1: (2.0, None, None, None), 2: (3.0, None, None, 5000.0), 3: (None, None, None, None)}


def job_scrapes(job, pod, node, start, end, **more):
    note = {k: "x" for k in fixed.POD_ANNOTATIONS.values()} | {fixed.POD_JOB_ID: str(job), "pod": pod, fixed.POD_ANNOTATIONS["package_name"]: "zlib"}
    note = {k: v for k, v in {**note, **more}.items() if v is not None}
    tag = {"pod": pod, **{k: "big" for k in fixed.POD_LABELS.values()}}
    build = {"container": "build", "pod": pod}
    rows = scrapes("kube_pod_annotations", note, start, end) + scrapes("kube_pod_labels", tag, start, end) + place(pod, node, start, end)
    rows += scrapes("container_cpu_usage_seconds_total", {**build, "node": node}, start, end, lambda t: float(t - start))
    rows += scrapes("container_memory_working_set_bytes", build, start, end, lambda t: 100.0 + (t - start) // 60)
    return rows + scrapes("kube_pod_container_resource_requests", {**build, "resource": "cpu"}, start, end, 2.0)


def test_records_from_metrics_artifacts_and_names(spark):
    rows = node_scrapes("a", 0, 20_000) + node_scrapes("b", 0, 20_000)
    rows += scrapes(fixed.PRICE_METRIC, {"capacity_type": "spot", "instance_type": "m1", "zone": "z"}, 0, 9000, 0.5)
    rows += job_scrapes(1, "p", "a", 0, 1200) + job_scrapes(2, "q", "a", 0, 1200)  # two pods share a node
    rows += job_scrapes(3, "p", "b", 6000, 7200) + job_scrapes(4, "r", "b", 6000, 7200, **{fixed.POD_ANNOTATIONS["arch"]: None})
    rows += job_scrapes(5, "s", "a", 12_000, 13_200) + job_scrapes(55, "s5", "a", 12_000, 13_200)  # no price
    rows += job_scrapes(6, "t", "b", 3000, 4200)  # alone on its node
    jobs = [(1, "zlib@1 /h", "success", True, 0.0, 1200.0), (2, "x", "success", False, 0.0, 1200.0), (3, "x", "failed", True, 6000.0, 7200.0),
            (4, "x", "success", True, 6000.0, 7200.0), (5, "x", "success", True, 12_000.0, 13_200.0), (6, "gcc@12 /g", "failed", True, 3000.0, 4200.0),
            (7, "x", "success", False, 0.0, 10.0), (8, "x", "success", True, 0.0, 10.0), (9, "x", "failed", True, 0.0, 10.0), (10, "x", "failed", True, 0.0, 10.0)]
    jobs = spark.createDataFrame(jobs, "job_id BIGINT, name STRING, status STRING, is_build BOOLEAN, start_ts DOUBLE, end_ts DOUBLE")
    given = {c: "a" for c in (*details.PACKAGE, "stack", "job_size")}
    artifacts = [(5, None, *given.values(), 8), (9, "VAR", *given.values(), 8)]
    artifacts = spark.createDataFrame(artifacts, f"job_id BIGINT, missing_variable STRING, {', '.join(f'{c} STRING' for c in given)}, build_jobs INT")
    records, rejects = details.job_details(spark.createDataFrame(rows, SAMPLE), jobs, artifacts)
    got = {r["job_id"]: r for r in records.collect()}
    assert {i: (r["info_source"], r["metrics_problem"]) for i, r in got.items()} == {
        1: ("metrics", None), 2: ("metrics", None), 3: ("metrics", None), 5: ("artifacts", "no price of spot, m1, z"),
        6: ("name", "only one series on the node"), 7: ("none", "no pod of the job"),
    }
    assert {r["key"]: r["reason"] for r in rejects.collect()} == {
        "4": f"missing label {fixed.POD_ANNOTATIONS['arch']}", "8": "no artifacts", "9": "missing variable VAR", "10": "job name does not name a package",
    }
    one = got[1]
    assert (one["node_name"], one["system_uuid"], one["node_cpu"], one["spot_price"], one["pod_name"]) == ("a", "uuid-a", 4, 0.5, "p")
    assert (one["pod_cpu_request"], one["pod_node_occupancy"], one["pod_cpu_usage_seconds"], one["pod_max_mem"]) == (2.0, 0.5, 1200.0, 120)
    assert (one["package_name"], one["stack"]) == ("zlib", "big") and (got[2]["package_name"], got[2]["node_name"]) == (None, "a")
    assert got[3]["node_name"] == "b" and got[6]["package_version"] == "12" and got[5]["build_jobs"] == 8 and got[5]["node_name"] is None


def test_details_reach_the_fact(spark):
    from cistern.operators import facts, warehouse

    jobs = spark.createDataFrame([(1, "copy", "copy", "success", None, "2024-01-01 00:00:00", 60.0, "develop", 1, 2, [], (None,))],
        "build_id BIGINT, build_name STRING, build_stage STRING, build_status STRING, build_failure_reason STRING, at STRING, duration_seconds DOUBLE,"
        "ref STRING, pipeline_id BIGINT, runner_id BIGINT, tags ARRAY<STRING>, source_pipeline STRUCT<pipeline_id BIGINT>")  # fmt: skip
    jobs = jobs.withColumn("started_at", F.col("at").cast("timestamp_ntz")).drop("at")
    info = spark.createDataFrame([(1, 2.0, 4.0, 0.5, 3.6)], "job_id BIGINT, pod_cpu_request DOUBLE, pod_cpu_limit DOUBLE, pod_node_occupancy DOUBLE, spot_price DOUBLE")
    none = spark.createDataFrame([], "job_id BIGINT, trace STRING")
    retry = spark.createDataFrame([], "build_id BIGINT, retry_max INT, retry_reasons ARRAY<STRING>, attempt_number INT")
    codes = spark.createDataFrame([], "build_id BIGINT, job_exit_code INT")
    rows, _ = warehouse.enrich_jobs(jobs, none, retry, codes, info)
    fact = facts.build_fact_job(rows, job_url_prefix="https://x/").first()
    assert (fact["pod_cpu_request"], fact["pod_cpu_limit"], float(fact["cost"]), fact["job_url"]) == (2.0, 4.0, 0.03, "https://x/1")


def test_prices_that_are_missing_are_rejects(spark):
    rows = scrapes(fixed.PRICE_METRIC, {"capacity_type": "spot", "instance_type": "m", "zone": "z"}, 0, 600, 2.0)
    windows = spark.createDataFrame([(1, "spot", "m", "z", 0.0, 600.0), (2, "spot", "m", "z", 601.0, 700.0), (3, "spot", "n", "z", 0.0, 9.0)],
        "window_id BIGINT, capacity_type STRING, instance_type STRING, zone STRING, start_ts DOUBLE, end_ts DOUBLE")
    priced = metrics.spot_price(spark.createDataFrame(rows, SAMPLE), windows)
    assert {r["key"]: r["reason"] for r in metrics.price_rejects(priced).collect()} == {"2": "no price of spot, m, z", "3": "no price of spot, n, z"}


def test_own_usage_counts_grid_points(spark):
    rows = job_scrapes(1, "p", "a", 0, 1200) + job_scrapes(2, "p", "b", 0, 1200)[-0:0]
    samples = spark.createDataFrame(rows, SAMPLE)
    windows = spark.createDataFrame([(1, "p", "a", 0.0, 1200.0), (2, "p", "b", 0.0, 1200.0), (3, "q", "a", 0.0, 1200.0)], "window_id BIGINT, pod STRING, node STRING, start_ts DOUBLE, end_ts DOUBLE")
    cpu, memory = (samples.where(F.col("metric") == m) for m in ("container_cpu_usage_seconds_total", "container_memory_working_set_bytes"))
    got = [tuple(r) for r in metrics.own_usage(cpu, memory, windows, parts=10).collect()]
    assert got == [(1, 1200.0, 120, sum(100 + 2 * k for k in range(11)) / 11)]


# --- smaller operators

def test_too_long_fields_are_reported(spark):
    specs = spark.createDataFrame([("h" * 32, "n" * 129, "1.2", "", "", "", ""), ("g" * 33, "n", "1" * 32, "", "", "a" * 65, "v" * 900)],
        "hash STRING, name STRING, version STRING, compiler_name STRING, compiler_version STRING, arch STRING, variants STRING")
    found = {(r["rule"], r["key"][0]) for r in dims.check_constraints({"dim_package_spec": specs}).collect()}
    assert found == {("max-length-name", "h"), ("max-length-hash", "g"), ("max-length-arch", "g"), ("no-missing-fields", "g")}


def test_specs_named_by_the_reproduction_file(spark, tmp_path):
    for job, named in ((1, "a.json"), (2, "b.json"), (3, None)):
        folder = tmp_path / str(job)
        folder.mkdir()
        for name in ("a", "b"):
            (folder / f"{name}.json").write_text('{"spec": {"nodes": [{"name": "%s%d", "hash": "h", "version": "1"}]}}' % (name, job))
        if named:
            (folder / "repro.json").write_text('{"job_spec_json": "%s"}' % named)
    out = readers.read_spec_nodes(spark, f"{tmp_path}/*/*.json", r"/([0-9]+)/[^/]*$", f"{tmp_path}/*/repro.json")
    assert sorted((r["job_id"], r["name"]) for r in out.collect()) == [(1, "a1"), (2, "b2")]


@pytest.mark.parametrize("kind, line, want", [
    ("apache2", '1.2.3.4 - bob [02/Jan/2024:03:04:05 +0000] "GET /x HTTP/1.1" 200 12 "ref" "curl"', {"host": "1.2.3.4", "user": "bob", "method": "GET", "path": "/x", "code": 200, "size": 12, "agent": "curl"}),
    ("nginx", '1.2.3.4 h - [02/Jan/2024:03:04:05 +0000] "GET /a b HTTP/1.1" 404 - "ref" "curl"', {"remote": "1.2.3.4", "host": "h", "user": "-", "path": "/a b", "code": 404, "size": None}),
    ("apache_error", "[Tue Jan 02 03:04:05 2024] [error] [pid 7] [client 9.9.9.9] it broke", {"time": "Jan 02 03:04:05 2024", "level": "error", "pid": "7", "client": "9.9.9.9", "message": "it broke"}),
    ("syslog", "<34>Jan  2 03:04:05 box sshd[12]: hello there", {"pri": "34", "time": "Jan  2 03:04:05", "host": "box", "ident": "sshd", "pid": "12", "message": "hello there"}),
    ("syslog", "no such line", {"pri": None, "message": None}),
])
def test_log_formats(spark, kind, line, want):
    row = logs.parse_access_log(spark.createDataFrame([(line,)], "line STRING"), kind).first()
    assert {k: row[k] for k in want} == want
    if "code" in want:
        assert str(row["ts"]) == "2024-01-02 03:04:05"


def test_nested_and_equal_prefixes(spark):
    objects = spark.createDataFrame([("a/b/x", 1), ("a/b/c/y", 2), ("a/bb/z", 4), ("a/w", 8), ("top", 16), ("b/a/b/v", 32), ("a/b/", 64)], "key STRING, size BIGINT")
    prefixes = spark.createDataFrame([("a/",), ("a/b/",), ("a/b/",), ("a/b/c/",), ("none/",), ("a/b",)], "prefix STRING")
    got = {r["prefix"]: (r["bytes"], r["objects"]) for r in buildcache.reclaimable_size(objects, prefixes).collect()}
    assert got == {"a/": (79, 5), "a/b/": (67, 3), "a/b/c/": (2, 1), "none/": (0, 0), "a/b": (0, 0), None: (148, 9)}


def test_missing_hashes_in_one_pass_equal_the_joins(spark):
    key = lambda p, h: f"{p}/v3/manifests/spec/zlib/zlib-1.0-{h}.spec.manifest.json"
    blob = lambda m, c: (1, m, "gzip", "sha256", c)
    tar, spec = fixed.TARBALL_MEDIA_TYPE, fixed.SPEC_MEDIA_TYPE
    full = [blob("other", "o"), blob(tar, "tt"), blob(spec, "ss"), blob(spec, "s2")]
    rows = [(key("develop/b", "h1"), full), (key("develop/a", "h1"), full), (key("develop/a", "h2"), full), (key("develop", "h2"), None), (key("develop/a", "h3"), [blob(tar, "t")]),
            (key("develop/a/deep", "h4"), full), (key("pr1/a", "h5"), full), ("develop/a/blobs/x", None), (key("develop/a", "h6"), None), (key("develop.x/a", "h7"), full)]
    objects = spark.createDataFrame(rows, "key STRING, data ARRAY<STRUCT<contentLength BIGINT, mediaType STRING, compression STRING, checksumAlgorithm STRING, checksum STRING>>")
    listing = objects.select("key", F.lit(1).cast("long").alias("size"))
    stacks, top = buildcache.split_stacks(buildcache.catalog_v3(listing), "develop")
    documents = objects.select(F.regexp_extract("key", "^develop/(.+)/v3/", 1).alias("stack"), F.regexp_extract("key", "-(h[0-9])[.]", 1).alias("hash"), "data").where("stack <> ''")
    missing = buildcache.missing_at_top(buildcache.manifest_blobs(stacks, documents, "develop"), top)
    once = buildcache.missing_by_hash(objects, "develop")
    cols = ["hash", "stack", "meta", "archive", "manifest"]
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(missing.select(cols), buildcache.entries_of(once).select(cols)) and once.count() == 2
    assert same(buildcache.missing_summary(missing)[0], buildcache.summary_of(once)[0]) and buildcache.summary_of(once)[1].first()[0] == 2
    assert same(buildcache.publish_plan(missing, "develop"), buildcache.plan_of(once, "develop"))
