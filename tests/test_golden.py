"""Hand-written rows for the cases where an operator's meaning is easy to get wrong."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cistern.functions import fixed, taxonomy_values
from cistern.functions.columns import grep_regex, mandatory_text
from cistern.operators import buildcache, dims, facts, logs, metrics, pipelines, rolling, upkeep


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# Text


def test_section_timers_pair_by_position(spark):
    traces = [
        (1, "section_start:10:a\rsection_end:15:a\nsection_start:20:b\rsection_end:50:c"),
        (2, "section_start:10:a section_end:12:a section_start:20:a section_end:29:a"),
        (3, "section_start:10:a section_end:12:a section_start:99:odd"),
        (4, ""),
        (5, "section_end:7:z section_start:3:y"),
    ]
    df = facts.section_timers(spark.createDataFrame(traces, "job_id INT, trace STRING"))
    got = {r.job_id: r.section_timers for r in df.collect()}
    assert got == {1: {"a": 5, "b": 30}, 2: {"a": 9}, 3: {"a": 2}, 4: {}, 5: {"z": -4}}
    cols = facts.section_timer_columns(df).where("job_id = 4").first()
    assert cols.gitlab_step_script == 0


def test_carriage_return_is_not_a_line_end(spark):
    df = spark.createDataFrame([("curl\rx SSL_ERROR_SYSCALL",), ("curl\nSSL_ERROR_SYSCALL",)], "t STRING")
    hit = logs.any_match("t", ["curl.+SSL_ERROR_SYSCALL"])
    assert [r[0] for r in df.select(hit).collect()] == [True, False]


def test_unescaped_parentheses_are_a_group(spark):
    df = spark.createDataFrame(
        [("An error occurred AccessDenied",), ("An error occurred (AccessDenied)",)], "t STRING"
    )
    hit = logs.any_match("t", taxonomy_values.CLASSES["aws_access_denied"])
    assert [r[0] for r in df.select(hit).collect()] == [True, False]


def test_traceback_over_lines(spark):
    text = "Traceback (most recent call last):\n  x\n\ty AssertionError"
    other = "Traceback (most recent call last):\r x AssertionError"
    df = spark.createDataFrame([(text,), (other,)], "t STRING")
    hit = logs.any_match("t", taxonomy_values.CLASSES[fixed.USER_ERRORS[0]])
    assert [r[0] for r in df.select(hit).collect()] == [True, False]


def test_mandatory_text_agrees_with_regex(spark):
    """The substring shortcut must never decide differently from the pattern."""
    import re

    samples = []
    for patterns in taxonomy_values.CLASSES.values():
        for p in patterns or []:
            plain = re.sub(r"\[[^\]]*\]", "0", p).replace("\\", "").replace(".+", "x").replace(".*", "")
            samples += [plain, plain.upper(), plain[1:], "a\n" + plain + "\nb"]
    df = spark.createDataFrame([(s,) for s in samples], "t STRING")
    every = [p for ps in taxonomy_values.CLASSES.values() for p in ps or []]
    got = df.select("t", *[logs.any_match("t", [p]).alias(f"c{i}") for i, p in enumerate(every)])
    for r in got.collect():
        for i, p in enumerate(every):
            assert r[f"c{i}"] == (re.search(p, r.t) is not None), (p, r.t)


def test_grep_patterns_are_basic():
    assert grep_regex("failed (system failure): 5[00|02]") == r"failed \(system failure\): 5[00|02]"
    assert mandatory_text("a.b") == ("a", False) or mandatory_text("a.b") == ("b", False)


def test_taxonomy_order_and_fallback(spark):
    data = [
        (1, "failed", "Killed No space left on device", "script_failure"),
        (2, "failed", "nothing", "stuck_or_timeout_failure"),
        (3, "failed", None, "script_failure"),
        (4, "success", "Killed", None),
        (5, "failed", "Killed", "stuck_or_timeout_failure"),
    ]
    df = spark.createDataFrame(
        data, "id INT, build_status STRING, trace STRING, build_failure_reason STRING"
    )
    got = {r.id: r.error_taxonomy for r in logs.assign_error_taxonomy(df).collect()}
    assert got == {1: "no_space", 2: "stuck_or_timeout_failure", 3: "other", 4: None, 5: "killed"}


def test_taxonomy_parameter_check():
    with pytest.raises(ValueError):
        logs.check_taxonomy({"a": ["x"]}, ["a", "b"])
    logs.check_taxonomy({"a": ["x"], "b": None}, ["a"])


def test_strip_ansi_leaves_known_tail(spark):
    df = spark.createDataFrame([("\x1b[0;mHi\x1b[32;1m!\x1b[0K",)], "t STRING")
    # The known remainder: a `;m` stays behind some escapes.
    assert logs.strip_ansi(df, "t").first().t == ";mHi!"


# Dimensions and facts


def test_infrastructure_error_reads_null_as_no_match(spark):
    data = [
        ("failed", None, "build"), ("failed", fixed.USER_ERRORS[0], "build"), ("success", None, "build"),
        ("failed", "failed_to_get_specs", "rebuild-index"), ("failed", "failed_to_get_specs", "copy"),
    ]
    df = spark.createDataFrame(data, "status STRING, error_taxonomy STRING, job_type STRING")
    got = [r.infrastructure_error for r in dims.infrastructure_error(df).collect()]
    assert got == [True, False, False, False, True]


def test_job_type_rejects(spark):
    df = spark.createDataFrame([(1, "odd", "other"), (2, "copy", "x")],
                               "build_id INT, build_name STRING, build_stage STRING")
    assert rows(dims.job_type_rejects(df), "key") == [(1,)]


def test_dim_date_and_time(spark):
    df = spark.createDataFrame([(datetime(2024, 12, 30, 0, 5, 9),), (datetime(2024, 3, 31, 12, 0, 0),)],
                               "ts TIMESTAMP_NTZ")
    got = rows(dims.build_dim_date(df, "ts"), "date_key", "day_of_week", "quarter", "weekday")
    assert got == [("20240331", 7, 0, False), ("20241230", 1, 3, True)]
    got = rows(dims.build_dim_time(df, "ts"), "time_key", "am_or_pm", "hour_12", "second_of_day")
    assert got == [("000509", "AM", 12, 309), ("120000", "PM", 12, 43200)]


def test_get_or_create_is_idempotent_with_nulls(spark):
    df = spark.createDataFrame(
        [("failed", None, False, "build", "x", None), ("failed", None, False, "build", "x", None),
         ("failed", None, False, "build", "x", 1)],
        "status STRING, error_taxonomy STRING, unnecessary BOOLEAN, job_type STRING, "
        "gitlab_failure_reason STRING, job_exit_code INT",
    )
    once = dims.build_dim_job_result(df)
    assert once.count() == 2
    assert dims.build_dim_job_result(df, once).count() == 2


def test_upsert_fills_only_empty_fields(spark):
    cols = "hash STRING, name STRING, version STRING, compiler_name STRING, compiler_version STRING, arch STRING, variants STRING"
    dim = spark.createDataFrame([("h", "p", "1", "", "", "x", "")], cols)
    new = spark.createDataFrame(
        [("h", "q", "2", "", "12", "y", "", 1), ("h", "q", "2", "gcc", "13", "", "+a", 2),
         ("k", "r", "3", "", "", "", "", 3)], cols + ", ord INT")
    got = rows(dims.upsert_package_spec(dim, new, ["ord"]), "*")
    assert got == [("h", "p", "1", "gcc", "12", "x", "+a"), ("k", "r", "3", "", "", "", "")]


def test_ratio_with_zero_total_and_unknown_spec(spark):
    timings = spark.createDataFrame(
        [(1, "p", "h", True, 0.0, [("build", 2.0)], "20240101", "000000"),
         (1, "p", "unknown", True, 4.0, [("build", 2.0)], "20240101", "000000")],
        "job_id INT, name STRING, hash STRING, cache BOOLEAN, total DOUBLE, "
        "phases ARRAY<STRUCT<path: STRING, seconds: DOUBLE>>, date_key STRING, time_key STRING")
    names = spark.createDataFrame([("p", "h")], "name STRING, hash STRING")
    fact = facts.build_fact_timer_phase(timings, names, names)
    assert rows(fact, "phase", "duration", "ratio_of_total") == [("build", 2.0, None)]
    assert facts.build_fact_timer(timings, names, names, facts.build_fact_timer(timings, names, names)).count() == 0


def test_generated_timestamps_bad_key(spark):
    df = spark.createDataFrame([("20240102", "030405", 60.5), ("20240102", "30405", 1.0), ("20241399", "000000", 1.0)],
                               "start_date_key STRING, start_time_key STRING, duration_seconds DOUBLE")
    got = [(r.started_at, r.finished_at) for r in facts.generated_timestamps(df).collect()]
    assert got[0] == (datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 5, 5, 500000))
    assert got[1] == (None, None) and got[2] == (None, None)


# Pipelines


def test_retry_max_null_is_not_retryable(spark):
    df = spark.createDataFrame(
        [(1, 1, None, ["always"], "x"), (2, 1, 2, ["always"], "x"), (3, 3, 2, ["always"], "x"),
         (4, 2, 2, ["x"], "x"), (5, 4, 2, ["y"], "x"), (6, 1, 0, ["always"], "x")],
        "id INT, attempt_number INT, retry_max INT, retry_reasons ARRAY<STRING>, build_failure_reason STRING")
    got = rows(pipelines.retry_info(df), "id", "is_retry", "is_manual_retry", "final_attempt")
    assert got == [(1, False, False, True), (2, False, False, False), (3, True, False, True),
                   (4, True, False, False), (5, True, True, True), (6, False, False, True)]


def test_unmapped_failure_code_is_rejected(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 777)], "id INT, failure_code INT")
    named = pipelines.failure_reason_name(df)
    assert rows(named, "build_failure_reason") == [("script_failure",), ("unknown_failure",), (None,)]
    assert rows(pipelines.failure_reason_rejects(df, "id"), "key") == [(3,)]


def test_latest_pipeline_keeps_first_of_equals(spark):
    t1, t2 = datetime(2020, 8, 26), datetime(2020, 8, 27)
    df = spark.createDataFrame([(1, "a", t1), (2, "a", t2), (3, "b", t1), (4, "b", t1)],
                               "id INT, sha STRING, updated_at TIMESTAMP_NTZ")
    assert rows(pipelines.latest_pipeline_per_sha(df, "id"), "sha", "id") == [("a", 2), ("b", 3)]


def test_pipeline_status_cases(spark):
    df = spark.createDataFrame([(1, "failed"), (2, "canceled"), (3, None), (4, "odd"), (5, "manual")],
                               "id INT, status STRING").withColumn("web_url", F.lit("u"))
    got = rows(pipelines.pipeline_status(df), "id", "state", "description", "target_url")
    assert got == [(1, "error", "Pipeline failed", "u"), (4, None, None, "u"),
                   (5, "pending", "Pipeline is running manually", "u")]


def test_only_first_run_of_a_check_counts(spark):
    now = datetime(2024, 1, 10)
    prs = spark.createDataFrame(
        [(n, False, now, "x", f"s{n}", "develop", "b", "m", f"s{n}", False, "mc") for n in (1, 2, 3)],
        "number INT, draft BOOLEAN, updated_at TIMESTAMP_NTZ, head_ref STRING, head_sha STRING, base_ref STRING, "
        "base_sha STRING, merge_base_sha STRING, repo_head_sha STRING, merge_conflict BOOLEAN, merge_commit_sha STRING")
    checks = spark.createDataFrame(
        [("s1", "style", "success", 1), ("s1", "style", "failure", 2), ("s2", "style", None, 1)],
        "head_sha STRING, name STRING, conclusion STRING, pos INT")
    labels = spark.createDataFrame([], "number INT, label STRING")
    heads = spark.createDataFrame([], "pr_string STRING, title STRING")
    reach = spark.createDataFrame([("m",)], "commit STRING")
    out, bad = pipelines.classify_prs(prs, checks, labels, heads, reach, now, ["style"], None, "develop")
    wait = "waiting for style check to succeed"
    assert rows(out, "number", "push", "backlogged") == [(1, True, None), (2, False, wait), (3, False, wait)]
    assert bad.count() == 0


def test_ancestor_closure_follows_merged_parents(spark):
    rng = random.Random(3)
    parents = {0: []}
    for c in range(1, 60):
        first = c - 1 - rng.randrange(min(c, 3))
        parents[c] = [first] + ([rng.randrange(c)] if rng.random() < 0.3 else [])
    edges = [(c, p, i) for c, ps in parents.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(edges, "commit INT, parent INT, pos INT")
    head = 57
    want, todo = set(), [head]
    while todo:
        c = todo.pop()
        if c not in want:
            want.add(c)
            todo += parents[c]
    got = pipelines.ancestor_closure(df, spark.createDataFrame([(head,)], "commit INT"))
    assert {r.commit for r in got.collect()} == want


# Ordered helpers against brute force


def test_rank_by_slices(spark):
    rng = random.Random(1)
    data = [(rng.choice("aab"), i * 37 % 1000) for i in range(400)] + [(None, 5), (None, 900)]
    df = spark.createDataFrame(data, "k STRING, id INT")
    got = rolling.rank_by_slices(df, ["k"], "id", 50, "rk").collect()
    assert len(got) == len(data)
    for r in got:
        assert r.rk == 1 + sum(k == r.k and i < r.id for k, i in data)


def test_held_since_over_slices(spark):
    rng = random.Random(2)
    data = [(k, float(t), rng.random() < 0.8) for k in "ab" for t in rng.sample(range(3000), 200)]
    df = spark.createDataFrame(data, "k STRING, ts DOUBLE, h BOOLEAN")
    got = {(r.k, r.ts): r.since for r in rolling.held_since(df, ["k"], "ts", "h", 100.0, "since").collect()}
    for k in "ab":
        since = None
        for _, t, h in sorted(x for x in data if x[0] == k):
            since = (since if since is not None else t) if h else None
            assert got[(k, t)] == since


def test_spans_and_pairs_across_slices(spark):
    rng = random.Random(4)
    times = sorted(rng.sample(range(20000), 150))
    df = spark.createDataFrame([("m", {"p": "a"}, float(t), float(t % 7)) for t in times],
                               "metric STRING, labels MAP<STRING, STRING>, ts DOUBLE, value DOUBLE")
    got = {r.ts: (r.until, r.closed) for r in metrics.spans(df, 300.0).collect()}
    for i, t in enumerate(times):
        nxt = times[i + 1] if i + 1 < len(times) else None
        near = nxt is not None and nxt - t <= 300
        assert got[t] == ((nxt, False) if near else (t + 300.0, True))
    pairs = {r.ts: r.prev_ts for r in metrics.sample_pairs(df, 300.0).collect()}
    assert pairs == {b: a for a, b in zip(times, times[1:]) if b - a <= 300}


# Metrics


def samples(spark, data):
    return spark.createDataFrame(
        [("cpu", {"pod": p, "node": "n"}, float(t), float(v), "n") for p, t, v in data],
        "metric STRING, labels MAP<STRING, STRING>, ts DOUBLE, value DOUBLE, node STRING")


def windows(spark, *spans):
    return spark.createDataFrame([(i, "n", float(a), float(b)) for i, (a, b) in enumerate(spans)],
                                 "window_id INT, node STRING, start_ts DOUBLE, end_ts DOUBLE")


def test_occupancy_against_brute_force(spark):
    rng = random.Random(5)
    data = [(f"p{p}", 15 * i + p, i) for p in range(4) for i in range(40 * p, 40 * p + 90)]
    spans = [(a, a + rng.randrange(1, 2500)) for a in rng.sample(range(4000), 25)]
    good, bad = metrics.node_occupancy(samples(spark, data), windows(spark, *spans), parts=10, lookback=60, width=500)
    got = {r.window_id: r.node_occupancy for r in good.collect()}
    rejected = {int(r.key) for r in bad.collect()}
    for w, (a, b) in enumerate(spans):
        step = max(-(-(b - a) // 10), 1)
        seen, per_time = set(), {}
        for k in range((b - a) // step + 1):
            t = a + k * step
            now = {p for p in {x[0] for x in data}
                   if any(q == p and t - 60 <= u <= t for q, u, _ in data)}
            if now:
                per_time[t], seen = len(now), seen | now
        if not per_time:
            assert w not in got and w not in rejected
        elif len(seen) == 1:
            assert w in rejected and w not in got
        else:
            lo, hi = min(per_time), max(per_time)
            want = 1 / per_time[lo] if lo == hi else (
                sum(1 / n for t, n in per_time.items() if t != lo) * step / (hi - lo))
            assert got[w] == pytest.approx(want)


def test_range_sample_points(spark):
    data = [("a", 0, 1), ("a", 100, 2), ("a", 700, 3)]
    out = metrics.range_sample(samples(spark, data), windows(spark, (0, 1000)), "node", parts=10,
                               lookback=300, width=150)
    got = {r.ts: r.value for r in out.collect()}
    assert got == {0: 1, 100: 2, 200: 2, 300: 2, 400: 2, 700: 3, 800: 3, 900: 3, 1000: 3}


def test_counter_reset(spark):
    data = [("a", 0, 5), ("a", 60, 8), ("a", 120, 2)]
    rate = {r.ts: r.value for r in metrics.counter_rate(samples(spark, data), 180, 60).collect()}
    assert rate[120] == pytest.approx((3 + 2) / 120)
    irate = {r.ts: r.value for r in metrics.counter_irate(samples(spark, data), 180, 60).collect()}
    assert irate[120] == pytest.approx(2 / 60) and irate[60] == pytest.approx(3 / 60)


def test_label_replace_needs_whole_value(spark):
    df = spark.createDataFrame([("10.0.0.1:9100",), ("host",)], "instance STRING")
    got = metrics.label_replace(df, "ip", "$1", "instance", "(.+):.+")
    assert rows(got, "ip") == [("10.0.0.1",), (None,)]


# Build cache


ARCHIVE = fixed.V2_SUFFIXES[1]


def test_catalog_and_publish(spark):
    keys = [
        "develop/s1/build_cache/linux-a-h1.spec.json.sig", f"develop/s1/build_cache/linux/a-h1{ARCHIVE}",
        "develop/s2/build_cache/linux-a-h1.spec.json.sig", f"develop/s2/build_cache/linux/a-h1{ARCHIVE}",
        "develop/s2/build_cache/linux-a-h2.spec.json.sig", f"develop/s1/build_cache/linux/a-h3{ARCHIVE}",
        "develop/build_cache/linux-a-h4.spec.json.sig", "develop/s1/build_cache/index.json",
        "develop/s2/build_cache/linux-a-h4.spec.json.sig", f"develop/s2/build_cache/linux/a-h4{ARCHIVE}",
    ]
    listing = spark.createDataFrame([(k, 1) for k in keys], "key STRING, size BIGINT")
    stacks, top = buildcache.split_stacks(buildcache.catalog_v2(listing), "develop")
    missing = buildcache.missing_at_top(stacks, top)
    assert rows(missing, "hash", "stack") == [("h1", "s1"), ("h1", "s2")]
    plan = buildcache.publish_plan(missing, "develop", version=2)
    assert rows(plan, "step", "stack", "dst") == [
        (0, "s1", f"develop/build_cache/linux/a-h1{ARCHIVE}"),
        (1, "s1", "develop/build_cache/linux-a-h1.spec.json.sig")]


def test_orphans_respect_index_time(spark):
    t = lambda d: datetime(2024, 1, d)
    objects = spark.createDataFrame(
        [("a", "meta", t(1)), ("b", "archive", t(1)), ("c", "archive", t(9)), ("d", "meta", t(1)), ("d", "archive", t(1)),
         ("e", "meta", t(1))], "hash STRING, kind STRING, modified TIMESTAMP_NTZ")
    index = spark.createDataFrame([("a", True), ("d", True), ("e", False)], "hash STRING, in_buildcache BOOLEAN")
    got = buildcache.prune_orphans(objects, index, t(10), t(5))
    assert rows(got, "hash") == [("a",), ("b",)]


def test_dedupe_removes_one_of_three(spark):
    df = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8)], "id INT, job_id INT")
    assert rows(upkeep.dedupe_job_facts(df), "id") == [(1,), (2,), (4,)]


def test_parent_pipelines(spark):
    dim = spark.createDataFrame([(1, None), (1, 5), (2, None), (3, 9), (None, None)],
                                "pipeline_id INT, parent_pipeline_id INT")
    links = spark.createDataFrame([(1, 50), (3, 90)], "pipeline_id INT, source_pipeline_id INT")
    got = rows(upkeep.update_parent_pipelines(dim, links), "*")
    assert got == sorted([(1, 50), (1, 50), (2, 2), (3, 9), (None, None)], key=repr)


def test_job_info_needs_more_than_a_missing_label(spark):
    jobs = spark.createDataFrame(
        [(1, "p@1 /h x", "failed", True), (2, "p@1 /h", "success", True), (3, "copy", "success", False), (4, "bad", "failed", True)],
        "job_id INT, name STRING, status STRING, is_build BOOLEAN")
    pkg = "STRUCT<name: STRING, hash: STRING, version: STRING, compiler_name: STRING, compiler_version: STRING, arch: STRING, variants: STRING>"
    misc = "STRUCT<stack: STRING, job_size: STRING, build_jobs: INT>"
    none = spark.createDataFrame([], f"job_id INT, missing_label STRING, package {pkg}, misc {misc}, pod STRUCT<name: STRING>, node STRUCT<name: STRING>")
    art = spark.createDataFrame([], f"job_id INT, missing_variable STRING, package {pkg}, misc {misc}")
    info, rejects = facts.job_info_cascade(jobs, none, art)
    assert rows(info, "job_id", "info_source", "package.hash") == [(1, "name", "h"), (3, "none", None)]
    assert rows(rejects, "key") == [(2,), (4,)]
