"""The given tables read as CI data.

Each binding projects one table by SQL expressions that Spark and DuckDB both accept, so the same
text feeds a query and its check. Where the engines spell a function differently, the expression
is a (Spark, DuckDB) pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed

Expr = str | tuple[str, str]

BUILD_NAME = (
    "case event_type when 'click' then concat('stack', event_id % 3, '-generate') "
    "when 'signup' then 'rebuild-index' when 'purchase' then 'copy' "
    "else concat('pkg', event_id % 7, '@1.', event_id % 5, ' /h', event_id % 35) end"
)
BUILD_STAGE = (
    "case when event_type in ('view', 'error') then concat('stage-', event_id % 4) "
    "else 'other' end"
)
BUILD_STATUS = "case event_type when 'error' then 'failed' else 'success' end"
FAILURE_CODE = "case when event_type = 'error' then nullif(event_id % 24, 0) end"
REF = "case when event_id % 4 = 0 then 'develop' else concat('pr', user_id % 50, '_x') end"
EPOCH = (
    "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1000000D",
    "epoch_us(ts) / cast(1000000 as double)",
)
TRACE = (
    "concat(text, chr(10), 'section_start:', 1700000000 + doc_id, ':prepare_script', chr(13), "
    "'section_end:', 1700000000 + doc_id + doc_id % 90, ':prepare_script', chr(10), "
    "case doc_id % 6 when 0 then 'error found in build log:' "
    "when 1 then 'No space left on device' when 2 then 'Killed' when 3 then 'curl: (28)' "
    "when 4 then 'Killed No space left on device' else '' end)"
)
LIST_STACK = "case when l_suppkey % 4 = 0 then '' else concat('stack', l_suppkey % 4) end"

BINDINGS: dict[str, tuple[str, dict[str, Expr]]] = {
    "jobs": (
        "events",
        {
            "build_id": "event_id",
            "pipeline_id": "user_id",
            "started_at": "ts",
            "duration_seconds": "value",
            "build_name": BUILD_NAME,
            "build_stage": BUILD_STAGE,
            "build_status": BUILD_STATUS,
            "failure_code": FAILURE_CODE,
            "retry_max": "event_id % 3",
            "ref": REF,
            "object_kind": "case when event_id % 17 = 0 then 'pipeline' else 'build' end",
            "runner_id": "nullif(event_id % 130, 0)",
            "exit_code": "case when event_type = 'error' then event_id % 3 end",
            "source_id": "case when event_id % 5 = 0 then event_id + 1000000 end",
            "tag": "concat('t', event_id % 3)",
            "job_size": "case event_id % 4 when 0 then 'small' when 1 then 'large' else 'huge' end",
            "stack": "concat('stack', event_id % 6)",
            "in_cluster": "event_id % 3 <> 0",
        },
    ),
    "traces": (
        "documents",
        {
            "job_id": "doc_id",
            "build_status": "case when doc_id % 2 = 0 then 'failed' else 'success' end",
            "trace": TRACE,
            "build_failure_reason": "case doc_id % 10 when 5 then 'stuck_or_timeout_failure' "
            "when 7 then 'scheduler_failure' else 'script_failure' end",
        },
    ),
    "samples": (
        "events",
        {
            "pod": "concat('p', user_id)",
            "node": "concat('n', user_id % 10)",
            "kind": "event_type",
            "ts": EPOCH,
            "value": "value",
            "eid": "event_id",
        },
    ),
    "listing": (
        "lineitem",
        {
            "stack": LIST_STACK,
            "hash": "md5(concat('h', l_orderkey))",
            "kind": "case when l_linenumber % 2 = 0 then 'archive' else 'meta' end",
            "modified": "l_shipdate",
            "size": "cast(floor(l_extendedprice) as bigint)",
        },
    ),
    "install_times": (
        "lineitem",
        {
            "job_id": "l_orderkey",
            "name": "concat('pkg', l_partkey)",
            "hash": "md5(concat('p', l_partkey))",
            "cache": "l_returnflag = 'R'",
            "total": "l_extendedprice",
            "phase": "case when l_linenumber % 2 = 0 then 'build/configure' else 'build' end",
            "seconds": "l_quantity",
        },
    ),
    "specs": (
        "part",
        {
            "hash": "md5(concat('p', p_partkey))",
            "name": "concat('pkg', p_partkey)",
            "version": "concat('1.', p_size)",
            "compiler_name": "case when p_size % 4 = 0 then '' else p_brand end",
            "compiler_version": "case when p_size % 4 = 0 then '' else '12' end",
            "arch": "p_type",
            "variants": "concat('+shared~', p_name, ' patches=', p_size, ' build=', p_brand)",
            "known": "p_partkey % 5 <> 0",
        },
    ),
    "pipelines": (
        "orders",
        {
            "id": "o_orderkey",
            "sha": "md5(concat('c', o_custkey))",
            "ref": "concat('pr', o_custkey % 50, '_x')",
            "status": "case o_orderstatus when 'F' then 'failed' when 'O' then 'running' "
            "else 'success' end",
            "updated_at": "cast(o_orderdate as {ntz})",
            "created_at": "cast(o_orderdate as {ntz})",
            "web_url": "concat('u/', o_orderkey)",
        },
    ),
    "statuses": (
        "orders",
        {
            "id": "o_orderkey",
            "status": "case o_orderkey % 13 when 0 then 'created' when 1 then "
            "'waiting_for_resource' when 2 then 'preparing' when 3 then 'pending' when 4 then "
            "'running' when 5 then 'manual' when 6 then 'scheduled' when 7 then 'failed' when 8 "
            "then 'canceled' when 9 then 'skipped' when 10 then 'success' when 11 then 'odd' end",
            "web_url": "concat('u/', o_orderkey)",
        },
    ),
    "cache_index": (
        "part",
        {
            "hash": "md5(concat('h', p_partkey))",
            "name": "p_name",
            "external": "p_size % 5 = 0",
            "in_buildcache": "p_size % 3 <> 0",
        },
    ),
    "keep": ("part", {"hash": "case when p_size % 2 = 0 then md5(concat('h', p_partkey)) end"}),
    "commits": (
        "orders",
        {
            "commit": "o_orderkey",
            "parent": "case when o_orderkey > 3 then o_orderkey - 1 - o_custkey % 3 end",
        },
    ),
    "prs": (
        "orders",
        {
            "number": "o_orderkey",
            "draft": "o_orderkey % 11 = 0",
            "updated_at": "cast(o_orderdate as {ntz})",
            "head_ref": "concat('fix', o_custkey)",
            "head_sha": "md5(concat('head', o_orderkey))",
            "base_ref": "case when o_custkey % 4 = 0 then 'v1' else 'develop' end",
            "base_sha": "md5(concat('base', o_custkey))",
            "merge_base_sha": "case when o_orderkey % 29 <> 0 then o_custkey end",
            "repo_head_sha": "case when o_orderkey % 23 = 0 then md5('other') "
            "else md5(concat('head', o_orderkey)) end",
            "merge_conflict": "o_orderkey % 19 = 0",
            "merge_commit_sha": "case when o_orderkey % 7 <> 0 then md5(concat('m', o_orderkey)) "
            "end",
        },
    ),
    "check_runs": (
        "lineitem",
        {
            "head_sha": "md5(concat('head', l_orderkey))",
            "name": "case l_linenumber when 1 then 'prechecks' when 2 then 'style' "
            "else concat('c', l_linenumber) end",
            "conclusion": "case when l_suppkey % 9 = 0 then 'failure' else 'success' end",
            "pos": "l_partkey * 1000000 + l_suppkey * 1000 + l_linenumber * 10 "
            "+ cast(l_quantity as int) % 10",
        },
    ),
    "pr_labels": (
        "orders",
        {
            "number": "o_orderkey",
            "label": "case o_custkey % 5 when 0 then 'pipelines:urgent' when 1 then 'other' "
            "else 'ci-ok' end",
        },
    ),
    "gitlab_heads": (
        "orders",
        {
            "pr_string": "concat('pr', o_orderkey, '_fix', o_custkey)",
            "title": "concat('Merge ', case when o_custkey % 3 = 0 then "
            "md5(concat('head', o_orderkey)) else 'abc' end, ' into ', md5('x'))",
        },
    ),
    "branches": (
        "orders",
        {
            "name": "case when o_orderkey % 6 = 0 then concat('main', o_orderkey) "
            "else concat('pr', o_orderkey, '_b') end",
            "protected": "o_orderkey % 10 = 1",
            "commit_id": "md5(concat('c', o_orderkey))",
            "commit_created_at": "cast(o_orderdate as {ntz})",
        },
    ),
    "pushes": (
        "orders",
        {
            "ref": "case when o_custkey % 9 <> 0 then concat('pr', o_orderkey, '_b') end",
            "commit_to": "case when o_custkey % 8 <> 0 then md5('z') end",
            "created_at": "cast(o_orderdate as {ntz})",
        },
    ),
    "bridges": (
        "orders",
        {
            "id": "o_orderkey",
            "name": "concat('stack', o_orderkey % 3, '-build')",
            "parent_pipeline_id": "o_custkey % 150",
            "failure_reason": "case when o_custkey % 3 = 0 then 'script_failure' "
            "else 'unknown_failure' end",
            "child_id": "case when o_orderkey % 13 <> 0 then o_orderkey end",
            "child_status": "case o_orderstatus when 'F' then 'failed' else 'success' end",
        },
    ),
    "generate_jobs": (
        "events",
        {
            "pipeline_id": "user_id",
            "name": "concat('stack', event_id % 3, '-generate')",
            "status": "case when event_id % 97 = 0 then 'failed' else 'success' end",
        },
    ),
    "ci_builds": (
        "events",
        {
            "id": "event_id",
            "commit_id": "user_id",
            "project_id": "cast(case when event_id % 10 = 0 then 2 else 57 end as bigint)",
            "stage_id": "event_id % 30",
            "runner_id": "event_id % 130",
            "user_id": "user_id % 2000",
            "name": BUILD_NAME,
            "status": "case when event_id % 19 = 0 then 'canceled' else " + BUILD_STATUS + " end",
            "type": "case when event_id % 9 = 0 then 'Ci::Bridge' else 'Ci::Build' end",
            "ref": REF,
            "failure_reason": "cast(" + FAILURE_CODE + " as int)",
            "created_at": "ts",
            "started_at": "case when event_id % 11 <> 0 then ts + interval '3' minute end",
            "finished_at": "ts + interval '13' minute",
            "allow_failure": "event_id % 8 = 0",
        },
    ),
    "ci_stages": (
        "nation",
        {"id": "cast(n_nationkey as bigint)", "name": "concat('stage-', n_nationkey)"},
    ),
    "ci_runners": (
        "supplier",
        {
            "id": "s_suppkey",
            "description": "concat(case s_suppkey % 3 when 0 then 'uo-' when 1 then 'runner-' "
            "else 'x-' end, s_name)",
            "runner_type": "cast(nullif(s_suppkey % 4, 0) as int)",
            "active": "s_suppkey % 5 <> 0",
            "platform": "'linux'",
            "architecture": "case when s_nationkey % 2 = 0 then 'amd64' else 'arm64' end",
        },
    ),
    "ci_taggings": ("lineitem", {"runner_id": "l_suppkey", "tag_id": "l_partkey % 40"}),
    "ci_tags": ("nation", {"id": "cast(n_nationkey as bigint)", "name": "n_name"}),
    "ci_users": (
        "customer",
        {"id": "c_custkey", "name": "c_name", "username": "concat('u', c_custkey)"},
    ),
    "ci_projects": (
        "region",
        {
            "id": "cast(case r_regionkey when 0 then 57 when 1 then 2 else 1000 + r_regionkey "
            "end as bigint)",
            "name": "r_name",
            "web_url": "concat('https://ci.example/', r_name)",
        },
    ),
    "ci_pipelines": (
        "orders",
        {"id": "o_orderkey", "sha": "md5(concat('c', o_custkey))", "status": "o_orderstatus"},
    ),
    "ci_links": (
        "orders",
        {
            "pipeline_id": "o_orderkey",
            "source_pipeline_id": "case when o_orderkey % 3 = 0 then o_orderkey + 1000000 end",
            "source_job_id": "o_custkey",
        },
    ),
    "ci_metadata": (
        "events",
        {
            "build_id": "event_id",
            "exit_code": "cast(case when event_type = 'error' then event_id % 3 end as int)",
            "config_options": "case when event_id % 7 <> 0 then concat('{\"retry\": {\"max\": ', "
            "event_id % 3, ', \"when\": [\"runner_system_failure\"]}}') else '{}' end",
        },
    ),
    "ci_instances": (
        "events",
        {
            "job_id": "event_id",
            "job_definition_id": "case when event_id % 2 = 0 then event_id % 5 end",
        },
    ),
    "ci_definitions": (
        "region",
        {
            "id": "cast(r_regionkey as bigint)",
            "config": "case when r_regionkey = 4 then '{\"options\": {}}' else concat("
            "'{\"options\": {\"retry\": {\"max\": ', r_regionkey % 3, "
            "', \"when\": [\"always\"]}}}') end",
        },
    ),
    "protected_refs": (
        "orders",
        {
            "ref": "case o_custkey % 6 when 0 then 'develop' when 1 then concat('v0.', "
            "o_custkey % 23, '.0') when 2 then concat('releases/v0.', o_custkey % 23) when 3 then "
            "'develop-2024-01-07' when 4 then 'v0.20' else concat('pr', o_custkey) end",
            "updated_at": "cast(o_orderdate as {ntz})",
        },
    ),
    "object_keys": (
        "lineitem",
        {
            "key": "concat('develop', case when l_suppkey % 4 = 0 then '' else "
            "concat('/stack', l_suppkey % 4) end, '/build_cache/linux-', l_orderkey % 5, '-', "
            "md5(concat('h', l_orderkey)), case when l_linenumber % 2 = 0 then '" + fixed.V2_SUFFIXES[1] + "' else '"
            + fixed.V2_SUFFIXES[0] + "' end)",
            "size": "cast(floor(l_extendedprice) as bigint)",
            "modified": "cast(l_shipdate as {ntz})",
        },
    ),
    "manifest_keys": (
        "lineitem",
        {
            "key": "concat('develop', case when l_suppkey % 4 = 0 then '' else "
            "concat('/stack', l_suppkey % 4) end, '/v3/manifests/spec/pkg/pkg-1.0-', "
            "md5(concat('h', l_orderkey)), '.spec.manifest.json')",
            "size": "cast(floor(l_extendedprice) as bigint)",
            "stack": "case when l_suppkey % 4 <> 0 then concat('stack', l_suppkey % 4) end",
            "hash": "md5(concat('h', l_orderkey))",
            "spec_sum": "case when l_orderkey % 17 <> 0 then md5(concat('s', l_orderkey)) end",
            "tar_sum": "case when l_orderkey % 13 <> 0 then md5(concat('t', l_orderkey)) end",
        },
    ),
    "cache_prefixes": (
        "orders",
        {
            "repo": "case when o_custkey % 10 = 0 then null when o_custkey % 2 = 0 then 'core' "
            "else 'packages' end",
            "prefix": "concat(case when o_custkey % 10 = 0 then '' when o_custkey % 2 = 0 then "
            "'core/' else 'packages/' end, case when o_orderkey % 12 = 0 then 'misc' else "
            "concat('pr', o_orderkey, '_fix') end, '/')",
        },
    ),
    "mirror_prs": (
        "orders",
        {
            "repo": "case when o_custkey % 2 = 0 then 'core' else 'packages' end",
            "number": "o_orderkey",
            "state": "case when o_custkey % 3 = 0 then 'closed' else 'open' end",
            "draft": "o_orderkey % 5 = 0",
            "updated_at": "cast(o_orderdate as {ntz})",
        },
    ),
    "locks": (
        "lineitem",
        {
            "pipeline_id": "l_orderkey",
            "stack": "concat('stack', l_suppkey % 4)",
            "hash": "md5(concat('h', l_partkey))",
        },
    ),
    "lock_pipelines": (
        "orders",
        {
            "id": "o_orderkey",
            "ref": "case when o_custkey % 3 = 0 then 'develop' else 'other' end",
            "updated_at": "cast(o_orderdate as {ntz})",
        },
    ),
    "fact_copies": (
        "lineitem",
        {
            "id": "l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber",
            "job_id": "l_orderkey",
            "cost": "l_extendedprice",
        },
    ),
    "access_lines": (
        "pages",
        {
            "line": "concat('10.0.0.', page_id % 250, ' - u', page_id % 9, "
            "' [0', 1 + page_id % 9, '/Jan/2024:1', page_id % 10, ':00:00 +0000] \"GET ', "
            "replace(url, ' ', '%20'), ' HTTP/1.1\" ', case when page_id % 7 = 0 then 404 else "
            "200 end, ' ', length(html), ' \"-\" \"agent ', page_id % 3, '\"')",
            "page_id": "page_id",
        },
    ),
    "json_lines": (
        "events",
        {
            "line": "concat('{\"log\": ', props, ', \"severity\": \"', case event_id % 4 when 0 "
            "then 'INFO' when 1 then 'ERROR' else 'WARN' end, '\", \"time\": "
            "\"2024-01-02T03:04:05.', 100 + event_id % 900, '\", \"event_id\": ', event_id, '}')",
            "event_id": "event_id",
        },
    ),
    "errors": (
        "events",
        {
            "id": "event_id",
            "name": BUILD_NAME,
            "created_at": "ts",
            "duration": "value",
            "runner": "case event_id % 3 when 0 then 'uo-1' when 1 then 'runner-x' end",
            "stage": BUILD_STAGE,
            "ref": REF,
            "project_name": "'packages'",
            "job_link": "concat('j/', event_id)",
            "api_link": "concat('a/', event_id)",
        },
    ),
}


def _render(expr: Expr, engine: int) -> str:
    text = expr[engine] if isinstance(expr, tuple) else expr
    return text.replace("{ntz}", ("timestamp_ntz", "timestamp")[engine])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = BINDINGS[name]
    return table(spark, sf_dir, source).selectExpr(
        *[f"{_render(e, 0)} AS {c}" for c, e in columns.items()]
    )


def check_sql(body: str, *names: str) -> str:
    """The body with the named bindings in front of it, as DuckDB reads them."""
    parts = []
    for name in names:
        source, columns = BINDINGS[name]
        cols = ", ".join(f"{_render(e, 1)} AS {c}" for c, e in columns.items())
        parts.append(f"b_{name} AS (SELECT {cols} FROM {source})")
    return ("WITH " + ", ".join(parts) + " " + body) if parts else body
