"""Sources and sinks: the given tables written in a source's format and read back."""

import functools
import os
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.columns import as_column
from ..operators import dims, facts, logs, warehouse
from ..sources import readers, writers
from ..sources.documents import write_files
from ..sources.scratch import scratch_path, stage
from .bindings import BINDINGS as BOUND
from .bindings import bind, table
from .common import (
    BINDINGS,
    DUCK_TS,
    ENRICHED_SQL,
    JOB_URL_PREFIX,
    enriched,
    reason_sql,
    runner_rows,
    ts_text,
)
from .q_buildcache import REFS_SQL, cache_entries
from .q_buildcache import NOW_SQL, keep_hashes
from .q_dims import timing_rows
from .q_logs import FLAGS_SQL, classified
from .registry import query

AS_OF = datetime(2024, 1, 25)
AS_OF_SQL = "timestamp '2024-01-25 00:00:00'"


def write_documents(rows, by: str, path: str) -> str:
    """One text file per value of `by`, its lines in the order of `ord`.

    rows: by, ord, value. A document is one file by its format, so its lines meet in one task. Tasks
    are as many as the session's shuffles have, since each sorts its rows. In a folder that is mounted
    everywhere they write the files themselves: Spark's writer makes a folder and two files of each
    document and moves them twice, which is most of the time where documents are small.
    """
    spark = rows.sparkSession
    tasks = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    spread = rows.repartition(tasks, by).sortWithinPartitions(by, "ord").select(by, "value")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() != "file":
        spread.write.partitionBy(by).text(path)
        return path
    folder = where.toUri().getPath()
    os.makedirs(folder)
    spread.foreachPartition(functools.partial(write_files, folder, by))
    return path


@contextmanager
def few_listing_tasks(spark):
    """The fixtures are many small folders; list them in a few tasks instead of one per folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, "8")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def framed(rows, by: str, head: str, foot: str):
    """The rows of each document between a first and a last line."""
    ends = rows.select(by).distinct()
    line = lambda n, text: ends.select(by, F.lit(n).alias("ord"), F.lit(text).alias("value"))
    body = rows.select(by, F.lit(1).alias("ord"), "value")
    return line(0, head).unionByName(body).unionByName(line(2, foot))


def event_rows(spark, sf):
    """The jobs binding as webhook events."""
    rows = bind(spark, sf, "jobs")
    text = lambda c: F.concat(ts_text(c), F.lit(" UTC"))
    from ..operators import pipelines

    rows = pipelines.failure_reason_name(rows)
    return rows.select(
        "object_kind", "build_id", "build_name", "build_stage", "build_status",
        "build_failure_reason", text("started_at").alias("build_created_at"),
        text("started_at").alias("build_started_at"), F.lit(None).cast("string").alias("build_finished_at"),
        F.col("duration_seconds").alias("build_duration"), "ref", "pipeline_id",
        F.lit(57).cast("bigint").alias("project_id"),
        F.struct(
            F.col("runner_id").alias("id"), F.lit("uo-x").alias("description"),
            F.array("tag").alias("tags"),
        ).alias("runner"),
        F.when(
            F.col("source_id").isNotNull(), F.struct(F.col("source_id").alias("pipeline_id"))
        ).alias("source_pipeline"),
    )


def write_events(spark, sf) -> str:
    """Packed files, of so many events that they are read by many tasks."""
    path = scratch_path(spark, "events")
    event_rows(spark, sf).write.option("maxRecordsPerFile", 200_000).json(path, compression="gzip")
    return path


@query(
    "read_job_events",
    f"""select build_id, object_kind, build_name, build_stage, build_status,
      {reason_sql('failure_code')} as build_failure_reason,
      strftime(started_at, {DUCK_TS}) || ' UTC' as build_started_at, runner_id, tag,
      source_id as source_pipeline_id from b_jobs""",
    "jobs",
)
def read_job_events(spark, sf):
    events = readers.read_job_events(spark, write_events(spark, sf))
    return events.select(
        "build_id", "object_kind", "build_name", "build_stage", "build_status",
        "build_failure_reason", "build_started_at", F.col("runner.id").alias("runner_id"),
        F.get("runner.tags", F.lit(0)).alias("tag"),
        F.col("source_pipeline.pipeline_id").alias("source_pipeline_id"),
    )


CI = {
    "builds": "ci_builds", "stages": "ci_stages", "pipelines": "ci_pipelines",
    "runners": "ci_runners", "runner_taggings": "ci_taggings", "tags": "ci_tags",
    "users": "ci_users", "projects": "ci_projects", "pipeline_links": "ci_links",
    "builds_metadata": "ci_metadata", "job_definition_instances": "ci_instances",
    "job_definitions": "ci_definitions",
}


def _first(name: str) -> str:
    return next(iter(BOUND[name][1]))


@query(
    "read_ci_tables",
    " union all ".join(
        f"select '{t}' as \"table\", count(*) as n, cast(sum({_first(b)}) as bigint) as total from b_{b}"
        for t, b in CI.items()
    ),
    *CI.values(),
)
def read_ci_tables(spark, sf):
    path = scratch_path(spark, "ci")
    for name, binding in CI.items():
        bind(spark, sf, binding).write.parquet(f"{path}/{name}")
    out = None
    for name, df in readers.read_ci_tables(spark, path).items():
        row = df.agg(
            F.count(F.lit(1)).alias("n"), F.sum(_first(CI[name])).cast("bigint").alias("total")
        ).select(F.lit(name).alias("table"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("read_job_traces", "select job_id, md5(trace || chr(10)) as digest from b_traces", "traces")
def read_job_traces(spark, sf):
    rows = bind(spark, sf, "traces").select(
        F.col("job_id").alias("job"), F.lit(0).alias("ord"), F.col("trace").alias("value")
    )
    path = write_documents(rows, "job", scratch_path(spark, "traces"))
    with few_listing_tasks(spark):
        traces = readers.read_job_traces(spark, path, r"job=([0-9]+)/")
    return traces.select("job_id", F.md5("trace").alias("digest"))


@query(
    "read_error_csv",
    f"""select id, name, strftime(created_at, {DUCK_TS}) as created_at, runner, stage, ref, api_link
      from b_errors""",
    "errors",
)
def read_error_csv(spark, sf):
    path = scratch_path(spark, "errors")
    bind(spark, sf, "errors").write.option("header", True).csv(path)
    rows = readers.read_error_csv(spark, path)
    return rows.select(
        "id", "name", ts_text("created_at").alias("created_at"), "runner", "stage", "ref",
        "api_link",
    )


@query(
    "read_series",
    "select pod, kind as metric, round(ts, 3) as ts, round(value, 4) as value from b_samples",
    "samples",
)
def read_series(spark, sf):
    rows = bind(spark, sf, "samples")
    series = F.struct(
        F.create_map(F.lit("__name__"), F.col("kind"), F.lit("pod"), F.col("pod")).alias("metric"),
        F.array(F.array(F.col("ts").cast("string"), F.col("value").cast("string"))).alias("values"),
    )
    answer = F.to_json(F.struct(F.struct(F.array(series).alias("result")).alias("data")))
    path = scratch_path(spark, "series")
    rows.select(answer.alias("value")).write.text(path)
    out = readers.read_series(spark, path)
    return out.select(
        F.try_element_at("labels", F.lit("pod")).alias("pod"), "metric",
        F.round("ts", 3).alias("ts"), F.round("value", 4).alias("value"),
    )


@query(
    "read_pipeline_vars",
    f"""select name || '@' || version || ' /' || hash as job_name, name as package_name,
      hash as package_hash, arch, 'stack' || substr(version, 3) as stack,
      case when known then 8 end as build_jobs,
      case when compiler_name = '' then '{fixed.REQUIRED_JOB_VARIABLES['compiler_name']}' end as missing_variable
      from b_specs""",
    "specs",
)
def read_pipeline_vars(spark, sf):
    rows = bind(spark, sf, "specs")
    pair = lambda key, value: F.concat(F.lit(f"    {key}: \""), value, F.lit("\"\n"))
    v = fixed.REQUIRED_JOB_VARIABLES
    sources = {
        "package_hash": "hash", "package_name": "name", "package_version": "version",
        "compiler_version": "compiler_version", "arch": "arch", "package_variants": "variants",
    }
    block = F.concat(
        F.lit("\""), F.col("name"), F.lit("@"), F.col("version"), F.lit(" /"), F.col("hash"),
        F.lit("\":\n  variables:\n"), *[pair(v[k], F.col(c)) for k, c in sources.items()],
        pair(v["job_size"], F.lit("small")),
        F.when(F.col("compiler_name") != "", pair(v["compiler_name"], F.col("compiler_name")))
        .otherwise(""),
        F.when(F.col("known"), pair(fixed.BUILD_JOBS_VARIABLE, F.lit("8"))).otherwise(""),
    )
    jobs = rows.select(F.substring("version", 3, 10).alias("doc"), F.lit(1).alias("ord"),
                       block.alias("value"))
    head = jobs.select("doc").distinct().select(
        "doc", F.lit(0).alias("ord"),
        F.concat(F.lit(f"variables:\n  {fixed.STACK_VARIABLE}: stack"), F.col("doc"))
        .alias("value"),
    )
    path = write_documents(head.unionByName(jobs), "doc", scratch_path(spark, "vars"))
    out = readers.job_variables(readers.read_pipeline_vars(spark, f"{path}/*/*"))
    return out.select(
        "job_name", "package_name", "package_hash", "arch", "stack", "build_jobs",
        "missing_variable",
    )


@query(
    "read_install_times",
    """select l_suppkey as job_id, concat('pkg', l_partkey) as name, l_returnflag = 'R' as cache,
      round(l_extendedprice, 2) as total, round(l_quantity, 2) as seconds from lineitem""",
)
def read_install_times(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("job"),
        F.concat(F.lit("pkg"), F.col("l_partkey").cast("string")).alias("name"),
        F.md5(F.col("l_partkey").cast("string")).alias("hash"),
        (F.col("l_returnflag") == "R").alias("cache"),
        F.col("l_extendedprice").alias("total"),
        F.array(F.struct(F.lit("build").alias("path"), F.col("l_quantity").alias("seconds")))
        .alias("phases"),
    )
    entry = F.to_json(F.struct("name", "hash", "cache", "total", "phases"))
    lines = rows.select("job", F.concat(F.lit(","), entry).alias("value"))
    path = write_documents(framed(lines, "job", "[{}", "]"), "job", scratch_path(spark, "times"))
    with few_listing_tasks(spark):
        out = readers.read_install_times(spark, path, r"job=([0-9]+)/")
    return out.select(
        "job_id", "name", "cache", F.round("total", 2).alias("total"),
        F.round(F.get("phases", F.lit(0))["seconds"], 2).alias("seconds"),
    )


@query(
    "read_spec_nodes",
    """select cast(substr(version, 3) as bigint) as job_id, name, hash, version, compiler_name, arch,
      variants from b_specs""",
    "specs",
)
def read_spec_nodes(spark, sf):
    rows = bind(spark, sf, "specs")
    node = F.struct(
        "name", "hash", "version", "arch", "variants",
        F.when(
            F.col("compiler_name") != "",
            F.struct(
                F.col("compiler_name").alias("name"), F.col("compiler_version").alias("version")
            ),
        ).alias("compiler"),
    )
    lines = rows.select(
        F.substring("version", 3, 10).alias("job"),
        F.concat(F.lit(","), F.to_json(node)).alias("value"),
    )
    path = write_documents(
        framed(lines, "job", '{"spec":{"nodes":[null', "]}}"), "job", scratch_path(spark, "nodes")
    )
    out = readers.read_spec_nodes(spark, f"{path}/*/*", r"job=([0-9]+)/")
    return out.select("job_id", "name", "hash", "version", "compiler_name", "arch", "variants")


@query(
    "read_bucket_listing",
    f"select key, size, strftime(modified, {DUCK_TS}) as modified from b_object_keys",
    "object_keys",
)
def read_bucket_listing(spark, sf):
    rows = bind(spark, sf, "object_keys")
    line = F.concat(
        ts_text("modified"), F.lit(" "), F.lpad(F.col("size").cast("string"), 10, " "),
        F.lit(" "), F.col("key"),
    )
    path = scratch_path(spark, "listing")
    rows.select(line.alias("value")).write.text(path)
    out = readers.read_bucket_listing(spark, path)
    return out.select("key", "size", ts_text("modified").alias("modified"))


@query("read_cache_index", "select hash, name, external, in_buildcache from b_cache_index",
       "cache_index")
def read_cache_index(spark, sf):
    rows = bind(spark, sf, "cache_index")
    spec = F.struct(
        "name", F.when(F.col("external"), F.struct(F.lit("/usr").alias("path"))).alias("external")
    )
    entry = F.to_json(F.struct(spec.alias("spec"), "in_buildcache"))
    lines = rows.select(
        F.substring("hash", 1, 1).alias("doc"),
        F.concat(F.lit('"'), F.col("hash"), F.lit('":'), entry, F.lit(",")).alias("value"),
    )
    path = write_documents(
        framed(lines, "doc", '{"database":{"installs":{', '"":null}}}'), "doc",
        scratch_path(spark, "index"),
    )
    return readers.read_cache_index(spark, f"{path}/*/*")


@query(
    "read_lockfiles",
    """select distinct l_suppkey as pipeline_id, 'stack' || (l_suppkey % 4) as stack,
      md5(concat('h', l_partkey)) as hash from lineitem""",
)
def read_lockfiles(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    doc = F.concat_ws(
        "_", F.col("l_suppkey").cast("string"),
        F.concat(F.lit("stack"), (F.col("l_suppkey") % 4).cast("string"), F.lit("-generate")),
    )
    key = F.md5(F.concat(F.lit("h"), F.col("l_partkey").cast("string")))
    lines = rows.select(
        doc.alias("doc"), F.concat(F.lit('"'), key, F.lit('":{},')).alias("value")
    )
    path = write_documents(
        framed(lines, "doc", '{"concrete_specs":{', '"":{}}}'), "doc", scratch_path(spark, "locks")
    )
    with few_listing_tasks(spark):
        return readers.read_lockfiles(
            spark, f"{path}/*/*", r"doc=([0-9]+)_", r"doc=[0-9]+_([^/]+)/"
        )


@query(
    "read_clearsigned_json",
    """select l_orderkey, l_linenumber, l_partkey, case when l_linenumber <> 3 then l_suppkey end as v
      from lineitem""",
)
def read_clearsigned_json(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn(
        "text",
        F.when(
            F.col("l_linenumber") != 3,
            F.concat(
                F.lit("-----BEGIN PGP SIGNED MESSAGE-----\nHash: SHA512\n\n{\"v\": "),
                F.col("l_suppkey").cast("string"),
                F.lit("}\n-----BEGIN PGP SIGNATURE-----\nabc\n-----END PGP SIGNATURE-----\n"),
            ),
        ).otherwise("unsigned"),
    )
    out = readers.read_clearsigned_json(rows, "text")
    value = F.from_json("text", "v BIGINT")["v"].alias("v")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", value)


def _warehouse(spark, sf):
    """All dimensions and facts of the given jobs and install timings."""
    jobs = stage(enriched(spark, sf), "jobs")
    tables, fact = warehouse.build_warehouse(
        jobs, runner_rows(spark, sf), job_url_prefix=JOB_URL_PREFIX
    )
    own = jobs.select(
        "job_id", "status", "job_type", F.col("package_hash").alias("spec_hash"),
        dims.date_key("started_at").alias("start_date_key"),
        dims.time_key("started_at").alias("start_time_key"),
    )
    chosen = stage(facts.select_timings(timing_rows(spark, sf), own), "timings")
    tables["dim_timer_phase"] = dims.build_dim_timer_phase(chosen)
    names, specs = tables["dim_package"], tables["dim_package_spec"]
    return tables, {
        "fact_job": fact,
        "fact_timer": facts.build_fact_timer(chosen, names, specs),
        "fact_timer_phase": facts.build_fact_timer_phase(chosen, names, specs),
    }


# The rows of each table, from the jobs and the install timings that belong to successful builds.
WAREHOUSE_SQL = ENRICHED_SQL + """, bj as (select job_id, i_package_hash as own, started_at,
    strftime(started_at, '%Y%m%d') as date_key from enriched where job_type = 'build' and status = 'success'),
  ch as (select distinct t.job_id, bj.started_at, date_key, cache, t.name, t.hash, phase, seconds
    from b_install_times t join bj on bj.job_id = t.job_id where cache or t.hash = own),
  ft as (select * from ch where name in (select i_package_name from enriched)
    and hash in (select i_package_hash from enriched)),
  ftp as (select job_id, started_at, date_key, cache, name, hash, phase, min(seconds) as seconds from ft group by all),
  ftt as (select distinct job_id, started_at, date_key, cache, name, hash from ft)"""
DIMS_SQL = """select 'dim_date' as "table", count(distinct cast(started_at as date)) as n from enriched
    union all select 'dim_time', count(distinct strftime(started_at, '%H%M%S')) from enriched
    union all select 'dim_package', 1 + count(distinct i_package_name) from enriched
    union all select 'dim_package_spec', 1 + count(distinct i_package_hash) from enriched
    union all select 'dim_job_result', 1 + count(distinct (status, error_taxonomy, unnecessary, job_type,
      gitlab_failure_reason, job_exit_code)) from enriched
    union all select 'dim_job_retry', 1 + count(distinct (is_retry, is_manual_retry, attempt_number,
      final_attempt)) from enriched
    union all select 'dim_gitlab_job', 1 + count(distinct (gitlab_runner_version, ref, tag, pipeline_id,
      parent_pipeline_id)) from enriched
    union all select 'dim_stack_job', count(*) from (select coalesce(i_stack, ''), coalesce(i_job_size, ''),
      case when i_stack is null then '' else job_type end from enriched union select '', '', '')
    union all select 'dim_node', 1 + count(distinct i_system_uuid) from enriched
    union all select 'dim_runner', 1 + count(*) from b_ci_runners where id <> 0
      and id in (select runner_id from enriched)
    union all select 'dim_timer_data', 2
    union all select 'dim_timer_phase', count(distinct phase) from ch"""


def _counts(tables):
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "write_warehouse",
    WAREHOUSE_SQL
    + DIMS_SQL
    + """ union all select 'fact_job', count(*) from enriched
    union all select 'fact_timer', count(*) from ftt
    union all select 'fact_timer_phase', count(*) from ftp""",
    *BINDINGS,
    "install_times",
    "ci_runners",
)
def write_warehouse(spark, sf):
    path = scratch_path(spark, "warehouse")
    tables, rows = _warehouse(spark, sf)
    # Both runs are given the same rows, so those are computed once.
    tables = {n: stage(df, n) for n, df in tables.items()}
    rows = {n: stage(df, n) for n, df in rows.items()}
    # Written twice: the second run finds every row and adds none.
    for _ in range(2):
        writers.write_warehouse(tables, rows, path)
    return _counts({n: writers.read_table(spark, path, n) for n in (*tables, *rows)})


@query(
    "write_job_logs",
    """select job_id, md5(trace) as digest, case when job_id % 4 = 0 then 'gitlab-job-logs-20240125'
      else strftime(date '2024-01-01' + cast(job_id % 9 as int), 'gitlab-job-logs-%Y%m%d') end as log_index
      from b_traces""",
    "traces",
)
def write_job_logs(spark, sf):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("job_id") % 9).cast("int"))
    docs = bind(spark, sf, "traces").withColumn(
        "timestamp", F.when(F.col("job_id") % 4 != 0, day.cast("timestamp_ntz"))
    )
    path = scratch_path(spark, "logs")
    writers.write_job_logs(logs.strip_ansi(docs, "trace"), path, AS_OF)
    return spark.read.parquet(path).select("job_id", F.md5("trace").alias("digest"), "log_index")


LIMITS = {"fact_job": 10, "fact_timer": 14, "fact_timer_phase": 7}


def _recent_sql(name: str) -> str:
    return f"""cast(started_at as date) >= cast({AS_OF_SQL} - interval '{LIMITS[name]}' day as date)
      and date_trunc('second', started_at) < {AS_OF_SQL} - interval '1' hour"""


@query(
    "export_snapshot",
    WAREHOUSE_SQL
    + DIMS_SQL
    + f""" union all select 'fact_job', count(*) from enriched where {_recent_sql('fact_job')}
    union all select 'fact_timer', count(*) from ftt where {_recent_sql('fact_timer')}
    union all select 'fact_timer_phase', count(*) from ftp where {_recent_sql('fact_timer_phase')}""",
    *BINDINGS,
    "install_times",
    "ci_runners",
)
def export_snapshot(spark, sf):
    path, schemas = _export(spark, sf)
    return _counts({n: spark.read.option("header", True).csv(f"{path}/{n}") for n in schemas})


def _export(spark, sf):
    """Where the snapshot of the whole warehouse is, and the schemas of its tables."""
    tables, rows = _warehouse(spark, sf)
    stored = scratch_path(spark, "warehouse")
    writers.write_warehouse(tables, rows, stored)
    tables = {n: writers.read_table(spark, stored, n).select(*df.columns) for n, df in tables.items()}
    rows = {n: writers.read_table(spark, stored, n).select(*df.columns) for n, df in rows.items()}
    # Days are folder names in the store, which read as numbers.
    for n, day in writers.FACT_PARTITION.items():
        rows[n] = rows[n].withColumn(day, F.col(day).cast("string"))
    rows["fact_job"] = facts.generated_timestamps(rows["fact_job"])
    path = scratch_path(spark, "snapshot")
    writers.export_snapshot(tables, rows, path, AS_OF, LIMITS)
    left_out = ("started_at", "finished_at", "infrastructure_error")
    return path, {
        n: T.StructType([f for f in df.schema.fields if f.name not in left_out])
        for n, df in {**tables, **rows}.items()
    }


@query(
    "restore_snapshot",
    WAREHOUSE_SQL
    + f"""select 'job' as kind, job_id, strftime(started_at, '%Y%m%d') as date_key,
      strftime(started_at, '%H%M%S') as time_key, coalesce(i_pod_name, '') as name, cast(null as varchar) as phase,
      i_node_cpu as node_cpu, i_build_jobs as build_jobs, error_taxonomy, job_exit_code
      from enriched where {_recent_sql('fact_job')}
    union all select 'timer', job_id, date_key, strftime(started_at, '%H%M%S'), name, null, null, null, null, null
      from ftt where {_recent_sql('fact_timer')}
    union all select 'phase', job_id, date_key, strftime(started_at, '%H%M%S'), name, phase, null, null, null, null
      from ftp where {_recent_sql('fact_timer_phase')}
    union all select 'table', n, null, null, "table", null, null, null, null, null from ({DIMS_SQL})""",
    *BINDINGS,
    "install_times",
    "ci_runners",
)
def restore_snapshot(spark, sf):
    path, schemas = _export(spark, sf)
    restored = scratch_path(spark, "restored")
    writers.write_restored(writers.restore_snapshot(spark, path, schemas), restored)
    read = lambda n: writers.read_table(spark, restored, n)
    none = {"phase": "string", "node_cpu": "int", "build_jobs": "int", "error_taxonomy": "string",
            "job_exit_code": "int"}

    def rows(kind, df, **cells):
        wanted = {"job_id": "job_id", "date_key": "date_key", "time_key": "time_key", **cells}
        return df.select(
            F.lit(kind).alias("kind"),
            *[as_column(v).alias(c) for c, v in wanted.items()],
            *[F.lit(None).cast(t).alias(c) for c, t in none.items() if c not in cells],
        )

    # Facts are read through the dimensions that they name, so a key that was lost would lose rows.
    job = read("fact_job").join(read("dim_job_result"), "job_result_id").join(
        read("dim_job_retry"), "job_retry_id"
    )
    text = lambda c: F.col(c).cast("string")
    out = rows(
        "job", job, date_key=text("start_date_key"), time_key=text("start_time_key"),
        name=F.col("pod_name"), **{c: F.col(c) for c in none if c != "phase"},
    )
    packages = read("dim_package").withColumnRenamed("name", "package")
    specs = read("dim_package_spec").select(F.col("hash").alias("spec_hash"))
    phases = read("dim_timer_phase").select(F.col("path").alias("phase"))
    timer, phase = (
        read(n).join(packages, "package", "left_semi").join(specs, "spec_hash", "left_semi")
        for n in ("fact_timer", "fact_timer_phase")
    )
    timed = {"date_key": text("date_key"), "time_key": text("time_key"), "name": F.col("package")}
    out = out.unionByName(rows("timer", timer, **timed))
    phase = phase.join(phases, "phase", "left_semi")
    out = out.unionByName(rows("phase", phase, **timed, phase=F.col("phase")))
    counted = _counts({n: read(n) for n in schemas if n.startswith("dim_")})
    empty = F.lit(None).cast("string")
    return out.unionByName(
        rows("table", counted, job_id=F.col("n"), date_key=empty, time_key=empty, name=F.col("table"))
    )


@query(
    "write_keeplists",
    f""", k as (select l.stack, hash from b_locks l join b_lock_pipelines p on p.id = l.pipeline_id
      where ref = 'develop' and updated_at between {NOW_SQL} - interval '500' day and {NOW_SQL})
    select stack, hash from k union select 'develop', hash from k""",
    "locks",
    "lock_pipelines",
)
def write_keeplists(spark, sf):
    path = scratch_path(spark, "keep")
    writers.write_keeplists(keep_hashes(spark, sf), path)
    return spark.read.text(path).select("stack", F.col("value").alias("hash"))


@query(
    "write_cache_listing",
    REFS_SQL
    + """ select ref, count(distinct (label, url)) as mirrors, min(label) as first_label from l group by ref""",
)
def write_cache_listing(spark, sf):
    path = scratch_path(spark, "cache")
    writers.write_cache_listing(cache_entries(spark, sf), path)
    schema = "MAP<STRING, ARRAY<STRUCT<label: STRING, url: STRING>>>"
    lines = spark.read.text(path).select(F.from_json("value", schema).alias("m"))
    rows = lines.select(F.explode("m").alias("ref", "mirrors"))
    return rows.select(
        "ref", F.size("mirrors").cast("bigint").alias("mirrors"),
        F.get("mirrors", F.lit(0))["label"].alias("first_label"),
    )


@query(
    "write_annotated_csv",
    FLAGS_SQL + "select cast(job_id as varchar) as job_id, cast(killed as varchar) as killed, "
    "cast(other_errors as varchar) as other_errors from f",
    "traces",
)
def write_annotated_csv(spark, sf):
    path = scratch_path(spark, "annotated")
    flags = classified(spark, sf).drop("trace")
    writers.write_annotated_csv(flags, path)
    out = spark.read.option("header", True).csv(path)
    return out.select("job_id", "killed", "other_errors")
