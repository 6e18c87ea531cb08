"""Fact builders and the star join."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import dims, facts, warehouse
from ..sources.scratch import stage
from .bindings import bind
from .common import (
    BINDINGS,
    DUCK_TS,
    ENRICHED_SQL,
    JOB_URL_PREFIX,
    enriched,
    key_sql,
    runner_rows,
    ts_text,
)
from .q_dims import timing_rows
from .registry import query


@query(
    "filter_finished_builds",
    "select build_id, build_status from b_jobs where object_kind = 'build' "
    "and build_status in ('success', 'failed')",
    "jobs",
)
def filter_finished_builds(spark, sf):
    return facts.filter_finished_builds(bind(spark, sf, "jobs")).select("build_id", "build_status")


@query(
    "filter_started",
    f"select id, strftime(started_at, {DUCK_TS}) as started_at from b_ci_builds "
    "where started_at is not null",
    "ci_builds",
)
def filter_started(spark, sf):
    rows = facts.filter_started(bind(spark, sf, "ci_builds"))
    return rows.select("id", ts_text("started_at").alias("started_at"))


# Adds a repeated section, one paired with another name, and an odd marker.
MORE_SECTIONS = (
    "concat(trace, 'section_start:', 100 + job_id, ':get_sources', chr(13), 'section_end:', "
    "200 + job_id * 2, ':other', chr(10), 'section_start:5:get_sources section_end:', job_id, "
    "':get_sources', case when job_id % 3 = 0 then 'section_start:9:step_script' else '' end)"
)
PAIRS_SQL = f""", x as (select job_id, {MORE_SECTIONS} as trace from b_traces),
 m as (select job_id, regexp_extract_all(trace, 'section_(start|end):(\\d+):([A-Za-z0-9_\\-\\.]+)', 2) as ts,
   regexp_extract_all(trace, 'section_(start|end):(\\d+):([A-Za-z0-9_\\-\\.]+)', 3) as nm from x),
 p as (select job_id, ts, nm, unnest(range(1, len(ts) // 2 + 1)) as i from m),
 q as (select job_id, i, nm[2*i-1] as name, cast(ts[2*i] as bigint) - cast(ts[2*i-1] as bigint) as seconds from p),
 l as (select job_id, name, arg_max(seconds, i) as seconds from q group by all)"""


def _traces(spark, sf):
    return bind(spark, sf, "traces").withColumn("trace", F.expr(MORE_SECTIONS))


@query("section_timers", PAIRS_SQL + "select job_id, name, seconds from l", "traces")
def section_timers(spark, sf):
    timers = facts.section_timers(_traces(spark, sf))
    return timers.select("job_id", F.explode("section_timers").alias("name", "seconds"))


@query(
    "section_timer_columns",
    PAIRS_SQL
    + "select b_traces.job_id, "
    + ", ".join(
        f"coalesce(max(seconds) filter (name = '{s}'), 0) as gitlab_{s}"
        for s in fixed.SECTION_TIMERS
    )
    + " from b_traces left join l on l.job_id = b_traces.job_id group by 1",
    "traces",
)
def section_timer_columns(spark, sf):
    timers = facts.section_timer_columns(facts.section_timers(_traces(spark, sf)))
    return timers.select("job_id", *[f"gitlab_{s}" for s in fixed.SECTION_TIMERS])


def micros(c):
    """Whole millionths; the offset keeps rounding of equal values equal."""
    return F.floor(F.col(c).cast("double") * 1_000_000 + 0.123).cast("bigint")


_PKG = "named_struct('name', {0}, 'hash', {1}, 'version', {2}, 'compiler_name', 'gcc', 'compiler_version', '12', 'arch', 'x', 'variants', '')"


@query(
    "job_info_cascade",
    """, j as (select build_id as job_id, build_name as name, build_status as status,
      regexp_matches(build_stage, '^stage-\\d+$') as is_build,
      in_cluster as m, case when build_id % 5 = 0 then 'label_x' end as ml,
      ref <> 'develop' as a, case when build_id % 8 = 1 then 'VAR' end as av from b_jobs),
    s as (select *, case when m and is_build and ml is not null then 'reject' when m then 'metrics'
      when not is_build then 'none' when a and av is not null then 'reject' when a then 'artifacts'
      when status = 'failed' then 'name' else 'reject' end as source,
      case when m then 'missing label ' || ml when a then 'missing variable ' || av
        else 'no artifacts' end as reason from j)
    select job_id, source as info_source,
      case when source = 'metrics' and is_build then 'm' when source = 'artifacts' then 'a'
        when source = 'name' then regexp_extract(name, '^([^@]*)@', 1) end as package,
      case when source = 'name' then regexp_extract(name, '/(.*)$', 1) end as name_hash,
      case when source = 'metrics' then 'pod' end as pod,
      case when source = 'reject' then reason end as reason
    from s""",
    "jobs",
)
def job_info_cascade(spark, sf):
    rows = bind(spark, sf, "jobs").select(
        F.col("build_id").alias("job_id"),
        F.col("build_name").alias("name"),
        F.col("build_status").alias("status"),
        F.col("build_stage").rlike(fixed.BUILD_STAGE).alias("is_build"),
        "in_cluster",
        "ref",
    )
    misc = "named_struct('stack', 's', 'job_size', 'small', 'build_jobs', 4)"
    metrics = rows.where("in_cluster").selectExpr(
        "job_id",
        "case when job_id % 5 = 0 then 'label_x' end AS missing_label",
        _PKG.format("'m'", "'h'", "'1'") + " AS package",
        misc + " AS misc",
        "named_struct('name', 'pod') AS pod",
        "named_struct('name', 'node') AS node",
    )
    artifacts = rows.where("ref <> 'develop'").selectExpr(
        "job_id",
        "case when job_id % 8 = 1 then 'VAR' end AS missing_variable",
        _PKG.format("'a'", "'h'", "'1'") + " AS package",
        misc + " AS misc",
    )
    info, rejects = facts.job_info_cascade(
        rows.drop("in_cluster", "ref"), metrics, artifacts
    )
    none = F.lit(None).cast("string")
    named = F.when(F.col("info_source") == "name", F.col("package.hash"))
    return info.select(
        "job_id", "info_source", F.col("package.name").alias("package"),
        named.alias("name_hash"), F.col("pod.name").alias("pod"), none.alias("reason"),
    ).unionByName(
        rejects.select(
            F.col("key").alias("job_id"), F.lit("reject").alias("info_source"),
            none.alias("package"), none.alias("name_hash"), none.alias("pod"), "reason",
        )
    )


@query(
    "parse_job_name",
    """select build_id, split_part(split_part(build_name, ' ', 1), '@', 1) as package_name,
      case when contains(build_name, '@') then split_part(split_part(build_name, ' ', 1), '@', 2) end
        as package_version,
      case when contains(build_name, ' ') then trim(split_part(build_name, ' ', 2), '/') end
        as package_hash from b_jobs""",
    "jobs",
)
def parse_job_name(spark, sf):
    rows = facts.parse_job_name(bind(spark, sf, "jobs"))
    return rows.select("build_id", "package_name", "package_version", "package_hash")


@query(
    "job_cost",
    ENRICHED_SQL
    + """select job_id,
      cast(floor(duration_seconds * i_pod_node_occupancy * i_spot_price / 3600 * 1000000 + 0.123)
        as bigint) as cost_micros,
      cast(floor(i_spot_price / 3600 * 1000000 + 0.123) as bigint) as price_micros from enriched""",
    *BINDINGS,
)
def job_cost(spark, sf):
    rows = enriched(spark, sf)
    return rows.select(
        "job_id",
        micros("cost").alias("cost_micros"),
        micros("node_price_per_second").alias("price_micros"),
    )


@query(
    "build_fact_job",
    ENRICHED_SQL
    + f"""select job_id, strftime(started_at, '%Y%m%d') as start_date_key,
      strftime(started_at, '%H%M%S') as start_time_key,
      coalesce(i_system_uuid, '00000000-0000-0000-0000-000000000000') as node_id,
      case when runner_id in (select id from b_ci_runners) then runner_id else 0 end as runner_id,
      coalesce(i_package_name, '') as package, coalesce(i_package_hash, '') as spec_hash,
      {key_sql("coalesce(i_stack, '')", "coalesce(i_job_size, '')",
               "case when i_stack is null then '' else job_type end")} as stack_job_id,
      {key_sql('gitlab_runner_version', 'ref', 'tag', 'pipeline_id', 'parent_pipeline_id')} as gitlab_job_id,
      {key_sql('status', 'error_taxonomy', 'unnecessary', 'job_type', 'gitlab_failure_reason',
               'job_exit_code')} as job_result_id,
      {key_sql('is_retry', 'is_manual_retry', 'attempt_number', 'final_attempt')} as job_retry_id,
      name, coalesce(i_pod_name, '') as pod_name, round(duration_seconds, 4) as duration_seconds,
      i_node_cpu as node_cpu, i_node_memory as node_memory, i_build_jobs as build_jobs,
      cast(floor(duration_seconds * i_pod_node_occupancy * i_spot_price / 3600 * 1000000 + 0.123)
        as bigint) as cost_micros,
      case when trace = '' then 0 else job_id % 90 end as gitlab_prepare_script
      from enriched""",
    *BINDINGS,
    "ci_runners",
)
def build_fact_job(spark, sf):
    jobs = enriched(spark, sf)
    runners = dims.build_dim_runner(jobs, runner_rows(spark, sf))
    fact = facts.build_fact_job(
        dims.with_runner_key(jobs, runners), job_url_prefix=JOB_URL_PREFIX
    )
    return fact.select(
        "job_id", "start_date_key", "start_time_key", "node_id", "runner_id", "package",
        "spec_hash", "stack_job_id", "gitlab_job_id", "job_result_id", "job_retry_id", "name",
        "pod_name", F.round("duration_seconds", 4).alias("duration_seconds"), "node_cpu",
        "node_memory", "build_jobs", micros("cost").alias("cost_micros"),
        "gitlab_prepare_script",
    )


@query(
    "generated_timestamps",
    f"""select build_id, strftime(date_trunc('second', started_at), {DUCK_TS}) as started_at,
      strftime(date_trunc('second', started_at)
        + to_microseconds(cast(round(duration_seconds * 1000000) as bigint)), {DUCK_TS}) as finished_at
      from b_jobs""",
    "jobs",
)
def generated_timestamps(spark, sf):
    keys = bind(spark, sf, "jobs").select(
        "build_id",
        dims.date_key("started_at").alias("start_date_key"),
        dims.time_key("started_at").alias("start_time_key"),
        "duration_seconds",
    )
    out = facts.generated_timestamps(keys)
    return out.select(
        "build_id", ts_text("started_at").alias("started_at"),
        ts_text("finished_at").alias("finished_at"),
    )


def timing_jobs(spark, sf):
    """Jobs that own the install timings: one per order."""
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey AS job_id",
        "case when o_custkey % 3 = 0 then 'failed' else 'success' end AS status",
        "case when o_custkey % 5 = 0 then 'copy' else 'build' end AS job_type",
        "md5(concat('p', o_orderkey % 2000)) AS spec_hash",
        "date_format(o_orderdate, 'yyyyMMdd') AS start_date_key",
        "'010203' AS start_time_key",
    )


TIMINGS_SQL = """, sel as (select t.*, strftime(o_orderdate, '%Y%m%d') as date_key
  from b_install_times t join orders o on o.o_orderkey = t.job_id
  where o_custkey % 3 <> 0 and o_custkey % 5 <> 0
    and (t.cache or t.hash = md5(concat('p', o_orderkey % 2000)))),
 ok as (select sel.* from sel where name in (select name from b_specs where known)
   and hash in (select hash from b_specs where known))"""


def selected(spark, sf):
    return facts.select_timings(timing_rows(spark, sf), timing_jobs(spark, sf))


@query(
    "select_timings",
    TIMINGS_SQL + "select job_id, name, cache, round(total, 2) as total, date_key from sel",
    "install_times",
    "specs",
)
def select_timings(spark, sf):
    return selected(spark, sf).select(
        "job_id", "name", "cache", F.round("total", 2).alias("total"), "date_key"
    )


@query(
    "build_fact_timer",
    TIMINGS_SQL
    + """select job_id, date_key, '010203' as time_key, cache, name as package, hash as spec_hash,
      total as total_duration from ok
      qualify row_number() over (partition by job_id, date_key, cache, name, hash order by total nulls first) = 1""",
    "install_times",
    "specs",
)
def build_fact_timer(spark, sf):
    specs = bind(spark, sf, "specs").where("known")
    return facts.build_fact_timer(selected(spark, sf), specs, specs)


@query(
    "build_fact_timer_phase",
    TIMINGS_SQL
    + """select job_id, date_key, '010203' as time_key, cache, name as package, hash as spec_hash,
      phase, seconds as duration, round(case when total <> 0 then seconds / total end, 6) as ratio_of_total
    from ok qualify row_number() over (partition by job_id, date_key, cache, name, hash, phase
      order by seconds nulls first, case when total <> 0 then seconds / total end nulls first) = 1""",
    "install_times",
    "specs",
)
def build_fact_timer_phase(spark, sf):
    specs = bind(spark, sf, "specs").where("known")
    fact = facts.build_fact_timer_phase(selected(spark, sf), specs, specs)
    return fact.withColumn("ratio_of_total", F.round("ratio_of_total", 6))


@query(
    "star_join",
    ENRICHED_SQL
    + """select strftime(started_at, '%Y-%m-%d') as day, dayname(started_at) as day_name, job_type,
      count(*) as jobs, round(sum(duration_seconds), 2) as total_duration,
      count(*) filter (status = 'failed') as failed from enriched
      group by all""",
    *BINDINGS,
)
def star_join(spark, sf):
    jobs = stage(enriched(spark, sf), "jobs")
    tables, fact = warehouse.build_warehouse(
        jobs, runner_rows(spark, sf), job_url_prefix=JOB_URL_PREFIX
    )
    used = {n: tables[n] for n in ("dim_date", "dim_job_result")}
    joined = facts.star_join(fact, used)
    return joined.groupBy(
        F.col("date_date").cast("string").alias("day"),
        F.col("date_day_name").alias("day_name"),
        F.col("job_result_job_type").alias("job_type"),
    ).agg(
        F.count(F.lit(1)).alias("jobs"),
        F.round(F.sum("duration_seconds"), 2).alias("total_duration"),
        F.count_if(F.col("job_result_status") == "failed").alias("failed"),
    )
