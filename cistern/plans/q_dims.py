"""Dimension builders."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import dims, warehouse
from ..sources.scratch import stage
from .bindings import bind
from .common import BINDINGS, ENRICHED_SQL, JOB_TYPE_SQL, enriched, job_rows, key_sql, runner_rows
from .registry import query


@query(
    "build_dim_date",
    """, d as (select distinct cast(started_at as date) as d from b_jobs)
    select strftime(d, '%Y%m%d') as date_key, strftime(d, '%Y-%m-%d') as date,
      strftime(d, '%B %d, %Y') as date_description, isodow(d) as day_of_week,
      day(d) as day_of_month, dayofyear(d) as day_of_year, dayname(d) as day_name,
      isodow(d) < 6 as weekday, month(d) as month, monthname(d) as month_name,
      quarter(d) - 1 as quarter, year(d) as year from d""",
    "jobs",
)
def build_dim_date(spark, sf):
    out = dims.build_dim_date(bind(spark, sf, "jobs"), "started_at")
    return out.withColumn("date", F.col("date").cast("string"))


@query(
    "build_dim_time",
    """, t as (select distinct hour(started_at) as h, minute(started_at) as m,
      second(started_at) as s from b_jobs)
    select lpad(cast(h*10000 + m*100 + s as varchar), 6, '0') as time_key,
      printf('%02d:%02d:%02d', h, m, s) as time, case when h < 12 then 'AM' else 'PM' end as am_or_pm,
      case when h % 12 = 0 then 12 else h % 12 end as hour_12, h as hour_24, m as minute,
      h*60 + m as minute_of_day, s as second, m*60 + s as second_of_hour,
      h*3600 + m*60 + s as second_of_day from t""",
    "jobs",
)
def build_dim_time(spark, sf):
    return dims.build_dim_time(bind(spark, sf, "jobs"), "started_at")


@query(
    "determine_job_type",
    f"select build_id, {JOB_TYPE_SQL} as job_type from b_jobs",
    "jobs",
)
def determine_job_type(spark, sf):
    return dims.determine_job_type(bind(spark, sf, "jobs")).select("build_id", "job_type")


@query(
    "build_dim_stack_job",
    f""", r as (select distinct case when in_cluster then stack else '' end as stack,
      case when in_cluster then job_size else '' end as job_size,
      case when in_cluster then {JOB_TYPE_SQL} else '' end as job_type from b_jobs)
    select *, {key_sql('stack', 'job_size', 'job_type')} as stack_job_id from r""",
    "jobs",
)
def build_dim_stack_job(spark, sf):
    typed = dims.determine_job_type(bind(spark, sf, "jobs"))
    known = [F.when(F.col("in_cluster"), F.col(c)).alias(c) for c in ("stack", "job_size")]
    return dims.build_dim_stack_job(typed.select("build_id", "job_type", *known))


@query(
    "extract_runner_version",
    """select job_id, regexp_extract(trace || case when job_id % 2 = 0 then
      chr(10) || 'Running with gitlab-runner 16.' || (job_id % 10) || '.1 (x)' else '' end,
      'Running with gitlab-runner (\\d+\\.\\d+\\.\\d+)', 1) as gitlab_runner_version
    from b_traces""",
    "traces",
)
def extract_runner_version(spark, sf):
    line = F.expr(
        "concat(trace, case when job_id % 2 = 0 then concat(chr(10), "
        "'Running with gitlab-runner 16.', job_id % 10, '.1 (x)') else '' end)"
    )
    traces = bind(spark, sf, "traces").withColumn("trace", line)
    return dims.extract_runner_version(traces).select("job_id", "gitlab_runner_version")


@query(
    "resolve_parent_pipeline",
    "select build_id, coalesce(source_id, pipeline_id) as parent_pipeline_id from b_jobs "
    "where object_kind = 'build'",
    "jobs",
)
def resolve_parent_pipeline(spark, sf):
    jobs = dims.resolve_parent_pipeline(job_rows(spark, sf))
    return jobs.select("build_id", "parent_pipeline_id")


@query(
    "build_dim_gitlab_job",
    ENRICHED_SQL
    + f"""select distinct gitlab_runner_version, ref, tag as tags, pipeline_id, parent_pipeline_id,
      {key_sql('gitlab_runner_version', 'ref', 'tag', 'pipeline_id', 'parent_pipeline_id')}
        as gitlab_job_id from enriched""",
    *BINDINGS,
)
def build_dim_gitlab_job(spark, sf):
    out = dims.build_dim_gitlab_job(enriched(spark, sf))
    return out.withColumn("tags", F.array_join("tags", ","))


@query(
    "flag_unnecessary",
    """select job_id, regexp_matches(trace || case when job_id % 3 = 0 then
      'No need to rebuild pkg, found hash match' when job_id % 3 = 1 then
      'No need to rebuild , found hash match' else '' end,
      'No need to rebuild [^,]+, found hash match') as unnecessary from b_traces""",
    "traces",
)
def flag_unnecessary(spark, sf):
    text = F.expr(
        "concat(trace, case job_id % 3 when 0 then 'No need to rebuild pkg, found hash match' "
        "when 1 then 'No need to rebuild , found hash match' else '' end)"
    )
    traces = bind(spark, sf, "traces").withColumn("trace", text)
    return dims.flag_unnecessary(traces).select("job_id", "unnecessary")


INFRA_SQL = f"""(status = 'failed'
  and not coalesce(error_taxonomy in {fixed.USER_ERRORS}, false)
  and not coalesce(job_type = 'rebuild-index' and error_taxonomy = 'failed_to_get_specs', false))"""


@query(
    "build_dim_job_result",
    ENRICHED_SQL
    + f"""select distinct status, error_taxonomy, unnecessary, job_type, gitlab_failure_reason,
      job_exit_code, {INFRA_SQL} as infrastructure_error,
      {key_sql('status', 'error_taxonomy', 'unnecessary', 'job_type', 'gitlab_failure_reason',
               'job_exit_code')} as job_result_id from enriched""",
    *BINDINGS,
)
def build_dim_job_result(spark, sf):
    return dims.build_dim_job_result(enriched(spark, sf))


@query(
    "infrastructure_error",
    ENRICHED_SQL + f"select job_id, {INFRA_SQL} as infrastructure_error from enriched",
    *BINDINGS,
)
def infrastructure_error(spark, sf):
    return dims.infrastructure_error(enriched(spark, sf)).select("job_id", "infrastructure_error")


@query(
    "build_dim_job_retry",
    ENRICHED_SQL
    + f"""select distinct is_retry, is_manual_retry, attempt_number, final_attempt,
      {key_sql('is_retry', 'is_manual_retry', 'attempt_number', 'final_attempt')} as job_retry_id
      from enriched""",
    *BINDINGS,
)
def build_dim_job_retry(spark, sf):
    return dims.build_dim_job_retry(enriched(spark, sf))


@query(
    "build_dim_node",
    """, r as (select concat('uuid-', build_id % 50) as system_uuid,
      concat('node-', build_id % 50) as name, 4 + build_id % 3 as cpu,
      1000000 * (build_id % 64) as memory, 'spot' as capacity_type,
      concat('m', build_id % 5) as instance_type,
      row_number() over (partition by build_id % 50 order by build_id) as rn
      from b_jobs where in_cluster)
    select system_uuid, name, cpu, memory, capacity_type, instance_type from r where rn = 1""",
    "jobs",
)
def build_dim_node(spark, sf):
    nodes = bind(spark, sf, "jobs").selectExpr(
        "build_id",
        "case when in_cluster then concat('uuid-', build_id % 50) end AS system_uuid",
        "concat('node-', build_id % 50) AS name",
        "4 + build_id % 3 AS cpu",
        "1000000 * (build_id % 64) AS memory",
        "'spot' AS capacity_type",
        "concat('m', build_id % 5) AS instance_type",
    )
    return dims.build_dim_node(nodes, ["build_id"])


@query(
    "build_dim_runner",
    """select id as runner_id, description as name, platform,
      case when starts_with(description, 'runner-') then 'cluster'
        when starts_with(description, 'uo-') then 'uo' else 'unknown' end as host,
      architecture as arch, architecture as tags,
      starts_with(description, 'runner-') as in_cluster
    from b_ci_runners where id in (select runner_id from b_jobs)""",
    "jobs",
    "ci_runners",
)
def build_dim_runner(spark, sf):
    out = dims.build_dim_runner(bind(spark, sf, "jobs"), runner_rows(spark, sf))
    return out.withColumn("tags", F.array_join("tags", ","))


@query(
    "build_dim_package",
    "select distinct name from b_install_times",
    "install_times",
)
def build_dim_package(spark, sf):
    return dims.build_dim_package(bind(spark, sf, "install_times"))


SPEC_ROWS = {
    "hash": "md5(concat('p', l_partkey))",
    "name": "concat('pkg', l_partkey)",
    "version": "'1.0'",
    "compiler_name": "case when l_linenumber = 1 then 'gcc' else '' end",
    "compiler_version": "case when l_linenumber = 2 then '12' else '' end",
    "arch": "l_returnflag",
    "variants": "case when l_linenumber = 3 then concat('+', l_linestatus) else '' end",
    "ord": "l_orderkey * 100000000 + l_suppkey * 100000 + l_linenumber * 10000 "
    "+ cast(l_quantity as int) * 100 + cast(floor(l_discount * 100) as int)",
}
_SPEC_COLS = ("name", "version", "compiler_name", "compiler_version", "arch", "variants")
_FIRST = ", ".join(
    f"coalesce(arg_min({c}, ord) filter ({c} <> ''), '') as n_{c}" for c in _SPEC_COLS
)
_FILL = ", ".join(
    f"case when coalesce(s.{c}, '') = '' then coalesce(n.n_{c}, '') else s.{c} end as {c}"
    for c in _SPEC_COLS
)


@query(
    "upsert_package_spec",
    ", inc as (select "
    + ", ".join(f"{e} as {c}" for c, e in SPEC_ROWS.items())
    + f""" from lineitem), n as (select hash, {_FIRST} from inc group by hash),
    s as (select * from b_specs where known)
    select coalesce(s.hash, n.hash) as hash, {_FILL} from s full join n on s.hash = n.hash""",
    "specs",
)
def upsert_package_spec(spark, sf):
    dim = bind(spark, sf, "specs").where("known")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        *[f"{e} AS {c}" for c, e in SPEC_ROWS.items()]
    )
    return dims.upsert_package_spec(dim, rows, ["ord"])


@query(
    "add_spec_nodes",
    """, n as (select * from b_specs), old as (select * from b_specs where known)
    select 'package' as kind, name, '' as hash, '' as compiler_name from (
      select name from n union select name from b_install_times)
    union all
    select 'spec', name, hash, compiler_name from old
    union all
    select 'spec', name, hash, compiler_name from n
    where compiler_name <> '' and compiler_version <> '' and hash not in (select hash from old)""",
    "specs",
    "install_times",
)
def add_spec_nodes(spark, sf):
    nodes = bind(spark, sf, "specs")
    packages = bind(spark, sf, "install_times").select("name").distinct()
    packages, specs = dims.add_spec_nodes(packages, nodes.where("known"), nodes)
    empty = F.lit("")
    return packages.select(
        F.lit("package").alias("kind"), "name", empty.alias("hash"), empty.alias("compiler_name")
    ).unionByName(specs.select(F.lit("spec").alias("kind"), "name", "hash", "compiler_name"))


def timing_rows(spark, sf):
    """Install timings with their phases as an array, as the artifact has them."""
    rows = bind(spark, sf, "install_times")
    phase = F.struct(F.col("phase").alias("path"), F.col("seconds").alias("seconds"))
    return rows.withColumn("phases", F.array(phase)).drop("phase", "seconds")


@query(
    "build_dim_timer_phase",
    "select distinct phase as path, contains(phase, '/') as is_subphase from b_install_times",
    "install_times",
)
def build_dim_timer_phase(spark, sf):
    return dims.build_dim_timer_phase(timing_rows(spark, sf))


@query(
    "with_empty_rows",
    """select 'dim_stack_job' as dim, count(*) as members from (
      select distinct case when in_cluster then stack else '' end as a,
        case when in_cluster then job_size else '' end as b,
        case when in_cluster then """
    + JOB_TYPE_SQL
    + """ else '' end as c from b_jobs where object_kind = 'build')
    union all select 'dim_package', count(distinct case when build_name like 'pkg%' then
      concat('pkg', build_id % 7) else '' end) from b_jobs where object_kind = 'build'
    union all select 'dim_runner', 1 + count(*) from b_ci_runners where id <> 0 and id in
      (select runner_id from b_jobs where object_kind = 'build')
    union all select 'dim_timer_data', 2
    union all select 'dim_node', 1 + count(distinct build_id % 50) from b_jobs
      where in_cluster and object_kind = 'build'""",
    "jobs",
    "ci_runners",
)
def with_empty_rows(spark, sf):
    jobs = stage(enriched(spark, sf), "jobs")
    tables = warehouse.build_dimensions(jobs, runner_rows(spark, sf))
    out = None
    for name in ("dim_stack_job", "dim_package", "dim_runner", "dim_timer_data", "dim_node"):
        row = tables[name].agg(F.count(F.lit(1)).alias("members"))
        row = row.select(F.lit(name).alias("dim"), "members")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "check_constraints",
    """select 'dim_package_spec' as "table", 'no-missing-fields' as rule, hash as key from b_specs
      where not (length(name) > 0 and length(hash) = 32 and length(version) > 2)
    union all
    select 'dim_job_result', 'error-taxonomy-only-on-failed-status', cast(build_id as varchar)
      from b_jobs where build_status <> 'failed' and build_id % 9 = 0
    union all
    select 'fact_job', 'nullable-field-consistency', cast(build_id as varchar) from b_jobs
      where build_id % 6 = 5
    union all
    select 'dim_timer_phase', 'unique', phase from b_install_times group by phase
      having count(*) > 1
    union all
    select 'dim_timer_phase', 'consistent-subphase-path', phase from b_install_times
      where seconds > 40 and contains(phase, '/')
    union all
    select 'dim_time', 'am-or-pm-value', cast(build_id as varchar) from b_jobs
      where build_id % 50 = 0 and build_id <= 235959
    union all
    select 'dim_time', 'time-key-value', cast(build_id as varchar) from b_jobs
      where build_id > 235959
    union all
    select 'dim_time', 'am-or-pm-value', cast(build_id as varchar) from b_jobs
      where build_id % 50 = 0 and build_id > 235959""",
    "specs",
    "jobs",
    "install_times",
)
def check_constraints(spark, sf):
    jobs = bind(spark, sf, "jobs")
    specs = bind(spark, sf, "specs")
    phases = bind(spark, sf, "install_times").selectExpr(
        "phase AS path", "seconds <= 40 AND contains(phase, '/') AS is_subphase"
    )
    results = jobs.selectExpr(
        "cast(build_id as string) AS job_result_id",
        "build_status AS status",
        "case when build_id % 9 = 0 then 'oom' end AS error_taxonomy",
    )
    times = jobs.selectExpr(
        "cast(build_id as string) AS time_key",
        "case when build_id % 50 = 0 then 'XX' else 'AM' end AS am_or_pm",
    )
    pod = [F.col("duration_seconds").alias(c) for c in dims.POD_FIELDS[:-1]]
    last = F.expr("case when build_id % 6 <> 5 then duration_seconds end").alias(
        dims.POD_FIELDS[-1]
    )
    fact = jobs.select(F.col("build_id").alias("job_id"), *pod, last)
    return dims.check_constraints(
        {
            "dim_package_spec": specs,
            "dim_job_result": results,
            "fact_job": fact,
            "dim_timer_phase": phases,
            "dim_time": times,
        }
    )
