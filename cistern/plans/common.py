"""Enriched jobs over the given tables, and the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, taxonomy_values
from ..operators import facts, pipelines, warehouse
from .bindings import bind


#: Addresses that the site is to name.
JOB_URL_PREFIX = "https://ci.example/jobs/"
BASE_DOC_URL = "https://ci.example/deferred"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


JOB_TYPE_SQL = (
    "case when contains(build_name, '-generate') then 'generate' when build_name in ("
    + ", ".join(quote(n) for n in fixed.NAMED_JOB_TYPES)
    + ") then build_name when regexp_matches(build_stage, '^stage-\\d+$') then 'build' end"
)


def case_sql(values: dict, on: str) -> str:
    def lit(v):
        return quote(v) if isinstance(v, str) else str(v)

    return f"case {on} " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in values.items()) + " end"


def reason_sql(code: str) -> str:
    return f"case when {code} is null then 'unknown_failure' else {case_sql(fixed.FAILURE_REASONS, code)} end"


def found_sql(text: str, patterns) -> str:
    return "(" + " or ".join(f"regexp_matches({text}, {quote(p)})" for p in patterns) + ")"


def taxonomy_sql(text: str, reason: str) -> str:
    whens = " ".join(
        f"when {found_sql(text, taxonomy_values.CLASSES[c])} then {quote(c)}"
        for c in taxonomy_values.ORDER
    )
    self_named = ", ".join(quote(r) for r in fixed.SELF_NAMED_REASONS)
    return f"case {whens} when {reason} in ({self_named}) then {reason} else 'other' end"


def key_sql(*cols: str) -> str:
    parts = ", ".join(f"coalesce(cast({c} as varchar), '<null>')" for c in cols)
    return f"md5(concat_ws(chr(31), {parts}))"


INFO = {
    "stack": "case when in_cluster then stack end",
    "job_size": "case when in_cluster then job_size end",
    "build_jobs": "cast(case when build_id % 2 = 0 then build_id % 16 end as int)",
    "package_version": "case when build_name like 'pkg%' then concat('1.', build_id % 5) end",
    "compiler_name": "case when build_id % 4 = 0 then '' else 'gcc' end",
    "compiler_version": "case when build_id % 4 = 0 then '' else '12' end",
    "arch": "'x86_64'",
    "variants": "case when build_id % 2 = 0 then '' else '+shared' end",
    "package_name": "case when build_name like 'pkg%' then concat('pkg', build_id % 7) end",
    "package_hash": "case when build_name like 'pkg%' then md5(concat('p', build_id % 35)) end",
    "pod_name": "case when in_cluster then concat('pod-', build_id) end",
    "system_uuid": "case when in_cluster then concat('uuid-', build_id % 50) end",
    "node_name": "case when in_cluster then concat('node-', build_id % 50) end",
    "node_cpu": "cast(case when in_cluster then 4 + build_id % 3 end as int)",
    "node_memory": "case when in_cluster then 1000000 * (build_id % 64) end",
    "capacity_type": "case when in_cluster then 'spot' end",
    "instance_type": "case when in_cluster then concat('m', build_id % 5) end",
    "spot_price": "case when in_cluster then cast(build_id % 10 as double) / 8 end",
    "pod_node_occupancy": "case when in_cluster then 1 / cast(1 + build_id % 4 as double) end",
    "pod_cpu_usage_seconds": "case when in_cluster then duration_seconds end",
    "pod_max_mem": "case when in_cluster then build_id * 10 end",
    "pod_avg_mem": "case when in_cluster then cast(build_id * 5 as double) end",
}


def job_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The jobs binding shaped like flattened webhook events."""
    named = pipelines.failure_reason_name(bind(spark, sf, "jobs"))
    return named.where("object_kind = 'build'").select(
        "build_id",
        "build_name",
        "build_stage",
        "build_status",
        "build_failure_reason",
        "started_at",
        "duration_seconds",
        "ref",
        "pipeline_id",
        "runner_id",
        F.array("tag").alias("tags"),
        F.struct(F.col("source_id").alias("pipeline_id")).alias("source_pipeline"),
    )


def retry_rows(spark: SparkSession, sf: str) -> DataFrame:
    builds = bind(spark, sf, "jobs").select(
        F.col("build_id").alias("id"),
        F.col("pipeline_id").alias("commit_id"),
        F.col("build_name").alias("name"),
        F.col("retry_max").cast("int").alias("retry_max"),
        F.array(F.when(F.col("build_id") % 2 == 0, "always").otherwise("script_failure"))
        .alias("retry_reasons"),
    )
    ranked = pipelines.attempt_number(builds)
    return ranked.select(
        F.col("id").alias("build_id"), "retry_max", "retry_reasons", "attempt_number"
    )


def info_rows(spark: SparkSession, sf: str) -> DataFrame:
    return bind(spark, sf, "jobs").selectExpr(
        "build_id AS job_id", *[f"{e} AS {c}" for c, e in INFO.items()]
    )


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    codes = bind(spark, sf, "jobs").selectExpr(
        "build_id", "cast(exit_code as int) AS job_exit_code"
    )
    jobs, _ = warehouse.enrich_jobs(
        job_rows(spark, sf),
        bind(spark, sf, "traces").select("job_id", "trace"),
        retry_rows(spark, sf),
        codes,
        info_rows(spark, sf),
    )
    return jobs


def runner_rows(spark: SparkSession, sf: str) -> DataFrame:
    return bind(spark, sf, "ci_runners").select(
        F.col("id").alias("runner_id"),
        "description",
        "platform",
        "architecture",
        F.array(F.col("architecture")).alias("tag_list"),
    )


_INFO_SQL = ", ".join(f"{e} as i_{c}" for c, e in INFO.items())
ENRICHED_SQL = f"""
, attempts as (
  select *, row_number() over (partition by pipeline_id, build_name order by build_id) as attempt_number
  from b_jobs
), raw as (
  select j.build_id as job_id, j.build_name as name, j.build_stage, j.build_status as status,
    j.started_at, j.duration_seconds, j.ref, j.pipeline_id, j.runner_id, j.tag, j.attempt_number,
    coalesce(j.source_id, j.pipeline_id) as parent_pipeline_id,
    coalesce(t.trace, '') as trace, j.retry_max, j.exit_code as job_exit_code,
    {JOB_TYPE_SQL} as job_type, {reason_sql('failure_code')} as gitlab_failure_reason,
    {_INFO_SQL}
  from attempts j left join b_traces t on t.job_id = j.build_id
  where object_kind = 'build'
), enriched as (
  select *,
    regexp_extract(trace, 'Running with gitlab-runner (\\d+\\.\\d+\\.\\d+)', 1) as gitlab_runner_version,
    regexp_matches(trace, 'No need to rebuild [^,]+, found hash match') as unnecessary,
    case when status = 'failed' then {taxonomy_sql('trace', 'gitlab_failure_reason')} end as error_taxonomy,
    attempt_number > 1 as is_retry, attempt_number > retry_max + 1 as is_manual_retry,
    not (retry_max <> 0 and (job_id % 2 = 0 or gitlab_failure_reason = 'script_failure')
         and attempt_number <= retry_max) as final_attempt
  from raw
)"""
BINDINGS = ("jobs", "traces")



def ts_text(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


DUCK_TS = "'%Y-%m-%d %H:%M:%S'"
