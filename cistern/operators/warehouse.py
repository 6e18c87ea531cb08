"""From job inputs to warehouse tables: the batch form that the stream applies to each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from . import dims, facts, logs, pipelines

#: Ids of jobs that are sent to every task, at most.
SENT_JOBS = 100_000

NO_INFO = {
    "stack": "string",
    "job_size": "string",
    "build_jobs": "int",
    "package_name": "string",
    "package_hash": "string",
    "package_version": "string",
    "compiler_name": "string",
    "compiler_version": "string",
    "arch": "string",
    "variants": "string",
    "pod_name": "string",
    "system_uuid": "string",
    "node_name": "string",
    "node_cpu": "int",
    "node_memory": "bigint",
    "capacity_type": "string",
    "instance_type": "string",
    "spot_price": "double",
    "pod_node_occupancy": "double",
    "pod_cpu_usage_seconds": "double",
    "pod_max_mem": "bigint",
    "pod_avg_mem": "double",
}


def with_columns_of(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Adds the wanted columns that are absent, as NULL."""
    absent = [F.lit(None).cast(t).alias(c) for c, t in wanted.items() if c not in df.columns]
    return df.select("*", *absent) if absent else df


def flatten_events(events: DataFrame) -> DataFrame:
    """Webhook events as job rows: times parsed, runner and source pipeline taken apart."""
    ok = facts.filter_finished_builds(events)

    def ts(c: str):
        return F.regexp_replace(c, " UTC$", "").try_cast("timestamp_ntz")

    return ok.select(
        "build_id",
        "build_name",
        "build_stage",
        "build_status",
        "build_failure_reason",
        ts("build_started_at").alias("started_at"),
        F.col("build_duration").alias("duration_seconds"),
        "ref",
        "pipeline_id",
        F.col("runner.id").alias("runner_id"),
        F.coalesce("runner.tags", F.array().cast("array<string>")).alias("tags"),
        "source_pipeline",
    )


def trace_features(traces: DataFrame) -> DataFrame:
    """What the warehouse keeps of each trace, computed where the trace is read.

    error_class is the first taxonomy class found; it counts only for jobs that failed, so pass
    the traces of failed jobs alone where they are stored apart.
    """
    text = traces.withColumn("trace", F.coalesce("trace", F.lit("")))
    read = text.withColumn("error_class", logs.first_class("trace"))
    read = dims.flag_unnecessary(dims.extract_runner_version(read))
    read = facts.section_timer_columns(facts.section_timers(read))
    return read.select(
        "job_id", "error_class", "gitlab_runner_version", "unnecessary",
        *[f"gitlab_{s}" for s in fixed.SECTION_TIMERS],
    )


def enrich_jobs(
    jobs: DataFrame,
    traces: DataFrame,
    retry: DataFrame,
    exit_codes: DataFrame,
    info: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One row per started job with every column the dimensions and the fact need, and rejects.

    jobs: flatten_events columns; traces: job_id, trace; retry: build_id, retry_max,
    retry_reasons, attempt_number; exit_codes: build_id, job_exit_code; info: job_id and any
    columns of NO_INFO.

    Only the short columns of trace_features are joined: the text itself is never shuffled. Where the
    jobs are at most SENT_JOBS, as in a micro-batch, their ids are sent along and only their traces
    are searched; the rows are the same.
    """
    started = facts.filter_started(jobs)
    rejects = dims.job_type_rejects(started)
    known = dims.determine_job_type(started).where("job_type IS NOT NULL")
    asked = started.select(F.col("build_id").alias("job_id"))
    if asked.limit(SENT_JOBS + 1).count() <= SENT_JOBS:
        traces = traces.join(F.broadcast(asked), "job_id", "left_semi")
    features = trace_features(traces).withColumnRenamed("job_id", "build_id")
    df = (
        known.join(features, "build_id", "left")
        .join(retry, "build_id", "left")
        .join(exit_codes, "build_id", "left")
    )
    no_trace = {
        "gitlab_runner_version": F.lit(""),
        "unnecessary": F.lit(False),
        **{f"gitlab_{s}": F.lit(0).cast("bigint") for s in fixed.SECTION_TIMERS},
    }
    df = df.withColumns({c: F.coalesce(c, v) for c, v in no_trace.items()})
    taxonomy = logs.settle_taxonomy(F.col("error_class"), "build_failure_reason")
    df = df.withColumn("error_taxonomy", F.when(F.col("build_status") == "failed", taxonomy))
    df = df.drop("error_class")
    df = dims.resolve_parent_pipeline(df)
    df = df.withColumn("attempt_number", F.coalesce("attempt_number", F.lit(1)).cast("int"))
    df = pipelines.retry_info(df)
    df = df.withColumnsRenamed(
        {
            "build_id": "job_id",
            "build_name": "name",
            "build_status": "status",
            "build_failure_reason": "gitlab_failure_reason",
        }
    )
    if info is not None:
        df = df.join(info, "job_id", "left")
    return facts.job_cost(with_columns_of(df, NO_INFO)), rejects


def timer_data(spark) -> DataFrame:
    return spark.range(2).select((F.col("id") == 1).alias("cache"))


def build_dimensions(jobs: DataFrame, runners: DataFrame) -> dict[str, DataFrame]:
    """Every dimension of the job fact from enriched jobs."""
    node = jobs.select(
        "job_id",
        "system_uuid",
        F.col("node_name").alias("name"),
        F.col("node_cpu").alias("cpu"),
        F.col("node_memory").alias("memory"),
        "capacity_type",
        "instance_type",
    )
    packages = jobs.where("package_name IS NOT NULL").select(F.col("package_name").alias("name"))
    spec = jobs.where("package_hash IS NOT NULL").select(
        "job_id",
        F.col("package_hash").alias("hash"),
        F.col("package_name").alias("name"),
        F.col("package_version").alias("version"),
        "compiler_name",
        "compiler_version",
        "arch",
        "variants",
    )
    no_specs = spec.select("hash", *dims.SPEC_FIELDS).limit(0)
    tables = {
        "dim_date": dims.build_dim_date(jobs, "started_at"),
        "dim_time": dims.build_dim_time(jobs, "started_at"),
        "dim_stack_job": dims.build_dim_stack_job(jobs),
        "dim_gitlab_job": dims.build_dim_gitlab_job(jobs),
        "dim_job_result": dims.build_dim_job_result(jobs),
        "dim_job_retry": dims.build_dim_job_retry(jobs),
        "dim_node": dims.build_dim_node(node, ["job_id"]),
        "dim_runner": dims.build_dim_runner(jobs, runners),
        "dim_package": dims.build_dim_package(packages),
        "dim_package_spec": dims.upsert_package_spec(no_specs, spec, ["job_id"]),
        "dim_timer_data": timer_data(jobs.sparkSession),
    }
    return dims.with_empty_rows(tables)


def build_warehouse(
    jobs: DataFrame, runners: DataFrame, existing_fact: DataFrame | None = None, *,
    job_url_prefix: str,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Dimensions and the job fact of enriched jobs, which are staged or persisted: each table reads them."""
    tables = build_dimensions(jobs, runners)
    keyed = dims.with_runner_key(jobs, tables["dim_runner"])
    return tables, facts.build_fact_job(
        keyed, existing_fact, job_url_prefix=job_url_prefix, kept=True
    )
