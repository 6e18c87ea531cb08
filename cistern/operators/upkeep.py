"""Warehouse upkeep: backfill, repairs and re-keying."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dims
from .pipelines import _lit_ts, failure_reason_name, runner_type_name

JOB_PROJECT = 57


def runner_tags(taggings: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct tag names per runner, sorted."""
    named = taggings.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id", "left")
    return named.groupBy("runner_id").agg(F.array_sort(F.collect_set("name")).alias("tags"))


def _seconds(later: str, earlier: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(earlier), F.col(later)) / F.lit(1_000_000.0)


def webhook_from_tables(
    builds: DataFrame, stages: DataFrame, pipelines: DataFrame, runners: DataFrame,
    projects: DataFrame, users: DataFrame, links: DataFrame, tags: DataFrame,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Build events as the webhook would have sent them, ordered by build id.

    tags: the output of runner_tags. Lookup tables join by their primary keys; only the builds
    asked for take part.
    """
    b = builds if ids is None else builds.join(ids.select("id"), "id", "left_semi")
    s = stages.select(F.col("id").alias("stage_id"), F.col("name").alias("stage_name"))
    p = pipelines.select(F.col("id").alias("commit_id"), F.col("id").alias("pipeline_id"), "sha",
                         F.col("status").alias("pipeline_status"))
    r = runners.select(F.col("id").alias("runner_id"), "description", "runner_type", "active")
    j = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"),
                        "web_url")
    u = users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"), "username")
    k = links.select("pipeline_id", "source_pipeline_id", "source_job_id")
    df = (
        b.join(j, "project_id", "left")
        .join(s, "stage_id", "left")
        .join(r, "runner_id", "left")
        .join(u, "user_id", "left")
        .join(p, "commit_id", "left")
        .join(k, "pipeline_id", "left")
        .join(tags, "runner_id", "left")
    )
    shared = F.coalesce(F.col("runner_type") == 1, F.lit(False))
    return df.select(
        F.lit("build").alias("object_kind"),
        "ref",
        F.col("id").alias("build_id"),
        F.col("name").alias("build_name"),
        F.col("stage_name").alias("build_stage"),
        F.col("status").alias("build_status"),
        F.col("created_at").alias("build_created_at"),
        F.col("started_at").alias("build_started_at"),
        F.col("finished_at").alias("build_finished_at"),
        _seconds("finished_at", "started_at").alias("build_duration"),
        _seconds("started_at", "created_at").alias("build_queued_duration"),
        F.col("allow_failure").alias("build_allow_failure"),
        F.col("failure_reason").alias("build_failure_reason"),
        "pipeline_id",
        F.struct(
            F.col("runner_id").alias("id"), "description", "runner_type", "active",
            shared.alias("is_shared"), "tags",
        ).alias("runner"),
        "project_id",
        "project_name",
        F.struct(F.col("user_id").alias("id"), F.col("user_name").alias("name"), "username",
                 F.lit("[REDACTED]").alias("email")).alias("user"),
        F.struct(F.col("pipeline_id").alias("id"), "sha",
                 F.col("pipeline_status").alias("status")).alias("commit"),
        F.struct(F.col("project_id").alias("id"), F.col("project_name").alias("name"), "web_url")
        .alias("project"),
        F.struct(F.col("source_job_id").alias("job_id"),
                 F.col("source_pipeline_id").alias("pipeline_id")).alias("source_pipeline"),
    ).orderBy("build_id")


def backfill_candidates(
    builds: DataFrame, facts: DataFrame, start: datetime, end: datetime,
    project_id: int = JOB_PROJECT,
) -> DataFrame:
    """Finished builds of the project in the range (ends included) without a fact in it."""
    a, z = _lit_ts(start), _lit_ts(end)
    wanted = builds.where(
        (F.col("project_id") == project_id)
        & (F.col("type") == "Ci::Build")
        & F.col("status").isin("success", "failed")
        & F.col("finished_at").between(a, z)
    ).select("id")
    have = facts.where(F.col("finished_at").between(a, z)).select(F.col("job_id").alias("id"))
    return wanted.join(have, "id", "left_anti").orderBy("id")


def fix_backfill_rows(df: DataFrame) -> DataFrame:
    """Start falls back to creation, codes become names, times become webhook text."""
    named = failure_reason_name(df.withColumnRenamed("build_failure_reason", "_code"), "_code")
    named = runner_type_name(named.withColumn("_type", F.col("runner.runner_type")), "_type")

    def text(c: Column) -> Column:
        return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))

    started = F.coalesce("build_started_at", "build_created_at")
    changed = {
        "build_created_at": text(F.col("build_created_at")),
        "build_started_at": text(started),
        "build_finished_at": text(F.col("build_finished_at")),
        "runner": F.col("runner").withField("runner_type", F.col("runner_type_name")),
    }
    return named.select(*[changed.get(c, F.col(c)).alias(c) for c in df.columns])


def update_parent_pipelines(dim: DataFrame, links: DataFrame) -> DataFrame:
    """Fill missing parents.

    A pipeline is in scope when some row of it has no parent. All rows of an in-scope pipeline
    take the link's parent if there is one; other missing parents become the pipeline itself.
    """
    scope = dim.where("parent_pipeline_id IS NULL AND pipeline_id IS NOT NULL").select(
        "pipeline_id"
    ).distinct()
    known = (
        links.where("source_pipeline_id IS NOT NULL")
        .join(scope, "pipeline_id", "left_semi")
        .groupBy("pipeline_id")
        .agg(F.max("source_pipeline_id").alias("_parent"))
    )
    return dim.join(known, "pipeline_id", "left").select(
        *[
            F.coalesce("_parent", "parent_pipeline_id", "pipeline_id").alias(c)
            if c == "parent_pipeline_id"
            else F.col(c)
            for c in dim.columns
        ]
    )


def dedupe_job_facts(df: DataFrame) -> DataFrame:
    """Of each job with several rows drop the one with the largest id, and only that one."""
    worst = df.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id"))
    return df.join(worst.where("n > 1").select("id"), "id", "left_anti").select(*df.columns)


def split_job_dimension(wide: DataFrame) -> dict[str, DataFrame]:
    """One wide job dimension as four dimensions, and the fact columns with their keys."""
    gitlab = dims.gitlab_job_key().alias("gitlab_job_id")
    result = dims.job_result_key().alias("job_result_id")
    retry = dims.job_retry_key().alias("job_retry_id")
    return {
        "dim_stack_job": dims.build_dim_stack_job(wide),
        "dim_gitlab_job": dims.build_dim_gitlab_job(wide),
        "dim_job_result": dims.build_dim_job_result(wide),
        "dim_job_retry": dims.build_dim_job_retry(wide),
        "fact": dims.with_stack_job(wide).select(
            "job_id", "stack_job_id", gitlab, result, retry, "job_url", "name",
            F.coalesce("pod_name", F.lit("")).alias("pod_name"),
        ),
    }


TIME_KEY_COLUMNS = {
    "dim_time": "time_key",
    "fact_job": "start_time_key",
    "fact_timer": "time_key",
    "fact_timer_phase": "time_key",
}


def pad_time_keys(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Whole-number time keys as six characters, in the dimension and every fact."""
    return {
        name: df.withColumn(
            TIME_KEY_COLUMNS[name],
            F.lpad(F.col(TIME_KEY_COLUMNS[name]).cast("string"), 6, "0"),
        )
        for name, df in tables.items()
    }


def unpad_time_keys(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        name: df.withColumn(
            TIME_KEY_COLUMNS[name],
            F.col(TIME_KEY_COLUMNS[name]).cast("int").cast("string"),
        )
        for name, df in tables.items()
    }


def fill_exit_codes(jobs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Failed jobs take the exit code the CI database has for them."""
    codes = metadata.where("exit_code IS NOT NULL").select(
        F.col("build_id").alias("job_id"), F.col("exit_code").alias("_code")
    )
    joined = jobs.join(codes, "job_id", "left")
    code = F.when(F.col("status") == "failed", F.coalesce("_code", "job_exit_code")).otherwise(
        F.col("job_exit_code")
    )
    return joined.withColumn("job_exit_code", code).select(*jobs.columns)


def fill_failure_reasons(jobs: DataFrame, builds: DataFrame) -> DataFrame:
    """Successful jobs get unknown_failure, failed ones the name of their build's code."""
    reasons = failure_reason_name(builds, "failure_reason").select(
        F.col("id").alias("job_id"), F.col("build_failure_reason").alias("_reason")
    )
    joined = jobs.join(reasons, "job_id", "left")
    reason = (
        F.when(F.col("status") == "success", "unknown_failure")
        .when(F.col("status") == "failed", F.coalesce("_reason", "gitlab_failure_reason"))
        .otherwise(F.col("gitlab_failure_reason"))
    )
    return joined.withColumn("gitlab_failure_reason", reason).select(*jobs.columns)
