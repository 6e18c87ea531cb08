"""Fact builders: jobs, timers and timer phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import ColumnOrName, as_column, one_per
from ..sources.scratch import stage
from . import dims

TIMER_KEY = ["job_id", "date_key", "time_key", "cache", "package", "spec_hash"]
PHASE_KEY = [*TIMER_KEY, "phase"]


def filter_finished_builds(df: DataFrame) -> DataFrame:
    """Finished build events only."""
    return df.where(
        (F.col("object_kind") == "build") & F.col("build_status").isin("success", "failed")
    )


def filter_started(df: DataFrame, started_at: str = "started_at") -> DataFrame:
    return df.where(F.col(started_at).isNotNull())


def section_timers(df: DataFrame, trace: str = "trace") -> DataFrame:
    """Adds section_timers, a map of section name to seconds.

    Markers are paired by position: the value is the time between the two, under the first's name,
    whatever kind or name the second has. An odd marker at the end is dropped, and the last pair of
    a name wins.
    """
    marks = df.withColumn(
        "_marks", F.regexp_extract_all(F.col(trace), F.lit(fixed.SECTION_MARKER), F.lit(0))
    )

    def seconds(mark: Column) -> Column:
        return F.split(mark, ":", 3)[1].cast("bigint")

    pair = F.transform(
        "_marks",
        lambda m, i: F.when(
            (i % 2 == 0) & (i + 1 < F.size("_marks")),
            F.struct(
                F.split(m, ":", 3)[2].alias("name"),
                (seconds(F.get("_marks", i + 1)) - seconds(m)).alias("seconds"),
            ),
        ),
    )
    pairs = marks.withColumn("_pairs", F.filter(pair, lambda p: p.isNotNull()))
    names = F.col("_pairs.name")
    last = F.filter(
        "_pairs",
        lambda p, i: F.size("_pairs") - F.array_position(F.reverse(names), p["name"]) == i,
    )
    out = pairs.withColumn("section_timers", F.map_from_entries(last))
    return out.drop("_marks", "_pairs")


def section_timer_columns(df: DataFrame) -> DataFrame:
    """The section timers that the job fact keeps, 0 where a section did not run."""
    return df.select(
        "*",
        *[
            F.coalesce(F.try_element_at("section_timers", F.lit(s)), F.lit(0).cast("bigint"))
            .alias(f"gitlab_{s}")
            for s in fixed.SECTION_TIMERS
        ],
    )


def parse_job_name(df: DataFrame, name: str = "build_name") -> DataFrame:
    """`pkg@version /hash ...` as columns; parts that are not there are NULL."""
    tokens = F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")
    spec = F.split(F.get(tokens, F.lit(0)), "@")
    return df.select(
        "*",
        F.get(spec, F.lit(0)).alias("package_name"),
        F.get(spec, F.lit(1)).alias("package_version"),
        F.btrim(F.get(tokens, F.lit(1)), F.lit("/")).alias("package_hash"),
    )


PACKAGE_FIELDS = ("name", "hash", "version", "compiler_name", "compiler_version", "arch", "variants")


def info_route(
    has_metrics: Column, missing_label: Column, has_artifacts: Column, missing_variable: Column
) -> tuple[Column, Column]:
    """Source of a job's details, and the reason if none can describe it.

    Columns is_build, status, package_version and package_hash (of the name) are read.
    """
    named = F.col("package_version").isNotNull() & F.col("package_hash").isNotNull()
    source = (
        F.when(has_metrics & F.col("is_build") & missing_label.isNotNull(), "reject")
        .when(has_metrics, "metrics")
        .when(~F.col("is_build"), "none")
        .when(has_artifacts & missing_variable.isNotNull(), "reject")
        .when(has_artifacts, "artifacts")
        .when((F.col("status") == "failed") & named, "name")
        .otherwise("reject")
    )
    reason = (
        F.when(has_metrics, F.concat(F.lit("missing label "), missing_label))
        .when(has_artifacts, F.concat(F.lit("missing variable "), missing_variable))
        .when(F.col("status") == "failed", F.lit("job name does not name a package"))
        .otherwise(F.lit("no artifacts"))
    )
    return source, reason


def job_info_cascade(
    jobs: DataFrame, metrics: DataFrame, artifacts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Job details from the best source that has them, and the jobs none can describe.

    jobs: job_id, name, status, is_build
    metrics: job_id, missing_label, package, misc, pod, node (structs), one row per job found
    artifacts: job_id, missing_variable, package, misc, one row per job with artifacts

    Metrics win; then, for builds, the artifacts; then, for failed builds, the job's name. A
    source that is there but lacks a required label or variable is an error, not a reason to look
    further. Other jobs without metrics have no details.
    """
    m = metrics.select(
        "job_id",
        F.lit(True).alias("has_metrics"),
        "missing_label",
        F.col("package").alias("m_package"),
        F.col("misc").alias("m_misc"),
        "pod",
        "node",
    )
    a = artifacts.select(
        "job_id",
        F.lit(True).alias("has_artifacts"),
        "missing_variable",
        F.col("package").alias("a_package"),
        F.col("misc").alias("a_misc"),
    )
    joined = parse_job_name(jobs.join(m, "job_id", "left").join(a, "job_id", "left"), "name")
    has_metrics = F.coalesce("has_metrics", F.lit(False))
    has_artifacts = F.coalesce("has_artifacts", F.lit(False))
    source, reason = info_route(
        has_metrics, F.col("missing_label"), has_artifacts, F.col("missing_variable")
    )
    from_name = F.struct(
        F.col("package_name").alias("name"),
        F.col("package_hash").alias("hash"),
        F.col("package_version").alias("version"),
        *[F.lit("").alias(c) for c in PACKAGE_FIELDS[3:]],
    )
    out = joined.withColumn("info_source", source)
    by_metrics = F.col("info_source") == "metrics"
    info = out.where("info_source <> 'reject'").select(
        "job_id",
        "info_source",
        F.when(by_metrics & F.col("is_build"), F.col("m_package"))
        .when(F.col("info_source") == "artifacts", F.col("a_package"))
        .when(F.col("info_source") == "name", from_name)
        .alias("package"),
        F.when(by_metrics & F.col("is_build"), F.col("m_misc"))
        .when(F.col("info_source") == "artifacts", F.col("a_misc"))
        .alias("misc"),
        F.when(by_metrics, F.col("pod")).alias("pod"),
        F.when(by_metrics, F.col("node")).alias("node"),
    )
    rejects = out.where("info_source = 'reject'").select(
        F.col("job_id").alias("key"),
        F.lit("job_info_cascade").alias("operator"),
        reason.alias("reason"),
    )
    return info, rejects


def job_cost(df: DataFrame) -> DataFrame:
    """Share of the node's hourly price for the time the job ran; NULL off the cluster."""
    per_second = F.col("spot_price") / 3600
    return df.select(
        "*",
        (F.col("duration_seconds") * F.col("pod_node_occupancy") * per_second)
        .cast("decimal(13,10)")
        .alias("cost"),
        per_second.cast("decimal(9,8)").alias("node_price_per_second"),
    )


FACT_DESCRIPTION = ("name", "pod_name", "job_url", "duration_seconds")
FACT_MEASURES = (
    "cost",
    "pod_node_occupancy",
    "pod_cpu_usage_seconds",
    "pod_max_mem",
    "pod_avg_mem",
    "node_price_per_second",
    "node_cpu",
    "node_memory",
    "build_jobs",
    "pod_cpu_request",
    "pod_cpu_limit",
    "pod_memory_request",
    "pod_memory_limit",
)


def build_fact_job(
    jobs: DataFrame, existing: DataFrame | None = None, *, job_url_prefix: str, kept: bool = False
) -> DataFrame:
    """One row per job; jobs that already have a row keep it. job_url_prefix: where job pages live.

    Foreign keys are computed from the job's own columns, so no dimension is joined here. Measures
    a source does not provide are NULL, section timers 0. kept: the jobs are staged or persisted, so
    that it costs little to read them again: ids that come more than once are looked up first, and only
    their rows are shuffled and sorted (`repeated_facts`).
    """
    have = set(jobs.columns)
    empty = F.lit("")
    measures = [F.col(c) if c in have else F.lit(None).cast("double").alias(c)
                for c in FACT_MEASURES]
    timers = [f"gitlab_{s}" for s in fixed.SECTION_TIMERS]
    rows = dims.with_stack_job(jobs).select(
        "job_id",
        dims.date_key("started_at").alias("start_date_key"),
        dims.time_key("started_at").alias("start_time_key"),
        F.coalesce("system_uuid", F.lit(dims.EMPTY_NODE)).alias("node_id"),
        F.coalesce("runner_id", F.lit(dims.EMPTY_RUNNER)).alias("runner_id"),
        F.coalesce("package_name", empty).alias("package"),
        F.coalesce("package_hash", empty).alias("spec_hash"),
        "stack_job_id",
        dims.gitlab_job_key().alias("gitlab_job_id"),
        dims.job_result_key().alias("job_result_id"),
        dims.job_retry_key().alias("job_retry_id"),
        F.coalesce("name", empty).alias("name"),
        F.coalesce("pod_name", empty).alias("pod_name"),
        F.concat(F.lit(job_url_prefix), F.col("job_id").cast("string")).alias("job_url"),
        "duration_seconds",
        *measures,
        *[F.col(t) if t in have else F.lit(0).cast("bigint").alias(t) for t in timers],
    )
    repeated = repeated_facts(jobs, ["job_id"]) if kept else None
    return new_facts(rows, ["job_id"], existing, repeated)


def repeated_facts(rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys of more than one row, staged: their size is known, so a few are sent to every task."""
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return stage(counted.where("_n > 1").select(*key), "repeated")


def new_facts(
    rows: DataFrame, key: list[str], existing: DataFrame | None, repeated: DataFrame | None = None
) -> DataFrame:
    """Duplicates of a key give the smallest of their rows, and keys already stored give none.

    repeated: the keys that come more than once, where they are known. All other rows stay where they are.
    """
    if repeated is None:
        fresh = one_per(rows, key)
    else:
        theirs = repeated.select(*[F.col(c).alias(f"_{c}") for c in key])
        same = F.lit(True)
        for c in key:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        many = one_per(rows.join(theirs, same, "left_semi"), key)
        fresh = rows.join(theirs, same, "left_anti").unionByName(many)
    if existing is None:
        return fresh
    return fresh.join(existing.select(*key), key, "left_anti").select(*rows.columns)


def key_timestamp(date_col: ColumnOrName, time_col: ColumnOrName) -> Column:
    """Timestamp of a (yyyyMMdd, HHmmss) key pair; NULL when either is malformed."""
    d, t = as_column(date_col), as_column(time_col)
    text = F.format_string(
        "%s-%s-%s %s:%s:%s",
        F.substring(d, 1, 4),
        F.substring(d, 5, 2),
        F.substring(d, 7, 2),
        F.substring(t, 1, 2),
        F.substring(t, 3, 2),
        F.substring(t, 5, 2),
    )
    return F.when(F.concat(d, t).rlike(r"^\d{14}$"), text.try_cast("timestamp_ntz"))


def generated_timestamps(
    df: DataFrame, date_col: str = "start_date_key", time_col: str = "start_time_key"
) -> DataFrame:
    """Adds started_at (to the second) and finished_at = started_at + duration."""
    started = df.withColumn("started_at", key_timestamp(date_col, time_col))
    length = F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.col("duration_seconds").cast("decimal(18,6)")
    )
    return started.withColumn("finished_at", F.col("started_at") + length)


def select_timings(timings: DataFrame, jobs: DataFrame, unknown: bool = False) -> DataFrame:
    """Timings of successful builds that came from cache or belong to the package being built.

    jobs: job_id, status, job_type, spec_hash, start_date_key, start_time_key. unknown: timings of jobs
    that aren't there are given as well, by the same join; `known` tells the two kinds apart.
    """
    own = jobs.select(
        "job_id",
        F.col("spec_hash").alias("own_hash"),
        F.col("start_date_key").alias("date_key"),
        F.col("start_time_key").alias("time_key"),
        F.expr("job_type = 'build' AND status = 'success'").alias("_counts"),
        F.lit(True).alias("known"),
    )
    ours = F.col("_counts") & F.expr("cache OR hash = own_hash")
    if unknown:
        joined = timings.join(own, "job_id", "left").withColumn("known", F.col("known").isNotNull())
        return joined.where(~F.col("known") | ours).drop("own_hash", "_counts")
    joined = timings.join(own.where("_counts"), "job_id")
    return joined.where(ours).drop("own_hash", "_counts", "known")


def build_fact_timer(
    timings: DataFrame,
    packages: DataFrame,
    specs: DataFrame,
    existing: DataFrame | None = None,
) -> DataFrame:
    """One row per selected timing whose package and spec are known."""
    rows = known_timings(timings, packages, specs).select(
        *TIMER_KEY, F.col("total").alias("total_duration")
    )
    return new_facts(rows, TIMER_KEY, existing)


def known_timings(timings: DataFrame, packages: DataFrame, specs: DataFrame) -> DataFrame:
    return (
        timings.withColumnRenamed("name", "package")
        .withColumnRenamed("hash", "spec_hash")
        .join(packages.select(F.col("name").alias("package")), "package", "left_semi")
        .join(specs.select(F.col("hash").alias("spec_hash")), "spec_hash", "left_semi")
    )


def build_fact_timer_phase(
    timings: DataFrame,
    packages: DataFrame,
    specs: DataFrame,
    existing: DataFrame | None = None,
) -> DataFrame:
    """One row per phase of a known timing, with its share of the timing's total."""
    phases = known_timings(timings, packages, specs).withColumn("p", F.explode("phases"))
    rows = phases.select(
        *TIMER_KEY,
        F.col("p.path").alias("phase"),
        F.col("p.seconds").alias("duration"),
        F.try_divide(F.col("p.seconds"), F.col("total")).alias("ratio_of_total"),
    )
    return new_facts(rows, PHASE_KEY, existing)


STAR_KEYS = {
    "dim_date": ("start_date_key", "date_key"),
    "dim_time": ("start_time_key", "time_key"),
    "dim_node": ("node_id", "system_uuid"),
    "dim_runner": ("runner_id", "runner_id"),
    "dim_package_spec": ("spec_hash", "hash"),
    "dim_stack_job": ("stack_job_id", "stack_job_id"),
    "dim_gitlab_job": ("gitlab_job_id", "gitlab_job_id"),
    "dim_job_result": ("job_result_id", "job_result_id"),
    "dim_job_retry": ("job_retry_id", "job_retry_id"),
}


def star_join(fact: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Fact with the columns of each given dimension, prefixed by the dimension's name.

    No hint is given: the optimizer broadcasts the dimensions whose measured size allows it and
    sort-merges the others.
    """
    out = fact
    for name, dim in tables.items():
        fk, key = STAR_KEYS[name]
        prefix = name.removeprefix("dim_")
        renamed = dim.select(*[F.col(c).alias(f"{prefix}_{c}") for c in dim.columns])
        out = out.join(renamed, F.col(fk) == F.col(f"{prefix}_{key}"), "left")
    return out
