"""Dimension builders.

Keys are hashes of the natural key, so a fact row can compute its foreign keys by itself and a
builder never needs a lookup join. Get-or-create is "distinct, minus what exists".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import (
    ColumnOrName,
    as_column,
    get_or_create,
    is_true,
    list_text,
    surrogate_key,
)

STACK_JOB_KEY = ("stack", "job_size", "job_type")
RESULT_KEY = (
    "status",
    "error_taxonomy",
    "unnecessary",
    "job_type",
    "gitlab_failure_reason",
    "job_exit_code",
)
RETRY_KEY = ("is_retry", "is_manual_retry", "attempt_number", "final_attempt")
EMPTY_NODE = "00000000-0000-0000-0000-000000000000"
EMPTY_RUNNER = 0


def date_key(ts: ColumnOrName) -> Column:
    return F.date_format(as_column(ts), "yyyyMMdd")


def time_key(ts: ColumnOrName) -> Column:
    return F.date_format(as_column(ts), "HHmmss")


def build_dim_date(df: DataFrame, ts: str, existing: DataFrame | None = None) -> DataFrame:
    """One row per calendar day. Monday is day 1 and the first quarter is 0."""
    days = df.select(F.to_date(ts).alias("date")).where("date IS NOT NULL").distinct()
    rows = days.select(
        F.date_format("date", "yyyyMMdd").alias("date_key"),
        "date",
        F.date_format("date", "MMMM dd, yyyy").alias("date_description"),
        (F.weekday("date") + 1).alias("day_of_week"),
        F.dayofmonth("date").alias("day_of_month"),
        F.dayofyear("date").alias("day_of_year"),
        F.date_format("date", "EEEE").alias("day_name"),
        (F.weekday("date") < 5).alias("weekday"),
        F.month("date").alias("month"),
        F.date_format("date", "MMMM").alias("month_name"),
        (F.quarter("date") - 1).alias("quarter"),
        F.year("date").alias("year"),
    )
    return rows if existing is None else get_or_create(rows, existing, "date_key")


def build_dim_time(df: DataFrame, ts: str, existing: DataFrame | None = None) -> DataFrame:
    """One row per second of day seen."""
    col = F.col(ts)
    seen = df.select(
        F.hour(col).alias("h"), F.minute(col).alias("m"), F.second(col).alias("s")
    ).where("h IS NOT NULL")
    seen = seen.distinct()
    h, m, s = F.col("h"), F.col("m"), F.col("s")
    text = F.format_string("%02d:%02d:%02d", h, m, s)
    rows = seen.select(
        F.translate(text, ":", "").alias("time_key"),
        text.alias("time"),
        F.when(h < 12, "AM").otherwise("PM").alias("am_or_pm"),
        (((h + 11) % 12) + 1).alias("hour_12"),
        h.alias("hour_24"),
        m.alias("minute"),
        (h * 60 + m).alias("minute_of_day"),
        s.alias("second"),
        (m * 60 + s).alias("second_of_hour"),
        (h * 3600 + m * 60 + s).alias("second_of_day"),
    )
    return rows if existing is None else get_or_create(rows, existing, "time_key")


def job_type(name: ColumnOrName, stage: ColumnOrName) -> Column:
    """Ordered rules; NULL when no rule applies."""
    name, stage = as_column(name), as_column(stage)
    return (
        F.when(name.contains("-generate"), "generate")
        .when(name.isin(*fixed.NAMED_JOB_TYPES), name)
        .when(stage.rlike(fixed.BUILD_STAGE), "build")
    )


def determine_job_type(df: DataFrame) -> DataFrame:
    """Adds job_type; rows no rule covers keep NULL and belong in job_type_rejects."""
    return df.withColumn("job_type", job_type("build_name", "build_stage"))


def job_type_rejects(df: DataFrame) -> DataFrame:
    unknown = determine_job_type(df).where("job_type IS NULL")
    return unknown.select(
        F.col("build_id").alias("key"),
        F.lit("determine_job_type").alias("operator"),
        F.concat(F.lit("unrecognized job type: "), F.col("build_name")).alias("reason"),
    )


def stack_job_key() -> Column:
    return surrogate_key(*[F.coalesce(F.col(c), F.lit("")) for c in STACK_JOB_KEY])


def with_stack_job(df: DataFrame) -> DataFrame:
    """Missing job details give the empty member, whatever the job type says."""
    missing = F.col("stack").isNull() & F.col("job_size").isNull()
    return df.select(
        "*",
        F.when(missing, surrogate_key(F.lit(""), F.lit(""), F.lit("")))
        .otherwise(stack_job_key())
        .alias("stack_job_id"),
    )


def build_dim_stack_job(df: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    missing = F.col("stack").isNull() & F.col("job_size").isNull()
    rows = with_stack_job(df).select(
        "stack_job_id",
        *[
            F.when(missing, F.lit("")).otherwise(F.coalesce(c, F.lit(""))).alias(c)
            for c in STACK_JOB_KEY
        ],
    )
    return get_or_create(rows, existing, "stack_job_id")


def extract_runner_version(df: DataFrame, trace: str = "trace") -> DataFrame:
    found = F.regexp_extract(trace, fixed.RUNNER_VERSION, 1)
    return df.withColumn("gitlab_runner_version", F.coalesce(found, F.lit("")))


def resolve_parent_pipeline(df: DataFrame) -> DataFrame:
    """Parent is the source pipeline when there is one, else the job's own pipeline."""
    return df.withColumn(
        "parent_pipeline_id", F.coalesce("source_pipeline.pipeline_id", "pipeline_id")
    )


def gitlab_job_key() -> Column:
    return surrogate_key(
        "gitlab_runner_version", "ref", list_text("tags"), "pipeline_id", "parent_pipeline_id"
    )


def build_dim_gitlab_job(df: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    rows = df.select(
        gitlab_job_key().alias("gitlab_job_id"),
        "gitlab_runner_version",
        "ref",
        "tags",
        "pipeline_id",
        "parent_pipeline_id",
    )
    return get_or_create(rows, existing, "gitlab_job_id")


def flag_unnecessary(df: DataFrame, trace: str = "trace") -> DataFrame:
    found = F.col(trace).contains("No need to rebuild ") & F.col(trace).rlike(fixed.UNNECESSARY_JOB)
    return df.withColumn("unnecessary", is_true(found))


def infrastructure_error_flag() -> Column:
    """Failed, and neither a user error nor a reindex that could not read its specs."""
    user_error = is_true(F.col("error_taxonomy").isin(*fixed.USER_ERRORS))
    reindex = is_true(
        (F.col("job_type") == "rebuild-index")
        & (F.col("error_taxonomy") == "failed_to_get_specs")
    )
    return (F.col("status") == "failed") & ~user_error & ~reindex


def infrastructure_error(df: DataFrame) -> DataFrame:
    return df.withColumn("infrastructure_error", infrastructure_error_flag())


def job_result_key() -> Column:
    return surrogate_key(*RESULT_KEY)


def build_dim_job_result(df: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    rows = df.select(
        job_result_key().alias("job_result_id"),
        *RESULT_KEY,
        infrastructure_error_flag().alias("infrastructure_error"),
    )
    return get_or_create(rows, existing, "job_result_id")


def job_retry_key() -> Column:
    return surrogate_key(*RETRY_KEY)


def build_dim_job_retry(df: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    rows = df.select(job_retry_key().alias("job_retry_id"), *RETRY_KEY)
    return get_or_create(rows, existing, "job_retry_id")


def first_write(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Earliest row per key, as an aggregate that combines before the shuffle."""
    row = F.struct(*[c for c in df.columns if c != key])
    picked = df.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("row"))
    return picked.select(key, "row.*").select(*df.columns)


def build_dim_node(
    df: DataFrame, order: list[str], existing: DataFrame | None = None
) -> DataFrame:
    """One row per system_uuid, first write wins; jobs without node info use the empty member."""
    cols = ["system_uuid", "name", "cpu", "memory", "capacity_type", "instance_type"]
    known = df.where("system_uuid IS NOT NULL").select(*dict.fromkeys([*cols, *order]))
    return get_or_create(first_write(known, "system_uuid", order).select(*cols), existing,
                         "system_uuid")


def runner_host(name: ColumnOrName) -> Column:
    name = as_column(name)
    return (
        F.when(name.startswith("runner-"), "cluster")
        .when(name.startswith("uo-"), "uo")
        .otherwise("unknown")
    )


def build_dim_runner(
    jobs: DataFrame, runners: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """Runners that jobs used and the runner list knows, first write wins."""
    used = jobs.select("runner_id").where("runner_id IS NOT NULL").distinct()
    rows = runners.join(used, "runner_id", "left_semi").select(
        "runner_id",
        F.col("description").alias("name"),
        "platform",
        runner_host("description").alias("host"),
        F.col("architecture").alias("arch"),
        F.col("tag_list").alias("tags"),
        is_true(F.col("description").startswith("runner-")).alias("in_cluster"),
    )
    return get_or_create(rows, existing, "runner_id")


def with_runner_key(jobs: DataFrame, dim_runner: DataFrame) -> DataFrame:
    """Unknown or absent runners fall to the empty member."""
    known = dim_runner.select("runner_id").withColumn("_known", F.lit(True))
    return (
        jobs.join(known, "runner_id", "left")
        .withColumn(
            "runner_id",
            F.when(F.col("_known"), F.col("runner_id")).otherwise(
                F.lit(EMPTY_RUNNER).cast(jobs.schema["runner_id"].dataType)
            ),
        )
        .drop("_known")
    )


def build_dim_package(df: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    rows = df.select(F.coalesce("name", F.lit("")).alias("name"))
    return get_or_create(rows, existing, "name")


SPEC_FIELDS = ("name", "version", "compiler_name", "compiler_version", "arch", "variants")


def upsert_package_spec(dim: DataFrame, df: DataFrame, order: list[str]) -> DataFrame:
    """Insert unseen hashes; for known ones fill only fields that are still empty.

    Several incoming rows of one hash are applied in order, which for each field means the first
    value that is not empty.
    """
    filled = [
        F.min_by(
            F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(*order))
        ).alias(f"_{c}")
        for c in SPEC_FIELDS
    ]
    incoming = df.groupBy("hash").agg(*filled)
    joined = dim.select("hash", *SPEC_FIELDS).join(incoming, "hash", "full")
    empty = F.lit("")
    return joined.select(
        "hash",
        *[
            F.when(F.coalesce(c, empty) == "", F.coalesce(f"_{c}", empty))
            .otherwise(F.col(c))
            .alias(c)
            for c in SPEC_FIELDS
        ],
    )


def add_spec_nodes(
    packages: DataFrame, specs: DataFrame, nodes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Every node names a package; nodes that know their compiler also become specs."""
    new_packages = build_dim_package(nodes, packages)
    complete = nodes.where("compiler_name <> '' AND compiler_version <> ''").select(
        "hash", *SPEC_FIELDS
    )
    first = first_write(complete, "hash", list(SPEC_FIELDS))
    added = first.join(specs.select("hash"), "hash", "left_anti")
    return new_packages, specs.select("hash", *SPEC_FIELDS).unionByName(added)


def build_dim_timer_phase(timings: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    paths = timings.select(F.explode("phases.path").alias("path")).distinct()
    rows = paths.withColumn("is_subphase", F.col("path").contains("/"))
    return get_or_create(rows, existing, "path")


def empty_members(name: str) -> list[dict[str, Column]]:
    """The fixed members of a dimension: its unknown member, or both members of dim_timer_data."""
    empty_key = surrogate_key(F.lit(""), F.lit(""), F.lit(""))
    no_text = {c: F.lit("") for c in ("stack", "job_size", "job_type")}
    members: dict[str, list[dict]] = {
        "dim_stack_job": [{"stack_job_id": empty_key, **no_text}],
        "dim_gitlab_job": [
            {
                "gitlab_job_id": surrogate_key(
                    F.lit(""), F.lit(""), F.lit(""), F.lit(None), F.lit(None)
                ),
                "gitlab_runner_version": F.lit(""),
                "ref": F.lit(""),
            }
        ],
        "dim_job_result": [
            {
                "job_result_id": surrogate_key(
                    F.lit(""), F.lit(None), F.lit(False), F.lit(""), F.lit(""), F.lit(None)
                ),
                "status": F.lit(""),
                "unnecessary": F.lit(False),
                "job_type": F.lit(""),
                "gitlab_failure_reason": F.lit(""),
                "infrastructure_error": F.lit(False),
            }
        ],
        "dim_job_retry": [
            {
                "job_retry_id": surrogate_key(
                    F.lit(False), F.lit(False), F.lit(0), F.lit(False)
                ),
                "is_retry": F.lit(False),
                "is_manual_retry": F.lit(False),
                "attempt_number": F.lit(0),
                "final_attempt": F.lit(False),
            }
        ],
        "dim_node": [
            {
                "system_uuid": F.lit(EMPTY_NODE),
                "name": F.lit(""),
                "cpu": F.lit(0),
                "memory": F.lit(0),
                "capacity_type": F.lit(""),
                "instance_type": F.lit(""),
            }
        ],
        "dim_runner": [
            {
                "runner_id": F.lit(EMPTY_RUNNER),
                "name": F.lit(""),
                "platform": F.lit(""),
                "host": F.lit(""),
                "arch": F.lit(""),
                "in_cluster": F.lit(False),
            }
        ],
        "dim_package": [{"name": F.lit("")}],
        "dim_package_spec": [{"hash": F.lit(""), **{c: F.lit("") for c in SPEC_FIELDS}}],
        "dim_timer_data": [{"cache": F.lit(True)}, {"cache": F.lit(False)}],
    }
    return members.get(name, [])


def empty_rows(name: str, like: DataFrame) -> DataFrame | None:
    """The fixed members shaped like the table they join."""
    one = like.sparkSession.range(1)
    out = None
    for member in empty_members(name):
        row = one.select(
            *[
                (
                    F.array().cast("array<string>")
                    if f.dataType.typeName() == "array"
                    else member.get(f.name, F.lit(None)).cast(f.dataType)
                ).alias(f.name)
                for f in like.schema.fields
            ]
        )
        out = row if out is None else out.unionByName(row)
    return out


KEYS = {
    "dim_date": "date_key",
    "dim_time": "time_key",
    "dim_stack_job": "stack_job_id",
    "dim_gitlab_job": "gitlab_job_id",
    "dim_job_result": "job_result_id",
    "dim_job_retry": "job_retry_id",
    "dim_node": "system_uuid",
    "dim_runner": "runner_id",
    "dim_package": "name",
    "dim_package_spec": "hash",
    "dim_timer_phase": "path",
    "dim_timer_data": "cache",
}


def with_empty_rows(dims: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every dimension with its fixed members present exactly once."""
    out = {}
    for name, df in dims.items():
        key = KEYS[name]
        members = empty_members(name)
        if members:
            is_fixed = is_true(F.col(key).isin(*[m[key] for m in members]))
            df = empty_rows(name, df).unionByName(df.where(~is_fixed))
        out[name] = df
    return out


def _violations(df: DataFrame, table: str, rule: str, key: Column, broken: Column) -> DataFrame:
    return df.where(broken).select(
        F.lit(table).alias("table"), F.lit(rule).alias("rule"), key.cast("string").alias("key")
    )


def _duplicates(df: DataFrame, table: str, rule: str, cols: list[str]) -> DataFrame:
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in cols])
    counts = df.groupBy(text.alias("key")).count().where("count > 1")
    return counts.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), "key")


POD_FIELDS = (
    "pod_node_occupancy",
    "pod_cpu_usage_seconds",
    "pod_max_mem",
    "pod_avg_mem",
    "node_price_per_second",
    "node_cpu",
    "node_memory",
)

# Characters that the stored text fields hold at most.
MAX_LENGTHS = {
    "dim_date": {"date_key": 8, "date_description": 32, "day_name": 16, "month_name": 16},
    "dim_time": {"time_key": 6, "am_or_pm": 2},
    "dim_stack_job": {"stack": 128, "job_size": 128},
    "dim_gitlab_job": {"gitlab_runner_version": 16, "ref": 256},
    "dim_job_result": {"status": 32, "error_taxonomy": 64, "gitlab_failure_reason": 256},
    "dim_node": {"name": 64, "capacity_type": 12, "instance_type": 32},
    "dim_runner": {"name": 64, "platform": 64, "host": 32, "arch": 32},
    "dim_package_spec": {
        "hash": 32, "name": 128, "version": 32, "compiler_name": 32, "compiler_version": 32,
        "arch": 64,
    },
    "dim_package": {"name": 128},
    "dim_timer_phase": {"path": 64},
    "fact_job": {"name": 128},
}

UNIQUE = {
    "dim_stack_job": ["stack", "job_size", "job_type"],
    "dim_gitlab_job": ["gitlab_job_id"],
    "dim_job_retry": list(RETRY_KEY),
    "dim_node": ["name", "system_uuid"],
    "dim_package_spec": ["hash"],
    "dim_timer_phase": ["path"],
    "dim_timer_data": ["cache"],
    "fact_job": ["job_id"],
    "fact_timer": ["job_id", "date_key", "time_key", "cache", "package", "spec_hash"],
    "fact_timer_phase": [
        "job_id", "date_key", "time_key", "cache", "package", "spec_hash", "phase",
    ],
}


def check_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """All CHECK, UNIQUE and length rules as one report of (table, rule, key)."""
    length = F.length
    complete = (
        (length("name") > 0) & (length("hash") == 32) & (length("version") > 0)
    )
    empty = F.lit(True)
    for c in ("hash", *SPEC_FIELDS):
        empty = empty & (F.col(c) == "")
    nulls = F.lit(0)
    for c in POD_FIELDS:
        nulls = nulls + F.col(c).isNull().cast("int")
    checks = {
        "dim_time": [
            ("am-or-pm-value", F.col("time_key"), ~F.col("am_or_pm").isin("AM", "PM")),
            (
                "time-key-value",
                F.col("time_key"),
                ~is_true(F.expr("try_cast(time_key AS INT)").between(0, 235959)),
            ),
        ],
        "dim_job_result": [
            (
                "error-taxonomy-only-on-failed-status",
                F.col("job_result_id"),
                (F.col("status") != "failed") & F.col("error_taxonomy").isNotNull(),
            )
        ],
        "dim_package_spec": [("no-missing-fields", F.col("hash"), ~is_true(complete | empty))],
        "dim_timer_phase": [
            (
                "consistent-subphase-path",
                F.col("path"),
                F.col("is_subphase") != F.col("path").contains("/"),
            )
        ],
        "fact_job": [
            (
                "nullable-field-consistency",
                F.col("job_id"),
                ~nulls.isin(0, len(POD_FIELDS)),
            )
        ],
    }
    report = None
    for name, df in tables.items():
        parts = [_violations(df, name, *rule) for rule in checks.get(name, [])]
        key = F.col(KEYS.get(name, "job_id"))
        for c, most in MAX_LENGTHS.get(name, {}).items():
            if c in df.columns:
                parts.append(_violations(df, name, f"max-length-{c}", key, length(c) > most))
        if name in UNIQUE:
            parts.append(_duplicates(df, name, "unique", UNIQUE[name]))
        for part in parts:
            report = part if report is None else report.unionByName(part)
    if report is None:
        raise ValueError("no table with constraints was given")
    return report
