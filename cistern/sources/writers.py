"""Writers. Each replaces or appends whole partitions, so a run that is repeated changes nothing.

Warehouse tables are versioned as a whole (`versions`): a run becomes visible when all its tables are
written.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import fixed
from ..functions.columns import new_members
from ..operators import dims as dim_builders
from ..operators.facts import PHASE_KEY, TIMER_KEY
from ..operators.pipelines import _lit_ts
from . import versions

#: Folders of a table from which on they are written anew as one.
COMPACT = 16
#: Runs that may commit first before a write gives up.
TRIES = 5

FACT_PARTITION = {
    "fact_job": "start_date_key",
    "fact_timer": "date_key",
    "fact_timer_phase": "date_key",
}
FACT_KEYS = {"fact_job": ["job_id"], "fact_timer": TIMER_KEY, "fact_timer_phase": PHASE_KEY}
FACT_TIMES = {
    "fact_job": ("start_date_key", "start_time_key"),
    "fact_timer": ("date_key", "time_key"),
    "fact_timer_phase": ("date_key", "time_key"),
}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A stored table, or None before its first write. Package specs are given in their last version."""
    stored = _stored(spark, path, name)
    return latest_specs(stored) if name == "dim_package_spec" and stored is not None else stored


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, if it is there, in whatever store holds it."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Version(NamedTuple):
    """Folders and columns of each table."""

    number: int
    tables: dict[str, list[str]]
    kinds: dict[str, StructType]


def _latest(spark: SparkSession, path: str) -> Version:
    number, tables = versions.latest(spark, path)
    return Version(number, tables, versions.schemas(spark, path, number))


def _stored(
    spark: SparkSession, path: str, name: str, version: Version | None = None
) -> DataFrame | None:
    """A table of the newest version, or of the one given; a plain folder where there are no versions."""
    if version is None:
        version = _latest(spark, path)
        if not version.number:
            return _folder(spark, f"{path}/{name}")
    folders = version.tables.get(name)
    if not folders:
        return None
    # Days are folder names, which read as numbers unless the columns are told.
    out = None
    for folder in folders:
        df = spark.read.schema(version.kinds[name]).parquet(f"{path}/{folder}")
        out = df if out is None else out.unionByName(df)
    return out


def _folder(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_warehouse(
    dims: dict[str, DataFrame], facts: dict[str, DataFrame], path: str
) -> int:
    """Append the members and facts that are not stored yet, as one new version; gives its number.

    Keys are computed from the data, so appending what is missing is all an upsert takes, except
    for package specs, whose empty fields may be filled: those are stored as versions and read
    through `latest_specs`. Facts are written in one folder per day, and only stored days that the
    run touches are looked up.

    New rows go to folders of their own; the manifest that names them is committed last. A run that
    is killed before leaves the old version in place. If another run commits meanwhile, what is
    missing is worked out again against its version. A table in many folders is written anew as one.
    """
    given = {**dims, **facts}
    spark = next(iter(given.values())).sparkSession
    for _ in range(TRIES):
        before = _latest(spark, path)
        if not before.number:  # tables that were there before versions are part of the first
            there = versions.plain_tables(spark, path, (*dim_builders.KEYS, *FACT_KEYS))
            kinds = {n: _folder(spark, f"{path}/{n}").schema for n in there}
            before = Version(0, there, kinds)
        tables, kinds = {n: list(f) for n, f in before.tables.items()}, dict(before.kinds)
        for name, df in given.items():
            fresh, folder = _fresh(spark, path, name, df, before), versions.new_folder(name)
            _write(fresh, name, f"{path}/{folder}")
            tables.setdefault(name, []).append(folder)
            old = kinds.get(name, StructType())
            kinds[name] = StructType([*old, *(f for f in fresh.schema if f.name not in old.names)])
            if len(tables[name]) >= COMPACT:
                whole = _stored(spark, path, name, Version(0, tables, kinds))
                folder = versions.new_folder(name)
                _write(whole, name, f"{path}/{folder}")
                tables[name] = [folder]
        try:
            versions.commit(spark, path, before.number + 1, tables, kinds)
            return before.number + 1
        except versions.Taken:
            for name in given:
                for folder in set(tables[name]) - set(before.tables.get(name, ())):
                    remove(spark, f"{path}/{folder}")
    raise versions.Taken(f"{TRIES} versions of {path}")


def _fresh(
    spark: SparkSession, path: str, name: str, df: DataFrame, version: Version
) -> DataFrame:
    """Rows of df that the version lacks."""
    old = _stored(spark, path, name, version)
    if name == "dim_package_spec":
        return _new_specs(df, old)
    if old is None:
        return df
    if name in FACT_KEYS:
        keys, day = FACT_KEYS[name], FACT_PARTITION[name]
        # As many days as the run has: a list for the scan, so that other days aren't read.
        days = [r[0] for r in df.select(day).distinct().collect()]
        seen = old.where(F.col(day).isin(days)) if days else old.limit(0)
        return df.join(seen.select(*keys), keys, "left_anti")
    return new_members(df, old, dim_builders.KEYS[name])


def _write(df: DataFrame, name: str, folder: str) -> None:
    if name in FACT_PARTITION:
        day = FACT_PARTITION[name]
        # Rebalancing gathers the rows of a day but splits a day that is larger than the others.
        df.hint("rebalance", day).write.partitionBy(day).parquet(folder)
    else:
        df.write.parquet(folder)


def _new_specs(df: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Specs that are new, and the next version of those that gain a value for an empty field."""
    columns = ["hash", *dim_builders.SPEC_FIELDS]
    if stored is None:
        return df.select(*columns).withColumn("stored_version", F.lit(1))
    hashes = df.select("hash").distinct()
    own = stored.join(hashes, "hash", "left_semi")
    last = latest_specs(own)
    after = dim_builders.upsert_package_spec(last, df, list(dim_builders.SPEC_FIELDS))
    changed = after.join(last, columns, "left_anti")
    number = own.groupBy("hash").agg(F.max("stored_version").alias("n"))
    return changed.join(number, "hash", "left").select(
        *columns, (F.coalesce("n", F.lit(0)) + 1).alias("stored_version")
    )


def latest_specs(specs: DataFrame) -> DataFrame:
    """Stored package specs in their last version."""
    return specs.groupBy("hash").agg(
        *[F.max_by(c, "stored_version").alias(c) for c in dim_builders.SPEC_FIELDS]
    )


def log_day(df: DataFrame, now: datetime | None, ts: str = "timestamp") -> DataFrame:
    """Adds the index of each document: one per day, that of now for documents without a time.

    Without now it is the time of the query, in a stream that of each micro-batch.
    """
    today = F.current_timestamp().cast("timestamp_ntz") if now is None else _lit_ts(now)
    when = F.coalesce(F.col(ts), today) if ts in df.columns else today
    return df.withColumn("timestamp", when).withColumn(
        "log_index", F.date_format("timestamp", "'gitlab-job-logs-'yyyyMMdd")
    )


def write_job_logs(df: DataFrame, path: str, now: datetime) -> None:
    log_day(df, now).write.mode("append").partitionBy("log_index").parquet(path)


def snapshot_facts(name: str, df: DataFrame, dim_date: DataFrame, dim_time: DataFrame,
                   as_of: datetime, days: int) -> DataFrame:
    """Facts of the last `days` days that started over an hour ago, generated columns left out."""
    date_col, time_col = FACT_TIMES[name]
    stored = [c for c in df.columns if c not in ("started_at", "finished_at")]
    d = dim_date.select(F.col("date_key").alias(date_col), F.col("date").alias("_date"))
    t = dim_time.select(F.col("time_key").alias(time_col), F.col("time").alias("_time"))
    joined = df.select(*stored).join(d, date_col, "left").join(t, time_col, "left")
    first_day = F.lit((as_of - timedelta(days=days)).date().isoformat()).cast("date")
    start = F.concat_ws(" ", F.col("_date").cast("string"), F.col("_time")).try_cast(
        "timestamp_ntz"
    )
    recent = (F.col("_date") >= first_day) & (start < _lit_ts(as_of - timedelta(hours=1)))
    return joined.where(recent & F.col("_date").isNotNull() & F.col("_time").isNotNull()).select(
        *stored
    )


def export_snapshot(
    dims: dict[str, DataFrame], facts: dict[str, DataFrame], path: str, as_of: datetime,
    limits: dict[str, int] | None = None,
) -> None:
    """CSV copies: dimensions whole, facts by their window; NULL is written as a marker."""
    limits = {**fixed.SNAPSHOT_DAYS, **(limits or {})}
    tables = {
        name: df.drop("infrastructure_error") for name, df in dims.items()
    }
    for name, df in facts.items():
        tables[name] = snapshot_facts(
            name, df, dims["dim_date"], dims["dim_time"], as_of, limits[name]
        )
    for name, df in tables.items():
        flat = df.select(
            *[
                F.to_json(f.name).alias(f.name) if f.dataType.typeName() == "array" else f.name
                for f in df.schema.fields
            ]
        )
        writer = flat.write.mode("overwrite").option("header", True).option("escape", '"')
        writer.option("nullValue", fixed.SNAPSHOT_NULL).csv(f"{path}/{name}")


def restore_snapshot(
    spark: SparkSession, path: str, schemas: dict[str, str]
) -> dict[str, DataFrame]:
    """Tables of a snapshot, dimensions before facts.

    Columns are matched by the header, so a file may order them differently.
    """
    out = {}
    for name in sorted(schemas, key=lambda n: (not n.startswith("dim_"), n)):
        wanted = spark.createDataFrame([], schemas[name]).schema
        raw = (
            spark.read.option("header", True).option("escape", '"')
            .option("nullValue", fixed.SNAPSHOT_NULL)
            .csv(f"{path}/{name}")
        )
        out[name] = raw.select(
            *[
                (
                    F.from_json(f.name, f.dataType)
                    if f.dataType.typeName() == "array"
                    else F.col(f.name).cast(f.dataType)
                ).alias(f.name)
                for f in wanted.fields
                if f.name in raw.columns
            ]
        )
    return out


def write_restored(tables: dict[str, DataFrame], path: str) -> int:
    """Replace the stored tables by the restored ones, as one new version."""
    spark = next(iter(tables.values())).sparkSession
    number, _ = versions.latest(spark, path)
    folders = {}
    if "dim_package_spec" in tables and "stored_version" not in tables["dim_package_spec"].columns:
        first = tables["dim_package_spec"].withColumn("stored_version", F.lit(1))
        tables = {**tables, "dim_package_spec": first}
    for name, df in tables.items():
        folders[name] = [versions.new_folder(name)]
        _write(df, name, f"{path}/{folders[name][0]}")
    versions.commit(spark, path, number + 1, folders, {n: df.schema for n, df in tables.items()})
    return number + 1


def write_keeplists(df: DataFrame, path: str) -> None:
    """One folder per stack, its hashes in order across the folder's files."""
    ordered = df.select("stack", "hash").distinct().repartitionByRange("stack", "hash")
    ordered.sortWithinPartitions("stack", "hash").write.mode("overwrite").partitionBy(
        "stack"
    ).text(path)


def cache_listing(df: DataFrame) -> DataFrame:
    """One JSON member per ref: its mirrors, at most one per stack."""
    entry = F.struct("label", "url")
    per_ref = df.groupBy("ref").agg(F.array_sort(F.collect_set(entry)).alias("mirrors"))
    return per_ref.select(
        "ref", F.to_json(F.create_map(F.col("ref"), F.col("mirrors"))).alias("value")
    )


def write_cache_listing(df: DataFrame, path: str) -> None:
    """One line per ref, each a JSON object `{ref: [{label, url}, ...]}`."""
    cache_listing(df).select("value").write.mode("overwrite").text(path)


def write_annotated_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


