"""Structured Streaming forms: each applies the batch operators to every micro-batch.

Delivery is at least once and may be out of order. Results do not depend on it: jobs are keyed by
id, a batch that runs again finds its own rows and adds nothing, and files are written by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.columns import is_true, one_per
from ..operators import dims, facts, logs, metrics, rolling, warehouse
from ..sources import scratch, writers

Trigger = dict
ONCE: Trigger = {"availableNow": True}


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.BUILD_EVENTS).json(path)


Enrich = Callable[[DataFrame], "DataFrame | tuple[DataFrame, DataFrame]"]


def stream_jobs(
    events: DataFrame, out: str, checkpoint: str, enrich: Enrich, runners: DataFrame,
    trigger: Trigger = ONCE, rejects: str | None = None, *, job_url_prefix: str,
) -> StreamingQuery:
    """Finished build events to warehouse tables.

    enrich turns the job rows of a batch into enriched jobs and rejects (warehouse.enrich_jobs with
    the caller's traces, retries and details); the jobs alone will do. rejects: a folder for those
    of each batch.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        # Finished builds first: a build also sends events of its earlier states.
        # Kept, since they are counted before they are joined.
        finished = one_per(warehouse.flatten_events(df), ["build_id"]).persist()
        try:
            enriched = enrich(finished)
            jobs, rejected = enriched if isinstance(enriched, tuple) else (enriched, None)
            if rejected is not None and rejects:
                rejected.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
            jobs = jobs.persist()
            try:
                tables, fact = warehouse.build_warehouse(
                    jobs, runners, job_url_prefix=job_url_prefix
                )
                writers.write_warehouse(tables, {"fact_job": fact}, out)
            finally:
                jobs.unpersist()
        finally:
            finished.unpersist()

    return (
        events.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stream_timings(
    timings: DataFrame, warehouse_path: str, checkpoint: str, nodes: DataFrame | None = None,
    trigger: Trigger = ONCE,
) -> StreamingQuery:
    """Timing facts of jobs in the warehouse, and the phases they name.

    A query of its own: if it fails, the job facts stand. nodes (job_id and the columns of a spec
    node) enter as packages and specs before timings are looked up, so that dependencies which no
    job has built are known. Rows whose job, package or spec isn't stored yet wait in
    `pending_timings`, one folder for each batch, and are tried again with the next batch.

    The timings of a batch are read twice, first only the ids of their jobs, and meet the jobs in one
    join; what comes of it is written once, and all else is made from that.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        path = f"{warehouse_path}/pending_timings"
        waiting = writers.read_table(spark, path, f"batch={batch_id - 1}") if batch_id else None
        if batch_id and waiting is None:
            raise RuntimeError(f"the pending timings of batch {batch_id - 1} are missing in {path}")
        rows = df if waiting is None else df.unionByName(waiting)
        chosen = rest = None
        try:
            found = _stored_timings(rows, nodes, warehouse_path)
            if found is None:
                rest = rows
            else:
                chosen, rest = found
                names = writers.read_table(spark, warehouse_path, "dim_package").select("name").distinct()
                specs = writers.read_table(spark, warehouse_path, "dim_package_spec")
                writers.write_warehouse(
                    {"dim_timer_phase": dims.build_dim_timer_phase(chosen)},
                    {
                        "fact_timer": facts.build_fact_timer(chosen, names, specs),
                        "fact_timer_phase": facts.build_fact_timer_phase(chosen, names, specs),
                    },
                    warehouse_path,
                )
            rest.select(*df.columns).write.mode("overwrite").parquet(
                f"{path}/batch={batch_id}", compression=scratch.DENSE
            )
            writers.remove(spark, f"{path}/batch={batch_id - 2}")
        finally:
            if chosen is not None:
                chosen.unpersist()
                scratch.discard(rest)

    return (
        timings.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _stored_timings(
    rows: DataFrame, nodes: DataFrame | None, warehouse_path: str
) -> tuple[DataFrame, DataFrame] | None:
    """Timings to store, persisted as five tables read them, and those that wait; None before there is a warehouse.

    Both are read from what was written of their join with the jobs, which `scratch.discard` of the second deletes.
    """
    spark = rows.sparkSession
    fact = writers.read_table(spark, warehouse_path, "fact_job")
    result = writers.read_table(spark, warehouse_path, "dim_job_result")
    if fact is None or result is None:
        return None
    asked = rows.select("job_id").distinct()
    if nodes is not None:
        own = nodes.join(asked, "job_id", "left_semi")
        packages, specs = dims.add_spec_nodes(
            own.select("name").limit(0), own.select("hash", *dims.SPEC_FIELDS).limit(0), own
        )
        writers.write_warehouse(
            {"dim_package": packages, "dim_package_spec": specs}, {}, warehouse_path
        )
    packages = writers.read_table(spark, warehouse_path, "dim_package")
    specs = writers.read_table(spark, warehouse_path, "dim_package_spec")
    if packages is None or specs is None:
        return None
    known = fact.join(asked, "job_id", "left_semi").select(
        "job_id", "spec_hash", "start_date_key", "start_time_key", "job_result_id"
    )
    jobs = known.join(
        result.select("job_result_id", "status", "job_type").distinct(), "job_result_id"
    )
    judged = scratch.stage(facts.select_timings(rows, jobs, unknown=True), "timings", scratch.DENSE)
    chosen = judged.where("known").drop("known").persist()
    no_job = judged.where("NOT known").select(*rows.columns)
    no_package = chosen.join(
        packages.select(F.col("name")).distinct(), "name", "left_anti"
    ).select(*rows.columns)
    no_spec = chosen.join(packages.select("name").distinct(), "name", "left_semi").join(
        specs.select("hash").distinct(), "hash", "left_anti"
    ).select(*rows.columns)
    rest = no_job.unionByName(no_package).unionByName(no_spec)
    rest._scratch = judged._scratch
    return chosen, rest


def stream_job_logs(
    documents: DataFrame, out: str, checkpoint: str, now: datetime | None = None, trigger: Trigger = ONCE
) -> StreamingQuery:
    """Cleaned log documents appended to the folder of their day.

    A document without a time belongs to the day of `now`, or else of its micro-batch.
    """
    clean = writers.log_day(logs.strip_ansi(documents, "trace", "job_trace").drop("trace"), now)
    return (
        clean.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .partitionBy("log_index")
        .trigger(**trigger)
        .start()
    )


def stream_access_logs(
    lines: DataFrame, kind: str, out: str, checkpoint: str, trigger: Trigger = ONCE
) -> StreamingQuery:
    """Text lines parsed and appended, without those of INFO severity."""
    parsed = logs.parse_access_log(lines, kind)
    if "severity" in parsed.columns:
        parsed = logs.drop_info_logs(parsed)
    return (
        parsed.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stream_alerts(
    evaluations: DataFrame, keys: Sequence[str], condition: Column, hold: float, out: str,
    state: str, checkpoint: str, trigger: Trigger = ONCE,
) -> StreamingQuery:
    """Firing alerts of a stream of evaluations, in order across batches.

    Only the time since which a key's condition holds passes from one batch to the next. It is
    kept as one small folder per batch, so a repeated batch starts from the state it had. Within
    a batch a busy key is worked on in time slices, as in the batch form.
    """
    keys = list(keys)

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        checked = df.withColumn("_holds", is_true(condition))
        old = writers.read_table(spark, state, f"batch={batch_id - 1}") if batch_id else None
        if batch_id and old is None:
            raise RuntimeError(f"the state of batch {batch_id - 1} is missing in {state}")
        since = rolling.held_since(
            checked, keys, "ts", "_holds", max(metrics.SLICE, hold), "active_since", old
        ).persist()
        try:
            fired = since.where(
                F.col("_holds") & (F.col("ts") - F.col("active_since") >= F.lit(float(hold)))
            ).drop("_holds")
            fired.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            last = since.groupBy(*keys).agg(
                F.max_by("active_since", "ts").alias("since")
            )
            if old is not None:
                quiet = old.join(last.select(*keys), keys, "left_anti").select(*last.columns)
                last = last.unionByName(quiet)
            last.where("since IS NOT NULL").write.mode("overwrite").parquet(
                f"{state}/batch={batch_id}"
            )
            # A batch that runs again needs the state before it; older ones are of no use.
            writers.remove(spark, f"{state}/batch={batch_id - 2}")
        finally:
            since.unpersist()

    return (
        evaluations.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
