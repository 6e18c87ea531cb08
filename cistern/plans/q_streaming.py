"""Streaming queries: the given tables as files that arrive, run until all are read."""

from pyspark.sql import functions as F

from ..operators import warehouse
from ..sources import writers
from ..sources.scratch import DENSE, discard, scratch_path, stage
from ..streaming import alerts, streams
from .bindings import bind
from .common import (
    BINDINGS,
    DUCK_TS,
    ENRICHED_SQL,
    JOB_URL_PREFIX,
    info_rows,
    retry_rows,
    runner_rows,
    ts_text,
)
from .q_dims import timing_rows
from .q_logs import _APACHE
from .q_metrics import ALERT_SQL, samples
from .q_sources import AS_OF, write_events
from .common import quote
from .registry import query


def _run_jobs(spark, sf) -> str:
    out = scratch_path(spark, "stream-warehouse")
    traces = bind(spark, sf, "traces").select("job_id", "trace")
    codes = bind(spark, sf, "jobs").selectExpr(
        "build_id", "cast(exit_code as int) AS job_exit_code"
    )
    retry = stage(retry_rows(spark, sf), "retry")

    def enrich(jobs):
        info = info_rows(spark, sf)
        return warehouse.enrich_jobs(jobs, traces, retry, codes, info)[0]

    events = write_events(spark, sf)
    run = streams.stream_jobs(
        streams.event_stream(spark, events), out, scratch_path(spark, "ckpt"), enrich, runner_rows(spark, sf),
        job_url_prefix=JOB_URL_PREFIX,
    )
    run.awaitTermination()
    discard(retry)
    writers.remove(spark, events)
    return out


@query(
    "stream_jobs",
    ENRICHED_SQL
    + """select job_id, strftime(started_at, '%Y%m%d') as start_date_key, name, status, job_type,
      error_taxonomy, coalesce(i_pod_name, '') as pod_name, final_attempt from enriched""",
    *BINDINGS,
)
def stream_jobs(spark, sf):
    out = _run_jobs(spark, sf)
    fact = writers.read_table(spark, out, "fact_job")
    result = writers.read_table(spark, out, "dim_job_result")
    retry = writers.read_table(spark, out, "dim_job_retry")
    return fact.join(result, "job_result_id").join(retry, "job_retry_id").select(
        "job_id", F.col("start_date_key").cast("string").alias("start_date_key"), "name",
        "status", "job_type", "error_taxonomy", "pod_name", "final_attempt",
    )


STREAM_TIMINGS_SQL = ENRICHED_SQL + """, bj as (select job_id, i_package_hash as own,
    strftime(started_at, '%Y%m%d') as date_key from enriched where job_type = 'build' and status = 'success'),
  pk as (select distinct i_package_name as name from enriched),
  sp as (select distinct i_package_hash as hash from enriched),
  ft as (select distinct t.job_id, date_key, cache, t.name, t.hash, phase from b_install_times t
    join bj on bj.job_id = t.job_id where (cache or t.hash = own)
      and t.name in (select name from pk where name is not null)
      and t.hash in (select hash from sp where hash is not null))"""


@query(
    "stream_timings",
    STREAM_TIMINGS_SQL
    + """select 'timer' as kind, job_id, date_key, name, cast(null as varchar) as phase, cache
      from ft group by all
    union all select 'phase', job_id, date_key, name, phase, cache from ft""",
    *BINDINGS,
    "install_times",
)
def stream_timings(spark, sf):
    out = _run_jobs(spark, sf)
    rows = stage(timing_rows(spark, sf), "timings", DENSE)
    path = rows.inputFiles()[0].rsplit("/", 1)[0]
    source = spark.readStream.schema(rows.schema).parquet(path)
    run = streams.stream_timings(source, out, scratch_path(spark, "ckpt"))
    run.awaitTermination()
    discard(rows)
    timer = writers.read_table(spark, out, "fact_timer")
    phase = writers.read_table(spark, out, "fact_timer_phase")
    day = F.col("date_key").cast("string").alias("date_key")
    name = F.col("package").alias("name")
    return timer.select(
        F.lit("timer").alias("kind"), "job_id", day, name,
        F.lit(None).cast("string").alias("phase"), "cache",
    ).unionByName(
        phase.select(F.lit("phase").alias("kind"), "job_id", day, name, "phase", "cache")
    )


@query(
    "stream_job_logs",
    """select job_id, md5(trace) as digest, strftime(date '2024-01-01' + cast(job_id % 9 as int),
      'gitlab-job-logs-%Y%m%d') as log_index from b_traces""",
    "traces",
)
def stream_job_logs(spark, sf):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("job_id") % 9).cast("int"))
    docs = bind(spark, sf, "traces").withColumn("timestamp", day.cast("timestamp_ntz"))
    path = scratch_path(spark, "documents")
    docs.write.parquet(path)
    out = scratch_path(spark, "log-index")
    source = spark.readStream.schema(docs.schema).parquet(path)
    streams.stream_job_logs(source, out, scratch_path(spark, "ckpt"), AS_OF).awaitTermination()
    return spark.read.parquet(out).select("job_id", F.md5("job_trace").alias("digest"), "log_index")


@query(
    "stream_access_logs",
    f"""select regexp_extract(line, {quote(_APACHE)}, 5) as path,
      cast(regexp_extract(line, {quote(_APACHE)}, 6) as int) as code,
      strftime(strptime(regexp_extract(line, {quote(_APACHE)}, 3), '%d/%b/%Y:%H:%M:%S +0000'),
        {DUCK_TS}) as ts from b_access_lines""",
    "access_lines",
)
def stream_access_logs(spark, sf):
    path = scratch_path(spark, "lines")
    bind(spark, sf, "access_lines").select("line").write.text(path)
    source = spark.readStream.text(path).withColumnRenamed("value", "line")
    out = scratch_path(spark, "access")
    run = streams.stream_access_logs(source, "apache", out, scratch_path(spark, "ckpt"))
    run.awaitTermination()
    return spark.read.parquet(out).select("path", "code", ts_text("ts").alias("ts"))


@query(
    "stream_alerts",
    ALERT_SQL + "select pod, round(ts, 3) as ts, round(since, 3) as active_since from al",
    "samples",
)
def stream_alerts(spark, sf):
    rows = samples(spark, sf).select("pod", "ts", "value")
    path = scratch_path(spark, "evaluations")
    # Written by slices of two days, several files at a time and in no order within a write; a last
    # evaluation of no pod, far behind the others, lets the watermark pass them all.
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    slice_ = F.floor(F.col("ts") / 172800)
    half = (low + high) / 2
    for part in (F.col("ts") < half, F.col("ts") >= half):
        rows.where(part).repartition(slice_).write.mode("append").parquet(path)
    span = int(high - low) + 1
    end = spark.range(1).select(
        F.lit(None).cast("string").alias("pod"), F.lit(high + 2.0 * span).alias("ts"),
        F.lit(0.0).alias("value"),
    )
    end.write.mode("append").parquet(path)
    source = (
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)
    )
    out = scratch_path(spark, "alerts")
    run = alerts.stream_alerts(
        source, ["pod"], F.col("value") > 20, 86400.0, f"{span} seconds", out,
        scratch_path(spark, "ckpt"),
    )
    run.awaitTermination()
    return spark.read.parquet(out).select(
        "pod", F.round("ts", 3).alias("ts"), F.round("active_since", 3).alias("active_since")
    )
