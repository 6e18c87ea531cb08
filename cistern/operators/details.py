"""One record for each job from its metrics, its artifacts or its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.scratch import discard, stage
from . import facts, metrics

#: Columns of a record, in the names that warehouse.enrich_jobs reads.
DETAILS = (
    "package_name", "package_hash", "package_version", "compiler_name", "compiler_version", "arch",
    "variants", "stack", "job_size", "build_jobs", "pod_name", "pod_node_occupancy",
    "pod_cpu_usage_seconds", "pod_max_mem", "pod_avg_mem", "pod_cpu_request", "pod_cpu_limit",
    "pod_memory_request", "pod_memory_limit", "system_uuid", "node_name", "node_cpu", "node_memory",
    "capacity_type", "instance_type", "spot_price",
)
PACKAGE = DETAILS[:7]
MISC = DETAILS[7:10]
#: What the labels of a pod call the columns of a record, where they differ.
_LABELS = {"variants": "package_variants"}


def job_details(
    samples: DataFrame, jobs: DataFrame, artifacts: DataFrame, lookback: float = metrics.LOOKBACK,
    width: float = metrics.SLICE,
) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): job_id, info_source, DETAILS and metrics_problem of each job, or why it has none.

    jobs: job_id, name, status, is_build, start_ts, end_ts; artifacts: job_id, missing_variable and
    the columns of PACKAGE and MISC, a row for each job that has artifacts.

    What the metrics tell of a job is looked up between its start and its end: its pod by the job's
    id, the pod's node, resources and labels, the node's identity, size and price, and the use that
    the pod made of it. Where a lookup finds no series, or more than one, the metrics don't count
    (metrics_problem says which) and the record comes from the artifacts or the name, as
    `facts.job_info_cascade` has it.

    Every source sends its own columns tagged by the job, and one aggregate by job puts the record
    together; sources aren't joined to each other. The records are written once, for both results, and
    what was written for them before is deleted then.
    """
    windows = jobs.select(F.col("job_id").alias("window_id"), "is_build", "start_ts", "end_ts")
    notes = metrics.select_series(samples, "kube_pod_annotations")
    by_job = metrics.one_series(
        notes.withColumn("key", metrics.label(fixed.POD_JOB_ID)),
        metrics.questions(
            windows.withColumn("job", F.col("window_id").cast("string")), "job",
            ["kube_pod_annotations"],
        ),
        10, lookback, width, ["pod"],
    )
    # What several lookups read is written once: a row for each job.
    pods = by_job.where("problem IS NULL").select(
        "window_id", metrics.label("pod").alias("pod"), "start_ts", "end_ts"
    ).where("pod IS NOT NULL")
    pods = stage(pods, "pods")
    nodes = stage(metrics.nodes_in_windows(samples, pods, lookback, width), "nodes")
    placed, lost = metrics.settled(nodes, "window_id", "pod_node")
    priced = stage(metrics.spot_price(samples, placed, width), "prices")
    limits = metrics.pod_requests_limits(samples, pods, lookback, width)
    build = [("container", "=", "build")]
    cpu = metrics.select_series(samples, "container_cpu_usage_seconds_total", build)
    memory = metrics.select_series(samples, "container_memory_working_set_bytes", build)
    on_node = placed.select("window_id", "pod", "node", "start_ts", "end_ts")
    usage = metrics.own_usage(cpu, memory, on_node, 100, lookback, width)
    shares, alone = metrics.node_occupancy(
        cpu.withColumn("node", metrics.label("node")), on_node.drop("pod"), "node", 100, lookback,
        width,
    )
    asked = pods.join(windows.where("is_build").select("window_id"), "window_id", "left_semi")
    tags = metrics.answers(
        metrics.one_series(
            samples.withColumn("key", metrics.label("pod")),
            metrics.questions(asked, "pod", list(metrics.POD_QUESTIONS)), 10, lookback, width,
            metrics.POD_NAMES,
        ),
        metrics.POD_QUESTIONS,
    )
    tags = stage(tags, "tags")
    cells, missing = metrics.label_columns()

    def tell(df: DataFrame, key: str, **columns: Column) -> DataFrame:
        return df.select(F.col(key).cast("string").alias("job"), *[v.alias(c) for c, v in columns.items()])

    def reasons(df: DataFrame, rank: int) -> DataFrame:
        return tell(df, "key", trouble=F.struct(F.lit(rank).alias("rank"), "reason"))

    labelled = {f"m_{c}": cells[_LABELS.get(c, c)] for c in (*PACKAGE, *MISC)}
    unpriced = metrics.price_rejects(priced)
    # The share of its node that a pod has counts for nothing without the pod's own use, and so on:
    # each part that a record needs marks itself.
    parts = [
        tell(jobs, "job_id", job_id=F.col("job_id"), name=F.col("name"), status=F.col("status"),
             is_build=F.col("is_build")),
        tell(pods, "window_id", pod_name=F.col("pod")),
        tell(priced.where("spot_price IS NOT NULL"), "window_id", node_name=F.col("node"),
             system_uuid=F.col("system_uuid"), node_cpu=F.col("cpu"), node_memory=F.col("memory"),
             capacity_type=F.col("capacity_type"), instance_type=F.col("instance_type"),
             spot_price=F.col("spot_price")),
        tell(limits, "window_id", **{f"pod_{c}": F.col(c) for c in
             ("cpu_request", "cpu_limit", "memory_request", "memory_limit")}),
        tell(usage, "window_id", pod_cpu_usage_seconds=F.col("cpu_usage_seconds"),
             pod_max_mem=F.col("max_memory"), pod_avg_mem=F.col("avg_memory")),
        tell(shares, "window_id", pod_node_occupancy=F.col("node_occupancy")),
        tell(tags.where("problem IS NULL"), "window_id", labelled=F.lit(True), missing_label=missing,
             **labelled),
        tell(artifacts, "job_id", has_artifacts=F.lit(True),
             missing_variable=F.col("missing_variable"),
             **{f"a_{c}": F.col(c) for c in (*PACKAGE, *MISC)}),
        reasons(lost, 1),
        reasons(unpriced, 2),
        reasons(alone, 3),
        reasons(tags.where("problem IS NOT NULL").select(
            F.col("window_id").alias("key"), F.col("problem").alias("reason")), 5),
    ]
    tagged = parts[0]
    for p in parts[1:]:
        tagged = tagged.unionByName(p, allowMissingColumns=True)
    values = [c for c in tagged.columns if c not in ("job", "trouble")]
    whole = tagged.groupBy("job").agg(
        *[F.max(c).alias(c) for c in values], F.min("trouble").alias("trouble")
    ).where("job_id IS NOT NULL")
    whole = stage(whole, "details")
    discard(pods, nodes, priced, tags)

    measured = [F.col(c).isNotNull() for c in ("node_name", "pod_cpu_usage_seconds", "pod_node_occupancy")]
    known = measured[0] & measured[1] & measured[2]
    has_metrics = known & (~F.col("is_build") | F.coalesce("labelled", F.lit(False)))
    problem = (
        F.when(has_metrics, F.lit(None).cast("string"))
        .when(F.col("pod_name").isNull(), "no pod of the job")
        .otherwise(F.coalesce("trouble.reason", F.lit("no usage of the pod")))
    )
    routed = facts.parse_job_name(
        whole.withColumn("metrics_problem", problem).withColumn("_metrics", has_metrics), "name"
    )
    source, reason = facts.info_route(
        F.col("_metrics"), F.col("missing_label"), F.coalesce("has_artifacts", F.lit(False)),
        F.col("missing_variable"),
    )
    routed = routed.withColumn("info_source", source).withColumn("_reason", reason)
    by_metrics = F.col("info_source") == "metrics"

    def detail(c: str) -> Column:
        if c in (*PACKAGE, *MISC):
            out = F.when(by_metrics & F.col("is_build"), F.col(f"m_{c}"))
            out = out.when(F.col("info_source") == "artifacts", F.col(f"a_{c}"))
            if c in PACKAGE:
                out = out.when(F.col("info_source") == "name", F.col(c) if c in PACKAGE[:3] else F.lit(""))
            return out
        return F.when(by_metrics, F.col(c))

    records = routed.where("info_source <> 'reject'").select(
        "job_id", "info_source", *[detail(c).alias(c) for c in DETAILS], "metrics_problem"
    )
    rejects = routed.where("info_source = 'reject'").select(
        F.col("job").alias("key"), F.lit("job_details").alias("operator"),
        F.col("_reason").alias("reason"),
    )
    return records, rejects
