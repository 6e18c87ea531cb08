"""Time series: range samples, PromQL-style functions, alerts, panels, usage and cost.

Every operator takes `samples(metric, labels, ts, value)` with ts in epoch seconds. A series is a
metric with one set of labels; `with_series` names it by a hash. Rates and differences use the
first and last samples of the window, without extrapolation to its edges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import is_true
from ..sources.scratch import stage
from . import runs as vectors
from .rolling import held_since, reach_width, slice_of, with_next, with_previous

LOOKBACK = 300.0
SLICE = 3600.0


def label(name: str) -> Column:
    return F.try_element_at("labels", F.lit(name))


def with_series(samples: DataFrame, packed: bool = False) -> DataFrame:
    """Adds `series`, a hash of the metric and its sorted labels.

    packed: as 16 bytes instead of their 32 digits, in the same order; for rows that are shuffled and
    don't show it.
    """
    if "series" in samples.columns:
        return samples
    entries = F.array_sort(F.map_entries("labels"))
    text = F.transform(
        entries, lambda e: F.concat_ws("\u001f", e["key"], F.coalesce(e["value"], F.lit("")))
    )
    digest = F.md5(F.concat_ws("\u001e", F.col("metric"), F.array_join(text, "\u001e")))
    return samples.withColumn("series", F.unhex(digest) if packed else digest)


def select_series(
    samples: DataFrame, metric: str | None = None, matchers: Sequence[tuple[str, str, str]] = ()
) -> DataFrame:
    """Series whose labels satisfy every (label, operator, value) matcher.

    Operators are =, !=, =~ and !~; patterns must match the whole value, and an absent label reads
    as an empty string.
    """
    out = samples if metric is None else samples.where(F.col("metric") == metric)
    for name, op, value in matchers:
        have = F.coalesce(label(name), F.lit(""))
        tests = {
            "=": have == value,
            "!=": have != value,
            "=~": have.rlike(f"^(?:{value})$"),
            "!~": ~have.rlike(f"^(?:{value})$"),
        }
        out = out.where(tests[op])
    return out


def single_series(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the keys that have exactly one series, and a reject per key that has more."""
    rows = with_series(df)
    per_key = rows.groupBy(key).agg(F.min("series").alias("lo"), F.max("series").alias("hi"))
    many = per_key.where("lo <> hi")
    good = rows.join(many.select(key), key, "left_anti")
    rejects = many.select(
        F.col(key).cast("string").alias("key"),
        F.lit("single_series").alias("operator"),
        F.lit("more than one series").alias("reason"),
    )
    return good, rejects


def spans(samples: DataFrame, lookback: float = LOOKBACK, sliced: str | None = None) -> DataFrame:
    """Adds until/closed: a sample is the current one from ts to `until`.

    That is up to the series' next sample (not included), or up to ts + lookback (included) when
    none comes by then. sliced: as `with_next` has it.
    """
    rows = with_series(samples)
    nxt = with_next(rows, ["series"], "ts", "value", lookback, F.col("ts"), "next_ts", sliced)
    end = F.col("ts") + F.lit(float(lookback))
    return nxt.select(
        *rows.columns,
        F.coalesce("next_ts", end).alias("until"),
        F.col("next_ts").isNull().alias("closed"),
        *([sliced] if sliced else []),
    )


def _grid(start: Column, end: Column, step: float, closed: Column) -> Column:
    """Multiples of step from start to end, as their numbers; end counts only if closed."""
    first = F.ceil(start / F.lit(float(step))).cast("bigint")
    last = F.floor(end / F.lit(float(step))).cast("bigint")
    on_end = (last * F.lit(float(step)) == end) & ~closed
    last = F.when(on_end, last - 1).otherwise(last)
    return F.when(first <= last, F.sequence(first, last))


def instant(samples: DataFrame, step: float, lookback: float = LOOKBACK) -> DataFrame:
    """Value of every series at each multiple of step: its last sample within lookback."""
    held = spans(samples, lookback)
    points = held.withColumn(
        "_k", F.explode(_grid(F.col("ts"), F.col("until"), step, F.col("closed")))
    )
    return points.select(
        "metric", "labels", "series", (F.col("_k") * F.lit(float(step))).alias("ts"), "value"
    )


def range_step(start: Column, end: Column, parts: int) -> Column:
    """Whole seconds between grid points: a tenth (or hundredth) of the window, rounded up."""
    return F.greatest(F.ceil((end - start) / F.lit(parts)), F.lit(1)).cast("double")


def _meet(held: DataFrame, windows: DataFrame, key: str, parts: int, width: float) -> DataFrame:
    """Windows with the spans of their key that hold at one of their grid points or more.

    Adds step and the first and last grid number, `k_from` and `k_to`. Both sides are cut into
    time slices and joined by (key, slice): no key's history meets in one task, and the range
    condition rides on an equality. A span counts in the slice where it starts or, if that is
    earlier, where the window starts, so every pair is found once.
    """
    def slices(rows: DataFrame, first: str, last: str, own: str) -> DataFrame:
        there = rows.withColumn(own, slice_of(F.col(first), width))
        return there.withColumn("_slice", F.explode(F.sequence(own, slice_of(F.col(last), width))))

    spread = slices(held, "ts", "until", "_ts_slice")
    cut = windows.withColumn("step", range_step(F.col("start_ts"), F.col("end_ts"), parts))
    cut = slices(cut, "start_ts", "end_ts", "_start_slice")
    start, step = F.col("start_ts"), F.col("step")
    met = cut.join(spread, [key, "_slice"]).where(
        (F.col("_slice") == F.greatest("_ts_slice", "_start_slice"))
        & (F.col("until") >= start)
        & (F.col("ts") <= F.col("end_ts"))
    )
    at = lambda k: start + k * step
    # Division may round either way, so the numbers are settled by comparing the grid points. Each
    # estimate is a column of its own and read in sums, which costs one division a pair.
    met = met.withColumns({
        "_low": F.greatest(F.ceil((F.col("ts") - start) / step) - 1, F.lit(0)),
        "_high": F.floor((F.least(F.col("until"), F.col("end_ts")) - start) / step) + 1,
    })
    low, high = F.col("_low"), F.col("_high")

    def late(k: Column) -> Column:
        """1 for a grid point before the span."""
        return (at(k) < F.col("ts")).cast("int")

    def over(k: Column) -> Column:
        """1 for a grid point past the span or the window."""
        past = F.when(F.col("closed"), at(k) > F.col("until")).otherwise(at(k) >= F.col("until"))
        return (past | (at(k) > F.col("end_ts"))).cast("int")

    ranged = met.withColumns({
        "k_from": (low + late(low) + late(low + 1)).cast("bigint"),
        "k_to": (high - over(high) - over(high - 1) - over(high - 2)).cast("bigint"),
    })
    return ranged.where("k_from <= k_to").drop(
        "_slice", "_ts_slice", "_start_slice", "_low", "_high"
    )


def range_sample(
    samples: DataFrame,
    windows: DataFrame,
    key: str,
    parts: int = 10,
    lookback: float = LOOKBACK,
    width: float = SLICE,
    runs: bool = False,
    by_window: bool = False,
) -> DataFrame:
    """Values of the series of each window's key at start, start + step, ... up to end.

    windows: window_id, <key>, start_ts, end_ts; samples carry <key> as a column. runs: one row for
    the points at which the same sample is read, ts being the first of them, instead of a row for each;
    adds last_ts and points, the last of them and how many they are.

    by_window: the runs of each window as one row, for keys with many series: window_id, <key>, start_ts,
    step, series and runs. series are those that the window reads, each once; a run is the place of its
    series among them, from 0, the numbers of its first and last grid point, and the value there.
    """
    if by_window:
        return _read_by_window(spans(samples, lookback), windows, key, parts, width)
    met = _meet(spans(samples, lookback), windows, key, parts, width)
    at = lambda k: F.col("start_ts") + F.col(k) * F.col("step")
    columns = ["window_id", key, "metric", "labels", "series", "step"]
    if runs:
        return met.select(
            *columns, at("k_from").alias("ts"), "value", at("k_to").alias("last_ts"),
            (F.col("k_to") - F.col("k_from") + 1).alias("points"),
        )
    points = met.withColumn("_k", F.explode(F.sequence("k_from", "k_to")))
    return points.select(*columns, at("_k").alias("ts"), "value")


def _read_by_window(held: DataFrame, windows: DataFrame, key: str, parts: int, width: float) -> DataFrame:
    """`range_sample` by window: windows that start in one slice are a group, with the spans that reach it.

    How far the windows of a group go is known from a row for each group, so a span goes to the groups
    that may read it and to no other. Pairs are made inside the tasks (`runs`).
    """
    asked = windows.where((F.col("start_ts") <= F.col("end_ts")) & F.col(key).isNotNull()).select(
        key, slice_of(F.col("start_ts"), width).alias("_group"), "window_id", "start_ts", "end_ts"
    )
    groups = asked.groupBy(key, "_group").agg(F.max(slice_of(F.col("end_ts"), width)).alias("_last"))
    groups = groups.withColumn("_slice", F.explode(F.sequence("_group", "_last")))
    there = held.where("ts <= until").withColumn("_own", slice_of(F.col("ts"), width))
    there = there.withColumn("_slice", F.explode(F.sequence("_own", slice_of(F.col("until"), width))))
    # Each span counts once in a group: where it starts or, if that is earlier, where the group does.
    near = there.join(groups, [key, "_slice"]).where(F.col("_slice") == F.greatest("_own", "_group"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = near.select(
        key, "_group", F.lit(False).alias("is_window"),
        none(windows.schema["window_id"].dataType).alias("window_id"), "series", F.col("ts").alias("at"),
        "until", "closed", F.col("value").cast("double").alias("value"),
    ).unionByName(asked.select(
        key, "_group", F.lit(True).alias("is_window"), "window_id", none(held.schema["series"].dataType).alias("series"),
        F.col("start_ts").alias("at"), F.col("end_ts").alias("until"), none("boolean").alias("closed"),
        none("double").alias("value"),
    ))
    spark = windows.sparkSession
    tasks = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    order = [key, "_group", "is_window"]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("window_id", key, "series")}
    return rows.repartition(tasks, key, "_group").sortWithinPartitions(*order).mapInArrow(
        vectors.reader(key, parts),
        f"window_id {kinds['window_id']}, {key} {kinds[key]}, start_ts DOUBLE, step DOUBLE, "
        f"series ARRAY<{kinds['series']}>, runs ARRAY<{vectors.RUN}>",
    )


def presence(
    samples: DataFrame, key: str, lookback: float, width: float, keep: Sequence[str] = ()
) -> DataFrame:
    """Times in which each series has a value, its spans joined where one follows the other.

    Spans are joined within a slice of time, so a long-lived series gives one row per slice. keep:
    further columns, the same for all rows of a series.
    """
    rows = with_series(samples, packed=True)
    if float(width) == reach_width(lookback):  # the slices that the spans were found in
        held = spans(rows, lookback, "_slice")
    else:
        held = spans(rows, lookback).withColumn("_slice", slice_of(F.col("ts"), width))
    before = (
        Window.partitionBy("series", "_slice")
        .orderBy("ts", "until")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    breaks = F.coalesce(F.sum(F.col("closed").cast("int")).over(before), F.lit(0))
    runs = held.select(
        "series", key, *keep, "ts", "until", "closed", "_slice", breaks.alias("_run")
    )
    return runs.groupBy("series", key, "_slice", "_run").agg(
        F.min("ts").alias("ts"),
        F.max("until").alias("until"),
        F.bool_or("closed").alias("closed"),
        *[F.first(c).alias(c) for c in keep],
    ).drop("_slice", "_run")


def one_series(
    samples: DataFrame, asked: DataFrame, parts: int = 10, lookback: float = LOOKBACK,
    width: float = SLICE, names: Sequence[str] | None = None,
) -> DataFrame:
    """Labels of the one series that each window's question finds.

    samples carry `key`; asked: window_id, metric, key, start_ts, end_ts, several questions a
    window. A series is found if it has a value at start, start + step, ... up to end. Adds labels
    and problem: NULL, or that there is no such series or more than one. names: the labels that are
    read, if not all of them; a series is still what all of its labels say.

    Series become intervals of time in which they are valid, and intervals meet windows by metric,
    key and slice of time, so a name that is used again later is another series to later windows.
    """
    both = F.concat_ws("\u001f", "metric", "key")
    # A few names: the samples stay where they are, also where they are all of one metric.
    wanted = F.broadcast(asked.select("metric").distinct())
    rows = samples.join(wanted, "metric", "left_semi").withColumn("_key", both)
    if names is not None:
        rows = with_series(rows, packed=True).withColumn(
            "labels", F.map_filter("labels", lambda k, _: k.isin(*names))
        )
    held = presence(rows, "_key", lookback, width, ["labels"])
    windows = asked.withColumn("_key", both)
    found = _meet(held, windows, "_key", parts, width).groupBy("window_id", "metric").agg(
        F.min("series").alias("_lo"), F.max("series").alias("_hi"),
        F.min_by("labels", "series").alias("_labels"),
    )
    problem = F.when(F.col("_lo").isNull(), "no series").when(
        F.col("_lo") != F.col("_hi"), "more than one series"
    )
    return asked.join(found, ["window_id", "metric"], "left").select(
        *asked.columns, F.when(problem.isNull(), F.col("_labels")).alias("labels"),
        problem.alias("problem"),
    )


def questions(windows: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Each window with each metric: what `one_series` is asked."""
    return windows.select(
        "window_id", F.explode(F.array(*map(F.lit, metrics))).alias("metric"),
        F.col(key).alias("key"), "start_ts", "end_ts",
    )


def answers(found: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
    """A row for each window: the labels found for each metric under its name, and the problem.

    The problem is that of the first metric, in the order given, that has one.
    """
    cells, problem = [], None
    for metric, name in metrics.items():
        own = F.col("metric") == metric
        cells.append(F.first(F.when(own, F.col("labels")), True).alias(name))
        said = F.max(F.when(own, F.concat(F.lit(f"{metric}: "), F.col("problem"))))
        problem = said if problem is None else F.coalesce(problem, said)
    return found.groupBy("window_id").agg(*cells, problem.alias("problem"))


def pod_for_job(samples: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pod of each job: the one annotation series of its job id in its window, else NULL.

    jobs: job_id, start_ts, end_ts
    """
    notes = with_series(select_series(samples, "kube_pod_annotations")).select(
        label(fixed.POD_JOB_ID).alias("_job"), label("pod").alias("_pod"), "series", "ts"
    )
    windows = jobs.withColumn("_job", F.col("job_id").cast("string"))
    near = notes.join(windows, "_job").where(
        (F.col("ts") >= F.col("start_ts") - LOOKBACK) & (F.col("ts") <= F.col("end_ts"))
    )
    found = near.groupBy("job_id").agg(
        F.min("_pod").alias("_pod"), F.min("series").alias("lo"), F.max("series").alias("hi")
    )
    one = found.where("lo = hi").select("job_id", F.col("_pod").alias("pod"))
    return jobs.join(one, "job_id", "left")


def pod_requests_limits(
    samples: DataFrame, windows: DataFrame | None = None, lookback: float = LOOKBACK,
    width: float = SLICE,
) -> DataFrame:
    """First value of each resource request and limit per pod, NULL where there is none.

    windows (window_id, pod, start_ts, end_ts): a row for each window, with the first values at its
    grid points; of several series of a resource the first by name counts.
    """
    kinds = {"request": "kube_pod_container_resource_requests",
             "limit": "kube_pod_container_resource_limits"}
    build = select_series(samples, matchers=[("container", "=", "build")]).where(
        F.col("metric").isin(*kinds.values())
    )
    resource = label("resource")
    cells, first = [], ["ts", "value"]
    if windows is not None:
        # What is asked of the labels, instead of the labels, goes through the shuffles.
        own = with_series(build, packed=True).select(
            label("pod").alias("pod"), resource.alias("resource"), "metric", "series", "ts", "value"
        ).where(F.col("resource").isin("cpu", "memory"))
        met, first = _meet(spans(own, lookback), windows, "pod", 10, width), ["series", "k_from"]
        resource = F.col("resource")
    for res in ("cpu", "memory"):
        for kind, metric in kinds.items():
            hit = (F.col("metric") == metric) & (resource == res)
            cells.append(
                F.min_by("value", F.when(hit, F.struct(*first))).alias(f"{res}_{kind}")
            )
    if windows is None:
        return build.groupBy(label("pod").alias("pod")).agg(*cells)
    found = met.groupBy("window_id").agg(*cells)
    return windows.select("window_id", "pod").join(found, "window_id", "left")


POD_QUESTIONS = {"kube_pod_annotations": "note", "kube_pod_labels": "tag"}


#: Labels that `label_columns` reads.
POD_NAMES = (
    *fixed.POD_ANNOTATIONS.values(), *fixed.POD_LABELS.values(), *fixed.POD_OPTIONAL_ANNOTATIONS.values(),
    fixed.POD_BUILD_JOBS,
)


def label_columns(note: str = "note", tag: str = "tag") -> tuple[dict[str, Column], Column]:
    """Package and stack details from a pod's annotations and labels, and the first that is missing."""
    required = {
        **{c: F.try_element_at(note, F.lit(k)) for c, k in fixed.POD_ANNOTATIONS.items()},
        **{c: F.try_element_at(tag, F.lit(k)) for c, k in fixed.POD_LABELS.items()},
    }
    keys = {**fixed.POD_ANNOTATIONS, **fixed.POD_LABELS}
    missing = None
    for c, v in required.items():
        gone = v.isNull()
        missing = F.when(gone, keys[c]) if missing is None else missing.when(gone, keys[c])
    optional = {
        c: F.coalesce(F.try_element_at(note, F.lit(k)), F.lit(""))
        for c, k in fixed.POD_OPTIONAL_ANNOTATIONS.items()
    }
    jobs = F.try_element_at(note, F.lit(fixed.POD_BUILD_JOBS)).try_cast("int")
    return {**required, **optional, "build_jobs": jobs}, missing


def pod_labels(
    samples: DataFrame, windows: DataFrame | None = None, lookback: float = LOOKBACK,
    width: float = SLICE,
) -> tuple[DataFrame, DataFrame]:
    """Package and stack details per pod from its annotations and labels, and the rejects.

    A pod needs exactly one series of each kind and every required label. windows (window_id, pod,
    start_ts, end_ts): a row or a reject for each window, by the series valid in it.
    """
    if windows is not None:
        keyed = samples.withColumn("key", label("pod"))
        found = one_series(
            keyed, questions(windows, "pod", list(POD_QUESTIONS)), 10, lookback, width, POD_NAMES
        )
        rows = answers(found, POD_QUESTIONS)
        cells, missing = label_columns()
        named = F.concat(F.lit("missing label "), missing)
        out = windows.select("window_id", "pod").join(rows, "window_id").select(
            "window_id", "pod", *[v.alias(c) for c, v in cells.items()],
            F.coalesce("problem", named).alias("_problem"),
        )
        return settled(out, "window_id", "pod_labels")
    notes = select_series(samples, "kube_pod_annotations")
    tags = select_series(samples, "kube_pod_labels")

    def one(df: DataFrame, name: str) -> DataFrame:
        rows = with_series(df).withColumn("pod", label("pod"))
        return rows.groupBy("pod").agg(
            F.min_by("labels", "series").alias(name),
            F.min("series").alias(f"{name}_lo"),
            F.max("series").alias(f"{name}_hi"),
        )

    both = one(notes, "note").join(one(tags, "tag"), "pod", "full")
    cells, missing = label_columns()
    unique = is_true(
        (F.col("note_lo") == F.col("note_hi")) & (F.col("tag_lo") == F.col("tag_hi"))
    )
    out = both.select(
        "pod",
        *[v.alias(c) for c, v in cells.items()],
        F.when(~unique, "not exactly one series")
        .otherwise(F.concat(F.lit("missing label "), missing))
        .alias("_problem"),
    )
    return settled(out, "pod", "pod_labels")


def settled(out: DataFrame, key: str, operator: str) -> tuple[DataFrame, DataFrame]:
    """Rows without a `_problem`, and the others as rejects."""
    rejects = out.where("_problem IS NOT NULL").select(
        F.col(key).cast("string").alias("key"), F.lit(operator).alias("operator"),
        F.col("_problem").alias("reason"),
    )
    return out.where("_problem IS NULL").drop("_problem"), rejects


NODE_QUESTIONS = {"kube_node_info": "info", "kube_node_labels": "size"}


def placements(samples: DataFrame) -> DataFrame:
    return select_series(
        samples, "kube_pod_info", [("node", "=~", ".+"), ("pod_ip", "=~", ".+")]
    )


def node_series(samples: DataFrame) -> DataFrame:
    """Series that tell a node's identity and size, keyed by the node."""
    ready = [(k, "=~", v) for k, v in fixed.NODE_READY_LABELS.items()]
    rows = select_series(samples, "kube_node_info").unionByName(
        select_series(samples, "kube_node_labels", ready)
    )
    return rows.withColumn("key", label("node"))


#: Labels that `node_columns` reads.
NODE_NAMES = ("system_uuid", *(fixed.NODE_LABELS[k] for k in ("cpu", "memory", "capacity_type", "instance_type", "zone")))


def node_columns(info: str = "info", size: str = "size") -> dict[str, Column]:
    names = fixed.NODE_LABELS
    of = lambda k: F.try_element_at(size, F.lit(names[k]))
    return {
        "system_uuid": F.try_element_at(info, F.lit("system_uuid")),
        "cpu": of("cpu").try_cast("int"),
        "memory": of("memory").try_cast("bigint") * 1_000_000,
        "capacity_type": of("capacity_type"),
        "instance_type": of("instance_type"),
        "zone": of("zone"),
    }


def nodes_in_windows(
    samples: DataFrame, windows: DataFrame, lookback: float = LOOKBACK, width: float = SLICE
) -> DataFrame:
    """Each window with its pod's node and the node's details, or `_problem`."""
    asked = questions(windows, "pod", ["kube_pod_info"])
    placed = placements(samples).withColumn("key", label("pod"))
    where = one_series(placed, asked, 10, lookback, width, ["node"]).select(
        "window_id", F.col("key").alias("pod"), label("node").alias("node"), "start_ts", "end_ts",
        F.concat(F.lit("kube_pod_info: "), F.col("problem")).alias("_lost"),
    )
    where = stage(where, "placed")  # read for the nodes' questions and for the answers
    known = where.where("_lost IS NULL")
    found = one_series(
        node_series(samples), questions(known, "node", list(NODE_QUESTIONS)), 10, lookback, width,
        NODE_NAMES,
    )
    return where.join(answers(found, NODE_QUESTIONS), "window_id", "left").select(
        "window_id", "pod", "node", "start_ts", "end_ts",
        *[v.alias(c) for c, v in node_columns().items()],
        F.coalesce("_lost", "problem").alias("_problem"),
    )


def pod_node(
    samples: DataFrame, windows: DataFrame | None = None, lookback: float = LOOKBACK,
    width: float = SLICE,
) -> tuple[DataFrame, DataFrame]:
    """Node of each pod with its uuid, size, capacity type, instance type and zone.

    windows (window_id, pod, start_ts, end_ts): a row or a reject for each window. The node is that
    of the one placement valid in the window, its details those of the one series of each kind.
    """
    if windows is not None:
        nodes = stage(nodes_in_windows(samples, windows, lookback, width), "nodes")
        return settled(nodes, "window_id", "pod_node")
    placed = placements(samples)
    placed, r1 = single_series(placed.withColumn("pod", label("pod")), "pod")
    pods = placed.groupBy("pod").agg(F.min(label("node")).alias("node"))
    infos, r2 = single_series(
        select_series(samples, "kube_node_info").withColumn("node", label("node")), "node"
    )
    uuids = infos.groupBy("node").agg(F.min(label("system_uuid")).alias("system_uuid"))
    ready = select_series(
        samples,
        "kube_node_labels",
        [(k, "=~", v) for k, v in fixed.NODE_READY_LABELS.items()],
    )
    tagged, r3 = single_series(ready.withColumn("node", label("node")), "node")
    names = fixed.NODE_LABELS
    sizes = tagged.groupBy("node").agg(
        F.min(label(names["cpu"])).try_cast("int").alias("cpu"),
        (F.min(label(names["memory"])).try_cast("bigint") * 1_000_000).alias("memory"),
        F.min(label(names["capacity_type"])).alias("capacity_type"),
        F.min(label(names["instance_type"])).alias("instance_type"),
        F.min(label(names["zone"])).alias("zone"),
    )
    nodes = uuids.join(sizes, "node")
    lost = pods.join(nodes.select("node"), "node", "left_anti").select(
        F.col("pod").cast("string").alias("key"), F.lit("pod_node").alias("operator"),
        F.concat(F.lit("no details of node "), F.col("node")).alias("reason"),
    )
    return pods.join(nodes, "node"), r1.unionByName(r2).unionByName(r3).unionByName(lost)


PRICE_KEY = ("capacity_type", "instance_type", "zone")


def price_rejects(priced: DataFrame) -> DataFrame:
    """A reject for each window that `spot_price` found no price for."""
    return priced.where("spot_price IS NULL").select(
        F.col("window_id").cast("string").alias("key"), F.lit("spot_price").alias("operator"),
        F.concat(F.lit("no price of "), F.concat_ws(", ", *PRICE_KEY)).alias("reason"),
    )


def spot_price(samples: DataFrame, windows: DataFrame, width: float = 3600.0) -> DataFrame:
    """Mean price of each window's kind of node; NULL where the window has no price, which
    `price_rejects` reports.

    windows: window_id, capacity_type, instance_type, zone, start_ts, end_ts

    One kind of node can serve most jobs, so windows never meet its samples one by one. Prices are
    summed per slice of time, and a running sum within each slice is read where a window starts
    and where it ends: a window is its slices up to the last, plus the part of the last slice
    before its end, minus the part of the first slice before its start.

    Sorts by time, sums by window and the last join are stages of their own, so that no task holds
    the memory of two of them; a row for each edge and a row for each window are written for it.
    """
    keys = [*PRICE_KEY, "_slice"]
    none = F.lit(None).cast(windows.schema["window_id"].dataType)
    prices = select_series(samples, fixed.PRICE_METRIC).select(
        *[label(k).alias(k) for k in PRICE_KEY],
        slice_of(F.col("ts"), width).alias("_slice"),
        F.col("ts").alias("at"),
        F.lit(0).alias("sign"),
        "value",
        none.alias("window_id"),
    )
    # Prices at the start count and so do those at the end: at one time, edges come by their sign.
    marks = F.explode(
        F.array(
            F.struct(F.col("start_ts").alias("at"), F.lit(-1).alias("sign")),
            F.struct(F.col("end_ts").alias("at"), F.lit(1).alias("sign")),
        )
    )
    edges = windows.select("window_id", *PRICE_KEY, marks.alias("m")).select(
        *PRICE_KEY,
        slice_of(F.col("m.at"), width).alias("_slice"),
        "m.at",
        "m.sign",
        F.lit(0.0).alias("value"),
        "window_id",
    )
    so_far = (
        Window.partitionBy(*keys)
        .orderBy("at", "sign")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = (
        prices.unionByName(edges)
        .select(
            "window_id",
            (F.sum("value").over(so_far) * F.col("sign")).alias("total"),
            (F.sum((F.col("sign") == 0).cast("int")).over(so_far) * F.col("sign")).alias("n"),
        )
        .where("window_id IS NOT NULL")
    )
    running = stage(running, "edges")
    sums = prices.groupBy(*keys).agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    first = slice_of(F.col("start_ts"), width)
    last = slice_of(F.col("end_ts"), width)
    whole = (
        windows.where(first < last)
        .withColumn("_slice", F.explode(F.sequence(first, last - 1)))
        .join(sums, keys)
        .select("window_id", "total", "n")
    )
    count = F.sum("n")
    mean = (
        whole.unionByName(running)
        .groupBy("window_id")
        .agg(F.when(count > 0, F.sum("total") / count).alias("spot_price"))
    )
    # Written ids look small enough to broadcast long before they are.
    return windows.join(stage(mean, "means").hint("merge"), "window_id", "left")


def node_occupancy(
    samples: DataFrame,
    windows: DataFrame,
    key: str = "node",
    parts: int = 100,
    lookback: float = LOOKBACK,
    width: float = SLICE,
) -> tuple[DataFrame, DataFrame]:
    """Share of its node that a job had: the mean of 1/n over time, n being the pods present.

    samples are the node's cpu series. The first time does not count unless it is the only one. A
    node with a single series gives a reject instead.

    How many series a node has is a step function of time that all its jobs share. Each presence
    adds one where it begins and takes it away where it ends, and the grid points of the jobs read
    the running sum at their place in between: the work is the sum of points and presences, not
    their product. Presences are cut at the borders of time slices, so that every slice of a node
    is summed alone.
    """
    low = F.col("_slice") * F.lit(float(width))
    cut = presence(samples, key, lookback, width).withColumn(
        "_slice",
        F.explode(F.sequence(slice_of(F.col("ts"), width), slice_of(F.col("until"), width))),
    )
    # When one series is present, the running sum of these numbers tells which one.
    tag = F.pmod(F.xxhash64("series"), F.lit(1 << 44))
    none = F.lit(None).cast("bigint")

    def event(at: Column, rank: Column, sign: int) -> Column:
        return F.struct(
            at.alias("at"), rank.alias("rank"), F.lit(sign).alias("d"), (tag * sign).alias("tag")
        )

    begin = event(F.greatest(F.col("ts"), low), F.lit(0), 1)
    # A presence that ends because its series fell silent still counts at its very end.
    end = event(F.col("until"), F.when(F.col("closed"), 2).otherwise(0), -1)
    ends_here = slice_of(F.col("until"), width) == F.col("_slice")
    events = cut.select(
        key, "_slice",
        F.explode(F.when(ends_here, F.array(begin, end)).otherwise(F.array(begin))).alias("e"),
    ).select(
        key, "_slice", "e.at", "e.rank", "e.d", "e.tag",
        F.lit(None).cast(windows.schema["window_id"].dataType).alias("window_id"),
        F.lit(None).cast("double").alias("step"), none.alias("_low"), none.alias("_high"),
    )
    stepped = windows.withColumn("step", range_step(F.col("start_ts"), F.col("end_ts"), parts))
    start, step = F.col("start_ts"), F.col("step")
    last = F.floor((F.col("end_ts") - start) / step).cast("bigint")
    zero = F.lit(0).cast("bigint")
    # A window goes to its slices as one row each, and its grid points become rows there. They are
    # numbered by estimates that are one too wide on either side, and settled by their own slices.
    there = stepped.withColumn("_last", last).withColumn(
        "_slice", F.explode(F.sequence(slice_of(start, width), slice_of(start + F.col("_last") * step, width)))
    )
    asked = there.select(
        key, "_slice", start.alias("at"), F.lit(1).alias("rank"), F.lit(0).alias("d"),
        zero.alias("tag"), "window_id", "step",
        F.greatest(F.ceil((low - start) / step) - 1, F.least(zero, "_last")).cast("bigint").alias("_low"),
        F.least(F.floor((low + F.lit(float(width)) - start) / step) + 1, F.greatest(zero, "_last"))
        .cast("bigint").alias("_high"),
    ).where("_low <= _high")
    tasks = max(
        windows.sparkSession.sparkContext.defaultParallelism,
        int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")),
    )
    lying = events.unionByName(asked).repartition(tasks, key, "_slice")
    points = lying.withColumn("k", F.explode_outer(F.sequence("_low", "_high"))).withColumn(
        "at", F.when(F.col("k").isNull(), F.col("at")).otherwise(F.col("at") + F.col("k") * step)
    ).where(F.col("k").isNull() | (slice_of(F.col("at"), width) == F.col("_slice")))
    so_far = (
        Window.partitionBy(key, "_slice")
        .orderBy("at", "rank")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = points.select(
        "window_id", "k", F.sum("d").over(so_far).alias("n"), F.sum("tag").over(so_far)
        .alias("who"),
    ).where("window_id IS NOT NULL AND n > 0")
    inverse = 1.0 / F.col("n")
    whole = counted.groupBy("window_id").agg(
        F.min("k").alias("first_k"),
        F.max("k").alias("last_k"),
        F.sum(inverse).alias("total"),
        F.min_by(inverse, "k").alias("first_inverse"),
        ((F.max("n") == 1) & (F.min("who") == F.max("who"))).alias("lonely"),
    )
    whole = stage(whole, "occupancy")  # a row for each window, read for the shares and the rejects
    # The step cancels out: both the sum and the span are counted in grid points.
    span = F.col("last_k") - F.col("first_k")
    share = F.when(span == 0, F.col("first_inverse")).otherwise(
        F.try_divide(F.col("total") - F.col("first_inverse"), span)
    )
    good = whole.where("NOT lonely").select("window_id", share.alias("node_occupancy"))
    rejects = whole.where("lonely").select(
        F.col("window_id").cast("string").alias("key"),
        F.lit("node_occupancy").alias("operator"),
        F.lit("only one series on the node").alias("reason"),
    )
    return good, rejects


def pod_usage(cpu_points: DataFrame, memory_points: DataFrame, pod: str = "pod") -> DataFrame:
    """Last cpu counter value, largest and mean memory per window.

    cpu_points covers every pod of the window's node; `pod` is the column that names the window's
    own pod, and only that pod's counter is read.
    """
    own = cpu_points.where(label("pod") == F.col(pod))
    cpu = own.groupBy("window_id").agg(F.max_by("value", "ts").alias("cpu_usage_seconds"))
    whole = F.floor("value").cast("bigint")
    memory = memory_points.groupBy("window_id").agg(
        F.max(whole).alias("max_memory"), F.avg(whole).alias("avg_memory")
    )
    return cpu.join(memory, "window_id")


def own_usage(
    cpu: DataFrame, memory: DataFrame, windows: DataFrame, parts: int = 100,
    lookback: float = LOOKBACK, width: float = SLICE,
) -> DataFrame:
    """Last cpu counter value, largest and mean memory per window, as `pod_usage` gives them.

    windows: window_id, pod, node, start_ts, end_ts. Only the series of each window's own pod meet
    it, and spans count with the number of grid points that they cover, so no grid point is a row.
    A window without its pod's counter on its node, or without exactly one memory series, gives no
    row.
    """
    here = cpu.withColumn("_at", F.concat_ws("\u001f", label("pod"), label("node")))
    asked = windows.withColumn("_at", F.concat_ws("\u001f", "pod", "node"))
    last = _meet(spans(here, lookback), asked, "_at", parts, width).groupBy("window_id").agg(
        F.max_by("value", F.struct("k_to", "series")).alias("cpu_usage_seconds")
    )
    whole, points = F.floor("value").cast("bigint"), F.col("k_to") - F.col("k_from") + 1
    own = spans(memory.withColumn("pod", label("pod")), lookback)
    held = _meet(own, windows.select("window_id", "pod", "start_ts", "end_ts"), "pod", parts, width)
    used = held.groupBy("window_id").agg(
        F.max(whole).alias("max_memory"),
        (F.sum(whole * points) / F.sum(points)).alias("avg_memory"),
        F.min("series").alias("_lo"), F.max("series").alias("_hi"),
    )
    return last.join(used.where("_lo = _hi").drop("_lo", "_hi"), "window_id")


def sample_pairs(samples: DataFrame, window: float) -> DataFrame:
    """Consecutive samples of a series at most `window` apart: (prev_ts, prev_value, increase).

    A counter that fell was reset, so its increase is the new value itself.
    """
    rows = with_series(samples)
    value = F.struct(F.col("ts").alias("ts"), F.col("value").alias("value"))
    near = with_previous(rows, ["series"], "ts", "value", window, value, "_prev")
    pairs = near.where(F.col("_prev").isNotNull() & (F.col("_prev.ts") < F.col("ts")))
    grew = F.col("value") >= F.col("_prev.value")
    return pairs.select(
        *rows.columns,
        F.col("_prev.ts").alias("prev_ts"),
        F.col("_prev.value").alias("prev_value"),
        F.when(grew, F.col("value") - F.col("_prev.value")).otherwise(F.col("value"))
        .alias("increase"),
    )


SERIES = ("metric", "series")


def _rollup(rows: DataFrame, start: Column, end: Column, step: float, value: Column) -> DataFrame:
    """One value per series and grid point, from the rows whose time range covers the point.

    Rows are aggregated, not sorted: a busy series combines on the map side.
    """
    points = rows.withColumn("_k", F.explode(_grid(start, end, step, F.lit(True))))
    rolled = points.groupBy(*SERIES, "_k").agg(
        F.first("labels").alias("labels"), value.alias("value")
    )
    return rolled.where("value IS NOT NULL").select(
        "metric", "labels", "series", (F.col("_k") * F.lit(float(step))).alias("ts"), "value"
    )


def counter_irate(samples: DataFrame, window: float, step: float) -> DataFrame:
    """Per-second change between the last two samples of each window ending at a grid point."""
    pairs = sample_pairs(samples, window)
    rate = F.col("increase") / (F.col("ts") - F.col("prev_ts"))
    return _rollup(
        pairs, F.col("ts"), F.col("prev_ts") + float(window), step,
        F.max_by(rate, F.struct("ts", "value")),
    )


def gauge_delta(samples: DataFrame, window: float, step: float) -> DataFrame:
    """Last minus first value of each window; windows with one sample give nothing."""
    rows = with_series(samples)
    order = F.struct("ts", "value")
    change = F.max_by("value", order) - F.min_by("value", order)
    return _rollup(
        rows, F.col("ts"), F.col("ts") + float(window), step,
        F.when(F.max("ts") > F.min("ts"), change),
    )


def counter_rate(samples: DataFrame, window: float, step: float) -> DataFrame:
    """Increase per second between the first and last samples of each window."""
    pairs = sample_pairs(samples, window)
    rate = F.sum("increase") / (F.max("ts") - F.min("prev_ts"))
    return _rollup(pairs, F.col("ts"), F.col("prev_ts") + float(window), step, rate)


def min_over_time(samples: DataFrame, window: float, step: float) -> DataFrame:
    return _rollup(
        with_series(samples), F.col("ts"), F.col("ts") + float(window), step, F.min("value")
    )


def value_offset(
    samples: DataFrame, offset: float, step: float, lookback: float = LOOKBACK
) -> DataFrame:
    """Value each series had `offset` earlier, at each grid point."""
    shifted = samples.withColumn("ts", F.col("ts") + F.lit(float(offset)))
    return instant(shifted, step, lookback)


def by_labels(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Chosen labels as columns."""
    return df.select("*", *[label(n).alias(n) for n in names])


def stuck_pods(
    samples: DataFrame, window: float = 180.0, step: float = 60.0,
    metrics: Mapping[str, str] | None = None,
) -> DataFrame:
    """Pods of the build namespace with no cpu, memory or network activity in the window."""
    m = {
        "cpu": "container_cpu_usage_seconds_total",
        "memory": "container_memory_usage_bytes",
        "rx": "container_network_receive_bytes_total",
        "tx": "container_network_transmit_bytes_total",
        **(metrics or {}),
    }
    build = [("namespace", "=", "pipeline"), ("container", "=", "build")]
    net = build[:1]

    def idle(df: DataFrame, names: Sequence[str]) -> DataFrame:
        return by_labels(df.where("value = 0"), names)

    cpu = idle(
        counter_irate(select_series(samples, m["cpu"], build), window, step),
        ["name", "pod", "node", "namespace", "container"],
    )
    still = idle(
        gauge_delta(select_series(samples, m["memory"], build), window, step), ["pod", "container"]
    )
    quiet = [
        idle(counter_irate(select_series(samples, m[k], net), window, step), ["pod"])
        for k in ("rx", "tx")
    ]
    out = cpu.join(still.select("ts", "pod", "container").distinct(),
                   ["ts", "pod", "container"], "left_semi")
    for q in quiet:
        out = out.join(q.select("ts", "pod").distinct(), ["ts", "pod"], "left_semi")
    return out.groupBy("ts", "name", "pod", "node", "namespace").agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )


def ingress_success_pct(
    samples: DataFrame, window: float = 120.0, step: float = 60.0,
    metric: str = "nginx_ingress_controller_requests",
    service: str = "gitlab-webservice-default",
) -> DataFrame:
    """Percentage of requests per ingress that were not answered with a 4xx or 5xx status."""
    rates = counter_irate(
        select_series(samples, metric, [("exported_service", "=", service)]), window, step
    )
    fine = ~F.coalesce(label("status"), F.lit("")).rlike(r"^(?:[4-5].*)$")
    sums = rates.groupBy("ts", label("ingress").alias("ingress")).agg(
        F.sum(F.when(fine, F.col("value"))).alias("good"), F.sum("value").alias("all")
    )
    return sums.where("good IS NOT NULL").select(
        "ts", "ingress", (F.try_divide(F.col("good"), F.col("all")) * 100).alias("value")
    )


def oom_killed(
    samples: DataFrame, window: float = 600.0, step: float = 60.0, lookback: float = LOOKBACK
) -> DataFrame:
    """Containers that restarted in the window and whose last end was out of memory throughout."""
    restarts = select_series(samples, "kube_pod_container_status_restarts_total")
    now = instant(restarts, step, lookback)
    before = value_offset(restarts, window, step, lookback).select(
        "series", "ts", F.col("value").alias("before")
    )
    grown = now.join(before, ["series", "ts"]).where("value - before >= 1")
    killed = select_series(
        samples, "kube_pod_container_status_last_terminated_reason",
        [("reason", "=", "OOMKilled")],
    )
    throughout = min_over_time(killed, window, step).where("value = 1")
    keys = ["namespace", "pod", "container"]
    hit = by_labels(throughout, keys).select("ts", *keys).distinct()
    return (
        by_labels(grown, keys)
        .join(hit, ["ts", *keys], "left_semi")
        .select("ts", *keys, (F.col("value") - F.col("before")).alias("value"))
    )


# Alert name -> how long its condition must hold, in seconds.
ALERT_HOLD = {
    "GitlabPipelinePodStuck": 300.0,
    "GitLabWebServiceErrorRate5Percent": 300.0,
    "GitLabWebServiceErrorRate10Percent": 120.0,
    "ContainerOOMKilled": 0.0,
}
# Success percentages at or below which the ingress alerts hold.
ERROR_RATE_LIMITS = {
    "GitLabWebServiceErrorRate5Percent": 95.0,
    "GitLabWebServiceErrorRate10Percent": 90.0,
}


def alert_for(
    df: DataFrame, keys: Sequence[str], condition: Column, hold: float, width: float = SLICE
) -> DataFrame:
    """Evaluations at which the condition has held without a break for at least `hold` seconds."""
    checked = df.withColumn("_holds", is_true(condition))
    since = held_since(checked, keys, "ts", "_holds", max(width, hold), "active_since")
    return since.where(
        F.col("_holds") & (F.col("ts") - F.col("active_since") >= F.lit(float(hold)))
    ).drop("_holds")


def firing_pods(alerts: DataFrame) -> DataFrame:
    """Pods that the stuck-pod alert names."""
    return alerts.where("alertname = 'GitlabPipelinePodStuck'").select("pod").distinct()


def match_left(
    many: DataFrame, one: DataFrame, on: Sequence[str], include: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Each row of the many side with the value (and chosen labels) of its match on the one side.

    Columns `on` and ts must be present on both; keys that the one side holds twice are rejects.
    """
    keys = ["ts", *on]
    grouped = one.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.first("value").alias("one_value"),
        *[F.first(c).alias(c) for c in include],
    )
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in on])
    rejects = grouped.where("_n > 1").select(
        text.alias("key"), F.lit("match_left").alias("operator"),
        F.lit("duplicate on the one side").alias("reason"),
    )
    left = many.drop(*[c for c in include if c in many.columns and c not in keys])
    return left.join(grouped.where("_n = 1").drop("_n"), keys), rejects


def label_replace(df: DataFrame, dst: str, repl: str, src: str, regex: str) -> DataFrame:
    """Sets column dst from column src where the regex matches the whole value."""
    whole = f"^(?:{regex})$"
    have = F.coalesce(F.col(src), F.lit(""))
    kept = F.col(dst) if dst in df.columns else F.lit(None).cast("string")
    return df.withColumn(
        dst, F.when(have.rlike(whole), F.regexp_replace(have, whole, repl)).otherwise(kept)
    )


REF = "label_metrics_gitlab_ci_commit_ref_name"


def pipeline_overview(samples: DataFrame, step: float, lookback: float = LOOKBACK) -> DataFrame:
    """The overview panels in one long table (panel, ts, dimension, value).

    Samples are read and laid on the grid once: the points of all three metrics, with the labels
    that the panels show, are a written table that every panel reads.
    """
    from ..sources.scratch import stage

    shown = ["node", "pod", "label_node_kubernetes_io_instance_type",
             "label_beta_kubernetes_io_instance_type", REF]
    build = F.coalesce(label("namespace"), F.lit("")) == "pipeline"
    ours = F.coalesce(label(fixed.PIPELINE_NODE_LABEL), F.lit("")) == "true"
    wanted = samples.where(
        ((F.col("metric") == "kube_node_labels") & ours)
        | (F.col("metric").isin("kube_pod_info", "kube_pod_labels") & build)
    )
    grid = by_labels(instant(wanted, step, lookback), shown).drop("labels", "series")
    grid = stage(grid, "grid")

    def of(metric: str, *names: str) -> DataFrame:
        rows = grid.where(F.col("metric") == metric)
        return rows.select("metric", "ts", "value", *names)

    nodes = of("kube_node_labels", "node", *shown[2:4])
    pods = of("kube_pod_info", "pod", "node")
    tags = of("kube_pod_labels", "pod", REF)
    no_dim = F.lit("")

    def panel(name: str, df: DataFrame, dim: Column, value: Column) -> DataFrame:
        rows = df.groupBy("ts", dim.alias("dimension")).agg(value.cast("double").alias("value"))
        return rows.select(F.lit(name).alias("panel"), "ts", "dimension", "value")

    one_tag = tags.withColumn("value", F.col("value").cast("double"))
    named, _ = match_left(pods.drop(REF), one_tag, ["pod"], [REF])
    named = named.withColumn("value", F.col("value") * F.col("one_value"))
    ref = F.coalesce(F.col(REF), no_dim)
    per_node = pods.where("coalesce(node, '') <> ''").groupBy("ts", "node").agg(
        F.sum("value").alias("value")
    )
    busy, _ = match_left(nodes, per_node, ["node"])
    busy = busy.withColumn("value", F.col("value") * F.col("one_value"))
    kinds = label_replace(
        tags.where(F.coalesce(F.col(REF), no_dim).rlike("^(?:(pr|develop).*)$")),
        "develop_or_pr", "$1", REF, "(pr|develop).*",
    )
    total, mean = F.sum("value"), F.avg("value")
    parts = [
        panel("node_count", nodes, no_dim, total),
        panel("pod_count", pods, no_dim, total),
        panel("pipeline_count", named, no_dim, F.count_distinct(ref)),
        panel("pods_by_ref", named, ref, total),
        panel("pods_per_node", busy, F.col("node"), total),
        panel("labelled_pods_by_ref", tags, ref, total),
        panel("pods_by_kind", kinds, F.col("develop_or_pr"), total),
        panel("nodes_by_type", nodes,
              F.coalesce("label_node_kubernetes_io_instance_type", no_dim), total),
        panel("pods_per_type", busy,
              F.coalesce("label_beta_kubernetes_io_instance_type", no_dim), mean),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def utilization(
    samples: DataFrame, window: float = 180.0, step: float = 60.0, lookback: float = LOOKBACK
) -> DataFrame:
    """Cpu and memory use in percent per instance and time, one row for both.

    Cpu is the non-idle share of all cpu time. Either is NULL where its series are missing.
    """
    cpu = counter_irate(select_series(samples, "node_cpu_seconds_total"), window, step)
    busy = F.coalesce(label("mode"), F.lit("")) != "idle"
    cpu_pct = cpu.groupBy("ts", label("instance").alias("instance")).agg(
        (
            100.0 * F.try_divide(F.sum(F.when(busy, F.col("value"))), F.sum("value"))
        ).alias("cpu_pct")
    )
    memory = by_labels(
        instant(
            samples.where(
                F.col("metric").isin("node_memory_MemTotal_bytes", "node_memory_MemFree_bytes")
            ),
            step, lookback,
        ),
        ["instance"],
    )
    total = F.max(F.when(F.col("metric") == "node_memory_MemTotal_bytes", F.col("value")))
    free = F.max(F.when(F.col("metric") == "node_memory_MemFree_bytes", F.col("value")))
    ram_pct = memory.groupBy("ts", "instance").agg(
        (100.0 * F.try_divide(total - free, total)).alias("ram_pct")
    )
    return cpu_pct.join(ram_pct, ["ts", "instance"], "full")


def utilization_average(per_instance: DataFrame) -> DataFrame:
    """Mean cpu and memory use over all instances at each time."""
    return per_instance.groupBy("ts").agg(
        F.avg("cpu_pct").alias("cpu_pct"), F.avg("ram_pct").alias("ram_pct")
    )
