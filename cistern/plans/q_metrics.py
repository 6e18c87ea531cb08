"""Time series queries.

The given events are sparse, so windows here are hours and days where a scraped series would use
minutes; the operators are the same.
"""

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import as_column, epoch_seconds
from ..operators import metrics
from .bindings import bind
from .registry import query

HOUR = 3600.0
DAY = 86400.0
STEP = 21600.0


def _labels(**columns):
    pairs = []
    for name, col in columns.items():
        pairs += [F.lit(name), as_column(col)]
    return F.create_map(*pairs)


def samples(spark, sf):
    """Events as one metric whose series are pods."""
    rows = bind(spark, sf, "samples")
    return rows.select(
        F.lit("usage").alias("metric"), _labels(pod="pod", node="node").alias("labels"), "ts",
        "value", "pod", "node", "kind", "eid",
    )


# Spans of every sample, per pod: [ts, until], closed where no next sample comes in time.
SPAN_SQL = f""", n as (select *, lead(ts) over (partition by pod order by ts, value) as nxt from b_samples),
 sp as (select *, case when nxt - ts <= {{look}} then nxt else ts + {{look}} end as until,
   coalesce(nxt - ts > {{look}}, true) as closed from n)"""
PAIR_SQL = f""", n as (select *, lag(ts) over w as pts, lag(value) over w as pval from b_samples
   window w as (partition by pod order by ts, value)),
 pr as (select *, case when value >= pval then value - pval else value end as inc
   from n where pts is not null and ts - pts <= {DAY} and pts < ts)"""


def grid(start: str, end: str, step: float = STEP) -> str:
    return (
        f"unnest(range(cast(ceil({start} / {step}) as bigint), "
        f"cast(floor({end} / {step}) as bigint) + 1))"
    )


def _out(df):
    return df.select(
        metrics.label("pod").alias("pod"), "ts", F.round("value", 6).alias("value")
    )


WINDOWS_SQL = """, wn as (select o_orderkey as window_id, 'n' || (o_custkey % 10) as node,
  1704067200.0 + (o_orderkey * 7919) % 2500000 as start_ts,
  1704067200.0 + (o_orderkey * 7919) % 2500000 + 600.0 * (1 + o_custkey % 200) as end_ts from orders)"""


def windows(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey AS window_id",
        "concat('n', o_custkey % 10) AS node",
        "cast(1704067200 + (o_orderkey * 7919) % 2500000 AS double) AS start_ts",
        "cast(1704067200 + (o_orderkey * 7919) % 2500000 + 600 * (1 + o_custkey % 200) AS double)"
        " AS end_ts",
    )


RANGE_SQL = (
    SPAN_SQL.format(look=DAY / 2)
    + WINDOWS_SQL
    + """, st as (select *, greatest(ceil((end_ts - start_ts) / 10), 1) as step from wn),
  pt as (select window_id, node, step, start_ts + k * step as t from (
    select *, unnest(range(0, cast(floor((end_ts - start_ts) / step) as bigint) + 1)) as k from st)),
  rg as (select window_id, pt.node, pod, step, t as ts, value from pt join sp on sp.node = pt.node
    and t >= ts and case when closed then t <= until else t < until end)"""
)


def ranged(spark, sf):
    return metrics.range_sample(
        samples(spark, sf), windows(spark, sf), "node", parts=10, lookback=DAY / 2, width=DAY / 2,
        by_window=True,
    )


def totals(read, repeated):
    """Points, series, sum of values, first and last time of each window id.

    repeated: ids of more than one window. Only their series are told apart by name: another id's are
    as many as its one window has.
    """
    again = repeated.select(F.col("window_id").alias("_id"), F.lit(True).alias("again"))
    runs = read.join(again, F.col("window_id").eqNullSafe(F.col("_id")), "left").select(
        "window_id", "start_ts", "step", F.size("series").alias("n_series"),
        F.when(F.col("again"), F.col("series")).alias("names"), F.inline("runs"),
    )
    points = F.col("last") - F.col("first") + 1
    at = lambda k: F.col("start_ts") + F.col(k) * F.col("step")
    named = F.count_distinct(F.get("names", F.col("series")))
    return runs.groupBy("window_id").agg(
        F.sum(points).alias("points"),
        F.when(named > 0, named).otherwise(F.max("n_series").cast("bigint")).alias("series"),
        F.round(F.sum(F.col("value") * points), 2).alias("total"),
        F.round(F.min(at("first")), 3).alias("first_ts"),
        F.round(F.max(at("last")), 3).alias("last_ts"),
    )


@query(
    "range_sample",
    RANGE_SQL
    + """select window_id, count(*) as points, count(distinct pod) as series,
      round(sum(value), 2) as total, round(min(ts), 3) as first_ts, round(max(ts), 3) as last_ts
      from rg group by window_id""",
    "samples",
)
def range_sample(spark, sf):
    counted = windows(spark, sf).groupBy("window_id").agg(F.count(F.lit(1)).alias("n"))
    return totals(ranged(spark, sf), counted.where("n > 1"))


@query(
    "select_series",
    """select eid, pod from b_samples where node = 'n3' and pod <> 'p13'
      and regexp_full_match(pod, 'p[0-9]*3') and not regexp_full_match(pod, 'p2.*')""",
    "samples",
)
def select_series(spark, sf):
    out = metrics.select_series(
        samples(spark, sf), "usage",
        [("node", "=", "n3"), ("pod", "!=", "p13"), ("pod", "=~", "p[0-9]*3"), ("pod", "!~", "p2.*")],
    )
    return out.select("eid", "pod")


@query(
    "single_series",
    """, k as (select pod, case when value > 485 then kind else 'all' end as tag, eid from b_samples),
    c as (select pod, count(distinct tag) as n from k group by pod)
    select pod, cast(count(*) as bigint) as samples, false as reject from k
      where pod in (select pod from c where n = 1) group by pod
    union all select pod, null, true from c where n > 1""",
    "samples",
)
def single_series(spark, sf):
    rows = samples(spark, sf)
    tag = F.when(F.col("value") > 485, F.col("kind")).otherwise("all")
    rows = rows.withColumn("labels", _labels(pod="pod", tag=tag))
    good, rejects = metrics.single_series(rows, "pod")
    counts = good.groupBy("pod").agg(F.count(F.lit(1)).alias("samples"))
    none = F.lit(None).cast("bigint").alias("samples")
    return counts.withColumn("reject", F.lit(False)).unionByName(
        rejects.select(F.col("key").alias("pod"), none, F.lit(True).alias("reject"))
    )


@query(
    "pod_for_job",
    """, a as (select cast(eid % 4000 as varchar) as job, pod, ts from b_samples),
    j as (select build_id as job_id, epoch_us(started_at) / 1000000.0 - 1000 as s,
      epoch_us(started_at) / 1000000.0 + 1000000 as e from b_jobs),
    f as (select job_id, count(distinct pod) as n, min(pod) as pod from j join a
      on a.job = cast(job_id as varchar) and ts >= s - 300 and ts <= e group by job_id)
    select j.job_id, case when n = 1 then pod end as pod from j left join f on f.job_id = j.job_id""",
    "samples",
    "jobs",
)
def pod_for_job(spark, sf):
    job = (F.col("eid") % 4000).cast("string")
    notes = samples(spark, sf).withColumn("labels", _labels(pod="pod", **{fixed.POD_JOB_ID: job}))
    notes = notes.withColumn("metric", F.lit("kube_pod_annotations"))
    jobs = bind(spark, sf, "jobs").select(
        F.col("build_id").alias("job_id"),
        (epoch_seconds("started_at") - 1000).alias("start_ts"),
        (epoch_seconds("started_at") + 1_000_000).alias("end_ts"),
    )
    return metrics.pod_for_job(notes, jobs).select("job_id", "pod")


@query(
    "pod_requests_limits",
    """select pod, round(arg_min(value, ts) filter (kind = 'view'), 4) as cpu_request,
      round(arg_min(value, ts) filter (kind = 'click'), 4) as cpu_limit,
      round(arg_min(value, ts) filter (kind = 'error'), 4) as memory_request,
      round(arg_min(value, ts) filter (kind = 'signup'), 4) as memory_limit
    from b_samples group by pod""",
    "samples",
)
def pod_requests_limits(spark, sf):
    # A purchase is a limit of a resource that isn't asked for.
    rows = samples(spark, sf)
    kind = F.col("kind")
    rows = rows.withColumn(
        "metric",
        F.when(kind.isin("view", "error"), "kube_pod_container_resource_requests").otherwise(
            "kube_pod_container_resource_limits"
        ),
    ).withColumn(
        "labels",
        _labels(
            pod="pod", container=F.lit("build"),
            resource=F.when(kind.isin("view", "click"), "cpu").when(kind == "purchase", "disk")
            .otherwise("memory"),
        ),
    )
    out = metrics.pod_requests_limits(rows)
    return out.select("pod", *[F.round(c, 4).alias(c) for c in out.columns if c != "pod"])


@query(
    "pod_labels",
    f""", p as (select distinct pod, cast(substr(pod, 2) as int) as n from b_samples)
    select pod, 'pkg' || n as package_name, 'stack' || n as stack,
      case when n % 3 = 0 then 'gcc' else '' end as compiler_name,
      case when n % 4 = 0 then n end as build_jobs, cast(null as varchar) as reason
      from p where n % 7 <> 0
    union all select pod, null, null, null, null,
      'missing label {fixed.POD_ANNOTATIONS['package_hash']}' from p where n % 7 = 0""",
    "samples",
)
def pod_labels(spark, sf):
    rows = samples(spark, sf).withColumn("n", F.substring("pod", 2, 10).cast("int"))
    text = F.col("n").cast("string")
    note = {k: F.lit("x") for k in fixed.POD_ANNOTATIONS.values()}
    note[fixed.POD_ANNOTATIONS["package_name"]] = F.concat(F.lit("pkg"), text)
    note[fixed.POD_ANNOTATIONS["package_hash"]] = F.when(F.col("n") % 7 != 0, text)
    note[fixed.POD_OPTIONAL_ANNOTATIONS["compiler_name"]] = F.when(F.col("n") % 3 == 0, "gcc")
    note[fixed.POD_BUILD_JOBS] = F.when(F.col("n") % 4 == 0, text)
    tag = {fixed.POD_LABELS["job_size"]: F.lit("s"),
           fixed.POD_LABELS["stack"]: F.concat(F.lit("stack"), text)}
    present = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    notes = rows.select(
        F.lit("kube_pod_annotations").alias("metric"),
        present(_labels(pod="pod", **note)).alias("labels"), "ts", "value",
    )
    tags = rows.select(
        F.lit("kube_pod_labels").alias("metric"), _labels(pod="pod", **tag).alias("labels"),
        "ts", "value",
    )
    good, rejects = metrics.pod_labels(notes.unionByName(tags))
    cols = ["pod", "package_name", "stack", "compiler_name", "build_jobs"]
    none = [F.lit(None).cast(good.schema[c].dataType).alias(c) for c in cols[1:]]
    return good.select(*cols, F.lit(None).cast("string").alias("reason")).unionByName(
        rejects.select(F.col("key").alias("pod"), *none, "reason")
    )


@query(
    "pod_node",
    """select distinct pod, 'n' || (n % 10) as node, 'uuid-n' || (n % 10) as system_uuid,
      4 + n % 10 as cpu, cast((1000 + n % 10) * 1000000 as bigint) as memory, 'spot' as capacity_type,
      'm' || (n % 10 % 3) as instance_type, 'z' || (n % 10 % 2) as zone
    from (select pod, cast(substr(pod, 2) as int) as n from b_samples)""",
    "samples",
)
def pod_node(spark, sf):
    good, _ = metrics.pod_node(node_samples(spark, sf))
    return good.select(
        "pod", "node", "system_uuid", "cpu", "memory", "capacity_type", "instance_type", "zone"
    )


def node_samples(spark, sf):
    """Pod placement, node identity and node labels, one sample per event each."""
    rows = samples(spark, sf).withColumn("k", F.substring("node", 2, 10).cast("int"))
    text = lambda c: c.cast("string")
    info = _labels(pod="pod", node="node", pod_ip=F.lit("10.0.0.1"))
    uuid = _labels(node="node", system_uuid=F.concat(F.lit("uuid-"), F.col("node")))
    names = fixed.NODE_LABELS
    size = _labels(
        node="node",
        **{
            names["cpu"]: text(4 + F.col("k")),
            names["memory"]: text(1000 + F.col("k")),
            names["capacity_type"]: F.lit("spot"),
            names["instance_type"]: F.concat(F.lit("m"), text(F.col("k") % 3)),
            names["zone"]: F.concat(F.lit("z"), text(F.col("k") % 2)),
            "label_karpenter_sh_initialized": F.lit("true"),
            "label_topology_ebs_csi_aws_com_zone": F.lit("z"),
        },
    )
    parts = [("kube_pod_info", info), ("kube_node_info", uuid), ("kube_node_labels", size)]
    out = None
    for metric, labels in parts:
        part = rows.select(F.lit(metric).alias("metric"), labels.alias("labels"), "ts", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "spot_price",
    WINDOWS_SQL
    + """, p as (select ts, value, 'm' || (cast(substr(node, 2) as int) % 3) as it from b_samples),
    w as (select *, 'm' || (cast(substr(node, 2) as int) % 3) as it from wn)
    select window_id, cast(floor(avg(value) * 10000 + 0.137) as bigint) as price_e4,
      case when count(value) = 0 then 'no price of spot, ' || any_value(w.it) || ', z' end as reason
      from w left join p on p.it = w.it and p.ts between start_ts and end_ts group by window_id""",
    "samples",
)
def spot_price(spark, sf):
    kind = F.concat(F.lit("m"), (F.substring("node", 2, 10).cast("int") % 3).cast("string"))
    prices = samples(spark, sf).select(
        F.lit(fixed.PRICE_METRIC).alias("metric"),
        _labels(capacity_type=F.lit("spot"), instance_type=kind, zone=F.lit("z")).alias("labels"),
        "ts", "value",
    )
    asked = windows(spark, sf).select(
        "window_id", F.lit("spot").alias("capacity_type"), kind.alias("instance_type"),
        F.lit("z").alias("zone"), "start_ts", "end_ts",
    )
    out = metrics.spot_price(prices, asked, width=HOUR)
    price = F.floor(F.col("spot_price") * 10000 + 0.137).cast("bigint")
    none = F.lit(None).cast("string")
    return out.where("spot_price IS NOT NULL").select(
        "window_id", price.alias("price_e4"), none.alias("reason")
    ).unionByName(
        metrics.price_rejects(out).select(
            F.col("key").cast("bigint").alias("window_id"),
            F.lit(None).cast("bigint").alias("price_e4"), "reason",
        )
    )


OCC_SQL = RANGE_SQL + """, pt2 as (select window_id, ts, count(*) as n, max(step) as step from rg group by all),
  lone as (select window_id from rg group by 1 having count(distinct pod) = 1),
  oc as (select window_id, min(ts) as f, max(ts) as l, sum(1.0 / n) as tot,
    arg_min(1.0 / n, ts) as fi, max(step) as step from pt2 group by 1)"""


@query(
    "node_occupancy",
    OCC_SQL
    + """select window_id, round(case when l = f then fi else (tot - fi) * step / (l - f) end, 4)
      as node_occupancy, false as reject from oc where window_id not in (select * from lone)
    union all select window_id, null, true from lone""",
    "samples",
)
def node_occupancy(spark, sf):
    good, rejects = metrics.node_occupancy(
        samples(spark, sf), windows(spark, sf), "node", parts=10, lookback=DAY / 2, width=DAY / 2
    )
    none = F.lit(None).cast("double").alias("node_occupancy")
    return good.select(
        "window_id", F.round("node_occupancy", 4).alias("node_occupancy"),
        F.lit(False).alias("reject"),
    ).unionByName(
        rejects.select(F.col("key").cast("bigint").alias("window_id"), none,
                       F.lit(True).alias("reject"))
    )


@query(
    "pod_usage",
    RANGE_SQL
    + """, own as (select rg.* from rg where pod = 'p' || (window_id % 150))
    select window_id, round(arg_max(value, ts), 4) as cpu_usage_seconds,
      max(cast(floor(value) as bigint)) as max_memory,
      round(avg(cast(floor(value) as bigint)), 4) as avg_memory from own group by window_id""",
    "samples",
)
def pod_usage(spark, sf):
    own = F.concat(F.lit("p"), (F.col("window_id") % 150).cast("string"))
    asked = windows(spark, sf).withColumn("pod", own)
    rows = samples(spark, sf)
    out = metrics.own_usage(rows, rows, asked, parts=10, lookback=DAY / 2, width=DAY / 2)
    return out.select(
        "window_id", F.round("cpu_usage_seconds", 4).alias("cpu_usage_seconds"), "max_memory",
        F.round("avg_memory", 4).alias("avg_memory"),
    )


@query(
    "counter_irate",
    PAIR_SQL
    + f""", k as (select *, {grid('ts', f'(pts + {DAY})')} as k from pr)
    select pod, cast(k * {STEP} as double) as ts, round(arg_max(inc / (ts - pts), ts), 6) as value from k
    group by pod, k""",
    "samples",
)
def counter_irate(spark, sf):
    return _out(metrics.counter_irate(samples(spark, sf), DAY, STEP))


@query(
    "gauge_delta",
    f""", k as (select *, {grid('ts', f'(ts + {DAY})')} as k from b_samples)
    select pod, cast(k * {STEP} as double) as ts, round(arg_max(value, ts) - arg_min(value, ts), 6) as value from k
    group by pod, k having max(ts) > min(ts)""",
    "samples",
)
def gauge_delta(spark, sf):
    return _out(metrics.gauge_delta(samples(spark, sf), DAY, STEP))


@query(
    "counter_rate",
    PAIR_SQL
    + f""", k as (select *, {grid('ts', f'(pts + {DAY})')} as k from pr)
    select pod, cast(k * {STEP} as double) as ts, round(sum(inc) / (max(ts) - min(pts)), 6) as value from k
    group by pod, k""",
    "samples",
)
def counter_rate(spark, sf):
    return _out(metrics.counter_rate(samples(spark, sf), DAY, STEP))


@query(
    "min_over_time",
    f""", k as (select *, {grid('ts', f'(ts + {DAY})')} as k from b_samples)
    select pod, cast(k * {STEP} as double) as ts, round(min(value), 6) as value from k group by pod, k""",
    "samples",
)
def min_over_time(spark, sf):
    return _out(metrics.min_over_time(samples(spark, sf), DAY, STEP))


def instant_sql(name: str, look: float, shift: float = 0.0, step: float = STEP,
                source: str = "b_samples", by: str = "pod") -> str:
    """CTEs that evaluate a source's series at grid points."""
    return f""", {name}_n as (select * exclude (ts), ts + {shift} as ts, lead(ts + {shift}) over
      (partition by {by} order by ts, value) as nxt from {source}),
    {name}_s as (select *, case when nxt - ts <= {look} then nxt else ts + {look} end as until,
      coalesce(nxt - ts > {look}, true) as closed from {name}_n),
    {name}_k as (select *, {grid('ts', 'until', step)} as k from {name}_s),
    {name} as (select * exclude (ts, k), cast(k * {step} as double) as t from {name}_k
      where closed or k * {step} < until)"""


@query(
    "value_offset",
    instant_sql("v", DAY / 2, shift=DAY)
    + "select pod, t as ts, round(value, 6) as value from v",
    "samples",
)
def value_offset(spark, sf):
    return _out(metrics.value_offset(samples(spark, sf), DAY, STEP, lookback=DAY / 2))


def _pod_metrics(spark, sf, metrics_by_kind):
    """Each event also as a sample of the metric its type stands for."""
    rows = samples(spark, sf)
    name = F.element_at(
        F.create_map(*[F.lit(x) for kv in metrics_by_kind.items() for x in kv]), F.col("kind")
    )
    return rows.withColumn("metric", name)


STUCK = {
    "view": "container_cpu_usage_seconds_total",
    "click": "container_memory_usage_bytes",
    "error": "container_network_receive_bytes_total",
    "signup": "container_network_transmit_bytes_total",
    "purchase": "other",
}


def stuck_rows(spark, sf):
    """Values rounded down to a coarse level, so that some stay the same for a while."""
    rows = _pod_metrics(spark, sf, STUCK)
    labels = _labels(
        pod="pod", node="node", namespace=F.lit("pipeline"), container=F.lit("build"),
        name=F.lit("c"),
    )
    level = F.floor(F.col("value") / 400)
    return rows.withColumn("labels", labels).withColumn("value", level.cast("double"))


STUCK_SQL = f""", b as (select pod, node, ts, kind, cast(floor(value / 400) as double) as value from b_samples),
  pn as (select *, lag(ts) over w as pts, lag(value) over w as pval from b
    window w as (partition by pod, kind order by ts, value)),
  pp as (select *, case when value >= pval then value - pval else value end as inc from pn
    where pts is not null and ts - pts <= {4 * DAY} and pts < ts),
  ir as (select pod, node, kind, cast(k * {STEP} as double) as ts, arg_max(inc / (ts - pts), ts) as value from (
    select *, {grid('ts', f'(pts + {4 * DAY})')} as k from pp) group by pod, node, kind, k),
  dl as (select pod, cast(k * {STEP} as double) as ts, arg_max(value, ts) - arg_min(value, ts) as value from (
    select *, {grid('ts', f'(ts + {4 * DAY})')} as k from b where kind = 'click') group by pod, k
    having max(ts) > min(ts)),
  sk as (select pod, node, ts from ir c where kind = 'view' and value = 0
    and exists (select 1 from dl where dl.pod = c.pod and dl.ts = c.ts and dl.value = 0)
    and exists (select 1 from ir r where r.kind = 'error' and r.pod = c.pod and r.ts = c.ts and r.value = 0)
    and exists (select 1 from ir r where r.kind = 'signup' and r.pod = c.pod and r.ts = c.ts and r.value = 0))"""


def _stuck(spark, sf):
    return metrics.stuck_pods(stuck_rows(spark, sf), window=4 * DAY, step=STEP)


@query("stuck_pods", STUCK_SQL + "select pod, node, ts, 1.0::double as value from sk", "samples")
def stuck_pods(spark, sf):
    return _stuck(spark, sf).select("pod", "node", "ts", "value")


def ingress_rows(spark, sf):
    rows = samples(spark, sf)
    status = F.when(F.col("kind") == "error", "500").when(F.col("kind") == "click", "404")
    labels = _labels(
        ingress="node", pod="pod", status=status.otherwise("200"),
        exported_service=F.lit("gitlab-webservice-default"),
    )
    return rows.withColumn("labels", labels).withColumn(
        "metric", F.lit("nginx_ingress_controller_requests")
    )


INGRESS_SQL = f""", b as (select *, case kind when 'error' then '500' when 'click' then '404'
    else '200' end as status from b_samples),
  pn as (select *, lag(ts) over w as pts, lag(value) over w as pval from b
    window w as (partition by pod, node, status order by ts, value)),
  pp as (select *, case when value >= pval then value - pval else value end as inc from pn
    where pts is not null and ts - pts <= {DAY} and pts < ts),
  ir as (select pod, node, status, cast(k * {STEP} as double) as ts, arg_max(inc / (ts - pts), ts) as value from (
    select *, {grid('ts', f'(pts + {DAY})')} as k from pp) group by pod, node, status, k),
  ok as (select node as ingress, ts, 100 * sum(value) filter (status = '200') / sum(value) as value
    from ir group by node, ts)"""


def _ingress(spark, sf):
    return metrics.ingress_success_pct(ingress_rows(spark, sf), window=DAY, step=STEP)


@query(
    "ingress_success_pct",
    INGRESS_SQL + "select ingress, ts, round(value, 4) as value from ok where value is not null",
    "samples",
)
def ingress_success_pct(spark, sf):
    return _ingress(spark, sf).select("ingress", "ts", F.round("value", 4).alias("value"))


def oom_rows(spark, sf):
    rows = samples(spark, sf)
    labels = _labels(namespace=F.lit("pipeline"), pod="pod", container=F.lit("build"))
    restarts = rows.select(
        F.lit("kube_pod_container_status_restarts_total").alias("metric"), labels.alias("labels"),
        "ts", F.floor(F.col("value") / 20).cast("double").alias("value"),
    )
    ended = rows.select(
        F.lit("kube_pod_container_status_last_terminated_reason").alias("metric"),
        F.map_concat(labels, F.create_map(F.lit("reason"), F.lit("OOMKilled"))).alias("labels"),
        "ts", F.when(F.col("kind") == "view", 0.0).otherwise(1.0).alias("value"),
    )
    return restarts.unionByName(ended)


@query(
    "oom_killed",
    ", rs as (select pod, ts, cast(floor(value / 20) as double) as value from b_samples)"
    + instant_sql("now", DAY, source="rs")
    + instant_sql("old", DAY, shift=DAY / 2, source="rs")
    + f""", mk as (select pod, cast(k * {STEP} as double) as t, min(case when kind = 'view' then 0 else 1 end) as m from (
      select *, {grid('ts', f'(ts + {DAY / 2})')} as k from b_samples) group by pod, k)
    select now.pod, now.t as ts, now.value - old.value as value from now join old
      on now.pod = old.pod and now.t = old.t join mk on mk.pod = now.pod and mk.t = now.t
    where now.value - old.value >= 1 and m = 1""",
    "samples",
)
def oom_killed(spark, sf):
    out = metrics.oom_killed(oom_rows(spark, sf), window=DAY / 2, step=STEP, lookback=DAY)
    return out.select("pod", "ts", "value")


ALERT_SQL = f""", e as (select pod, ts, value > 20 as h from b_samples),
  g as (select *, sum(case when h then 0 else 1 end) over (partition by pod order by ts) as run from e),
  s as (select *, min(ts) over (partition by pod, run order by ts) as r0,
    min(case when h then ts end) over (partition by pod, run order by ts) as since from g),
  al as (select pod, ts, since from s where h and ts - since >= {DAY})"""


def _alerts(spark, sf):
    return metrics.alert_for(samples(spark, sf), ["pod"], F.col("value") > 20, DAY, width=DAY)


@query(
    "alert_for",
    ALERT_SQL + "select pod, round(ts, 3) as ts, round(since, 3) as active_since from al",
    "samples",
)
def alert_for(spark, sf):
    return _alerts(spark, sf).select(
        "pod", F.round("ts", 3).alias("ts"), F.round("active_since", 3).alias("active_since")
    )


@query("firing_pods", ALERT_SQL + "select distinct pod from al", "samples")
def firing_pods(spark, sf):
    named = _alerts(spark, sf).withColumn("alertname", F.lit("GitlabPipelinePodStuck"))
    return metrics.firing_pods(named)


@query(
    "match_left",
    instant_sql("v", DAY)
    + """, one as (select 'n' || (s_suppkey % 12) as node, max(s_name) as ip, count(*) as n,
        max(cast(s_suppkey as double)) as value
        from supplier group by 1)
    select pod, v.node, t as ts, round(v.value * one.value, 4) as value, ip, false as reject
      from v join one on one.node = v.node
    union all select null, node, null, null, null, true from one where n > 1""",
    "samples",
)
def match_left(spark, sf):
    many = metrics.by_labels(
        metrics.instant(samples(spark, sf), STEP, DAY), ["pod", "node"]
    )
    per_node = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr(
        "concat('n', s_suppkey % 12) AS node", "s_name AS ip", "cast(s_suppkey as double) AS value"
    )
    top = per_node.groupBy("node").agg(
        F.max("ip").alias("ip"), F.max("value").alias("value"), F.count(F.lit(1)).alias("n")
    )
    # The same value of each node at every time, and the raw rows once for their duplicates.
    one = many.select("ts", "node").distinct().join(top.drop("n"), "node")
    out, _ = metrics.match_left(many, one, ["node"], ["ip"])
    _, rejects = metrics.match_left(
        many, per_node.withColumn("ts", F.lit(0.0)), ["node"], ["ip"]
    )
    none = {c: F.lit(None).cast(t).alias(c) for c, t in
            (("pod", "string"), ("ts", "double"), ("value", "double"), ("ip", "string"))}
    return out.select(
        "pod", "node", "ts",
        F.round(F.col("value") * F.col("one_value"), 4).alias("value"), "ip",
        F.lit(False).alias("reject"),
    ).unionByName(
        rejects.select(none["pod"], F.col("key").alias("node"), none["ts"], none["value"],
                       none["ip"], F.lit(True).alias("reject"))
    )


@query(
    "label_replace",
    """select eid, case when regexp_full_match(pod, 'p([0-9]+)5') then
      regexp_replace(pod, '^(?:p([0-9]+)5)$', 'x\\1') end as short from b_samples""",
    "samples",
)
def label_replace(spark, sf):
    out = metrics.label_replace(samples(spark, sf), "short", "x$1", "pod", "p([0-9]+)5")
    return out.select("eid", "short")


def overview_rows(spark, sf):
    """Nodes, pods and pod labels, each with the value 1, once per event."""
    rows = samples(spark, sf).withColumn("k", F.substring("node", 2, 10).cast("int"))
    n = F.substring("pod", 2, 10).cast("int")
    ref = (
        F.when(n % 3 == 0, "develop")
        .when(n % 3 == 1, F.concat(F.lit("pr"), (n % 7).cast("string")))
        .otherwise("main")
    )
    kind = F.concat(F.lit("m"), (F.col("k") % 3).cast("string"))
    parts = [
        ("kube_node_labels", _labels(
            node="node", **{fixed.PIPELINE_NODE_LABEL: F.lit("true")},
            label_node_kubernetes_io_instance_type=kind,
            label_beta_kubernetes_io_instance_type=kind)),
        ("kube_pod_info", _labels(pod="pod", node="node", namespace=F.lit("pipeline"))),
        ("kube_pod_labels", _labels(pod="pod", namespace=F.lit("pipeline"), **{metrics.REF: ref})),
    ]
    out = None
    for metric, labels in parts:
        part = rows.select(
            F.lit(metric).alias("metric"), labels.alias("labels"), "ts", F.lit(1.0).alias("value")
        )
        out = part if out is None else out.unionByName(part)
    return out


OVERVIEW_SQL = (
    instant_sql("pi", HOUR * 6, step=STEP)
    + instant_sql("ni", HOUR * 6, step=STEP, by="node")
    + """, pl as (select t as ts, pod, node, cast(substr(pod, 2) as int) as n from pi),
    pd as (select *, case n % 3 when 0 then 'develop' when 1 then 'pr' || (n % 7) else 'main' end as ref from pl),
    nd as (select t as ts, node, 'm' || (cast(substr(node, 2) as int) % 3) as type from ni),
    pn as (select ts, node, count(*) as c from pd group by all),
    bz as (select nd.*, c from nd join pn on pn.ts = nd.ts and pn.node = nd.node),
    panels as (
      select 'node_count' as panel, ts, '' as dimension, cast(count(*) as double) as value from nd group by ts
      union all select 'pod_count', ts, '', count(*) from pd group by ts
      union all select 'pipeline_count', ts, '', count(distinct ref) from pd group by ts
      union all select 'pods_by_ref', ts, ref, count(*) from pd group by ts, ref
      union all select 'pods_per_node', ts, node, sum(c) from bz group by ts, node
      union all select 'labelled_pods_by_ref', ts, ref, count(*) from pd group by ts, ref
      union all select 'pods_by_kind', ts, case when ref = 'develop' then ref else 'pr' end, count(*)
        from pd where ref <> 'main' group by all
      union all select 'nodes_by_type', ts, type, count(*) from nd group by ts, type
      union all select 'pods_per_type', ts, type, avg(c) from bz group by ts, type)"""
)


@query(
    "pipeline_overview",
    OVERVIEW_SQL + "select panel, ts, dimension, round(value, 4) as value from panels",
    "samples",
)
def pipeline_overview(spark, sf):
    out = metrics.pipeline_overview(overview_rows(spark, sf), STEP, HOUR * 6)
    return out.select("panel", "ts", "dimension", F.round("value", 4).alias("value"))


def utilization_rows(spark, sf):
    rows = samples(spark, sf)
    mode = F.when(F.col("kind") == "view", "idle").otherwise("user")
    cpu = rows.select(
        F.lit("node_cpu_seconds_total").alias("metric"),
        _labels(instance="node", cpu="pod", mode=mode).alias("labels"), "ts", "value",
    )
    total = rows.where("kind = 'click'").select(
        F.lit("node_memory_MemTotal_bytes").alias("metric"),
        _labels(instance="node").alias("labels"), "ts", (F.col("value") + 500).alias("value"),
    )
    free = rows.where("kind = 'error'").select(
        F.lit("node_memory_MemFree_bytes").alias("metric"),
        _labels(instance="node").alias("labels"), "ts", "value",
    )
    return cpu.unionByName(total).unionByName(free)


UTIL_SQL = (
    f""", b as (select *, case kind when 'view' then 'idle' else 'user' end as mode from b_samples),
  pn as (select *, lag(ts) over w as pts, lag(value) over w as pval from b
    window w as (partition by pod, node, mode order by ts, value)),
  pp as (select *, case when value >= pval then value - pval else value end as inc from pn
    where pts is not null and ts - pts <= {DAY} and pts < ts),
  ir as (select pod, node, mode, cast(k * {STEP} as double) as ts, arg_max(inc / (ts - pts), ts) as value from (
    select *, {grid('ts', f'(pts + {DAY})')} as k from pp) group by pod, node, mode, k),
  cp as (select node, ts, 100.0 * sum(value) filter (mode = 'user') / sum(value) as cpu from ir group by all),
  tt as (select node, ts, value + 500 as value from b_samples where kind = 'click'),
  ff as (select node, ts, value from b_samples where kind = 'error')"""
    + instant_sql("ti", DAY, source="tt", by="node")
    + instant_sql("fi", DAY, source="ff", by="node")
    + """, rm as (select coalesce(ti.node, fi.node) as node, coalesce(ti.t, fi.t) as ts,
      100.0 * (ti.value - fi.value) / ti.value as ram from ti full join fi
      on ti.node = fi.node and ti.t = fi.t),
    ut as (select coalesce(cp.node, rm.node) as instance, coalesce(cp.ts, rm.ts) as ts, cpu, ram
      from cp full join rm on cp.node = rm.node and cp.ts = rm.ts)"""
)


def _utilization(spark, sf):
    return metrics.utilization(utilization_rows(spark, sf), window=DAY, step=STEP, lookback=DAY)


@query(
    "utilization",
    UTIL_SQL
    + """select instance, ts, round(cpu, 4) as cpu_pct, round(ram, 4) as ram_pct from ut
    union all select '(all)', ts, round(avg(cpu), 4), round(avg(ram), 4) from ut group by ts""",
    "samples",
)
def utilization(spark, sf):
    per = _utilization(spark, sf)
    both = per.select("instance", "ts", "cpu_pct", "ram_pct").unionByName(
        metrics.utilization_average(per).withColumn("instance", F.lit("(all)"))
    )
    return both.select(
        "instance", "ts", F.round("cpu_pct", 4).alias("cpu_pct"),
        F.round("ram_pct", 4).alias("ram_pct"),
    )
