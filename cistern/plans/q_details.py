"""Details of a job from samples within its window, and the record that comes of them."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import as_column
from ..operators import details, metrics
from ..sources.scratch import DENSE, discard, stage
from .bindings import bind
from .registry import query

NOTES, TAGS = fixed.POD_ANNOTATIONS, fixed.POD_LABELS
AT = 0.137


def _labels(**columns):
    pairs = []
    for name, col in columns.items():
        pairs += [F.lit(name), as_column(col)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def metric_samples(spark, sf):
    """Each event as the scrape of a pod, its node and its resources; pod names are used again and again."""
    rows = bind(spark, sf, "samples").withColumn("k", F.col("eid") % 10)
    text = lambda c: c.cast("string")
    eid, k = F.col("eid"), F.col("k")
    node = F.concat(F.lit("n"), text(k))
    build = {"container": F.lit("build"), "pod": "pod"}
    note = {
        **{name: F.lit("x") for name in NOTES.values()},
        NOTES["package_name"]: F.concat(F.lit("pkg"), text(eid % 5)),
        NOTES["package_hash"]: F.when(eid % 7 != 0, F.concat(F.lit("h"), text(eid))),
        fixed.POD_OPTIONAL_ANNOTATIONS["compiler_name"]: F.when(eid % 3 == 0, "gcc"),
        fixed.POD_BUILD_JOBS: F.when(eid % 4 == 0, text(eid % 9)),
        fixed.POD_JOB_ID: text(eid),
    }
    names = fixed.NODE_LABELS
    size = {
        names["cpu"]: text(4 + k), names["memory"]: text(1000 + k), names["capacity_type"]: F.lit("spot"),
        names["instance_type"]: F.concat(F.lit("m"), text(k % 3)),
        names["zone"]: F.concat(F.lit("z"), text(k % 2)),
        "label_karpenter_sh_initialized": F.lit("true"),
        "label_topology_ebs_csi_aws_com_zone": F.lit("z"),
    }
    uuid = F.concat(node, F.lit("-"), text(F.floor(F.col("ts") / 432000)))
    value, always = F.col("value"), F.lit(True)
    kinds = [
        ("kube_pod_annotations", _labels(pod="pod", **note), value, always),
        ("kube_pod_annotations", _labels(pod=F.lit("other"), **note), value, eid % 11 == 0),
        ("kube_pod_info", _labels(pod="pod", node=node, pod_ip=F.lit("10.0.0.1")), value, always),
        ("kube_pod_labels", _labels(pod="pod", **{
            TAGS["job_size"]: F.concat(F.lit("s"), text(eid % 2)), TAGS["stack"]: F.lit("st")}),
         value, always),
        ("kube_node_info", _labels(node=node, system_uuid=uuid), value, always),
        ("kube_node_labels", _labels(node=node, **size), value, always),
        (fixed.PRICE_METRIC, _labels(
            capacity_type=F.lit("spot"), instance_type=size[names["instance_type"]],
            zone=size[names["zone"]]), value, eid % 13 != 0),
        ("container_cpu_usage_seconds_total", _labels(node=node, **build), value, always),
        ("container_memory_working_set_bytes", _labels(**build), value * 1000, always),
    ]
    for metric, resource, amount, given in (
        ("requests", "cpu", eid % 8, always), ("requests", "memory", eid % 16, always),
        ("limits", "cpu", eid % 32, eid % 2 == 0), ("limits", "memory", eid % 64, always),
    ):
        kinds.append((f"kube_pod_container_resource_{metric}",
                      _labels(resource=F.lit(resource), **build), amount.cast("double"), given))
    # A branch for each kind: who asks for some metrics computes and reads only those.
    out = None
    for m, labels, v, given in kinds:
        own = rows.where(given).select(F.lit(m).alias("metric"), labels.alias("labels"), "ts", v.alias("value"))
        out = own if out is None else out.unionByName(own)
    return out


def job_windows(spark, sf):
    """Every job from its event on, a minute and as many seconds as the event's value."""
    at = bind(spark, sf, "samples").select("eid", "pod", "ts", "value")
    jobs = bind(spark, sf, "jobs").select(
        F.col("build_id").alias("job_id"), F.col("build_name").alias("name"),
        F.col("build_status").alias("status"),
        F.col("build_stage").rlike(fixed.BUILD_STAGE).alias("is_build"), "ref",
    )
    return jobs.join(at, F.col("eid") == F.col("job_id")).select(
        "job_id", "name", "status", "is_build", "ref", "pod", F.col("ts").alias("start_ts"),
        (F.col("ts") + 60 + F.col("value")).alias("end_ts"),
    )


def hits_sql(name: str, windows: str, spans: str, parts: int) -> str:
    """Windows (job_id, key, s, t) with the spans of their key at each of their grid points k."""
    return f""", {name} as (select * from (select w.job_id, x.*, w.s, w.st,
        unnest(range(0, cast(floor((w.t - w.s) / w.st) as bigint) + 1)) as k
      from (select *, greatest(ceil((t - s) / {parts}), 1) as st from {windows}) w
      join {spans} x on x.key = w.key and x.until >= w.s and x.ts <= w.t)
      where s + k * st >= ts and case when closed then s + k * st <= until else s + k * st < until end)"""


def spans_sql(name: str, series: str, key: str, where: str = "true") -> str:
    return f""", {name} as (select *, case when nxt - ts <= 300 then nxt else ts + 300 end as until,
      coalesce(nxt - ts > 300, true) as closed from (select *, {series} as series, {key} as key,
        lead(ts) over (partition by {series} order by ts, value) as nxt from e where {where}))"""


WINDOWS_SQL = """, e as (select *, eid % 10 as kn, 'n' || (eid % 10) as nd,
    'n' || (eid % 10) || '-' || cast(floor(ts / 432000) as bigint) as uuid from b_samples),
  j as (select build_id as job_id, build_name as name, build_status as status, ref,
    regexp_matches(build_stage, '^stage-\\d+$') as is_build, e.pod, e.ts as s, e.ts + 60 + e.value as t
    from b_jobs join e on e.eid = build_id),
  jp as (select *, pod as key from j)"""
# Which series each window's pod and node have; the job's own is always among them.
NODE_SQL = (
    spans_sql("info", "pod || '|' || nd", "pod")
    + hits_sql("ih", "jp", "info", 10)
    + """, pi as (select job_id, count(distinct series) as n, min(nd) as nd from ih group by 1),
    jn as (select j.*, pi.nd as key, pi.nd from j join pi on pi.job_id = j.job_id where n = 1)"""
    + spans_sql("ni", "uuid", "nd")
    + hits_sql("nh", "jn", "ni", 10)
    + """, pn as (select job_id, count(distinct series) as n, min(uuid) as uuid from nh group by 1),
    node as (select j.job_id, jn.nd, pn.uuid, cast(substr(jn.nd, 2) as int) as kn,
      case when jn.nd is null then 'kube_pod_info: more than one series'
        when pn.n > 1 then 'kube_node_info: more than one series' end as reason
      from j left join jn on jn.job_id = j.job_id left join pn on pn.job_id = j.job_id)"""
)
TAG_SQL = (
    spans_sql("an", "cast(eid as varchar)", "pod")
    + hits_sql("ah", "jp", "an", 10)
    + spans_sql("tg", "pod || '|' || (eid % 2)", "pod")
    + hits_sql("th", "jp", "tg", 10)
    + f""", tag as (select j.job_id, case when a.n > 1 then 'kube_pod_annotations: more than one series'
        when t.n > 1 then 'kube_pod_labels: more than one series' end as reason,
      case when j.job_id % 7 = 0 then 'missing label {NOTES['package_hash']}' end as gone
      from j join (select job_id, count(distinct series) as n from ah group by 1) a on a.job_id = j.job_id
      join (select job_id, count(distinct series) as n from th group by 1) t on t.job_id = j.job_id)"""
)
LIMIT_SQL = (
    spans_sql("rs", "pod", "pod")
    + hits_sql("rh", "jp", "rs", 10)
    + spans_sql("ls", "pod", "pod", "eid % 2 = 0")
    + hits_sql("lh", "jp", "ls", 10)
    + """, lim as (select j.job_id, r.cr, r.mr, r.ml, l.cl from j
      left join (select job_id, cast(arg_min(eid % 8, k) as double) as cr,
        cast(arg_min(eid % 16, k) as double) as mr, cast(arg_min(eid % 64, k) as double) as ml
        from rh group by 1) r on r.job_id = j.job_id
      left join (select job_id, cast(arg_min(eid % 32, k) as double) as cl from lh group by 1) l
        on l.job_id = j.job_id)"""
)


@query(
    "pod_node_in_window",
    WINDOWS_SQL
    + NODE_SQL
    + """select job_id, case when reason is null then nd end as node, case when reason is null then uuid end
      as system_uuid, case when reason is null then 4 + kn end as cpu,
      case when reason is null then cast((1000 + kn) * 1000000 as bigint) end as memory,
      case when reason is null then 'm' || (kn % 3) end as instance_type, reason from node""",
    "samples", "jobs",
)
def pod_node_in_window(spark, sf):
    windows = job_windows(spark, sf).withColumnRenamed("job_id", "window_id")
    good, rejects = metrics.pod_node(metric_samples(spark, sf), windows)
    cols = ["node", "system_uuid", "cpu", "memory", "instance_type"]
    none = [F.lit(None).cast(good.schema[c].dataType).alias(c) for c in cols]
    return good.select(
        F.col("window_id").alias("job_id"), *cols, F.lit(None).cast("string").alias("reason")
    ).unionByName(rejects.select(F.col("key").cast("bigint").alias("job_id"), *none, "reason"))


@query(
    "pod_labels_in_window",
    WINDOWS_SQL
    + TAG_SQL
    + """select job_id, case when reason is null and gone is null then 'pkg' || (job_id % 5) end as package_name,
      case when reason is null and gone is null then 'h' || job_id end as package_hash,
      case when reason is null and gone is null then case when job_id % 3 = 0 then 'gcc' else '' end end
        as compiler_name,
      case when reason is null and gone is null then 's' || (job_id % 2) end as job_size,
      cast(case when reason is null and gone is null and job_id % 4 = 0 then job_id % 9 end as int) as build_jobs,
      coalesce(reason, gone) as reason from tag""",
    "samples", "jobs",
)
def pod_labels_in_window(spark, sf):
    windows = job_windows(spark, sf).withColumnRenamed("job_id", "window_id")
    good, rejects = metrics.pod_labels(metric_samples(spark, sf), windows)
    cols = ["package_name", "package_hash", "compiler_name", "job_size", "build_jobs"]
    none = [F.lit(None).cast(good.schema[c].dataType).alias(c) for c in cols]
    return good.select(
        F.col("window_id").alias("job_id"), *cols, F.lit(None).cast("string").alias("reason")
    ).unionByName(rejects.select(F.col("key").cast("bigint").alias("job_id"), *none, "reason"))


@query(
    "pod_requests_limits_in_window",
    WINDOWS_SQL + LIMIT_SQL
    + "select job_id, cr as cpu_request, cl as cpu_limit, mr as memory_request, ml as memory_limit from lim",
    "samples", "jobs",
)
def pod_requests_limits_in_window(spark, sf):
    windows = job_windows(spark, sf).withColumnRenamed("job_id", "window_id")
    out = metrics.pod_requests_limits(metric_samples(spark, sf), windows)
    return out.select(
        F.col("window_id").alias("job_id"), "cpu_request", "cpu_limit", "memory_request", "memory_limit"
    )


def _floored(expr: str, scale: int = 10_000) -> str:
    return f"cast(floor({expr} * {scale} + {AT}) as bigint)"


USAGE_SQL = (
    """, ju as (select j.*, n.nd, n.uuid, n.kn, j.pod || '|' || n.nd as key from j
      join node n on n.job_id = j.job_id where n.reason is null and j.job_id % 11 <> 0),
    jm as (select * replace (nd as key) from ju), jq as (select * replace (pod as key) from ju),
    price as (select w.job_id, avg(p.value) as price from ju w join e p on p.kn % 3 = w.kn % 3
      and p.kn % 2 = w.kn % 2 and p.eid % 13 <> 0 and p.ts between w.s and w.t group by 1)"""
    + spans_sql("cp", "pod || '|' || nd", "pod || '|' || nd")
    + hits_sql("ch", "ju", "cp", 100)
    + spans_sql("cn", "pod || '|' || nd", "nd")
    + hits_sql("oh", "jm", "cn", 100)
    + spans_sql("ms", "pod", "pod")
    + hits_sql("mh", "jq", "ms", 100)
    + """, own as (select job_id, arg_max(value, k) as cpu from ch group by 1),
    occ as (select job_id, min(k) as f, max(k) as l, sum(1.0 / n) as tot, arg_min(1.0 / n, k) as fi from
      (select job_id, k, count(*) as n from oh group by all) group by 1),
    lone as (select job_id from oh group by 1 having count(distinct series) = 1),
    mem as (select job_id, max(floor(value * 1000)) as mx, avg(floor(value * 1000)) as av from mh group by 1)"""
)


@query(
    "job_details",
    WINDOWS_SQL + NODE_SQL + TAG_SQL + LIMIT_SQL + USAGE_SQL
    + f""", u as (select j.job_id, j.name, j.status, j.is_build, j.pod, n.nd, n.uuid, n.kn, price.price,
      own.cpu, mem.mx, mem.av, lim.*exclude(job_id),
      case when lone.job_id is null then case when l = f then fi else (tot - fi) / (l - f) end end as share,
      j.ref <> 'develop' as a, case when j.job_id % 8 = 1 then 'VAR' end as av_gone, tag.gone,
      case when j.job_id % 11 = 0 then 'no pod of the job' when n.reason is not null then n.reason
        when price.price is null then 'no price of spot, m' || (n.kn % 3) || ', z' || (n.kn % 2)
        when lone.job_id is not null then 'only one series on the node'
        when j.is_build then tag.reason end as problem
      from j join node n on n.job_id = j.job_id join tag on tag.job_id = j.job_id
      join lim on lim.job_id = j.job_id left join price on price.job_id = j.job_id
      left join own on own.job_id = j.job_id left join occ on occ.job_id = j.job_id
      left join lone on lone.job_id = j.job_id left join mem on mem.job_id = j.job_id),
    r as (select *, problem is null as m from u),
    s as (select *, case when m and is_build and gone is not null then 'reject' when m then 'metrics'
      when not is_build then 'none' when a and av_gone is not null then 'reject' when a then 'artifacts'
      when status = 'failed' then 'name' else 'reject' end as source from r)
    select job_id, source as info_source,
      case when source = 'reject' then case when m then gone when a then 'missing variable ' || av_gone
        else 'no artifacts' end else problem end as reason,
      case when source = 'metrics' and is_build then 'pkg' || (job_id % 5) when source = 'artifacts' then 'a'
        when source = 'name' then regexp_extract(name, '^([^@]*)@', 1) end as package_name,
      case when source = 'metrics' and is_build then 'h' || job_id when source = 'artifacts' then 'ah'
        when source = 'name' then regexp_extract(name, '/(.*)$', 1) end as package_hash,
      case when source = 'metrics' and is_build then 'st' when source = 'artifacts' then 'as' end as stack,
      cast(case when source = 'metrics' and is_build and job_id % 4 = 0 then job_id % 9
        when source = 'artifacts' then 3 end as int) as build_jobs,
      case when source = 'metrics' then pod end as pod_name,
      case when source = 'metrics' then nd end as node_name,
      case when source = 'metrics' then uuid end as system_uuid,
      cast(case when source = 'metrics' then 4 + kn end as int) as node_cpu,
      case when source = 'metrics' then {_floored('price')} end as price_e4,
      case when source = 'metrics' then {_floored('share')} end as share_e4,
      case when source = 'metrics' then {_floored('cpu')} end as cpu_e4,
      cast(case when source = 'metrics' then mx end as bigint) as pod_max_mem,
      case when source = 'metrics' then {_floored('av', 100)} end as avg_mem_e2,
      case when source = 'metrics' then cr end as pod_cpu_request,
      case when source = 'metrics' then cl end as pod_cpu_limit,
      case when source = 'metrics' then ml end as pod_memory_limit from s""",
    "samples", "jobs",
)
def job_details(spark, sf):
    jobs = job_windows(spark, sf)
    given = {c: "x" for c in (*details.PACKAGE, *details.MISC)}
    given |= {"package_name": "a", "package_hash": "ah", "stack": "as"}
    artifacts = jobs.where("ref <> 'develop'").select(
        "job_id", F.when(F.col("job_id") % 8 == 1, "VAR").alias("missing_variable"),
        *[F.lit(v).alias(c) for c, v in given.items() if c != "build_jobs"],
        F.lit(3).alias("build_jobs"),
    )
    samples = stage(metric_samples(spark, sf), "samples", DENSE)
    records, rejects = details.job_details(samples, jobs.drop("pod", "ref"), artifacts)
    discard(samples)

    def whole(c, scale=10_000):
        return F.floor(F.col(c) * scale + AT).cast("bigint")

    cells = {
        **{c: F.col(c) for c in ("package_name", "package_hash", "stack", "build_jobs", "pod_name",
                                 "node_name", "system_uuid", "node_cpu")},
        "price_e4": whole("spot_price"), "share_e4": whole("pod_node_occupancy"),
        "cpu_e4": whole("pod_cpu_usage_seconds"), "pod_max_mem": F.col("pod_max_mem"),
        "avg_mem_e2": whole("pod_avg_mem", 100),
        **{c: F.col(c) for c in ("pod_cpu_request", "pod_cpu_limit", "pod_memory_limit")},
    }
    out = records.select(
        "job_id", "info_source", F.col("metrics_problem").alias("reason"),
        *[v.alias(c) for c, v in cells.items()],
    )
    none = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in cells]
    return out.unionByName(
        rejects.select(
            F.col("key").cast("bigint").alias("job_id"), F.lit("reject").alias("info_source"),
            "reason", *none,
        )
    )
