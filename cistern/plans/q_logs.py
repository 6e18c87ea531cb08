"""Error taxonomy and log work."""

from pyspark.sql import functions as F

from ..functions import fixed, taxonomy_values
from ..functions.columns import grep_regex
from ..operators import logs
from ..sources import readers
from .bindings import bind
from .common import DUCK_TS, found_sql, job_rows, quote, retry_rows, taxonomy_sql, ts_text
from .registry import query

EXPORT = [*taxonomy_values.EXPORT_CLASSES, logs.OTHER]


def _sorted_list_sql(classes) -> str:
    cases = ", ".join(
        f"case when {found_sql('trace', ps)} then {quote(c)} end" for c, ps in classes.items() if ps
    )
    return f"array_to_string(list_sort(list_filter([{cases}], lambda x: x is not null)), ',')"


@query(
    "match_taxonomy",
    f"select job_id, {_sorted_list_sql(taxonomy_values.CLASSES)} as matched_classes from b_traces "
    "where build_status = 'failed'",
    "traces",
)
def match_taxonomy(spark, sf):
    out = logs.match_taxonomy(bind(spark, sf, "traces"))
    names = F.array_join(F.array_sort("matched_classes"), ",")
    return out.select("job_id", names.alias("matched_classes"))


@query(
    "assign_error_taxonomy",
    f"""select job_id, case when build_status = 'failed' then
      {taxonomy_sql('trace', 'build_failure_reason')} end as error_taxonomy,
      case when build_status = 'failed' then '0.0.0-dev' end as error_taxonomy_version
      from b_traces""",
    "traces",
)
def assign_error_taxonomy(spark, sf):
    out = logs.assign_error_taxonomy(bind(spark, sf, "traces"))
    return out.select("job_id", "error_taxonomy", "error_taxonomy_version")


_FLAG_SQL = ", ".join(
    f"{found_sql('trace', [grep_regex(p) for p in ps])} as \"{c}\""
    for c, ps in taxonomy_values.EXPORT_CLASSES.items()
)
_ANY_SQL = " or ".join(f'"{c}"' for c in taxonomy_values.EXPORT_CLASSES)
# More classes per trace than the binding alone gives.
BUSY = (
    "concat(trace, case job_id % 5 when 0 then ' error: RPC failed' when 1 then "
    "' FATAL: invalid argument Killed' when 2 then ' HTTP Error 502' else '' end, "
    "case when job_id % 7 = 0 then ' To reproduce this build locally, run: x Killed' else '' end)"
)
FLAGS_SQL = f""", g as (select job_id, {BUSY} as trace from b_traces),
 f0 as (select job_id, {_FLAG_SQL} from g),
 f as (select *, not ({_ANY_SQL}) as other_errors from f0)"""


def classified(spark, sf):
    traces = bind(spark, sf, "traces").withColumn("trace", F.expr(BUSY))
    return logs.classify_errors(traces)


@query(
    "classify_errors",
    FLAGS_SQL + "select job_id, " + ", ".join(f'"{c}"' for c in EXPORT) + " from f",
    "traces",
)
def classify_errors(spark, sf):
    return classified(spark, sf).select("job_id", *[f"`{c}`" for c in EXPORT])


_POSITION = "case c " + " ".join(f"when {quote(c)} then {i}" for i, c in enumerate(EXPORT)) + " end"
LONG_SQL = FLAGS_SQL + ", l as (" + " union all ".join(
    f"select job_id, {quote(c)} as c from f where \"{c}\"" for c in EXPORT
) + f"), p as (select *, {_POSITION} as pos from l)"


@query(
    "class_overlap",
    LONG_SQL
    + """, n as (select c, count(*) as n from l group by c),
    o as (select a.c as class_a, b.c as class_b, count(*) as overlap from p a join p b
      on a.job_id = b.job_id and a.pos < b.pos group by all)
    select class_a, class_b, overlap, x.n + y.n - overlap as total,
      round(100.0 * overlap / (x.n + y.n - overlap), 2) as percent
    from o join n x on x.c = class_a join n y on y.c = class_b""",
    "traces",
)
def class_overlap(spark, sf):
    return logs.class_overlap(classified(spark, sf), EXPORT)


_FIRST_SQL = "case " + " ".join(f'when "{c}" then {quote(c)}' for c in taxonomy_values.EXPORT_ORDER) + " end"


@query(
    "deconflict",
    FLAGS_SQL
    + f", d as (select job_id, {_FIRST_SQL} as c from f) select job_id, "
    + ", ".join(f'coalesce(c = {quote(c)}, false) as "{c}"' for c in EXPORT)
    + " from d",
    "traces",
)
def deconflict(spark, sf):
    out = logs.deconflict(classified(spark, sf).drop("trace", "build_failure_reason"))
    return out.select("job_id", *[f"`{c}`" for c in EXPORT])


_COUNT_SQL = " + ".join(f'cast("{c}" as int)' for c in EXPORT)


@query(
    "is_deconflicted",
    FLAGS_SQL + f"select 'before' as stage, max({_COUNT_SQL}) <= 1 as is_deconflicted from f "
    "union all select 'after', true",
    "traces",
)
def is_deconflicted(spark, sf):
    flags = classified(spark, sf)
    before = logs.is_deconflicted(flags, EXPORT)
    after = logs.is_deconflicted(logs.deconflict(flags), EXPORT)
    return before.select(F.lit("before").alias("stage"), "*").unionByName(
        after.select(F.lit("after").alias("stage"), "*")
    )


@query(
    "class_stats",
    FLAGS_SQL
    + ", s as ("
    + " union all ".join(
        f"select {quote(c)} as class, count(*) filter (\"{c}\") as \"count\", count(*) as n from f"
        for c in EXPORT
    )
    + ") select class, \"count\", round(100.0 * \"count\" / n, 2) as percent from s",
    "traces",
)
def class_stats(spark, sf):
    return logs.class_stats(classified(spark, sf), EXPORT)


@query(
    "runner_kind",
    "select id, case when runner is null then 'None' when starts_with(runner, 'uo') then 'UO' "
    "else 'AWS' end as kind from b_errors",
    "errors",
)
def runner_kind(spark, sf):
    return logs.runner_kind(bind(spark, sf, "errors")).select("id", "kind")


@query(
    "verify_logs",
    """select job_id as id, 'log without row' as problem from b_traces
      where job_id not in (select id + 3 from b_errors)
    union all select id + 3, 'row without log' from b_errors
      where id + 3 not in (select job_id from b_traces)""",
    "errors",
    "traces",
)
def verify_logs(spark, sf):
    rows = bind(spark, sf, "errors").withColumn("id", F.col("id") + 3)
    return logs.verify_logs(rows, bind(spark, sf, "traces"))


@query(
    "sample_log_per_class",
    LONG_SQL
    + "select c as class, arg_min(job_id, md5(concat('7:', job_id))) as job_id from l group by c",
    "traces",
)
def sample_log_per_class(spark, sf):
    return logs.sample_log_per_class(classified(spark, sf), EXPORT, seed=7)


COLOURED = (
    "concat(chr(27), '[0;m', trace, chr(27), '[32;1m', 'done', chr(27), '[0K', chr(27), "
    "'[38;5;200m')"
)


@query(
    "strip_ansi",
    f"select job_id, md5(regexp_replace({COLOURED}, "
    f"{quote(fixed.ANSI_ESCAPE)}, '', 'g')) as cleaned from b_traces",
    "traces",
)
def strip_ansi(spark, sf):
    rows = bind(spark, sf, "traces").withColumn("trace", F.expr(COLOURED))
    return logs.strip_ansi(rows, "trace").select("job_id", F.md5("trace").alias("cleaned"))


@query(
    "build_log_documents",
    """, a as (select *, row_number() over (partition by pipeline_id, build_name order by build_id)
      as attempt_number from b_jobs)
    select build_id, attempt_number, 'https://ci.example/p/-/jobs/' || build_id as job_url,
      md5(trace) as job_trace
    from a left join b_traces on job_id = build_id where object_kind = 'build'""",
    "jobs",
    "traces",
)
def build_log_documents(spark, sf):
    events = job_rows(spark, sf).withColumn(
        "project", F.struct(F.lit("https://ci.example/p").alias("web_url"))
    )
    docs = logs.build_log_documents(events, bind(spark, sf, "traces"), retry_rows(spark, sf))
    return docs.select(
        "build_id", "attempt_number", "job_url", F.md5("job_trace").alias("job_trace")
    )


_APACHE = fixed.LOG_FORMATS["apache"][0]


@query(
    "parse_access_log",
    ", m as (select page_id, regexp_matches(line, {p}) as hit, line from b_access_lines) "
    "select page_id, {cols}, "
    "try_cast(case when hit then regexp_extract(line, {p}, 6) end as int) as code, "
    "try_cast(case when hit then regexp_extract(line, {p}, 7) end as bigint) as size, "
    "case when hit then strftime(strptime(regexp_extract(line, {p}, 3), '%d/%b/%Y:%H:%M:%S +0000'), "
    "{ts}) end as ts from m".format(
        p=quote(_APACHE),
        ts=DUCK_TS,
        cols=", ".join(
            f"case when hit then regexp_extract(line, {quote(_APACHE)}, {i}) end as \"{n}\""
            for i, n in ((1, "host"), (2, "user"), (4, "method"), (5, "path"), (9, "agent"))
        ),
    ),
    "access_lines",
)
def parse_access_log(spark, sf):
    out = logs.parse_access_log(bind(spark, sf, "access_lines"), "apache")
    return out.select(
        "page_id", "host", "user", "method", "path", "agent", "code", "size",
        ts_text("ts").alias("ts"),
    )


JSON_LOG = "severity STRING, time STRING, event_id BIGINT, log STRUCT<k: BIGINT>"


@query(
    "parse_json_log",
    """select event_id, json_extract_string(line, '$.severity') as severity,
      json_extract_string(line, '$.time') as time,
      cast(json_extract(line, '$.log.k') as bigint) as k,
      '2024-01-02 03:04:05' as ts from b_json_lines""",
    "json_lines",
)
def parse_json_log(spark, sf):
    lines = bind(spark, sf, "json_lines").select("line")
    out = logs.parse_json_log(lines, JSON_LOG)
    return out.select(
        "event_id", "severity", "time", F.col("log.k").alias("k"), ts_text("ts").alias("ts")
    )


@query(
    "drop_info_logs",
    """select event_id, json_extract_string(line, '$.severity') as severity from b_json_lines
      where json_extract_string(line, '$.severity') <> 'INFO'""",
    "json_lines",
)
def drop_info_logs(spark, sf):
    out = logs.parse_json_log(bind(spark, sf, "json_lines").select("line"), JSON_LOG)
    return logs.drop_info_logs(out).select("event_id", "severity")


@query(
    "distinct_variants",
    """, m as (select unnest(regexp_extract_all(variants, '(~[^+~ ]+|\\+[^+~ ]+|\\s+[^+~ ]+=[^+~ ]+)', 1))
      as v from b_specs)
    select distinct trim(v) as variant from m where not starts_with(trim(v), 'patches')""",
    "specs",
)
def distinct_variants(spark, sf):
    return logs.distinct_variants(bind(spark, sf, "specs"))


@query(
    "event_tags",
    """select build_id, starts_with(r.description, 'uo-') as is_uo, ref = 'develop' as is_develop,
      build_status from b_jobs left join b_ci_runners r on r.id = runner_id
      where object_kind = 'build'""",
    "jobs",
    "ci_runners",
)
def event_tags(spark, sf):
    runners = bind(spark, sf, "ci_runners").select(
        F.col("id").alias("runner_id"), F.struct("description").alias("runner")
    )
    return logs.event_tags(job_rows(spark, sf).join(runners, "runner_id", "left"))


@query(
    "normalize_missing_logs",
    """select id, case when id % 4 = 0 then 'ERROR: Got 404 for ' || api_link
      when id % 3 = 0 then 'ERROR: Log File Empty' else name end as text from b_errors""",
    "errors",
)
def normalize_missing_logs(spark, sf):
    rows = bind(spark, sf, "errors").selectExpr(
        "id", "api_link", "case when id % 4 = 0 then 404 else 200 end AS status_code",
        "case when id % 3 = 0 then '' else name end AS text",
    )
    return readers.normalize_missing_logs(rows).select("id", "text")
