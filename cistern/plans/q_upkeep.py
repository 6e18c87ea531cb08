"""Warehouse upkeep queries."""

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import upkeep
from .bindings import bind
from .common import DUCK_TS, case_sql, enriched, key_sql, reason_sql
from .common import BINDINGS, ENRICHED_SQL
from .registry import query

START, END = datetime(2024, 1, 5), datetime(2024, 1, 20)
RANGE_SQL = "timestamp '2024-01-05 00:00:00' and timestamp '2024-01-20 00:00:00'"


def _tags(spark, sf):
    return upkeep.runner_tags(bind(spark, sf, "ci_taggings"), bind(spark, sf, "ci_tags"))


TAGS_SQL = """, rt as (select runner_id, list_sort(list(distinct name) filter (name is not null)) as tags
  from b_ci_taggings left join b_ci_tags on id = tag_id group by runner_id)"""


@query(
    "runner_tags",
    TAGS_SQL + "select runner_id, array_to_string(tags, ',') as tags from rt",
    "ci_taggings",
    "ci_tags",
)
def runner_tags(spark, sf):
    return _tags(spark, sf).select("runner_id", F.array_join("tags", ",").alias("tags"))


WEBHOOK_BINDINGS = (
    "ci_builds", "ci_stages", "ci_pipelines", "ci_runners", "ci_projects", "ci_users", "ci_links",
    "ci_taggings", "ci_tags",
)
WEBHOOK_SQL = TAGS_SQL + """, wh as (select b.*, s.name as stage_name, p.id as pid, p.sha, r.description,
    r.runner_type, j.name as project_name, u.name as user_name, k.source_pipeline_id, k.source_job_id,
    array_to_string(rt.tags, ',') as tags
  from b_ci_builds b left join b_ci_projects j on j.id = b.project_id
    left join b_ci_stages s on s.id = b.stage_id left join b_ci_runners r on r.id = b.runner_id
    left join b_ci_users u on u.id = b.user_id left join b_ci_pipelines p on p.id = b.commit_id
    left join b_ci_links k on k.pipeline_id = p.id left join rt on rt.runner_id = b.runner_id)"""


def webhook_rows(spark, sf):
    b = {n: bind(spark, sf, n) for n in WEBHOOK_BINDINGS}
    return upkeep.webhook_from_tables(
        b["ci_builds"], b["ci_stages"], b["ci_pipelines"], b["ci_runners"], b["ci_projects"],
        b["ci_users"], b["ci_links"], _tags(spark, sf),
    )


@query(
    "webhook_from_tables",
    WEBHOOK_SQL
    + """select id as build_id, name as build_name, stage_name as build_stage, project_id, project_name,
      round(epoch_us(finished_at - started_at) / 1e6, 3) as build_duration,
      round(epoch_us(started_at - created_at) / 1e6, 3) as build_queued_duration,
      pid as pipeline_id, sha, description, coalesce(runner_type = 1, false) as is_shared, tags,
      user_name, source_pipeline_id, source_job_id from wh""",
    *WEBHOOK_BINDINGS,
)
def webhook_from_tables(spark, sf):
    w = webhook_rows(spark, sf)
    return w.select(
        "build_id", "build_name", "build_stage", "project_id", "project_name",
        F.round("build_duration", 3).alias("build_duration"),
        F.round("build_queued_duration", 3).alias("build_queued_duration"), "pipeline_id",
        F.col("commit.sha").alias("sha"), F.col("runner.description").alias("description"),
        F.col("runner.is_shared").alias("is_shared"),
        F.array_join("runner.tags", ",").alias("tags"),
        F.col("user.name").alias("user_name"),
        F.col("source_pipeline.pipeline_id").alias("source_pipeline_id"),
        F.col("source_pipeline.job_id").alias("source_job_id"),
    )


@query(
    "backfill_candidates",
    f"""select id from b_ci_builds where project_id = 57 and type = 'Ci::Build'
      and status in ('success', 'failed') and finished_at between {RANGE_SQL}
      and id not in (select build_id from b_jobs where started_at between {RANGE_SQL}
        and build_status = 'failed')""",
    "ci_builds",
    "jobs",
)
def backfill_candidates(spark, sf):
    facts = bind(spark, sf, "jobs").where("build_status = 'failed'").selectExpr(
        "build_id AS job_id", "started_at AS finished_at"
    )
    return upkeep.backfill_candidates(bind(spark, sf, "ci_builds"), facts, START, END)


@query(
    "fix_backfill_rows",
    WEBHOOK_SQL
    + f"""select id as build_id, strftime(created_at, {DUCK_TS}) || ' UTC' as build_created_at,
      strftime(coalesce(started_at, created_at), {DUCK_TS}) || ' UTC' as build_started_at,
      strftime(finished_at, {DUCK_TS}) || ' UTC' as build_finished_at,
      {reason_sql('failure_reason')} as build_failure_reason,
      {case_sql(fixed.RUNNER_TYPES, 'runner_type')} as runner_type from wh""",
    *WEBHOOK_BINDINGS,
)
def fix_backfill_rows(spark, sf):
    out = upkeep.fix_backfill_rows(webhook_rows(spark, sf))
    return out.select(
        "build_id", "build_created_at", "build_started_at", "build_finished_at",
        "build_failure_reason", F.col("runner.runner_type").alias("runner_type"),
    )


PARENT = "case when build_id % 3 = 0 then pipeline_id + 7 end"


@query(
    "update_parent_pipelines",
    f""", d as (select build_id, pipeline_id, {PARENT} as parent_pipeline_id from b_jobs),
    sc as (select distinct pipeline_id from d where parent_pipeline_id is null),
    k as (select pipeline_id, max(source_pipeline_id) as p from b_ci_links
      where source_pipeline_id is not null and pipeline_id in (select pipeline_id from sc) group by 1)
    select build_id, d.pipeline_id, coalesce(p, parent_pipeline_id, d.pipeline_id) as parent_pipeline_id
    from d left join k on k.pipeline_id = d.pipeline_id""",
    "jobs",
    "ci_links",
)
def update_parent_pipelines(spark, sf):
    dim = bind(spark, sf, "jobs").selectExpr(
        "build_id", "pipeline_id", f"{PARENT} AS parent_pipeline_id"
    )
    return upkeep.update_parent_pipelines(dim, bind(spark, sf, "ci_links"))


@query(
    "dedupe_job_facts",
    """, w as (select job_id, count(*) as n, max(id) as id from b_fact_copies group by job_id)
    select id, job_id from b_fact_copies where id not in (select id from w where n > 1)""",
    "fact_copies",
)
def dedupe_job_facts(spark, sf):
    return upkeep.dedupe_job_facts(bind(spark, sf, "fact_copies")).select("id", "job_id")


@query(
    "split_job_dimension",
    ENRICHED_SQL
    + f""", f as (select job_id,
      {key_sql("coalesce(i_stack, '')", "coalesce(i_job_size, '')",
               "case when i_stack is null then '' else job_type end")} as a,
      {key_sql('gitlab_runner_version', 'ref', 'tag', 'pipeline_id', 'parent_pipeline_id')} as b,
      {key_sql('status', 'error_taxonomy', 'unnecessary', 'job_type', 'gitlab_failure_reason',
               'job_exit_code')} as c,
      {key_sql('is_retry', 'is_manual_retry', 'attempt_number', 'final_attempt')} as d from enriched)
    select 'fact' as "table", count(*) as n, count(distinct a || b || c || d) as keys from f
    union all select 'dim_stack_job', count(distinct a), count(distinct a) from f
    union all select 'dim_gitlab_job', count(distinct b), count(distinct b) from f
    union all select 'dim_job_result', count(distinct c), count(distinct c) from f
    union all select 'dim_job_retry', count(distinct d), count(distinct d) from f""",
    *BINDINGS,
)
def split_job_dimension(spark, sf):
    from ..sources.scratch import stage

    wide = stage(enriched(spark, sf).withColumn("job_url", F.lit("u")), "wide")
    tables = upkeep.split_job_dimension(wide)
    out = None
    for name, df in tables.items():
        key = (
            F.concat("stack_job_id", "gitlab_job_id", "job_result_id", "job_retry_id")
            if name == "fact"
            else F.col(name.replace("dim_", "") + "_id")
        )
        row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys"))
        row = row.select(F.lit(name).alias("table"), "n", "keys")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "pad_time_keys",
    """select build_id, lpad(cast(hour(started_at) * 10000 + minute(started_at) * 100
      + second(started_at) as varchar), 6, '0') as start_time_key,
      cast(hour(started_at) * 10000 + minute(started_at) * 100 + second(started_at) as varchar)
        as unpadded from b_jobs""",
    "jobs",
)
def pad_time_keys(spark, sf):
    whole = F.hour("started_at") * 10000 + F.minute("started_at") * 100 + F.second("started_at")
    rows = bind(spark, sf, "jobs").select("build_id", whole.alias("start_time_key"))
    padded = upkeep.pad_time_keys({"fact_job": rows})["fact_job"]
    copy = padded.withColumn("time_key", F.col("start_time_key"))
    back = upkeep.unpad_time_keys({"dim_time": copy})["dim_time"]
    return back.select("build_id", "start_time_key", F.col("time_key").alias("unpadded"))


@query(
    "fill_exit_codes",
    """select j.build_id as job_id, case when build_status = 'failed' then
      coalesce(m.exit_code, 99) else 99 end as job_exit_code
      from b_jobs j left join b_ci_metadata m on m.build_id = j.build_id""",
    "jobs",
    "ci_metadata",
)
def fill_exit_codes(spark, sf):
    jobs = bind(spark, sf, "jobs").selectExpr(
        "build_id AS job_id", "build_status AS status", "99 AS job_exit_code"
    )
    out = upkeep.fill_exit_codes(jobs, bind(spark, sf, "ci_metadata"))
    return out.select("job_id", "job_exit_code")


@query(
    "fill_failure_reasons",
    f"""select j.build_id as job_id, case when build_status = 'success' then 'unknown_failure'
      else {reason_sql('b.failure_reason')} end as gitlab_failure_reason
      from b_jobs j left join b_ci_builds b on b.id = j.build_id""",
    "jobs",
    "ci_builds",
)
def fill_failure_reasons(spark, sf):
    jobs = bind(spark, sf, "jobs").selectExpr(
        "build_id AS job_id", "build_status AS status", "'' AS gitlab_failure_reason"
    )
    out = upkeep.fill_failure_reasons(jobs, bind(spark, sf, "ci_builds"))
    return out.select("job_id", "gitlab_failure_reason")
