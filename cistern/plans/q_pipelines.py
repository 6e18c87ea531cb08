"""Retries and pipeline state."""

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import pipelines
from .bindings import bind, table
from .common import BASE_DOC_URL, case_sql, quote, reason_sql
from .registry import query

NOW = datetime(1999, 1, 1)
NOW_SQL = "timestamp '1999-01-01 00:00:00'"


@query(
    "attempt_number",
    "select id, row_number() over (partition by commit_id, name order by id) as attempt_number "
    "from b_ci_builds",
    "ci_builds",
)
def attempt_number(spark, sf):
    # Ranges narrower than the default, so that the given tables span many of them.
    out = pipelines.attempt_number(bind(spark, sf, "ci_builds"), width=1000)
    return out.select("id", "attempt_number")


def _configured(spark, sf):
    return pipelines.retry_config(
        bind(spark, sf, "ci_builds"),
        bind(spark, sf, "ci_instances"),
        bind(spark, sf, "ci_definitions"),
        bind(spark, sf, "ci_metadata"),
    )


CONFIG_SQL = """, d as (select job_id, json_extract(config, '$.options.retry') as cfg
    from b_ci_instances join b_ci_definitions on id = job_definition_id),
  c as (select b.id, b.name, b.commit_id, b.failure_reason,
    case when d.job_id is not null then d.cfg else json_extract(m.config_options, '$.retry') end as cfg
    from b_ci_builds b left join d on d.job_id = b.id left join b_ci_metadata m on m.build_id = b.id),
  r as (select *, case when cfg is null then 0 else cast(json_extract(cfg, '$.max') as int) end as retry_max,
    case when cfg is null then 'always' else json_extract_string(cfg, '$.when[0]') end as first_reason
    from c)"""


@query(
    "retry_config",
    CONFIG_SQL + "select id, retry_max, first_reason, cfg is null as retry_defaulted from r",
    "ci_builds",
    "ci_instances",
    "ci_definitions",
    "ci_metadata",
)
def retry_config(spark, sf):
    out = _configured(spark, sf)
    first = F.get("retry_reasons", F.lit(0)).alias("first_reason")
    return out.select("id", "retry_max", first, "retry_defaulted")


@query(
    "retry_info",
    CONFIG_SQL
    + f""", a as (select *, row_number() over (partition by commit_id, name order by id) as n,
      {reason_sql('failure_reason')} as reason from r)
    select id, n > 1 as is_retry, n > retry_max + 1 as is_manual_retry,
      not (retry_max <> 0 and first_reason in ('always', reason) and n <= retry_max)
        as final_attempt from a""",
    "ci_builds",
    "ci_instances",
    "ci_definitions",
    "ci_metadata",
)
def retry_info(spark, sf):
    named = pipelines.failure_reason_name(_configured(spark, sf), "failure_reason")
    out = pipelines.retry_info(pipelines.attempt_number(named))
    return out.select("id", "is_retry", "is_manual_retry", "final_attempt")


@query(
    "exit_codes",
    "select id, exit_code as job_exit_code from b_ci_builds left join b_ci_metadata on build_id = id",
    "ci_builds",
    "ci_metadata",
)
def exit_codes(spark, sf):
    out = pipelines.exit_codes(bind(spark, sf, "ci_builds"), bind(spark, sf, "ci_metadata"))
    return out.select("id", "job_exit_code")


@query(
    "failure_reason_name",
    f"select build_id, {reason_sql('failure_code')} as build_failure_reason from b_jobs",
    "jobs",
)
def failure_reason_name(spark, sf):
    out = pipelines.failure_reason_name(bind(spark, sf, "jobs"))
    return out.select("build_id", "build_failure_reason")


@query(
    "runner_type_name",
    f"select id, {case_sql(fixed.RUNNER_TYPES, 'runner_type')} as runner_type_name from b_ci_runners",
    "ci_runners",
)
def runner_type_name(spark, sf):
    return pipelines.runner_type_name(bind(spark, sf, "ci_runners")).select("id", "runner_type_name")


@query(
    "latest_pipeline_per_sha",
    """, r as (select *, row_number() over (partition by sha order by updated_at desc, id) as rn
      from b_pipelines) select sha, id, ref, status from r where rn = 1""",
    "pipelines",
)
def latest_pipeline_per_sha(spark, sf):
    rows = bind(spark, sf, "pipelines")
    return pipelines.latest_pipeline_per_sha(rows, "id").select("sha", "id", "ref", "status")


@query(
    "pipeline_status",
    "select id, "
    + case_sql({k: v[0] for k, v in fixed.PIPELINE_STATES.items()}, "status")
    + " as state, "
    + case_sql({k: v[1] for k, v in fixed.PIPELINE_STATES.items()}, "status")
    + " as description, web_url as target_url from b_statuses "
    "where status is not null and status <> 'canceled'",
    "statuses",
)
def pipeline_status(spark, sf):
    out = pipelines.pipeline_status(bind(spark, sf, "statuses"))
    return out.select("id", "state", "description", "target_url")


TITLED = "case when id % 3 = 0 then 'Fix things' else concat('Merge a', id, ' into b') end"


@query(
    "pr_sha_from_merge",
    "select id, case when id % 3 = 0 then sha else concat('a', id) end as pr_sha from b_pipelines",
    "pipelines",
)
def pr_sha_from_merge(spark, sf):
    rows = bind(spark, sf, "pipelines").withColumn("title", F.expr(TITLED))
    return pipelines.pr_sha_from_merge(rows).select("id", "pr_sha")


@query(
    "latest_tested_and_running",
    """select ref, arg_min(sha, id) filter (status in ('success', 'failed')) as latest_tested_sha,
      arg_min(sha, id) filter (status = 'running') as running_sha from b_pipelines group by ref""",
    "pipelines",
)
def latest_tested_and_running(spark, sf):
    return pipelines.latest_tested_and_running(bind(spark, sf, "pipelines"), "id")


@query(
    "latest_success",
    """select ref, arg_max(sha, id) as sha from b_pipelines where ref = 'pr7_x'
      and status = 'success' group by ref""",
    "pipelines",
)
def latest_success(spark, sf):
    return pipelines.latest_success(bind(spark, sf, "pipelines"), "pr7_x")


@query(
    "recent_protected_refs",
    f"""select distinct ref from b_protected_refs where updated_at between
      {NOW_SQL} - interval '700' day and {NOW_SQL} and (ref = 'develop'
      or regexp_matches(ref, '^v\\d+\\.\\d+\\.\\d+$') or regexp_matches(ref, '^releases/v\\d+\\.\\d+$')
      or regexp_matches(ref, '^develop-\\d{{4}}-\\d{{2}}-\\d{{2}}$'))""",
    "protected_refs",
)
def recent_protected_refs(spark, sf):
    return pipelines.recent_protected_refs(bind(spark, sf, "protected_refs"), NOW, 700)


STUCK_SQL = f"""status = 'running' and floor((epoch({NOW_SQL}) - epoch(created_at)) / 86400) > 300"""


def _stuck(spark, sf):
    return pipelines.stuck_pipelines(bind(spark, sf, "pipelines"), NOW, 300)


@query("stuck_pipelines", f"select id, ref from b_pipelines where {STUCK_SQL}", "pipelines")
def stuck_pipelines(spark, sf):
    return _stuck(spark, sf).select("id", "ref")


@query(
    "cancel_plan",
    f""", s as (select id from b_pipelines where {STUCK_SQL})
    select parent_pipeline_id, child_id as cancel_id, 0 as step from b_bridges
      where child_id is not null and parent_pipeline_id in (select id from s)
    union all select id, id, 1 from s""",
    "pipelines",
    "bridges",
)
def cancel_plan(spark, sf):
    return pipelines.cancel_plan(_stuck(spark, sf), bind(spark, sf, "bridges"))


@query(
    "skipped_pipelines",
    f"""select name, commit_id from b_branches where regexp_matches(name, 'pr[0-9]+')
      and name not in (select ref from b_pushes where ref is not null and commit_to is not null
        and created_at > {NOW_SQL} - interval '1' hour)
      and commit_id not in (select sha from b_pipelines)""",
    "branches",
    "pushes",
    "pipelines",
)
def skipped_pipelines(spark, sf):
    out = pipelines.skipped_pipelines(
        bind(spark, sf, "branches"), bind(spark, sf, "pushes"), bind(spark, sf, "pipelines"), NOW
    )
    return out.select("name", "commit_id")


@query(
    "stale_branches",
    f"""select name from b_branches where not protected and regexp_matches(name, 'pr[0-9]+')
      and commit_created_at < {NOW_SQL} - interval '100' day""",
    "branches",
)
def stale_branches(spark, sf):
    return pipelines.stale_branches(bind(spark, sf, "branches"), NOW).select("name")


@query(
    "retryable_triggers",
    """, g as (select pipeline_id, name from b_generate_jobs group by all
      having bool_or(status = 'success') and bool_or(status = 'failed'))
    select id, child_id from b_bridges b where child_status = 'failed'
      and failure_reason = 'unknown_failure' and child_id is not null
      and child_id not in (select pipeline_id from b_generate_jobs)
      and exists (select 1 from g where g.pipeline_id = b.parent_pipeline_id
        and g.name = replace(b.name, '-build', '-generate'))""",
    "bridges",
    "generate_jobs",
)
def retryable_triggers(spark, sf):
    out = pipelines.retryable_triggers(
        bind(spark, sf, "bridges"), bind(spark, sf, "generate_jobs")
    )
    return out.select("id", "child_id")


CHECKS = ["prechecks", "style"]
PRS_SQL = f""", c1 as (select head_sha, name, arg_min(conclusion, pos) as conclusion, min(pos) as pos
    from b_check_runs where name in ('prechecks', 'style') group by all),
  c as (select head_sha, arg_min(name, pos) filter (conclusion <> 'success') as failing,
    bool_or(name = 'prechecks') as has_pre, bool_or(name = 'style') as has_style from c1 group by all),
  d as (select p.*, 'pr' || p.number || '_' || p.head_ref as pr_string,
    case when draft then 'draft' when updated_at < {NOW_SQL} - interval '48' hour then 'stale' end as early,
    coalesce(regexp_extract(g.title, '^Merge\\s+(\\S+)\\s+into\\s+(\\S+)', 1) = p.head_sha, false) as already,
    coalesce(c.failing, case when not coalesce(has_pre, false) then 'prechecks'
      when not coalesce(has_style, false) then 'style' end) as late,
    coalesce(l.label, '') as label
    from b_prs p left join b_gitlab_heads g on g.pr_string = 'pr' || p.number || '_' || p.head_ref
    left join c on c.head_sha = p.head_sha left join b_pr_labels l on l.number = p.number),
  e as (select *, case when late is not null then 'waiting for ' || late || ' check to succeed'
      when label = 'other' then 'missing_label' end as gate,
    base_ref = 'develop' and label <> 'pipelines:urgent' as on_main,
    merge_base_sha in (select parent from b_commits where parent is not null) as reached from d),
  f as (select *, early is null and not already and gate is null as open from e),
  h as (select *, open and on_main and (merge_base_sha is null or
      (head_sha = repo_head_sha and reached and merge_conflict)) as main_conflict,
    open and not on_main and merge_commit_sha is null as side_conflict,
    coalesce(early, case when not already then coalesce(gate, case when open and on_main then
      case when head_sha <> repo_head_sha then 'GitHub HEAD shas out of sync (repo=' ||
        substr(repo_head_sha, 1, 7) || ', API=' || substr(head_sha, 1, 7) || ')'
      when not coalesce(reached, false) then 'base' end end) end) as backlogged from f)"""


def _classified(spark, sf):
    labels = bind(spark, sf, "pr_labels")
    # Two labels may excuse a missing required one: both readings of the label table are used.
    tagged = labels.where("label <> 'other'").select("number", F.lit("ci").alias("label"))
    reach = bind(spark, sf, "commits").selectExpr("parent AS commit")
    return pipelines.classify_prs(
        bind(spark, sf, "prs"),
        bind(spark, sf, "check_runs"),
        labels.unionByName(tagged),
        bind(spark, sf, "gitlab_heads"),
        reach,
        now=NOW,
        prereq_checks=CHECKS,
        required_label="ci",
        main_branch="develop",
    )


PR_BINDINGS = ("prs", "check_runs", "gitlab_heads", "pr_labels", "commits")


@query(
    "classify_prs",
    PRS_SQL
    + """select number, pr_string, backlogged is null and not already as push, backlogged,
      head_sha, false as unmergeable from h where not main_conflict and not side_conflict
    union all
    select null, null, null, null, head_sha, true from h where main_conflict""",
    *PR_BINDINGS,
)
def classify_prs(spark, sf):
    prs, unmergeable = _classified(spark, sf)
    cols = ["number", "pr_string", "push", "backlogged"]
    rows = prs.select(*cols, "head_sha", F.lit(False).alias("unmergeable"))
    bad = unmergeable.select(
        *[F.lit(None).cast(prs.schema[c].dataType).alias(c) for c in cols],
        "head_sha", F.lit(True).alias("unmergeable"),
    )
    return rows.unionByName(bad)


STATUS_SQL = f""", st as (select head_sha as sha, pr_string as branch, 'pending' as state,
    case backlogged when 'base' then {quote(BASE_DOC_URL)} else '' end as target_url,
    case backlogged when 'base' then 'This branch''s merge-base with develop is newer than the latest commit tested by GitLab'
      when 'draft' then 'GitLab CI is disabled for draft PRs' else backlogged end as description
    from h where not main_conflict and not side_conflict and backlogged is not null
      and backlogged not in ('stale', 'missing_label')
  union all select head_sha, '', 'error', '', 'PR could not be merged with develop' from h
    where main_conflict)"""


def _statuses(spark, sf):
    return pipelines.backlog_status(
        *_classified(spark, sf), "develop", base_doc_url=BASE_DOC_URL
    )


@query("backlog_status", PRS_SQL + STATUS_SQL + "select * from st", *PR_BINDINGS)
def backlog_status(spark, sf):
    return _statuses(spark, sf)


@query(
    "new_statuses",
    PRS_SQL
    + STATUS_SQL
    + """select sha, state, description from st where not (state = 'pending' and target_url = ''
      and description = 'GitLab CI is disabled for draft PRs'
      and sha in (select md5(concat('head', o_orderkey)) from orders where o_custkey % 2 = 0))""",
    *PR_BINDINGS,
)
def new_statuses(spark, sf):
    context = F.lit("ci/gitlab-ci").alias("context")
    posted = table(spark, sf, "orders").selectExpr(
        "md5(concat('head', o_orderkey)) AS sha",
        "case when o_custkey % 2 = 0 then 'pending' else 'success' end AS state",
        "'GitLab CI is disabled for draft PRs' AS description",
        "'' AS target_url",
    )
    fresh = pipelines.new_statuses(
        _statuses(spark, sf).select("*", context), posted.select("*", context)
    )
    return fresh.select("sha", "state", "description")



def _reach(spark, sf):
    commits = bind(spark, sf, "commits").withColumn("pos", F.lit(0))
    heads = commits.agg(F.max("commit").alias("commit"))
    return pipelines.ancestor_closure(commits, heads, has_merges=False)


@query(
    "ancestor_closure",
    "WITH RECURSIVE b_commits AS (SELECT o_orderkey AS commit, case when o_orderkey > 3 then "
    "o_orderkey - 1 - o_custkey % 3 end AS parent FROM orders), r AS (SELECT max(commit) AS commit "
    "FROM b_commits UNION ALL SELECT b.parent FROM r JOIN b_commits b ON b.commit = r.commit "
    "WHERE b.parent IS NOT NULL) SELECT commit FROM r",
)
def ancestor_closure(spark, sf):
    return _reach(spark, sf)


@query(
    "is_ancestor",
    "WITH RECURSIVE b_commits AS (SELECT o_orderkey AS commit, o_custkey AS base, case when "
    "o_orderkey > 3 then o_orderkey - 1 - o_custkey % 3 end AS parent FROM orders), r AS (SELECT "
    "max(commit) AS commit FROM b_commits UNION ALL SELECT b.parent FROM r JOIN b_commits b ON "
    "b.commit = r.commit WHERE b.parent IS NOT NULL) SELECT o_orderkey AS number, o_custkey AS "
    "commit, o_custkey IN (SELECT commit FROM r) AS is_ancestor FROM orders",
)
def is_ancestor(spark, sf):
    pairs = table(spark, sf, "orders").selectExpr("o_orderkey AS number", "o_custkey AS commit")
    return pipelines.is_ancestor(pairs, _reach(spark, sf))
