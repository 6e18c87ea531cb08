"""Retries and the state of pipelines, branches and pull requests.

`now` is always a parameter, and every result is a table: nothing is posted, retried or deleted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import is_true, lookup, matches_one_of
from .rolling import rank_by_slices


def _lit_ts(value: datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def attempt_number(builds: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Adds attempt_number = 1 + builds of the same pipeline and name with a smaller id.

    Ids are ranked in ranges of `width`, so one job name that fills a pipeline is spread out.
    """
    return rank_by_slices(builds, ["commit_id", "name"], "id", width, "attempt_number")


def retry_config(
    builds: DataFrame, instances: DataFrame, definitions: DataFrame, metadata: DataFrame
) -> DataFrame:
    """Retry settings per build: job definition, else legacy metadata, else the default.

    A build that has a definition does not look at the metadata, even if the definition is silent.
    """
    defined = instances.join(
        definitions, instances.job_definition_id == definitions.id
    ).select(
        F.col("job_id").alias("id"),
        F.get_json_object("config", "$.options.retry").alias("_defined"),
        F.lit(True).alias("_has_definition"),
    )
    legacy = metadata.select(
        F.col("build_id").alias("id"),
        F.get_json_object("config_options", "$.retry").alias("_legacy"),
    )
    joined = builds.join(defined, "id", "left").join(legacy, "id", "left")
    raw = F.when(F.col("_has_definition"), F.col("_defined")).otherwise(F.col("_legacy"))
    parsed = F.from_json(raw, "max INT, when ARRAY<STRING>")
    out = joined.withColumn("_cfg", parsed).withColumn("_raw", raw)
    missing = F.col("_raw").isNull()
    return out.select(
        *builds.columns,
        F.when(missing, F.lit(0)).otherwise(F.col("_cfg.max")).alias("retry_max"),
        F.when(missing, F.array(F.lit("always"))).otherwise(F.col("_cfg.when"))
        .alias("retry_reasons"),
        missing.alias("retry_defaulted"),
    )


def retry_info(df: DataFrame) -> DataFrame:
    """Adds is_retry, is_manual_retry and final_attempt from attempt, settings and reason."""
    most = F.coalesce(F.col("retry_max"), F.lit(0))
    reasons = F.when(most == 0, F.array().cast("array<string>")).otherwise(F.col("retry_reasons"))
    by_reason = is_true(F.array_contains(reasons, "always")) | is_true(
        F.exists(reasons, lambda r: r == F.col("build_failure_reason"))
    )
    attempt = F.col("attempt_number")
    return df.select(
        "*",
        (attempt > 1).alias("is_retry"),
        (attempt > most + 1).alias("is_manual_retry"),
        (~(by_reason & (attempt <= most))).alias("final_attempt"),
    )


def exit_codes(builds: DataFrame, metadata: DataFrame) -> DataFrame:
    codes = metadata.select(F.col("build_id").alias("id"), F.col("exit_code").alias("job_exit_code"))
    return builds.join(codes, "id", "left")


def failure_reason_name(df: DataFrame, code: str = "failure_code") -> DataFrame:
    """Adds build_failure_reason; an unmapped code gives NULL (see failure_reason_rejects)."""
    c = F.col(code)
    return df.withColumn(
        "build_failure_reason",
        F.when(c.isNull(), "unknown_failure").otherwise(lookup(fixed.FAILURE_REASONS, c)),
    )


def failure_reason_rejects(df: DataFrame, key: str, code: str = "failure_code") -> DataFrame:
    unmapped = failure_reason_name(df, code).where("build_failure_reason IS NULL")
    return unmapped.select(
        F.col(key).alias("key"),
        F.lit("failure_reason_name").alias("operator"),
        F.concat(F.lit("unmapped code "), F.col(code).cast("string")).alias("reason"),
    )


def runner_type_name(df: DataFrame, code: str = "runner_type") -> DataFrame:
    return df.withColumn("runner_type_name", lookup(fixed.RUNNER_TYPES, F.col(code)))


def latest_pipeline_per_sha(df: DataFrame, position: str) -> DataFrame:
    """Most recently updated row per sha; among equals the one listed first.

    An aggregate, so copies of one sha combine before they are shuffled.
    """
    row = F.struct(*[c for c in df.columns if c != "sha"])
    best = F.max_by(row, F.struct(F.col("updated_at"), -F.col(position)))
    return df.groupBy("sha").agg(best.alias("row")).select("sha", "row.*").select(*df.columns)


def pipeline_status(df: DataFrame) -> DataFrame:
    """Commit state, description and url of each pipeline; canceled ones post nothing."""
    states = {s: v[0] for s, v in fixed.PIPELINE_STATES.items()}
    texts = {s: v[1] for s, v in fixed.PIPELINE_STATES.items()}
    posted = df.where(F.col("status").isNotNull() & (F.col("status") != "canceled"))
    return posted.select(
        *df.columns,
        lookup(states, F.col("status")).alias("state"),
        lookup(texts, F.col("status")).alias("description"),
        F.col("web_url").alias("target_url"),
    )


def pr_sha_from_merge(df: DataFrame, title: str = "title", tested: str = "sha") -> DataFrame:
    found = F.regexp_extract(title, fixed.MERGE_TITLE, 1)
    return df.withColumn("pr_sha", F.coalesce(F.nullif(found, F.lit("")), F.col(tested)))


def latest_tested_and_running(df: DataFrame, position: str) -> DataFrame:
    """One row per ref: first completed and first running sha in listing order."""
    sha, pos = F.col("sha"), F.col(position)
    done = F.col("status").isin("success", "failed")
    return df.groupBy("ref").agg(
        F.min_by(sha, F.when(done, pos)).alias("latest_tested_sha"),
        F.min_by(sha, F.when(F.col("status") == "running", pos)).alias("running_sha"),
    )


def latest_success(df: DataFrame, ref: str) -> DataFrame:
    """Sha of the newest successful pipeline of a ref; no row when there is none."""
    wins = df.where((F.col("ref") == ref) & (F.col("status") == "success"))
    return wins.groupBy("ref").agg(F.max_by("sha", "id").alias("sha"))


def recent_protected_refs(df: DataFrame, now: datetime, days: int) -> DataFrame:
    recent = df.where(
        (F.col("updated_at") >= _lit_ts(now - timedelta(days=days)))
        & (F.col("updated_at") <= _lit_ts(now))
    )
    return recent.where(matches_one_of(F.col("ref"), fixed.PROTECTED_REFS)).select("ref").distinct()


def stuck_pipelines(df: DataFrame, now: datetime, num_days: int) -> DataFrame:
    """Running pipelines whose whole days since creation exceed num_days."""
    seconds = F.timestamp_diff("SECOND", F.col("created_at"), _lit_ts(now))
    return df.where(
        (F.col("status") == "running") & (F.floor(seconds / 86400) > F.lit(num_days))
    )


def cancel_plan(stuck: DataFrame, bridges: DataFrame) -> DataFrame:
    """Pipelines to cancel: the children of each stuck pipeline first, then itself."""
    parents = stuck.select(F.col("id").alias("parent_pipeline_id"))
    children = (
        bridges.where("child_id IS NOT NULL")
        .join(parents, "parent_pipeline_id", "left_semi")
        .select("parent_pipeline_id", F.col("child_id").alias("cancel_id"), F.lit(0).alias("step"))
    )
    own = parents.select(
        "parent_pipeline_id", F.col("parent_pipeline_id").alias("cancel_id"), F.lit(1).alias("step")
    )
    return children.unionByName(own)


def skipped_pipelines(
    branches: DataFrame, pushes: DataFrame, pipelines: DataFrame, now: datetime
) -> DataFrame:
    """Pull request branches whose head has no pipeline and that were not pushed this hour."""
    candidates = branches.where(F.col("name").rlike(fixed.PR_BRANCH))
    complete = F.col("ref").isNotNull() & F.col("commit_to").isNotNull()
    recent = pushes.where(
        complete
        & F.col("ref").rlike(fixed.PR_BRANCH)
        & (F.date_trunc("second", "created_at") > _lit_ts(now - timedelta(hours=1)))
    )
    waiting = candidates.join(
        recent.select(F.col("ref").alias("name")).distinct(), "name", "left_anti"
    )
    run = pipelines.select(F.col("sha").alias("commit_id")).distinct()
    return waiting.join(run, "commit_id", "left_anti").select(*branches.columns)


def stale_branches(branches: DataFrame, now: datetime, days: int = 100) -> DataFrame:
    """Unprotected pull request branches without a commit for more than `days`."""
    return branches.where(
        ~is_true(F.col("protected"))
        & F.col("name").rlike(fixed.PR_BRANCH)
        & (F.date_trunc("second", "commit_created_at") < _lit_ts(now - timedelta(days=days)))
    )


def retryable_triggers(bridges: DataFrame, jobs: DataFrame) -> DataFrame:
    """Trigger jobs whose empty child pipeline failed because generation failed at first.

    bridges: id, name, parent_pipeline_id, failure_reason, child_id, child_status
    jobs: pipeline_id, name, status, retried attempts included. A bridge without a child has nothing
    to retry.
    """
    broken = bridges.where(
        "child_id IS NOT NULL AND child_status = 'failed' AND failure_reason = 'unknown_failure'"
    )
    busy = jobs.select(F.col("pipeline_id").alias("child_id")).distinct()
    empty = broken.join(busy, "child_id", "left_anti")
    named = empty.withColumn("generate_name", F.replace("name", F.lit("-build"), F.lit("-generate")))
    healed = (
        jobs.groupBy(
            F.col("pipeline_id").alias("parent_pipeline_id"), F.col("name").alias("generate_name")
        )
        .agg(
            F.bool_or(F.col("status") == "success").alias("ok"),
            F.bool_or(F.col("status") == "failed").alias("bad"),
        )
        .where("ok AND bad")
    )
    keys = ["parent_pipeline_id", "generate_name"]
    return named.join(healed, keys, "left_semi").select(*bridges.columns)


def classify_prs(
    prs: DataFrame,
    checks: DataFrame,
    labels: DataFrame,
    gitlab_heads: DataFrame,
    reach: DataFrame,
    now: datetime,
    prereq_checks: Sequence[str] = (),
    required_label: str | None = None,
    main_branch: str | None = None,
    sync_drafts: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Push decision and backlog reason of each open pull request, and the unmergeable heads.

    prs: number, draft, updated_at, head_ref, head_sha, base_ref, base_sha, merge_base_sha,
         repo_head_sha, merge_conflict, merge_commit_sha
    checks: head_sha, name, conclusion, pos (listing order)
    labels: number, label
    gitlab_heads: pr_string, title (of the branch's last commit)
    reach: commit, the ancestors of the latest tested commit of the main branch

    Rules apply in order: draft, stale, head already pushed (no reason), checks, label, head
    mismatch, base not tested. A pull request that cannot be merged leaves the result; on the main
    branch its head is reported as unmergeable.
    """
    number = F.col("number").cast("string")
    df = prs.withColumn("pr_string", F.concat(F.lit("pr"), number, F.lit("_"), F.col("head_ref")))
    pushed = gitlab_heads.select(
        "pr_string",
        F.regexp_extract("title", fixed.MERGE_TITLE, 1).alias("_a"),
        F.regexp_extract("title", fixed.MERGE_TITLE, 2).alias("_b"),
    )
    # Rows carry on what the rules need of a column, not the column: every join sorts them.
    already = is_true(F.col("_a") == F.col("head_sha")) | is_true(F.col("_b") == F.col("head_sha"))
    differ = F.col("head_sha") != F.col("repo_head_sha")
    short = [F.substring(c, 1, 7) for c in ("repo_head_sha", "head_sha")]
    mismatch = F.concat(
        F.lit("GitHub HEAD shas out of sync (repo="), short[0], F.lit(", API="), short[1], F.lit(")")
    )
    df = df.join(pushed, "pr_string", "left").select(
        "number", "pr_string", "draft", "updated_at", "base_ref", "base_sha", "head_sha",
        "merge_base_sha", "merge_conflict", already.alias("_already"),
        F.when(is_true(differ), mismatch).alias("_mismatch"), is_true(differ).alias("_differ"),
        F.col("merge_commit_sha").isNull().alias("_unmerged"),
    )
    reason = F.lit(None).cast("string")
    if prereq_checks:
        # Only the first run listed of each check counts. Numbers and booleans throughout: their
        # aggregates need no sort.
        rank = lookup({c: i for i, c in enumerate(prereq_checks)}, F.col("name"))
        bad = is_true(F.col("conclusion") != "success") | F.col("conclusion").isNull()
        wanted = (
            checks.where(F.col("name").isin(*prereq_checks))
            .groupBy("head_sha", rank.alias("_rank"))
            .agg(F.min_by(bad, "pos").alias("_bad"), F.min("pos").alias("pos"))
        )
        late = F.coalesce("_bad", F.lit(True))
        seen = wanted.groupBy("head_sha").agg(
            F.min_by("_rank", F.when(late, F.col("pos"))).alias("_failing"),
            *[F.bool_or(F.col("_rank") == i).alias(f"_seen{i}") for i in range(len(prereq_checks))],
        )
        df = df.join(seen, "head_sha", "left")
        # The first wanted check that did not report at all.
        absent = None
        for i, c in enumerate(prereq_checks):
            gone = ~is_true(F.col(f"_seen{i}"))
            absent = F.when(gone, c) if absent is None else absent.when(gone, c)
        failing = lookup(dict(enumerate(prereq_checks)), F.col("_failing"))
        late = F.coalesce(failing, absent)
        reason = F.when(
            late.isNotNull(), F.concat(F.lit("waiting for "), late, F.lit(" check to succeed"))
        )
    # One aggregate and one join for both labels; neither `_urgent` nor `_tagged` is ever false.
    asked = {"_urgent": "pipelines:urgent"}
    if required_label is not None:
        asked["_tagged"] = required_label
    has = {c: F.when(F.col("label") == v, True) for c, v in asked.items()}
    marked = labels.where(F.col("label").isin(*asked.values())).groupBy("number").agg(
        *[F.bool_or(v).alias(c) for c, v in has.items()]
    )
    df = df.join(marked, "number", "left")
    if required_label is not None:
        reason = F.coalesce(reason, F.when(F.col("_tagged").isNull(), F.lit(fixed.LABEL_REASON)))
    on_main = F.lit(False)
    if main_branch is not None:
        on_main = (F.col("base_ref") == main_branch) & F.col("_urgent").isNull()
    known = reach.select(F.col("commit").alias("merge_base_sha")).distinct()
    df = df.join(known.withColumn("_reached", F.lit(True)), "merge_base_sha", "left")
    early = (
        F.when(F.col("draft") & F.lit(not sync_drafts), fixed.DRAFT_REASON)
        .when(F.col("updated_at") < _lit_ts(now - timedelta(hours=48)), fixed.STALE_REASON)
    )
    df = df.select("*", early.alias("_early"), reason.alias("_gate"))
    open_case = F.col("_early").isNull() & ~F.col("_already") & F.col("_gate").isNull()
    no_base = F.col("merge_base_sha").isNull()
    on_main_case = open_case & on_main
    in_sync = ~F.col("_differ")
    main_conflict = on_main_case & (
        no_base | (in_sync & is_true(F.col("_reached")) & is_true(F.col("merge_conflict")))
    )
    side_conflict = open_case & ~on_main & F.col("_unmerged")
    last = F.when(
        on_main_case,
        F.when(F.col("_differ"), F.col("_mismatch")).when(F.col("_reached").isNull(), fixed.BASE_REASON),
    )
    decided = df.select(
        "*",
        main_conflict.alias("_main_conflict"),
        side_conflict.alias("_side_conflict"),
        F.coalesce(
            F.col("_early"), F.when(~F.col("_already"), F.coalesce(F.col("_gate"), last))
        ).alias("backlogged"),
    )
    result = decided.where("NOT _main_conflict AND NOT _side_conflict").select(
        "number",
        "pr_string",
        "base_sha",
        "head_sha",
        (F.col("backlogged").isNull() & ~F.col("_already")).alias("push"),
        "backlogged",
    )
    unmergeable = decided.where("_main_conflict").select("head_sha")
    return result, unmergeable


def ancestor_closure(commits: DataFrame, heads: DataFrame, has_merges: bool = True) -> DataFrame:
    """Commits reachable from the heads through their parents, the heads included.

    commits: commit, parent, and pos (0 for the first parent, 1 and up for merged ones)

    First parents form chains. Following them by jumps of 1, 2, 4, ... covers a chain of n commits
    in log2(n) rounds; merged parents then seed another pass, until nothing is added. Each round's
    result is checkpointed, which cuts the plan and survives lost executors.
    """
    ensure_checkpoint_dir(commits.sparkSession)
    edges = commits.where("parent IS NOT NULL")
    first = edges.where("pos = 0").select("commit", F.col("parent").alias("to"))
    merged = edges.where("pos > 0").select("commit", F.col("parent").alias("to"))
    reached = heads.select("commit").distinct()
    jumps = [first.checkpoint()]
    rounds = max(1, math.ceil(math.log2(max(2, jumps[0].count() + 1))))

    def step(marked: DataFrame, jump: DataFrame) -> DataFrame:
        ahead = jump.join(marked, "commit", "left_semi").select(F.col("to").alias("commit"))
        return marked.unionByName(ahead).distinct()

    while True:
        for i in range(rounds):
            if i == len(jumps):
                last = jumps[-1]
                onward = last.select(F.col("commit").alias("to"), F.col("to").alias("far"))
                longer = last.join(onward, "to").select("commit", F.col("far").alias("to"))
                longer = longer.checkpoint()
                if longer.isEmpty():
                    rounds = i
                    break
                jumps.append(longer)
            reached = step(reached, jumps[i]).checkpoint()
        if not has_merges:
            return reached
        grown = step(reached, merged).checkpoint()
        if grown.count() == reached.count():
            return reached
        reached = grown


def ensure_checkpoint_dir(spark) -> None:
    """Use the cluster's shared checkpoint folder; make one only where none is configured."""
    from ..sources.scratch import scratch_root

    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


def is_ancestor(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """Adds is_ancestor: is the row's `commit` among the reached commits?"""
    known = reach.select("commit").distinct().withColumn("_hit", F.lit(True))
    return (
        pairs.join(known, "commit", "left")
        .withColumn("is_ancestor", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def backlog_status(
    prs: DataFrame, unmergeable: DataFrame, main_branch: str, *, base_doc_url: str
) -> DataFrame:
    """Statuses to post for deferred pull requests and for heads that cannot be merged.

    base_doc_url: the page that explains why a pull request waits for its base to be tested.
    """
    reason = F.col("backlogged")
    silent = (fixed.STALE_REASON, fixed.LABEL_REASON)
    waiting = prs.where(reason.isNotNull() & ~reason.isin(*silent)).select(
        F.col("head_sha").alias("sha"),
        F.col("pr_string").alias("branch"),
        F.lit("pending").alias("state"),
        F.when(reason == fixed.BASE_REASON, base_doc_url).otherwise("").alias("target_url"),
        F.when(
            reason == fixed.BASE_REASON,
            f"This branch's merge-base with {main_branch} is newer than the latest commit "
            "tested by GitLab",
        )
        .when(reason == fixed.DRAFT_REASON, "GitLab CI is disabled for draft PRs")
        .otherwise(reason)
        .alias("description"),
    )
    failed = unmergeable.select(
        F.col("head_sha").alias("sha"),
        F.lit("").alias("branch"),
        F.lit("error").alias("state"),
        F.lit("").alias("target_url"),
        F.lit(f"PR could not be merged with {main_branch}").alias("description"),
    )
    return waiting.unionByName(failed)


def new_statuses(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates that no existing status of the same commit equals, NULLs compared as values."""
    keys = ["sha", "context", "state", "description", "target_url"]
    old = existing.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return candidates.join(old, same, "left_anti")
