"""Names, codes, patterns and formats that decide results."""

import json
import re
from pathlib import Path

#: Names that the site's data carry: change the file for another site.
SITE = json.loads((Path(__file__).resolve().parents[1] / "settings.json").read_text(encoding="utf-8"))

# Job names that are their own job type.
NAMED_JOB_TYPES = (
    "no-specs-to-rebuild",
    "rebuild-index",
    "copy",
    "unsupported-copy",
    "sign-pkgs",
    "protected-publish",
    "dotenv",
)

# Patterns read from job names, stages and traces.
BUILD_STAGE = r"^stage-\d+$"
RUNNER_VERSION = r"Running with gitlab-runner (\d+\.\d+\.\d+)"
UNNECESSARY_JOB = r"No need to rebuild [^,]+, found hash match"
SECTION_MARKER = r"section_(start|end):(\d+):([A-Za-z0-9_\-\.]+)"
ANSI_ESCAPE = r"\x1b\[([0-9,A-Z]{1,2}(;[0-9]{1,2})?(;[0-9]{3})?)?[m|G|K]?"
VARIANT = r"(~[^+~ ]+|\+[^+~ ]+|\s+(?!patches)[^+~ ]+=[^+~ ]+)"
MERGE_TITLE = r"^Merge\s+([^\s]+)\s+into\s+([^\s]+)"
PR_BRANCH = r"pr([0-9]+)"
PR_PREFIX = r"pr([0-9]+)_.*"
CLEARSIGNED_BODY = (
    r"(?m)^-----BEGIN PGP SIGNED MESSAGE-----"
    r"\s+Hash:\s+[^\s]+\s+((?s:.+))-----BEGIN PGP SIGNATURE-----"
)

# Section timers kept as columns of the job fact.
SECTION_TIMERS = (
    "clear_worktree",
    "after_script",
    "cleanup_file_variables",
    "download_artifacts",
    "get_sources",
    "prepare_executor",
    "prepare_script",
    "resolve_secrets",
    "step_script",
    "upload_artifacts_on_failure",
    "upload_artifacts_on_success",
)

# Taxonomy classes that are the user's own error.
USER_ERRORS = ("spack_error", "build_error", "concretization_error", "module_not_found")

# Failure reasons that stand in when no pattern matched.
SELF_NAMED_REASONS = ("stuck_or_timeout_failure", "scheduler_failure")

# Failure reason codes of the CI database (NULL means unknown_failure).
FAILURE_REASONS = {
    1: "script_failure",
    2: "api_failure",
    3: "stuck_or_timeout_failure",
    4: "runner_system_failure",
    5: "missing_dependency_failure",
    6: "runner_unsupported",
    7: "stale_schedule",
    8: "job_execution_timeout",
    9: "archived_failure",
    10: "unmet_prerequisites",
    11: "scheduler_failure",
    12: "data_integrity_failure",
    13: "forward_deployment_failure",
    14: "user_blocked",
    15: "project_deleted",
    16: "ci_quota_exceeded",
    17: "pipeline_loop_detected",
    18: "no_matching_runner",
    19: "trace_size_exceeded",
    20: "builds_disabled",
    21: "environment_creation_failure",
    22: "deployment_rejected",
    23: "failed_outdated_deployment_job",
    1000: "protected_environment_failure",
    1001: "insufficient_bridge_permissions",
    1002: "downstream_bridge_project_not_found",
    1003: "invalid_bridge_trigger",
    1004: "upstream_bridge_project_not_found",
    1005: "insufficient_upstream_permissions",
    1006: "bridge_pipeline_is_child_pipeline",
    1007: "downstream_pipeline_creation_failed",
    1008: "secrets_provider_not_found",
    1009: "reached_max_descendant_pipelines_depth",
    1010: "ip_restriction_failure",
    1011: "reached_max_pipeline_hierarchy_size",
    1012: "reached_downstream_pipeline_trigger_rate_limit",
    1013: "duo_workflow_not_allowed",
}

# Runner type codes of the CI database.
RUNNER_TYPES = {1: "instance_type", 2: "group_type", 3: "project_type"}

# Pipeline status -> (commit state, description). Canceled pipelines post nothing.
PIPELINE_STATES = {
    "created": ("pending", "Pipeline has been created"),
    "waiting_for_resource": ("pending", "Pipeline is waiting for resources"),
    "preparing": ("pending", "Pipeline is preparing"),
    "pending": ("pending", "Pipeline is pending"),
    "running": ("pending", "Pipeline is running"),
    "manual": ("pending", "Pipeline is running manually"),
    "scheduled": ("pending", "Pipeline is scheduled"),
    "failed": ("error", "Pipeline failed"),
    "skipped": ("failure", "Pipeline was skipped"),
    "success": ("success", "Pipeline succeeded"),
}

# Refs whose mirrors are published.
PROTECTED_REFS = (
    r"^develop$",
    r"^v[\d]+\.[\d]+\.[\d]+$",
    r"^releases/v[\d]+\.[\d]+$",
    r"^develop-[\d]{4}-[\d]{2}-[\d]{2}$",
)

# Refs and sub-mirrors shown by the cache listing.
LISTED_REFS = (r"^develop-[\d]+-[\d]+-[\d]+$", r"^develop$", r"^v[\d]+\.[\d]+\.[\d]+$")
UNLISTED_STACKS = (r"^deprecated$", r"^e4s-mac$")
INDEX_MANIFEST = r"/v[\d]+/manifests/index/index.manifest.json$"
LAYOUT_ROOT = r"^v[\d]+$"

# Media types in build cache manifests.
TARBALL_MEDIA_TYPE = SITE["tarball_media_type"]
SPEC_MEDIA_TYPE = SITE["spec_media_type"]
INDEX_MEDIA_PREFIX = SITE["index_media_prefix"]
INDEX_MEDIA_TYPE = SITE["index_media_type"]
KEY_MEDIA_TYPE = "application/pgp-keys"

# Object listing line, and the kinds of object key that describe a build.
LISTING_LINE = r"^(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2})\s+(\d+)\s+(.+)$"
V2_SUFFIXES = (SITE["spec_suffix"], SITE["archive_suffix"])
V2_KEY = rf"^(.+)(/build_cache/.+-)([^\.]+)({'|'.join(map(re.escape, V2_SUFFIXES))})$"
V3_SUFFIXES = (".spec.manifest.json",)
V3_KEY = r"^(.+)(/v3/manifests/spec/.+-)([^-\.]+)(\.spec\.manifest\.json)$"

# Variables that a build job's definition must carry, by output column.
REQUIRED_JOB_VARIABLES = SITE["required_job_variables"]
STACK_VARIABLE = SITE["stack_variable"]
BUILD_JOBS_VARIABLE = SITE["build_jobs_variable"]

# Pod annotations and labels, by output column.
POD_ANNOTATIONS = SITE["pod_annotations"]
POD_OPTIONAL_ANNOTATIONS = SITE["pod_optional_annotations"]
POD_LABELS = SITE["pod_labels"]
POD_BUILD_JOBS = SITE["pod_build_jobs"]
PIPELINE_NODE_LABEL = SITE["pipeline_node_label"]
POD_JOB_ID = "annotation_gitlab_ci_job_id"
NODE_LABELS = {
    "cpu": "label_karpenter_k8s_aws_instance_cpu",
    "memory": "label_karpenter_k8s_aws_instance_memory",
    "capacity_type": "label_karpenter_sh_capacity_type",
    "instance_type": "label_node_kubernetes_io_instance_type",
    "zone": "label_topology_kubernetes_io_zone",
}
NODE_READY_LABELS = {
    "label_karpenter_sh_initialized": "true",
    "label_topology_ebs_csi_aws_com_zone": ".+",
}
PRICE_METRIC = "karpenter_cloudprovider_instance_type_offering_price_estimate"

# Columns an error export must have.
ERROR_CSV_COLUMNS = (
    "id",
    "name",
    "created_at",
    "duration",
    "runner",
    "stage",
    "ref",
    "project_name",
    "job_link",
    "api_link",
)

# Days of facts kept in a snapshot.
SNAPSHOT_DAYS = {"fact_job": 1000, "fact_timer": 30, "fact_timer_phase": 7}
SNAPSHOT_NULL = "<null>"

# Backlog texts of pull requests.
STALE_REASON = "stale"
DRAFT_REASON = "draft"
LABEL_REASON = "missing_label"
BASE_REASON = "base"

# Log line formats; groups are listed in order.
LOG_FORMATS = {
    "apache": (
        r'^([^ ]*) [^ ]* ([^ ]*) \[([^\]]*)\] "(\S+)(?: +([^\"]*?)(?: +\S*)?)?" ([^ ]*) ([^ ]*)'
        r'(?: "([^\"]*)" "([^\"]*)")?$',
        ("host", "user", "time", "method", "path", "code", "size", "referer", "agent"),
    ),
    "apache2": (
        r'^([^ ]*) [^ ]* ([^ ]*) \[([^\]]*)\] "(\S+)(?: +([^ ]*) +\S*)?" ([^ ]*) ([^ ]*)'
        r'(?: "([^\"]*)" "([^\"]*)")?$',
        ("host", "user", "time", "method", "path", "code", "size", "referer", "agent"),
    ),
    "apache_error": (
        r"^\[[^ ]* ([^\]]*)\] \[([^\]]*)\](?: \[pid ([^\]]*)\])?(?: \[client ([^\]]*)\])? (.*)$",
        ("time", "level", "pid", "client", "message"),
    ),
    "nginx": (
        r'^([^ ]*) ([^ ]*) ([^ ]*) \[([^\]]*)\] "(\S+)(?: +([^\"]*?)(?: +\S*)?)?" ([^ ]*) ([^ ]*)'
        r'(?: "([^\"]*)" "([^\"]*)")?$',
        ("remote", "host", "user", "time", "method", "path", "code", "size", "referer", "agent"),
    ),
    "syslog": (
        r"^\<([0-9]+)\>([^ ]* {1,2}[^ ]* [^ ]*) ([^ ]*) ([a-zA-Z0-9_\/\.\-]*)(?:\[([0-9]+)\])?"
        r"(?:[^\:]*\:)? *(.*)$",
        ("pri", "time", "host", "ident", "pid", "message"),
    ),
}
