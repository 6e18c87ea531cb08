"""Declared schemas of every input; nothing is inferred."""

BUILD_EVENTS = """
    object_kind STRING, build_id BIGINT, build_name STRING, build_stage STRING,
    build_status STRING, build_failure_reason STRING, build_created_at STRING,
    build_started_at STRING, build_finished_at STRING, build_duration DOUBLE, ref STRING,
    pipeline_id BIGINT, project_id BIGINT,
    runner STRUCT<id: BIGINT, description: STRING, runner_type: STRING, active: BOOLEAN,
                  is_shared: BOOLEAN, tags: ARRAY<STRING>>,
    project STRUCT<id: BIGINT, web_url: STRING>,
    source_pipeline STRUCT<job_id: BIGINT, pipeline_id: BIGINT>
"""

CI_TABLES = {
    "builds": """id BIGINT, commit_id BIGINT, project_id BIGINT, stage_id BIGINT,
        runner_id BIGINT, user_id BIGINT, name STRING, status STRING, type STRING, ref STRING,
        failure_reason INT, created_at TIMESTAMP_NTZ, started_at TIMESTAMP_NTZ,
        finished_at TIMESTAMP_NTZ, allow_failure BOOLEAN""",
    "stages": "id BIGINT, name STRING",
    "pipelines": "id BIGINT, sha STRING, status STRING",
    "runners": "id BIGINT, description STRING, runner_type INT, active BOOLEAN",
    "runner_taggings": "runner_id BIGINT, tag_id BIGINT",
    "tags": "id BIGINT, name STRING",
    "users": "id BIGINT, name STRING, username STRING",
    "projects": "id BIGINT, name STRING, web_url STRING",
    "pipeline_links": "pipeline_id BIGINT, source_pipeline_id BIGINT, source_job_id BIGINT",
    "builds_metadata": "build_id BIGINT, exit_code INT, config_options STRING",
    "job_definition_instances": "job_id BIGINT, job_definition_id BIGINT",
    "job_definitions": "id BIGINT, config STRING",
}

# Name in the CI database and numeric column to split a read by.
CI_TABLE_SOURCES = {
    "builds": ("p_ci_builds", "id"),
    "stages": ("p_ci_stages", "id"),
    "pipelines": ("p_ci_pipelines", "id"),
    "runners": ("ci_runners", "id"),
    "runner_taggings": ("ci_runner_taggings", "runner_id"),
    "tags": ("tags", "id"),
    "users": ("users", "id"),
    "projects": ("projects", "id"),
    "pipeline_links": ("ci_sources_pipelines", "pipeline_id"),
    "builds_metadata": ("p_ci_builds_metadata", "build_id"),
    "job_definition_instances": ("p_ci_job_definition_instances", "job_id"),
    "job_definitions": ("p_ci_job_definitions", "id"),
}

SERIES_RESULT = """
    data STRUCT<result: ARRAY<STRUCT<metric: MAP<STRING, STRING>,
                                     values: ARRAY<ARRAY<STRING>>>>>
"""

INSTALL_TIMES = """
    name STRING, hash STRING, cache BOOLEAN, total DOUBLE,
    phases ARRAY<STRUCT<path: STRING, seconds: DOUBLE>>
"""

SPEC_DOCUMENT = """
    spec STRUCT<nodes: ARRAY<STRUCT<name: STRING, version: STRING, hash: STRING,
        compiler: STRUCT<name: STRING, version: STRING>, arch: STRING, variants: STRING>>>
"""

CACHE_INDEX = """
    database STRUCT<installs: MAP<STRING, STRUCT<
        spec: STRUCT<name: STRING, external: STRING>, in_buildcache: BOOLEAN>>>
"""

MANIFEST_DATA = """
    ARRAY<STRUCT<contentLength: BIGINT, mediaType: STRING, compression: STRING,
                 checksumAlgorithm: STRING, checksum: STRING>>
"""

PIPELINE_VARS = """
    path STRING, job_name STRING, variables MAP<STRING, STRING>,
    pipeline_variables MAP<STRING, STRING>, problem STRING
"""
