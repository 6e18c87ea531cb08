"""Readers. Each returns a DataFrame with a declared schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed
from . import documents


#: Rows that a task which parses files holds before it hands them on.
PARSED_ROWS = 5_000
FILE_STEM = r"([^/]+)\.[^./]+$"


def from_path(pattern: str) -> Column:
    """First group of the pattern in the path of the row's file."""
    return F.regexp_extract(F.input_file_name(), pattern, 1)


def read_job_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BUILD_EVENTS).json(path)


def read_ci_table(
    spark: SparkSession, name: str, options: Mapping[str, str] | str, partitions: int = 64
) -> DataFrame:
    """One table of the CI database.

    Give a folder of parquet extracts, or JDBC options. A JDBC read is split by the table's id into
    parallel ranges, between the bounds given or else the least and greatest id.
    """
    ddl = schemas.CI_TABLES[name]
    if isinstance(options, str):
        return spark.read.schema(ddl).parquet(f"{options}/{name}")
    table, column = schemas.CI_TABLE_SOURCES[name]
    source = spark.read.format("jdbc").options(**options)
    if "lowerBound" not in options or "upperBound" not in options:
        ends = f"(SELECT min({column}) AS lo, max({column}) AS hi FROM {table}) ends"
        lo, hi = source.option("dbtable", ends).load().first()
        source = source.option("lowerBound", lo or 0).option("upperBound", (hi or 0) + 1)
    reader = source.option("dbtable", table).option("partitionColumn", column)
    rows = reader.option("numPartitions", partitions).load()
    wanted = spark.createDataFrame([], ddl).schema
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in wanted])


def read_ci_tables(
    spark: SparkSession, options: Mapping[str, str] | str
) -> dict[str, DataFrame]:
    return {name: read_ci_table(spark, name, options) for name in schemas.CI_TABLES}


def read_job_traces(spark: SparkSession, path: str, job_id: str = FILE_STEM) -> DataFrame:
    """One row per `<job_id>.log`, the whole text in it; job_id is the pattern of its path.

    path: a folder, which tasks list and read where it is mounted on every machine, so that the driver
    holds no names; or a pattern or a folder of another store, whose files Spark lists in the driver.
    """
    folder = documents.plain_folder(spark, path)
    if folder is None:
        text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        name, trace = from_path(job_id), F.col("value")
    else:
        text = documents.read_files(spark, folder)
        name, trace = F.regexp_extract("path", job_id, 1), F.col("text").cast("string")
    return text.select(name.try_cast("bigint").alias("job_id"), trace.alias("trace"))


def normalize_missing_logs(df: DataFrame) -> DataFrame:
    """Text that stands in for logs that could not be fetched or were empty.

    Input columns: api_link, status_code, text.
    """
    failed = F.concat(
        F.lit("ERROR: Got "), F.col("status_code").cast("string"), F.lit(" for "),
        F.col("api_link"),
    )
    return df.withColumn(
        "text",
        F.when(F.col("status_code") != 200, failed)
        .when(F.coalesce("text", F.lit("")) == "", "ERROR: Log File Empty")
        .otherwise(F.col("text")),
    )


def read_error_csv(spark: SparkSession, path: str) -> DataFrame:
    """Error export with its required columns; fails if one is absent."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    missing = sorted(set(fixed.ERROR_CSV_COLUMNS) - set(raw.columns))
    if missing:
        raise ValueError(f"CSV does not contain the following columns: {missing}")
    return raw.withColumn("id", F.expr("try_cast(id AS BIGINT)")).withColumn(
        "created_at", F.expr("try_cast(created_at AS TIMESTAMP_NTZ)")
    )


def parse_series(df: DataFrame, body: str = "value") -> DataFrame:
    """Metric API answers as samples; values arrive as text."""
    parsed = df.select(F.from_json(body, schemas.SERIES_RESULT).alias("j"))
    series = parsed.select(F.explode("j.data.result").alias("s"))
    points = series.select("s.metric", F.explode("s.values").alias("v"))
    name = F.try_element_at("metric", F.lit("__name__"))
    return points.select(
        F.coalesce(name, F.lit("")).alias("metric"),
        F.map_filter("metric", lambda k, _: k != "__name__").alias("labels"),
        F.get("v", F.lit(0)).try_cast("double").alias("ts"),
        F.get("v", F.lit(1)).try_cast("double").alias("value"),
    )


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Samples from files that hold one answer per line."""
    return parse_series(spark.read.text(path))


def read_pipeline_vars(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of each generated pipeline file with their own and the pipeline's variables.

    YAML is parsed where the file is read, one file and one entry of it at a time: once for the
    pipeline's variables, which may come last, and once for the jobs. A file that isn't a plain
    mapping, or can't be parsed, is loaded as a whole.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches):
        import pandas as pd
        import yaml

        names = ["path", "job_name", "variables", "pipeline_variables", "problem"]
        base = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

        class Entries(yaml.composer.Composer, base):
            def __init__(self, content):
                base.__init__(self, content)
                self.anchors = {}

        def texts(values):
            return {str(k): None if v is None else str(v) for k, v in (values or {}).items()}

        def entries(content):
            """Keys and values of the document; ValueError where it has to be loaded as a whole."""
            loader = Entries(content)
            try:
                loader.get_event()
                loader.get_event()
                if not loader.check_event(yaml.MappingStartEvent):
                    raise ValueError("no mapping")
                if loader.get_event().anchor is not None:
                    raise ValueError("anchor")
                while not loader.check_event(yaml.MappingEndEvent):
                    key = loader.compose_node(None, None)
                    if not isinstance(key, yaml.ScalarNode) or key.tag.endswith(":merge"):
                        raise ValueError("no plain key")
                    value = loader.compose_node(None, None)
                    yield loader.construct_document(key), loader.construct_document(value)
                loader.get_event()
                loader.get_event()
                if not loader.check_event(yaml.StreamEndEvent):
                    raise ValueError("more documents")
            finally:
                loader.dispose()

        def jobs_of(content):
            shared, seen = None, set()
            try:
                for k, v in entries(content):
                    if k in seen:
                        raise ValueError("repeated key")
                    seen.add(k)
                    if k == "variables":
                        shared = texts(v)
                    elif isinstance(v, dict):
                        texts(v.get("variables"))
            except (yaml.YAMLError, AttributeError, ValueError, TypeError):
                doc = yaml.load(content, Loader=base) or {}
                shared = texts(doc.get("variables"))
                own = list(doc.items())
                for k, v in own:
                    if isinstance(v, dict) and k != "variables":
                        texts(v.get("variables"))
            else:
                del seen
                own = entries(content)
            shared = shared or {}
            for k, v in own:
                if isinstance(v, dict) and k != "variables":
                    yield k, texts(v.get("variables")), shared

        for batch in batches:
            rows = []
            for path_, content in zip(batch["path"], batch["content"]):
                done = len(rows)
                try:
                    for k, v, shared in jobs_of(content):
                        rows.append((path_, k, v, shared, None))
                        if len(rows) == PARSED_ROWS:
                            yield pd.DataFrame(rows, columns=names)
                            rows, done = [], 0
                except (yaml.YAMLError, AttributeError) as error:
                    rows[done:] = [(path_, None, None, None, str(error))]
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(parse, schemas.PIPELINE_VARS)


def pipeline_var_rejects(df: DataFrame) -> DataFrame:
    """(path, operator, reason) of files that can't be parsed and of jobs that lack a variable."""
    broken = df.where("job_name IS NULL").select(
        "path", F.lit("read_pipeline_vars").alias("operator"), F.col("problem").alias("reason")
    )
    lacking = job_variables(df).where("missing_variable IS NOT NULL").select(
        "path",
        F.lit("job_variables").alias("operator"),
        F.concat(F.col("job_name"), F.lit(" has no "), F.col("missing_variable")).alias("reason"),
    )
    return broken.unionByName(lacking)


def job_variables(df: DataFrame) -> DataFrame:
    """Required and optional variables as columns; missing_variable names the first absent one."""
    own = {
        c: F.try_element_at("variables", F.lit(k))
        for c, k in fixed.REQUIRED_JOB_VARIABLES.items()
    }
    stack = F.try_element_at("pipeline_variables", F.lit(fixed.STACK_VARIABLE))
    missing = None
    for c, v in [*own.items(), ("stack", stack)]:
        name = fixed.REQUIRED_JOB_VARIABLES.get(c, fixed.STACK_VARIABLE)
        missing = F.when(v.isNull(), name) if missing is None else missing.when(v.isNull(), name)
    build_jobs = F.try_element_at("variables", F.lit(fixed.BUILD_JOBS_VARIABLE))
    kept = [c for c in df.columns if c not in ("variables", "pipeline_variables", "problem")]
    return df.where("job_name IS NOT NULL").select(
        *kept,
        *[v.alias(c) for c, v in own.items()],
        stack.alias("stack"),
        build_jobs.try_cast("int").alias("build_jobs"),
        missing.alias("missing_variable"),
    )


def read_install_times(spark: SparkSession, path: str, job_id: str = FILE_STEM) -> DataFrame:
    """Timings of each `<job_id>.json` array; entries without a hash name no spec.

    path: a folder, whose folders are listed by tasks, or a pattern, which the driver expands.
    """
    rows = spark.read.schema(schemas.INSTALL_TIMES).option("multiLine", True).json(
        path, recursiveFileLookup=True
    )
    named = rows.select(from_path(job_id).try_cast("bigint").alias("job_id"), "*")
    return named.where("hash IS NOT NULL")


def read_spec_nodes(
    spark: SparkSession, path: str, job_id: str = FILE_STEM, repro: str | None = None
) -> DataFrame:
    """One row per node of each `<job_id>.json` spec document.

    repro: the jobs' reproduction files; only the documents that they name, below their own folder,
    are then read as specs. job_id is found in the document's path.
    """
    docs = spark.read.schema(schemas.SPEC_DOCUMENT).option("multiLine", True).json(path)
    if repro is not None:
        named = spark.read.schema("job_spec_json STRING").option("multiLine", True).json(repro)
        folder = F.regexp_extract(F.input_file_name(), "^(.*/)[^/]*$", 1)
        named = named.select(F.concat(folder, F.col("job_spec_json")).alias("_file")).distinct()
        docs = docs.withColumn("_file", F.input_file_name()).join(named, "_file", "left_semi")
        return _spec_nodes(docs, F.regexp_extract("_file", job_id, 1))
    return _spec_nodes(docs, from_path(job_id))


def _spec_nodes(docs: DataFrame, job_id: Column) -> DataFrame:
    nodes = docs.select(
        job_id.try_cast("bigint").alias("job_id"), F.explode("spec.nodes").alias("n")
    ).where("n IS NOT NULL")
    empty = F.lit("")
    return nodes.select(
        "job_id",
        F.col("n.name").alias("name"),
        F.col("n.hash").alias("hash"),
        F.col("n.version").alias("version"),
        F.coalesce("n.compiler.name", empty).alias("compiler_name"),
        F.coalesce("n.compiler.version", empty).alias("compiler_version"),
        F.coalesce("n.arch", empty).alias("arch"),
        F.coalesce("n.variants", empty).alias("variants"),
    )


def parse_listing(lines: DataFrame, line: str = "value") -> DataFrame:
    """Object listing lines as (modified, size, key); other lines are left out."""
    hit = F.col(line).rlike(fixed.LISTING_LINE)
    return lines.where(hit).select(
        F.regexp_extract(line, fixed.LISTING_LINE, 1).try_cast("timestamp_ntz").alias("modified"),
        F.regexp_extract(line, fixed.LISTING_LINE, 2).try_cast("bigint").alias("size"),
        F.regexp_extract(line, fixed.LISTING_LINE, 3).alias("key"),
    )


def read_bucket_listing(spark: SparkSession, path: str) -> DataFrame:
    return parse_listing(spark.read.text(path))


def read_cache_index(spark: SparkSession, path: str) -> DataFrame:
    """Specs of each index document."""
    docs = spark.read.text(path, wholetext=True).select(
        F.from_json("value", schemas.CACHE_INDEX).alias("j")
    )
    rows = docs.select(F.explode("j.database.installs").alias("hash", "i")).where("i IS NOT NULL")
    return rows.select(
        "hash",
        F.col("i.spec.name").alias("name"),
        F.col("i.spec.external").isNotNull().alias("external"),
        F.coalesce("i.in_buildcache", F.lit(False)).alias("in_buildcache"),
    )


def read_lockfiles(
    spark: SparkSession,
    path: str,
    pipeline_id: str = r"([0-9]+)/[^/]+\.lock$",
    job_name: str = r"([^/]+)\.lock$",
) -> DataFrame:
    """(pipeline_id, stack, hash) of each `<pipeline_id>/<job name>.lock` file."""
    docs = spark.read.text(path, wholetext=True).select(
        from_path(pipeline_id).try_cast("bigint").alias("pipeline_id"),
        F.replace(from_path(job_name), F.lit("-generate"), F.lit("")).alias("stack"),
        F.from_json("value", "concrete_specs MAP<STRING, STRING>").alias("j"),
    )
    hashes = F.explode(F.map_keys("j.concrete_specs")).alias("hash")
    return docs.select("pipeline_id", "stack", hashes).where("hash <> ''")


def read_clearsigned_json(df: DataFrame, col: str) -> DataFrame:
    """Replaces a clearsigned text by its JSON body, `{}` where there is none. Not verified."""
    body = F.trim(F.regexp_extract(col, fixed.CLEARSIGNED_BODY, 1))
    return df.withColumn(col, F.when(F.coalesce(body, F.lit("")) == "", "{}").otherwise(body))
