"""Error taxonomy and log work."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, taxonomy_values
from ..functions.columns import ColumnOrName, any_match, as_column, grep_regex, is_true

Taxonomy = Mapping[str, Sequence[str] | None]
OTHER = "other_errors"


def check_taxonomy(classes: Taxonomy, order: Sequence[str]) -> None:
    """The order must name exactly the classes that have patterns."""
    with_patterns = {c for c, patterns in classes.items() if patterns}
    if with_patterns != set(order):
        raise ValueError(f"classes and order differ: {sorted(with_patterns ^ set(order))}")


def match_taxonomy(
    df: DataFrame,
    classes: Taxonomy = taxonomy_values.CLASSES,
    order: Sequence[str] = taxonomy_values.ORDER,
    trace: str = "trace",
    status: str = "build_status",
) -> DataFrame:
    """Adds matched_classes: every class with a pattern found anywhere in a failed trace."""
    check_taxonomy(classes, order)
    found = [
        F.when(any_match(trace, patterns), F.lit(name))
        for name, patterns in classes.items()
        if patterns
    ]
    return df.where(F.col(status) == "failed").withColumn(
        "matched_classes", F.array_compact(F.array(*found))
    )


def first_class(
    trace: ColumnOrName,
    classes: Taxonomy = taxonomy_values.CLASSES,
    order: Sequence[str] = taxonomy_values.ORDER,
) -> Column:
    """First class of the order found in the text, NULL when none is.

    The order is written as a CASE chain, so evaluation stops at the first class that matches
    instead of searching the text for all of them.
    """
    check_taxonomy(classes, order)
    chain = None
    for name in order:
        hit = any_match(trace, classes[name])
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain


def settle_taxonomy(found: Column, failure_reason: ColumnOrName) -> Column:
    """The class found, else the failure reason where it names itself, else `other`."""
    reason = as_column(failure_reason)
    own = F.when(reason.isin(*fixed.SELF_NAMED_REASONS), reason)
    return F.coalesce(found, own, F.lit("other"))


def assign_error_taxonomy(
    df: DataFrame,
    classes: Taxonomy = taxonomy_values.CLASSES,
    order: Sequence[str] = taxonomy_values.ORDER,
    version: str = taxonomy_values.VERSION,
    trace: str = "trace",
    status: str = "build_status",
    reason: str = "build_failure_reason",
) -> DataFrame:
    """Adds error_taxonomy (NULL unless failed) and the version of the taxonomy used."""
    failed = F.col(status) == "failed"
    text = F.coalesce(F.col(trace), F.lit(""))
    return df.select(
        "*",
        F.when(failed, settle_taxonomy(first_class(text, classes, order), reason))
        .alias("error_taxonomy"),
        F.when(failed, F.lit(version)).alias("error_taxonomy_version"),
    )


def classify_errors(
    df: DataFrame,
    classes: Taxonomy = taxonomy_values.EXPORT_CLASSES,
    order: Sequence[str] = taxonomy_values.EXPORT_ORDER,
    trace: str = "trace",
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One boolean column per class, and other_errors where no class holds.

    Patterns are basic regular expressions searched line by line. `extra` adds classes computed by
    the caller.
    """
    extra = dict(extra or {})
    check_taxonomy({**classes, **{c: ["extra"] for c in extra}, OTHER: ["rest"]}, order)
    text = F.coalesce(F.col(trace), F.lit(""))
    flags = {c: any_match(text, [grep_regex(p) for p in ps]) for c, ps in classes.items()}
    flags.update({c: is_true(v) for c, v in extra.items()})
    flagged = df.select("*", *[v.alias(c) for c, v in flags.items()])
    hit = F.lit(False)
    for c in flags:
        hit = hit | F.col(f"`{c}`")
    return flagged.withColumn(OTHER, ~hit)


def true_classes(columns: Sequence[str]) -> Column:
    """Names of the true class columns, in column order."""
    return F.array_compact(
        F.array(*[F.when(F.col(f"`{c}`"), F.lit(c)) for c in columns])
    )


def class_signatures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows counted per set of true classes; everything below works on these few sets."""
    return df.groupBy(true_classes(columns).alias("classes")).agg(F.count(F.lit(1)).alias("rows"))


def class_overlap(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows shared by each pair of classes, their union and the percentage shared."""
    sets = class_signatures(df, columns)
    n = F.lit(len(columns))
    # A set has at most as many members as there are classes, so its pairs are few. A class
    # paired with itself counts the rows of that class.
    pairs = F.flatten(
        F.transform(
            "classes",
            lambda a, i: F.transform(
                F.slice(F.col("classes"), i + 1, n), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
    counts = (
        sets.select(F.explode(pairs).alias("p"), "rows")
        .groupBy("p.a", "p.b")
        .agg(F.sum("rows").alias("n"))
    )
    single = counts.where("a = b")
    left = single.select("a", F.col("n").alias("na"))
    right = single.select("b", F.col("n").alias("nb"))
    both = counts.where("a <> b").withColumnRenamed("n", "overlap")
    total = F.col("na") + F.col("nb") - F.col("overlap")
    return (
        both.join(left, "a")
        .join(right, "b")
        .select(
            F.col("a").alias("class_a"),
            F.col("b").alias("class_b"),
            "overlap",
            total.alias("total"),
            F.round(100.0 * F.col("overlap") / total, 2).alias("percent"),
        )
        .orderBy(F.desc("percent"), "class_a", "class_b")
    )


def deconflict(df: DataFrame, order: Sequence[str] = taxonomy_values.EXPORT_ORDER) -> DataFrame:
    """Keep only the first true class of the order in each row."""
    chain = None
    for c in order:
        hit = F.col(f"`{c}`")
        chain = F.when(hit, c) if chain is None else chain.when(hit, c)
    first = df.withColumn("_first", chain)
    kept = [
        is_true(F.col("_first") == c).alias(c) if c in order else F.col(f"`{c}`")
        for c in df.columns
    ]
    return first.select(*kept)


def is_deconflicted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: does every row have at most one true class?"""
    held = F.lit(0)
    for c in columns:
        held = held + F.col(f"`{c}`").cast("int")
    return df.agg((F.coalesce(F.max(held), F.lit(0)) <= 1).alias("is_deconflicted"))


def class_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and percentage of rows per class, classes without rows included."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count_if(F.col(f"`{c}`")).alias(c) for c in columns],
    )
    long = counts.unpivot("_all", [f"`{c}`" for c in columns], "class", "count")
    return long.select(
        "class", "count", F.round(100.0 * F.try_divide(F.col("count"), F.col("_all")), 2)
        .alias("percent")
    ).orderBy(F.desc("count"), "class")


def runner_kind(df: DataFrame, runner: str = "runner") -> DataFrame:
    return df.withColumn(
        "kind",
        F.when(F.col(runner).isNull(), "None").when(F.col(runner).startswith("uo"), "UO")
        .otherwise("AWS"),
    )


def verify_logs(rows: DataFrame, logs: DataFrame) -> DataFrame:
    """Ids found on one side only."""
    ids = rows.select(F.col("id").cast("bigint").alias("id")).distinct()
    logged = logs.select(F.col("job_id").alias("id")).distinct()
    extra = logged.join(ids, "id", "left_anti").withColumn("problem", F.lit("log without row"))
    missing = ids.join(logged, "id", "left_anti").withColumn("problem", F.lit("row without log"))
    return extra.unionByName(missing)


def sample_log_per_class(
    df: DataFrame, columns: Sequence[str], seed: int, key: str = "job_id"
) -> DataFrame:
    """One random row of each class.

    The draw is a hash of seed and key: a task that runs again after a lost executor draws the
    same row, and each class needs only a minimum that combines before the shuffle.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    long = df.select(key, draw.alias("_draw"), F.explode(true_classes(columns)).alias("class"))
    return long.groupBy("class").agg(F.min_by(key, F.struct("_draw", key)).alias(key))


def strip_ansi(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Removes colour escapes; a trailing `;m` of long ones stays."""
    return df.withColumn(out or col, F.regexp_replace(col, fixed.ANSI_ESCAPE, ""))


def build_log_documents(events: DataFrame, traces: DataFrame, retry: DataFrame) -> DataFrame:
    """Event, retry facts, job address and cleaned trace of each job."""
    clean = strip_ansi(traces, "trace", "job_trace").select(
        F.col("job_id").alias("build_id"), "job_trace"
    )
    joined = events.join(clean, "build_id", "left").join(retry, "build_id", "left")
    url = F.concat(F.col("project.web_url"), F.lit("/-/jobs/"), F.col("build_id").cast("string"))
    return joined.withColumn("job_url", url)


LOG_TIME_FORMATS = {
    "apache": "dd/MMM/yyyy:HH:mm:ss Z",
    "apache2": "dd/MMM/yyyy:HH:mm:ss Z",
    "nginx": "dd/MMM/yyyy:HH:mm:ss Z",
}


def parse_access_log(df: DataFrame, kind: str, line: str = "line") -> DataFrame:
    """Named fields of a log line; lines of another shape give NULL fields.

    Adds a timestamp where the format has a full date: syslog lines carry no year and the error
    log's time has no declared format, so those keep their time as text only.
    """
    pattern, groups = fixed.LOG_FORMATS[kind]
    regex = "(?d)" + pattern
    matched = df.withColumn("_hit", F.col(line).rlike(regex))
    fields = [
        F.when(F.col("_hit"), F.regexp_extract(line, regex, i + 1)).alias(g)
        for i, g in enumerate(groups)
    ]
    out = matched.select(*df.columns, *fields)
    if "code" in groups:
        out = out.withColumn("code", F.expr("try_cast(code AS INT)"))
        out = out.withColumn("size", F.expr("try_cast(size AS BIGINT)"))
    if kind in LOG_TIME_FORMATS:
        out = out.withColumn("ts", F.try_to_timestamp("time", F.lit(LOG_TIME_FORMATS[kind])))
    return out


def parse_json_log(df: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """JSON lines as columns; the time field is kept as text beside the parsed timestamp."""
    parsed = df.withColumn("_j", F.from_json(line, schema))
    out = parsed.select(*df.columns, "_j.*")
    if "time" in out.columns:
        out = out.withColumn(
            "ts", F.try_to_timestamp("time", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS"))
        )
    return out


def drop_info_logs(df: DataFrame, severity: str = "severity") -> DataFrame:
    """Drops rows whose severity is INFO; rows without one stay."""
    return df.where(~is_true(F.col(severity).contains("INFO")))


def distinct_variants(specs: DataFrame, col: str = "variants") -> DataFrame:
    found = F.regexp_extract_all(F.col(col), F.lit(fixed.VARIANT), F.lit(1))
    return specs.select(F.explode(found).alias("v")).select(F.trim("v").alias("variant")).distinct()


def event_tags(df: DataFrame) -> DataFrame:
    """is_uo (NULL without a runner description), is_develop and the status of each event."""
    described = F.coalesce(F.col("runner.description"), F.lit("")) != ""
    return df.select(
        "build_id",
        F.when(described, F.col("runner.description").startswith("uo-")).alias("is_uo"),
        (F.col("ref") == "develop").alias("is_develop"),
        "build_status",
    )
