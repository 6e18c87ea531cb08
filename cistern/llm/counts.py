"""Token counts: an exact histogram of encoded lengths, and its suffix sums.

Documents are aggregated by encoded length before anything is shuffled. From the documents and tokens at and above each
length come totals, quantiles and, for every context limit, what is left and lost when documents are cut there.

A document's length is its tokens in the vocabulary (a file, broadcast; its size is that of the vocabulary). Null and
empty texts have length 0. A null group is a group of its own. Very long texts are encoded whole. Equal lengths and
repeated rows add up; an empty table gives an empty histogram. Columns but the text and the groups aren't read; they
may not be named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cistern.llm.frames import with_fields
from cistern.llm.tokenids import coder, vocabulary
from cistern.sources.scratch import stage

#: Lengths in a block of the suffix sums: blocks are summed first, so that no task orders all lengths.
BLOCK = 1024


def lengths(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs, but for the text, with n_tokens."""
    content = vocabulary(docs.sparkSession, path)
    rest = [c for c in docs.columns if c != text]
    docs = docs.select(*rest, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(content.value)
        for batch in batches:
            n = pa.array([len(encode(t.as_py() or "")) for t in batch.column(len(rest))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*rest, "n_tokens"])

    return docs.mapInArrow(run, with_fields(docs.drop(text), n_tokens=LongType()))


def histogram(docs: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, n_tokens, n_docs)."""
    return docs.groupBy(*groups, "n_tokens").agg(F.count("*").alias("n_docs"))


def with_suffixes(lengths: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """The histogram with, for each length L: docs_from and tokens_from (of L and more), docs and tokens of the whole
    group, tokens_cut (all tokens when documents are cut at L), tokens_lost, and quantile (share of documents of at most L)."""
    df = lengths.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    sums = [F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t")]
    blocks = df.groupBy(*groups, "block").agg(*sums)
    behind = Window.partitionBy(*groups).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*groups)
    after = [F.coalesce(F.sum(c).over(behind), F.lit(0)).alias(f"{c}_after") for c in "dt"]
    whole = [F.sum("d").over(everything).alias("docs"), F.sum("t").over(everything).alias("tokens")]
    blocks = blocks.select(*groups, "block", *after, *whole)
    joined = _null_safe(df, blocks, (*groups, "block"))
    within = Window.partitionBy(*groups, "block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)

    def suffix(x: Column, c: str) -> Column:
        return F.sum(x).over(within) + F.col(f"{c}_after")

    out = joined.withColumn("docs_from", suffix(F.col("n_docs"), "d")).withColumn("tokens_from", suffix(F.col("n_docs") * F.col("n_tokens"), "t"))
    lost = F.col("tokens_from") - F.col("docs_from") * F.col("n_tokens")
    below = F.col("docs") - F.col("docs_from") + F.col("n_docs")
    return out.select(
        *groups, "n_tokens", "n_docs", "docs_from", "tokens_from", "docs", "tokens",
        (F.col("tokens") - lost).alias("tokens_cut"), lost.alias("tokens_lost"), (below / F.col("docs")).alias("quantile"),
    )


def _null_safe(a: DataFrame, b: DataFrame, on: tuple[str, ...], how: str = "inner") -> DataFrame:
    b = b.select(*(F.col(c).alias(f"_{c}") if c in on else c for c in b.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    cond = same[0]
    for s in same[1:]:
        cond &= s
    return a.join(b, cond, how).drop(*(f"_{c}" for c in on))


def limits(suffixes: DataFrame, at: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """For any context limits (column max_tokens) and each group: documents cut, tokens left and lost.

    The first length above a limit has all that is needed: tokens lost are those above it, less the limit for each
    document. A limit that no document of a group exceeds cuts nothing there. Null limits give no rows.
    """
    pairs = suffixes.join(at, F.col("n_tokens") > F.col("max_tokens"))
    first = pairs.groupBy(*groups, "max_tokens").agg(F.min_by(F.struct("docs_from", "tokens_from"), "n_tokens").alias("s"))
    totals = suffixes.groupBy(*groups).agg(F.max("tokens").alias("tokens")).where("tokens is not null")
    every = totals.crossJoin(at.select("max_tokens").where("max_tokens is not null").distinct())
    out = _null_safe(every, first, (*groups, "max_tokens"), "left")
    cut = F.coalesce("s.docs_from", F.lit(0))
    lost = F.coalesce(F.col("s.tokens_from") - F.col("s.docs_from") * F.col("max_tokens"), F.lit(0))
    return out.select(*groups, "max_tokens", cut.alias("docs_cut"), (F.col("tokens") - lost).alias("tokens_left"), lost.alias("tokens_lost"))


def token_counts(docs: DataFrame, path: str, text: str = "text", groups: tuple[str, ...] = ()) -> DataFrame:
    return with_suffixes(stage(histogram(lengths(docs.select(*groups, text), path, text), groups), "lengths"), groups)
