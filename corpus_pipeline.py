"""The pipeline over documents: toxicity, quality rules, near copies, benchmark leaks, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. The first four return the columns of
documents; the last one adds tokens and what they decode to.

Nulls in any column, empty and very long texts pass through a stage as its operator says: a null or empty text has the score
of no words, fails the quality rules for want of words, is nobody's copy and leaks nothing; a row with a null id is judged
by its own text alone and stays where ids decide. Repeated rows of one id are one document and stay or go together; rows of
one id with different texts are judged each by its text. An empty table gives an empty one. Columns beyond those of
documents are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cistern.llm import bpe, leaks, near, quality, toxicity
from cistern.llm.queries import WORD_BPE, table
from cistern.sources.scratch import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold. The model is fitted on the labelled documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(*COLUMNS), model, result="_score")
    return scored.where(F.col("_score") < toxicity.THRESHOLD).select(*COLUMNS)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the languages' histograms are those of these documents."""
    return quality.quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies.

    Of several texts under one id only those go that are copies of a document of a smaller id.
    """
    gone = near.near_copies(docs).where(~F.col("kept")).select("doc_id", "text_hash").distinct()
    named = docs.withColumn("text_hash", near.text_hash(F.col("text")))
    return named.join(gone, ["doc_id", "text_hash"], "left_anti").select(*COLUMNS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return leaks.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def with_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its tokens, their decoded text, and whether that encodes to as many tokens again."""
    return bpe.round_trip(docs.select(*COLUMNS), WORD_BPE).select(*COLUMNS, "token_ids", "n_tokens", "decoded", "same_count")


STAGES = [
    ("toxicity", without_toxic),
    ("quality_rules", of_quality),
    ("near_copies", without_copies),
    ("leaks", without_leaks),
    ("bpe", with_tokens),
]
#: Trained scores and tokens are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
