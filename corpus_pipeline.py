"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, BPE encoding.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and works on all that its
predecessor kept. All but the last return the columns of ``documents``. Stages with work in Python set
the session's Arrow batches to a few MB, since several of them are held per task at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decklens.llm import bpe, line_dedup, mixing, near_dup, quality
from decklens.llm.common import bound_batches, staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees."""
    bound_batches(spark)
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines; those of which nothing is left go."""
    bound_batches(spark)
    cut = line_dedup.dedup_lines(docs).filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return cut.select(*[n_chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    bound_batches(spark)
    return near_dup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every row."""
    bound_batches(spark)
    return bpe.encode(docs.select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens", "ids")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_stage),
    ("mixing", mixing_stage),
    ("bpe_encoding", encoding_stage),
]

#: SQL cannot express the trees, the signatures or the merges of the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
