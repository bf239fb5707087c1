"""From raw documents to packed training sequences: quality rules, near-duplicates, benchmark passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import decontaminate, near_dedup, packing, quality_rules, secrets
from paperloom.llm.common import benchmark, documents, labels, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, also those with a null or empty text; repeated rows are judged alike, and an
    empty table gives an empty one. Extra columns stay, whatever their names."""
    return quality_rules.passed(docs, labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, a similarity of 0.8 or more) stays: the smallest doc_id's, with all
    rows that share it. Texts without words, null ones too, and null doc_ids are copies of nothing and stay."""
    return near_dedup.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none and stay, repeated rows share their fate."""
    return decontaminate.clean(docs, benchmark(spark, sf_dir))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; no row goes, and texts without secrets, null ones too, stay as they are."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their ids and their places in sequences; a null or empty text is its end id, repeated
    rows are documents of their own, other columns go."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("secrets", secret_spans),
    ("packing", packed),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage writes for itself is deleted when its result is written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
