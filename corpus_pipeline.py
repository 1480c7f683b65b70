"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage sees all that the one before kept, and its decisions take effect: the
quality classifier's rejects go, one document of each near-duplicate group stays,
documents with benchmark items go, personal data is replaced in the texts, and
the mix is drawn.  All but the last return the columns of ``documents``.

Nulls, empty texts, ties, repeated rows and ids: each stage does with them what its
operator's docstring says; other columns than those of ``documents`` are left out, and
an empty table stays empty.

A stage first gives back the driver's memory that those before it have freed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from watchmere.llm import decontam, mixing, neardup, pii, quality
from watchmere.llm.work import Work, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is at least 0.3, as learned from the labels of the documents at hand."""
    release(spark)
    return quality.keep(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group."""
    release(spark)
    return neardup.keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    release(spark)
    return decontam.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars stays that of the source text."""
    release(spark)
    return pii.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shuffled mix: copies of documents, with copies, copy and shuffle_key."""
    release(spark)
    return mixing.replicate(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_pii", redact_pii),
    ("mix_sources", mix_sources),
]

#: The classifier can't be written in SQL; the tests compare each stage with what its decisions must be.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again as the next one's docs."""
    work = Work(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
        work.release()
    return STAGES[-1][1](spark, docs, sf_dir)
