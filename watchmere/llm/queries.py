"""The subpackage's registered queries: (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cluster, decontam, importance, langid, lattice, license, media, mixing, neardup, pii, quality, substring, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(_table(spark, sf_dir, "documents"))


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(_table(spark, sf_dir, "documents"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_table(spark, sf_dir, "documents")).withColumnRenamed("kept", "kept_sha256")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.group(_table(spark, sf_dir, "embeddings"))


def op12_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster(_table(spark, sf_dir, "embeddings"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_toxicity, op3_quality, op4_neardup, op5_license, op6_langid, op7_mixing, op8_media, op9_substring, op10_decontam, op11_lattice, op12_elkan, op13_importance)}

SQL = {"op4_neardup": neardup.SQL, "op7_mixing": mixing.SQL, "op9_substring": substring.SQL, "op11_lattice": lattice.SQL, "op12_elkan": cluster.SQL, "op13_importance": importance.SQL}
