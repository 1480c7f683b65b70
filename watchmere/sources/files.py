"""Scans of log files and directories into event DataFrames, with rejects and per-file counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import LEAVES, nested
from . import parsers

SAMPLE_LINES = 40

# The files of a standard log directory and their sources.
STANDARD = {"auth.log": "auth", "access.log": "nginx", "windows_security.json": "winlog", "suricata_eve.json": "suricata", "cowrie.json": "cowrie"}


@dataclass
class Scan:
    events: DataFrame
    rejects: DataFrame
    stats: DataFrame


def lines(spark: SparkSession, path: str, order: int = 0) -> DataFrame:
    """Non-blank lines of a path with their file and ``_seq``, which orders them as they stand in the inputs.

    A line that isn't valid UTF-8 keeps its readable parts.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    seq = F.struct(F.lit(order).alias("input"), F.col("file"), F.col("start"), F.monotonically_increasing_id().alias("line"))
    return raw.select("value", "file", seq.alias("_seq")).filter(F.trim("value") != "")


def sniff(spark: SparkSession, path: str) -> str:
    """Source of a path: the one whose parsers take most of its first lines; auth if none takes any."""
    sample = spark.read.text(path).limit(SAMPLE_LINES)
    taken = sample.agg(*[F.count_if(parsers.gate(F.col("value"), source)).alias(source) for source in parsers.CHAINS]).first().asDict()
    return max(parsers.CHAINS, key=lambda source: taken[source])


def parse_lines(df: DataFrame, source: str, year: int = 2026) -> DataFrame:
    """df with ``parsed``: the event's leaves, null for rejects."""
    return df.select("*", parsers.parse(F.col("value"), source, year).alias("parsed"))


def to_events(df: DataFrame) -> DataFrame:
    """Events of parsed lines."""
    leaves = {p: F.col("parsed").getField(p) for p in LEAVES if p != "log.file.path"}
    leaves["log.file.path"] = F.col("file")
    return df.filter("parsed IS NOT NULL").select(*nested(leaves), "_seq")


def scan(spark: SparkSession, paths: dict[str, str | None], year: int = 2026, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Scan:
    """Events of {path: source or None to sniff}, in no order; ties of time are ordered by ``_seq``.

    stats: file, source, parsed, skipped of every file.  No paths give empty tables.
    ``keep`` may write the parsed lines, so that they are parsed once for all three.
    """
    parts = []
    for order, (path, source) in enumerate(paths.items()):
        source = source or sniff(spark, path)
        parts.append(parse_lines(lines(spark, path, order), source, year).withColumn("source_name", F.lit(source)))
    if not parts:
        empty = spark.createDataFrame([], "value string, file string, _seq struct<input:int,file:string,start:long,line:long>")
        parts = [parse_lines(empty, "auth", year).withColumn("source_name", F.lit("auth"))]
    both = keep(reduce(DataFrame.unionByName, parts))
    stats = both.groupBy(F.col("file"), F.col("source_name").alias("source")).agg(F.count("parsed").alias("parsed"), F.count_if(F.col("parsed").isNull()).alias("skipped"))
    return Scan(to_events(both), both.filter("parsed IS NULL").select("value", "file", F.col("source_name").alias("source"), "_seq"), stats)


def standard_inputs(directory: str, exists) -> dict[str, str]:
    """The standard files of a directory that exist, with their sources."""
    return {f"{directory.rstrip('/')}/{name}": source for name, source in STANDARD.items() if exists(f"{directory.rstrip('/')}/{name}")}
