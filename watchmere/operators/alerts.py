"""The alert table: its columns, union, dedup and documents.

Columns: rule_id, rule_name, severity, ts, entity, entity_type, description, tags,
evidence, event_count, context, first_honeypot, first_business_hours, base_score,
and stage_ord, rule_ord, emit (time and seq), which order alerts as they arise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fields import CONTEXT
from ..functions.text import fingerprint

# Score and rank of each severity.
SEVERITY = {"critical": (90, 0), "high": (60, 1), "medium": (35, 2), "low": (15, 3), "informational": (5, 4)}
UNKNOWN_SCORE, UNKNOWN_RANK = 10, 9
ATOMIC, STATEFUL, BEHAVIOUR, CHAIN = range(4)

COLUMNS = ["rule_id", "rule_name", "severity", "ts", "entity", "entity_type", "description", "tags", "evidence", "event_count", "context", "first_honeypot", "first_business_hours", "base_score", "stage_ord", "rule_ord", "emit"]


def _case(column: Column, k: int, default: int) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for name, v in SEVERITY.items() for x in (name, v[k])])[column], F.lit(default))


def score(severity: Column) -> Column:
    return _case(severity, 0, UNKNOWN_SCORE)


def rank(severity: Column) -> Column:
    return _case(severity, 1, UNKNOWN_RANK)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


def dedup(alerts: DataFrame) -> DataFrame:
    """The first alert of each rule, entity and hour, in the order they arose; adds fingerprint."""
    df = alerts.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("entity"), F.col("ts")))
    order = Window.partitionBy("fingerprint").orderBy("stage_ord", "rule_ord", "emit", "entity", "ts")
    return df.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def document(alerts: DataFrame) -> DataFrame:
    """One JSON text per alert: the nested signal document, evidence cut to ten lines; fingerprint beside it."""
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format("ts", "SSSSSS") != "000000", F.date_format("ts", ".SSSSSS")).otherwise(""))
    technique = F.filter("tags", lambda t: F.upper(F.substring(t, 1, 1)) == "T")
    risk = F.col("risk_score") if "risk_score" in alerts.columns else F.col("base_score").cast("long")
    doc = F.struct(
        iso.alias("@timestamp"),
        F.struct(F.lit("signal").alias("kind"), F.col("severity").alias("severity"), risk.alias("risk_score")).alias("event"),
        F.struct(F.col("rule_id").alias("id"), F.col("rule_name").alias("name"), F.col("description")).alias("rule"),
        F.struct(F.struct(technique.alias("id")).alias("technique")).alias("threat"),
        F.struct(F.col("entity").alias("id"), F.col("entity_type").alias("type")).alias("entity"),
        F.struct(F.col("fingerprint"), F.slice("evidence", 1, 10).alias("evidence"), F.col("event_count"), F.col("context")).alias("signal"),
    )
    return alerts.select("fingerprint", F.to_json(doc).alias("doc"))


def empty_context() -> Column:
    return F.struct(*[F.lit(None).cast("boolean" if p in ("source.internal", "user.privileged") else "string").alias(p.replace(".", "_")) for p in CONTEXT])
