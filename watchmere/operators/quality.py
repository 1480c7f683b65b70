"""Detection quality against labelled truth: precision, recall, scenarios and threshold sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GATE = 0.8
SWEEP = [3, 5, 8, 10, 15, 20, 30]


def split(alerts: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts of labelled entities, and the others."""
    known = truth.select("entity").distinct()
    return alerts.join(known, "entity", "left_semi"), alerts.join(known, "entity", "left_anti")


def behaviours(alerts: DataFrame, truth: DataFrame) -> DataFrame:
    """truth (scenario, entity, technique, expected_rules) with ``detected``: did any expected rule fire for the entity?"""
    fired = alerts.groupBy("entity").agg(F.collect_set("rule_id").alias("fired"))
    return truth.join(fired, "entity", "left").withColumn("detected", F.coalesce(F.arrays_overlap("fired", "expected_rules"), F.lit(False)))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def score(alerts: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true_positives, false_positives, detected, missed, precision, recall, f1."""
    right, wrong = split(alerts, truth)
    found = behaviours(alerts, truth).agg(F.count_if("detected").alias("detected"), F.count_if(~F.col("detected")).alias("missed"))
    one = right.agg(F.count("*").alias("true_positives")).join(wrong.agg(F.count("*").alias("false_positives"))).join(found)
    p = _ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_positives"))
    r = _ratio(F.col("detected"), F.col("detected") + F.col("missed"))
    one = one.withColumns({"p": p, "r": r})
    f1 = _ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return one.select("true_positives", "false_positives", "detected", "missed", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def scenarios(alerts: DataFrame, truth: DataFrame) -> DataFrame:
    """scenario, behaviours, detected, recall."""
    return behaviours(alerts, truth).groupBy("scenario").agg(F.count("*").alias("behaviours"), F.count_if("detected").alias("detected")).withColumn("recall", F.round(F.col("detected") / F.col("behaviours"), 3))


def passes(row) -> bool:
    """The gate on a row of score()."""
    return row["precision"] >= GATE and row["recall"] >= GATE
