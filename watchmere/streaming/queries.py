"""Registered streaming queries: the detections replayed over the events table as a stream, with SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import contract as C
from ..plans import contract_logs
from ..sources import rulebook
from . import correlate, detect, run


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return C.as_events(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))  # a pattern, since a stream's plain path must be a folder


def stream_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C._plain(run.replay(detect.thresholds(_events(spark, sf_dir), [C._threshold(5, "1d")])))


def stream_success_after_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C._plain(run.replay(detect.success_after_failures(_events(spark, sf_dir), threshold=4, minutes=24 * 60)))


def stream_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases announced by live risk: each entity's score after each alert, once a day."""
    alerts = detect.detect.stateless(_events(spark, sf_dir), C._RAW_RULES)
    found = run.replay(correlate.followed(alerts, []))
    return found.filter("kind = 'case'").select("case_id", "entity", "severity", C.stamp("ts").alias("opened_at"), F.round("score", 3).alias("score"))


def stream_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of a stream's alerts, one an hour."""
    alerts = detect.detect.stateless(_events(spark, sf_dir), C._RAW_RULES)
    found = run.replay(correlate.followed(alerts, [rulebook.sequence(C._CHAIN)], threshold=float("inf")))
    return found.filter("kind = 'chain'").select("rule_id", "entity", C.stamp("ts").alias("ts"), "event_count")


QUERIES = {f.__name__: f for f in (stream_threshold, stream_success_after_failures, stream_cases, stream_chains)}

_FIRST = "SELECT 'bursts' AS rule_id, ip AS entity, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS ts, CAST(5 AS BIGINT) AS event_count FROM (SELECT *, {} AS hit FROM ev WHERE outcome = 'failure') WHERE hit GROUP BY ip"
SQL = {"stream_threshold": C.EV + _FIRST.format(C._WITHIN.format(4, C.DAY)), "stream_success_after_failures": C.SQL["success_after_failures"]}

_LIVE = """, live AS (SELECT *, sum(base * CASE WHEN internal THEN 1.0 ELSE 1.2 END::DOUBLE * pow(2.0, (epoch_us(ts) - 1704067200000000) / 86400000000.0)) OVER (PARTITION BY entity ORDER BY ts, o, id ROWS UNBOUNDED PRECEDING) / pow(2.0, (epoch_us(ts) - 1704067200000000) / 86400000000.0) AS score FROM dd)
SELECT 'CASE-' || strftime(ts, '%Y%m%d') || '-' || upper(substr(sha256('ip:' || entity), 1, 6)) AS case_id, entity, CASE WHEN score >= 180 THEN 'critical' WHEN score >= 130 THEN 'high' ELSE 'medium' END AS severity,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS opened_at, round(score, 3) AS score FROM live WHERE score >= 100 QUALIFY row_number() OVER (PARTITION BY entity, date_trunc('day', ts) ORDER BY ts, o, id) = 1"""
SQL["stream_cases"] = C.EV + C._RAW + _LIVE
SQL["stream_chains"] = C.EV + C._RAW + contract_logs._CHAIN.replace("FROM raw)", "FROM dd)") + """SELECT 'fail_then_view' AS rule_id, entity, strftime(fired, '%Y-%m-%d %H:%M:%S.%f') AS ts, CAST(2 AS BIGINT) AS event_count FROM fold
 QUALIFY row_number() OVER (PARTITION BY entity, date_trunc('hour', fired) ORDER BY fired) = 1"""
