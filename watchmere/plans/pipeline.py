"""The batch detection pipeline as one plan: events to alerts, risk, cases and actions."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import baseline, detect, risk, sequence, stateful
from ..operators.enrich import enrich
from ..session import delete, shared, written
from ..sources import files, lookups, rulebook

CONFIG = Path(__file__).resolve().parent.parent / "config"


@dataclass
class Result:
    events: DataFrame
    rejects: DataFrame
    file_stats: DataFrame
    raw_alerts: DataFrame
    alerts: DataFrame
    entities: DataFrame
    cases: DataFrame
    actions: DataFrame
    coverage: dict[str, list[str]]
    folder: str

    def summary(self) -> dict:
        """Counts of a run; small aggregates only."""
        by_severity = {r["severity"]: r["n"] for r in severities(self.alerts).collect()}
        stages = {r["stage_ord"]: r["count"] for r in self.raw_alerts.groupBy("stage_ord").count().collect()}
        return {
            "events_parsed": self.events.count(), "alerts": sum(by_severity.values()), "alerts_by_severity": by_severity, "entities_scored": self.entities.count(),
            "cases_opened": self.cases.count(), "techniques_covered": len(self.coverage), "actions_recorded": self.actions.count(),
            "detections": {name: stages.get(k, 0) for k, name in enumerate(("atomic", "stateful", "behavioural", "correlation"))},
        }

    def release(self) -> None:
        """Delete the tables behind the result."""
        delete(self.events.sparkSession, self.folder)


def severities(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count("*").alias("n"))


def detections(events: DataFrame, rules: list[rulebook.Rule], sequences: list[rulebook.Sequence], folder: str) -> DataFrame:
    """All alerts before dedup; chains see the alerts of the other stages.  Each detector's alerts are a table of their own."""
    parts = {"atomic": detect.run(events, rules), "stateful": stateful.run(events), "behavioural": baseline.run(events)}
    base = A.union([written(p, folder, name) for name, p in parts.items() if p is not None])
    chains = sequence.run(base, sequences)
    return base if chains is None else A.union([base, written(chains.select(*A.COLUMNS), folder, "chains")])


def analyze(events: DataFrame, found: lookups.Lookups, rules: list[rulebook.Rule] | None = None, sequences: list[rulebook.Sequence] | None = None, threshold: float = risk.CASE, live: bool = False, rejects: DataFrame | None = None, file_stats: DataFrame | None = None, folder: str | None = None) -> Result:
    """The whole pipeline over events.

    Enriched events, the alerts of each detector, the alerts after dedup and the
    entities are written to a folder, so that no plan holds more than one step.
    """
    folder = folder or shared(events.sparkSession)
    rules = rulebook.load_rules() if rules is None else rules
    sequences = rulebook.load_sequences() if sequences is None else sequences
    enriched = written(enrich(events, found), folder, "enriched")
    raw = detections(enriched, rules, sequences, folder)
    alerts = written(risk.scored(A.dedup(raw)), folder, "alerts")
    entities = written(risk.entities(alerts), folder, "entities")
    cases = risk.cases(entities, threshold)
    return Result(enriched, rejects, file_stats, raw, alerts, entities, cases, risk.actions(cases, live), rulebook.coverage(rules), folder)


def run(spark: SparkSession, paths: dict[str, str | None], config: str | Path = CONFIG, year: int = 2026, **options) -> Result:
    """analyze() over log files."""
    folder = shared(spark)
    scan = files.scan(spark, paths, year, keep=lambda df: written(df, folder, "lines"))
    return analyze(scan.events, lookups.load(config), rejects=scan.rejects, file_stats=scan.stats, folder=folder, **options)
