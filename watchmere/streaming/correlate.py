"""What follows from a stream of alerts: chains, live risk and case announcements, as keyed state.

``followed`` keeps one state for each entity: its running decayed score, the chains begun,
the alerts of the last HORIZON (their number is bounded, as one alert a rule and hour
counts), and what was announced.  A batch touches the states of its own entities and
nothing else, whatever came before.  An alert that comes late is put in its place: its
score decays from its own time, and chains are followed again over the alerts kept.  A
state goes when its entity had no alert for TTL_DAYS.

``Correlator`` writes what follows, by batch, and calls back.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import digest, fingerprint
from ..operators import alerts as A
from ..operators import risk
from ..operators.sequence import CHAIN_SCORE, Fold
from ..sources.rulebook import Rule, Sequence

CASE_MARK = "__case__"
STATEFUL_NAMES = {"auth_success_after_failures": ("Successful Authentication After Repeated Failures", "critical")}
TTL_DAYS = 30
HOUR = 3_600_000_000
LEAST_HOURS = 24

FOLLOWED = "kind string, rule_id string, rule_name string, severity string, ts timestamp, entity string, entity_type string, event_count long, score double, case_id string, fingerprint string"


def as_alerts(fired: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule_id, entity, ts, event_count of a keyed detector as rows of the alert table."""
    known = {r.id: (r.title, r.level) for r in rules} | STATEFUL_NAMES
    kinds = {r.id: "ip" if "ip" in r.entity else "user" if "user" in r.entity else "host" for r in rules}
    of = lambda table, default: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("rule_id")], F.lit(default))
    severity = of({k: v[1] for k, v in known.items()}, "medium")
    title = of({k: v[0] for k, v in known.items()}, "")
    order = {r.id: i for i, r in enumerate(rules)}
    return fired.select(
        "rule_id", title.alias("rule_name"), severity.alias("severity"), "ts", "entity", of(kinds or {"": ""}, "ip").alias("entity_type"), title.alias("description"),
        F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("evidence"), "event_count", A.empty_context().alias("context"),
        F.lit(None).cast("boolean").alias("first_honeypot"), F.lit(None).cast("boolean").alias("first_business_hours"), A.score(severity).alias("base_score"),
        F.lit(A.ATOMIC).alias("stage_ord"), of(order or {"": 0}, 0).alias("rule_ord"), F.struct(F.col("ts").alias("t"), F.unix_micros("ts").alias("s")).alias("emit"),
    )


class _Entity(StatefulProcessor):
    """The state of one entity and what a batch of its alerts adds."""

    def __init__(self, sequences: list[Sequence], threshold: float, half_life: float):
        self.rules = [(q.id, q.title, q.level, q.stages, round(q.within * 1_000_000), q.ordered) for q in sequences]
        self.threshold, self.half_life = threshold, half_life * HOUR
        self.horizon = max([LEAST_HOURS * HOUR, *[2 * r[4] for r in self.rules]])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("entity", "doc string", TTL_DAYS * 86_400_000)

    def close(self) -> None:
        pass

    def _folded(self, k: int, state: list, alerts: list) -> tuple[list, list]:
        """The chain begun after these alerts and the chains completed on the way."""
        _, _, _, stages, span, _ = self.rules[k]
        fits = [sum(1 << i for i, s in enumerate(stages) if a["rule_id"] in s) for a in alerts]
        done: list = []
        return Fold(0, [a["n"] for a in alerts], [a["us"] for a in alerts], fits, len(stages), span).walk(state, done=done), done

    def _count(self, doc: dict, us: int, amount: float, risk_score: int, name: str) -> None:
        later = max(us, doc["last"])
        doc["score"] = doc["score"] * 0.5 ** ((later - doc["last"]) / self.half_life) + amount * 0.5 ** ((later - us) / self.half_life)
        doc["last"] = later
        if doc["worst"] is None or risk_score > doc["worst"][0]:
            doc["worst"] = [risk_score, name]

    def _chains(self, doc: dict, alert: dict) -> Iterator[tuple[str, str, str, int, int, float]]:
        """Chains that this alert, the newest or a late one, leaves complete: id, title, severity, time, events, amount."""
        late = alert is not doc["recent"][-1]
        known = {a["n"]: a for a in doc["recent"]} | {a["n"]: a for held in doc["held"] for a in held}
        for k, (name, title, level, stages, span, ordered) in enumerate(self.rules):
            doc["open"][k], done = self._folded(k, doc["base"][k], doc["recent"]) if late else self._folded(k, doc["open"][k], [alert])
            for chain in done:
                mine = [known[n] for _, _, n in chain]
                yield name, title, level, mine[-1]["us"], sum(a["events"] for a in mine), mine[0]["chained"]
            if not ordered and not done and all(set(s) & set(doc["rules"]) for s in stages) and doc["newest"] - doc["first"] <= span:
                yield name, title, level, doc["newest"], doc["events"], doc["chained"]

    def _trim(self, doc: dict) -> None:
        """Alerts beyond the horizon go; chains that they begin stay."""
        past = [a for a in doc["recent"] if a["us"] < doc["newest"] - self.horizon]
        if past:
            doc["recent"] = doc["recent"][len(past) :]
            for k in range(len(self.rules)):
                doc["base"][k], _ = self._folded(k, doc["base"][k], past)
                held = {a["n"]: a for a in [*doc["held"][k], *past]}
                doc["held"][k] = [held[n] for _, _, n in doc["base"][k]]
        doc["seen"] = {f: us for f, us in doc["seen"].items() if us >= doc["newest"] - self.horizon}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kind, entity = key
        if self.kept.exists():
            doc = json.loads(self.kept.get()[0])
        else:
            n = len(self.rules)
            doc = {"score": 0.0, "last": 0, "worst": None, "first": None, "newest": 0, "events": 0, "chained": 0.0, "rules": [], "n": 0, "recent": [], "seen": {}, "cases": [], "base": [[]] * n, "open": [[]] * n, "held": [[]] * n}
        batch = pd.concat(list(rows)).sort_values(["us", "stage_ord", "rule_ord"], kind="stable")
        out = []

        def put(what, rule_id, name, severity, us, events, mark, case=None):
            out.append((what, rule_id, name, severity, pd.Timestamp(us, unit="us"), entity, kind, events, doc["score"], case, mark))

        for r in batch.to_dict("records"):
            if r["fingerprint"] in doc["seen"]:
                continue
            doc["seen"][r["fingerprint"]] = us = int(r["us"])
            self._count(doc, us, r["contribution"], int(r["risk_score"]), r["rule_name"])
            if doc["first"] is None or us < doc["first"]:
                doc["first"], doc["chained"] = us, float(r["chained"])
            doc["newest"], doc["n"], doc["events"] = max(us, doc["newest"]), doc["n"] + 1, doc["events"] + int(r["event_count"])
            doc["rules"] = sorted({*doc["rules"], r["rule_id"]})
            put("alert", r["rule_id"], r["rule_name"], r["severity"], us, int(r["event_count"]), r["fingerprint"])
            alert = {"n": doc["n"], "us": us, "rule_id": r["rule_id"], "events": int(r["event_count"]), "chained": float(r["chained"])}
            bisect.insort(doc["recent"], alert, key=lambda a: (a["us"], a["n"]))
            for name, title, level, at, events, amount in list(self._chains(doc, alert)):
                mark = f"{name}|{at // HOUR}"
                if mark not in doc["seen"]:
                    doc["seen"][mark] = at
                    self._count(doc, at, amount, round(amount), title)
                    put("chain", name, title, level, at, events, mark)
            day = pd.Timestamp(doc["last"], unit="us").strftime("%Y%m%d")
            if doc["score"] >= self.threshold and day not in doc["cases"]:
                doc["cases"] = [*doc["cases"], day][-TTL_DAYS:]
                severity = "critical" if doc["score"] >= risk.CRITICAL else "high" if doc["score"] >= self.threshold * risk.HIGH_FACTOR else "medium"
                put("case", CASE_MARK, f"{severity.upper()}: {kind} {entity} - {doc['worst'][1]}", severity, doc["last"], 0, "", f"CASE-{day}-")
        self._trim(doc)
        self.kept.update((json.dumps(doc),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FOLLOWED.split(", ")])


def followed(alerts: DataFrame, sequences: list[Sequence], threshold: float = risk.CASE, half_life: float = risk.HALF_LIFE_HOURS) -> DataFrame:
    """A stream of alerts with the chains and cases that follow (FOLLOWED; kind: alert, chain or case).

    An alert counts once for its rule, entity and hour.  A case is announced once for
    its entity and day, at the alert that lifts the score over the threshold or finds it there.
    """
    spark = alerts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # state that expires by the clock else asks for batches without end, also of a stream that has ended
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    own = risk.scored(alerts)
    chained = F.lit(float(CHAIN_SCORE)) * risk.multiplier(chain=True)
    rows = own.select(
        "entity_type", "entity", F.unix_micros("ts").alias("us"), "stage_ord", "rule_ord", "rule_id", "rule_name", "severity", F.col("event_count").cast("long").alias("event_count"),
        F.col("contribution").cast("double").alias("contribution"), "risk_score", chained.cast("double").alias("chained"), fingerprint(F.col("rule_id"), F.col("entity"), F.col("ts")).alias("fingerprint"),
    )
    rows = rows.filter("entity IS NOT NULL")
    out = rows.groupBy("entity_type", "entity").transformWithStateInPandas(_Entity(sequences, threshold, half_life), FOLLOWED, "Append", "ProcessingTime")
    stamp = F.upper(digest(6, F.concat_ws(":", "entity_type", "entity")))
    mark = F.when(F.col("kind") == "chain", fingerprint(F.col("rule_id"), F.col("entity"), F.col("ts"))).otherwise(F.col("fingerprint"))
    return out.withColumns({"case_id": F.concat("case_id", stamp), "fingerprint": mark})


@dataclass
class Status:
    alerts: int = 0
    chains: int = 0
    cases: list[str] = field(default_factory=list)


class Correlator:
    """Called with each batch of what follows and its number.

    ``folder`` gets history/ (alerts and chains) and cases/, a part a batch; a batch that
    runs again replaces its own.  ``on_alert`` sees the batch's alerts and chains,
    ``on_case`` the newly opened cases (rule id CASE_MARK).
    """

    def __init__(self, folder: str, sequences: list[Sequence], threshold: float = risk.CASE, on_alert: Callable[[DataFrame], None] | None = None, on_case: Callable[[DataFrame], None] | None = None):
        self.folder, self.sequences, self.threshold = folder.rstrip("/"), sequences, threshold
        self.on_alert, self.on_case, self.status = on_alert, on_case, Status()

    def follow(self, alerts: DataFrame) -> DataFrame:
        return followed(alerts, self.sequences, self.threshold)

    def __call__(self, batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        kept = batch.persist()
        try:
            path = f"{self.folder}/history/batch={n}"
            kept.filter("kind <> 'case'").drop("case_id").write.mode("overwrite").parquet(path)
            out = spark.read.schema(batch.drop("case_id").schema).parquet(path)
            opened = kept.filter("kind = 'case'").select("case_id", "entity", "severity", F.col("rule_name").alias("title"), F.col("ts").alias("opened_at"), "score", "rule_id")
            path = f"{self.folder}/cases/batch={n}"
            opened.write.mode("overwrite").parquet(path)
            opened = spark.read.schema(opened.schema).parquet(path)
        finally:
            kept.unpersist()
        kinds = {r["kind"]: r["count"] for r in out.groupBy("kind").count().collect()}
        self.status.alerts += sum(kinds.values())
        self.status.chains += kinds.get("chain", 0)
        self.status.cases += [r["case_id"] for r in opened.select("case_id").collect()]  # those of one batch
        if self.on_alert:
            self.on_alert(out)
        if self.on_case:
            self.on_case(opened)
