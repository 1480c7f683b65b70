"""Detection and sequence rules from YAML files."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import seconds

RULES = Path(__file__).resolve().parent.parent / "rules"


def technique(tag: str) -> str:
    """attack.tNNNN as TNNNN, other tags as they are."""
    return tag.removeprefix("attack.").upper() if tag.startswith("attack.t") else tag


@dataclass
class Threshold:
    group_by: list[str]
    count: int
    window: float
    distinct: str | None = None


@dataclass
class Rule:
    id: str
    title: str
    description: str
    level: str
    status: str
    tags: list[str]
    entity: str
    evidence_fields: list[str]
    enabled: bool
    blocks: dict[str, dict]
    condition: str
    threshold: Threshold | None
    falsepositives: list[str] = field(default_factory=list)
    response: list[str] = field(default_factory=list)


@dataclass
class Sequence:
    id: str
    title: str
    description: str
    level: str
    tags: list[str]
    stages: list[list[str]]
    within: float
    ordered: bool
    group_by: str
    response: list[str] = field(default_factory=list)


def _listed(value) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def rule(data: dict) -> Rule:
    detection = dict(data["detection"])
    limit, condition = detection.pop("threshold", None), detection.pop("condition", "selection")
    threshold = Threshold(_listed(limit.get("group_by", ["source.ip"])), int(limit.get("count", 5)), seconds(limit.get("window", "60s")), limit.get("distinct")) if limit else None
    return Rule(
        id=data["id"], title=data.get("title", data["id"]), description=str(data.get("description") or "").strip(), level=data.get("level", "medium"), status=data.get("status", "experimental"),
        tags=[technique(t) for t in _listed(data.get("tags"))], entity=data.get("entity", "source.ip"), evidence_fields=_listed(data.get("evidence_fields")) or ["message"],
        enabled=data.get("enabled", True), blocks=detection, condition=condition, threshold=threshold, falsepositives=_listed(data.get("falsepositives")), response=_listed(data.get("response")),
    )


def sequence(data: dict) -> Sequence:
    spec = data["sequence"]
    return Sequence(
        id=data["id"], title=data.get("title", data["id"]), description=str(data.get("description") or "").strip(), level=data.get("level", "critical"), tags=[technique(t) for t in _listed(data.get("tags"))],
        stages=[_listed(s.get("rule_id")) for s in spec["stages"]], within=seconds(spec.get("within", "2h")), ordered=spec.get("ordered", True), group_by=spec.get("group_by", "entity"), response=_listed(data.get("response")),
    )


def _documents(directory: str | Path, spark: SparkSession | None = None):
    """The YAML documents of a directory in path order: of a local one, or of any file system that Spark reads."""
    if spark is None:
        texts = [path.read_text(encoding="utf-8") for path in sorted(Path(directory).rglob("*.yml"))]
    else:
        rows = spark.read.option("recursiveFileLookup", True).text(str(directory), wholetext=True).select("value", F.input_file_name().alias("path"))
        texts = [r["value"] for r in rows.orderBy("path").collect()]  # one row a rule file
    for text in texts:
        data = yaml.safe_load(text)
        if isinstance(data, dict):
            yield data


def load_rules(directory: str | Path = RULES, disabled: bool = False, spark: SparkSession | None = None) -> list[Rule]:
    """Detection rules of a directory in path order; only enabled ones unless asked."""
    found = [rule(d) for d in _documents(directory, spark) if "detection" in d]
    return [r for r in found if r.enabled or disabled]


def load_sequences(directory: str | Path = RULES, spark: SparkSession | None = None) -> list[Sequence]:
    return [sequence(d) for d in _documents(directory, spark) if "sequence" in d]


def coverage(rules: list[Rule]) -> dict[str, list[str]]:
    """Technique -> titles of the rules that cover it, both sorted."""
    found: dict[str, set[str]] = {}
    for r in rules:
        for t in r.tags:
            if t.startswith("T") and t[1:2].isdigit():
                found.setdefault(t, set()).add(r.title)
    return {t: sorted(v) for t, v in sorted(found.items())}
