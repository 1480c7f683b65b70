"""Sinks: NDJSON signals, bulk files, cases, summaries, blocklists and metrics.

Tables are written by executors; small results (cases, summaries) by the driver.
"""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import alerts as A
from .operators import risk
from .plans.pipeline import Result

SIGNALS, EVENTS = "signals", "events"


def alerts_ndjson(alerts: DataFrame, path: str) -> None:
    """One signal document a line."""
    A.document(alerts).select("doc").write.mode("overwrite").text(path)


def bulk(alerts: DataFrame, events: DataFrame | None, path: str, signals: str = SIGNALS, events_index: str = EVENTS) -> None:
    """Bulk-index format: an action line and a document line for each alert (id: its fingerprint) and event."""
    pair = lambda action, doc: F.concat_ws("\n", action, doc).alias("value")
    signal = A.document(alerts).select(pair(F.to_json(F.struct(F.struct(F.lit(signals).alias("_index"), F.col("fingerprint").alias("_id")).alias("index"))), F.col("doc")))
    if events is not None:
        cells = [F.col(f"`{c}`") for c in events.columns if c != "_seq"]
        signal = signal.unionAll(events.select(pair(F.to_json(F.struct(F.struct(F.lit(events_index).alias("_index")).alias("index"))), F.to_json(F.struct(*cells)))))
    signal.write.mode("overwrite").text(path)


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def case_documents(cases: DataFrame) -> list[dict]:
    """Cases, worst first, as plain dicts."""
    return [_plain(r.asDict(recursive=True)) for r in cases.orderBy(F.desc("score"), "case_id").collect()]


def case_files(documents: list[dict], directory: str | Path) -> list[Path]:
    out = Path(directory)
    out.mkdir(parents=True, exist_ok=True)
    paths = []
    for d in documents:
        path = out / f"{d['case_id']}.json"
        path.write_text(json.dumps(d, indent=2), encoding="utf-8")
        paths.append(path)
    return paths


def blocklist(actions: list, path: str | Path, now: dt.datetime | None = None) -> int:
    """Append the executed blocks: address, reason and date."""
    rows = [a for a in actions if a["action"] == "block_ip" and a["executed"]]
    if rows:
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("a", encoding="utf-8") as fh:
            for a in rows:
                fh.write(f"{a['target']}  # {a['detail']} ({now or dt.datetime.now():%Y-%m-%d %H:%M})\n")
    return len(rows)


def json_file(value, path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(_plain(value), indent=2, default=str), encoding="utf-8")
    return path


def json_rows(df: DataFrame):
    """Rows as JSON texts, one by one."""
    return df.toJSON().toLocalIterator()


def export(result: Result, directory: str | Path) -> dict[str, str]:
    """alerts.ndjson, opensearch_bulk.ndjson (folders of part files), cases.json, cases/, summary.json."""
    out = Path(directory)
    out.mkdir(parents=True, exist_ok=True)
    alerts_ndjson(result.alerts, str(out / "alerts.ndjson"))
    bulk(result.alerts, result.events, str(out / "opensearch_bulk.ndjson"))
    documents = case_documents(risk.with_timelines(result.cases, result.alerts))
    case_files(documents, out / "cases")
    json_file(documents, out / "cases.json")
    stats = [r.asDict() for r in result.file_stats.collect()] if result.file_stats is not None else []
    json_file({"generated_at": dt.datetime.now().isoformat(timespec="seconds"), **result.summary(), "stats": stats, "attack_coverage": result.coverage}, out / "summary.json")
    return {name: str(out / name) for name in ("alerts.ndjson", "opensearch_bulk.ndjson", "cases.json", "summary.json")}
