"""Reports: the aggregates behind them, a console text and an HTML page."""

from __future__ import annotations

import html
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import alerts as A
from .operators import risk
from .plans.pipeline import Result, severities

TOP_ALERTS, TOP_ENTITIES, TOP_RULES, TOP_TECHNIQUES = 25, 10, 8, 8
TOP_CASES, TOP_ACTIONS, TIMELINE = 50, 200, 10
COLOURS = {"critical": "\033[91m", "high": "\033[93m", "medium": "\033[94m", "low": "\033[90m"}
HEX = {"critical": "#c0392b", "high": "#e67e22", "medium": "#2980b9", "low": "#7f8c8d", "informational": "#95a5a6"}


def worst_alerts(alerts: DataFrame, n: int = TOP_ALERTS) -> DataFrame:
    return alerts.orderBy(A.rank(F.col("severity")), "ts", "rule_id", "entity").limit(n)


def top_entities(entities: DataFrame, n: int = TOP_ENTITIES) -> DataFrame:
    band = F.when(F.col("score") >= 180, "critical").when(F.col("score") >= 100, "high").when(F.col("score") >= 50, "medium").otherwise("low")
    return entities.select("entity_type", "entity", "score", band.alias("band"), "alerts", "first_seen", "last_seen").orderBy(F.desc("score"), "entity_type", "entity").limit(n)


def top_rules(alerts: DataFrame, n: int = TOP_RULES) -> DataFrame:
    return alerts.groupBy("rule_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_name").limit(n)


def techniques(alerts: DataFrame, n: int = TOP_TECHNIQUES) -> DataFrame:
    tags = alerts.select(F.explode("tags").alias("tag")).select(F.upper("tag").alias("technique")).filter(F.col("technique").rlike("^T[0-9]"))
    return tags.groupBy("technique").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "technique").limit(n)


def shares(alerts: DataFrame) -> DataFrame:
    counted = severities(alerts)
    return counted.join(F.broadcast(counted.agg(F.sum("n").alias("all")))).select("severity", "n", (F.col("n") / F.col("all")).alias("share"))  # one row


def timeline(alerts: DataFrame, n: int = 500) -> DataFrame:
    """Alerts in time order with their place between the first (0) and the last (1)."""
    ends = alerts.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), (F.unix_micros("ts") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return alerts.join(F.broadcast(ends)).select("ts", "severity", "rule_name", "entity", at.alias("x")).orderBy("ts", "rule_name", "entity").limit(n)  # one row


def field_counts(events: DataFrame, first: int | None = 2000) -> DataFrame:
    """path, n: how many of the first events have each field; one aggregate.  None: of all events."""
    from .functions.fields import LEAVES, find, resolve

    df = events if first is None else events.limit(first)
    paths = [p for p in LEAVES if find(df.schema, p)]
    counted = df.agg(*[F.count(resolve(df, p)).alias(str(i)) for i, p in enumerate(paths)])
    cells = F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"`{i}`").alias("n")) for i, p in enumerate(paths)])
    return counted.select(F.explode(cells).alias("c")).select("c.*").filter("n > 0").orderBy(F.desc("n"), "path")


@dataclass
class Figures:
    summary: dict
    stats: list
    alerts: list
    entities: list
    rules: list
    techniques: list
    shares: list
    timeline: list
    cases: list
    actions: list


def gather(result: Result) -> Figures:
    """All figures of a report: each is a small aggregate or a bounded top list."""
    take = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    return Figures(
        result.summary(), take(result.file_stats) if result.file_stats is not None else [], take(worst_alerts(result.alerts)), take(top_entities(result.entities)), take(top_rules(result.alerts)), take(techniques(result.alerts)),
        take(shares(result.alerts)), take(timeline(result.alerts)), take(risk.with_timelines(result.cases.orderBy(F.desc("score"), "case_id").limit(TOP_CASES), result.alerts, TIMELINE).orderBy(F.desc("score"), "case_id")), take(result.actions.orderBy("case_id", "n").limit(TOP_ACTIONS)),
    )


def _of(what: str, shown: int, all_: int) -> str:
    """A heading that says so where not all are shown."""
    return what if shown >= all_ else f"{what} (first {shown} of {all_})"


def console(f: Figures, colour: bool = True) -> str:
    paint = lambda severity, text: f"{COLOURS.get(severity, '')}{text}\033[0m" if colour and severity in COLOURS else text
    s = f.summary
    out = [f"Events {s['events_parsed']}  Alerts {s['alerts']}  Entities {s['entities_scored']}  Cases {s['cases_opened']}  Actions {s['actions_recorded']}", ""]
    out += ["Inputs"] + [f"  {x['file']}  {x['source']}  parsed {x['parsed']}  skipped {x['skipped']}" for x in f.stats] + [""]
    out += ["Riskiest entities"] + [paint(e["band"], f"  {e['score']:8.1f}  {e['entity_type']:<5} {e['entity']}  {e['alerts']} alerts") for e in f.entities] + [""]
    out += ["Alerts"] + [paint(a["severity"], f"  {a['ts']:%m-%d %H:%M:%S}  {a['severity']:<9} {a['entity']:<16} {a['rule_name']}") for a in f.alerts] + [""]
    out += [_of("Cases", len(f.cases), s["cases_opened"])]
    for c in f.cases:
        out.append(paint(c["severity"], f"  {c['case_id']}  {c['title']}  SLA {c['sla_hours']}h"))
        out.append(f"    {c['summary']}")
        out += [f"    {t['ts']:%m-%d %H:%M:%S}  {t['rule_name']}" for t in c["timeline"][:8]]
        out += [f"    - {a}" for a in c["recommended_actions"][:5]]
    return "\n".join(out)


def _table(heads: list[str], rows: list[list]) -> str:
    esc = lambda v: html.escape(str(v))
    return "<table><tr>" + "".join(f"<th>{esc(h)}</th>" for h in heads) + "</tr>" + "".join("<tr>" + "".join(f"<td>{esc(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def _bars(rows: list[tuple[str, int]]) -> str:
    most = max((n for _, n in rows), default=1) or 1
    cells = "".join(f'<text x="0" y="{22 * i + 15}">{html.escape(name)}</text><rect x="260" y="{22 * i + 3}" width="{300 * n / most:.1f}" height="14"/><text x="{266 + 300 * n / most:.1f}" y="{22 * i + 15}">{n}</text>' for i, (name, n) in enumerate(rows))
    return f'<svg width="620" height="{22 * len(rows) + 4}" fill="#34495e" font-size="12">{cells}</svg>'


def _donut(rows: list[dict]) -> str:
    at, out = 0.0, ""
    for r in sorted(rows, key=lambda r: r["severity"]):
        length = 100 * r["share"]
        out += f'<circle r="15.9155" cx="21" cy="21" fill="none" stroke="{HEX.get(r["severity"], "#bdc3c7")}" stroke-width="6" stroke-dasharray="{length:.2f} {100 - length:.2f}" stroke-dashoffset="{25 - at:.2f}"><title>{html.escape(r["severity"])}: {r["n"]}</title></circle>'
        at += length
    return f'<svg width="160" height="160" viewBox="0 0 42 42">{out}</svg>'


def page(f: Figures, title: str = "Security report") -> str:
    """The report as one HTML page; every text is escaped."""
    s = f.summary
    tiles = "".join(f'<div class="tile"><b>{html.escape(str(v))}</b><br>{html.escape(k)}</div>' for k, v in (("events", s["events_parsed"]), ("alerts", s["alerts"]), ("entities", s["entities_scored"]), ("cases", s["cases_opened"]), ("actions", s["actions_recorded"])))
    dots = "".join(f'<circle cx="{10 + 780 * t["x"]:.1f}" cy="20" r="5" fill="{HEX.get(t["severity"], "#7f8c8d")}"><title>{html.escape(str(t["ts"]))} {html.escape(t["rule_name"])} {html.escape(t["entity"])}</title></circle>' for t in f.timeline)
    cases = "".join(
        f"<h3>{html.escape(c['case_id'])} {html.escape(c['title'])}</h3><p>{html.escape(c['summary'])}</p>" + _table(["time", "rule", "risk"], [[t["ts"], t["rule_name"], t["risk_score"]] for t in c["timeline"][:10]]) + "<ul>" + "".join(f"<li>{html.escape(a)}</li>" for a in c["recommended_actions"][:6]) + "</ul>" for c in f.cases
    )
    style = "body{font-family:sans-serif;margin:24px}table{border-collapse:collapse}td,th{border:1px solid #ddd;padding:3px 8px;font-size:13px;text-align:left}.tile{display:inline-block;border:1px solid #ddd;padding:10px 18px;margin-right:8px}"
    return (
        f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{tiles}"
        f"<h2>Severities</h2>{_donut(f.shares)}<h2>Timeline</h2><svg width='800' height='40'><line x1='10' x2='790' y1='20' y2='20' stroke='#ccc'/>{dots}</svg>"
        f"<h2>Rules</h2>{_bars([(r['rule_name'], r['n']) for r in f.rules])}<h2>Techniques</h2>{_bars([(r['technique'], r['n']) for r in f.techniques])}"
        f"<h2>Entities</h2>{_table(['type', 'entity', 'score', 'alerts', 'first', 'last'], [[e['entity_type'], e['entity'], round(e['score'], 1), e['alerts'], e['first_seen'], e['last_seen']] for e in f.entities])}"
        f"<h2>Alerts</h2>{_table(['time', 'severity', 'entity', 'rule', 'description'], [[a['ts'], a['severity'], a['entity'], a['rule_name'], a['description']] for a in f.alerts])}"
        f"<h2>{_of('Cases', len(f.cases), s['cases_opened'])}</h2>{cases}<h2>{_of('Actions', len(f.actions), s['actions_recorded'])}</h2>{_table(['case', 'action', 'target', 'detail', 'mode'], [[a['case_id'], a['action'], a['target'], a['detail'], a['mode']] for a in f.actions])}"
        f"<h2>Inputs</h2>{_table(['file', 'source', 'parsed', 'skipped'], [[x['file'], x['source'], x['parsed'], x['skipped']] for x in f.stats])}</body></html>"
    )
