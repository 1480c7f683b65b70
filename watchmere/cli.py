"""Command line: analyze, rules, metrics, search, shell and stream over a directory of logs."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report, sinks
from .operators import detect, quality
from .operators.enrich import enrich
from .plans import pipeline
from .plans.search import EXAMPLES, QueryError, compile_search, render_table
from .session import session, shared, written
from .sources import corpus, files, lookups, rulebook

SHELL_HELP = "A query, or .help  .fields  .examples  .history  .quit"


def _inputs(args) -> dict[str, str | None]:
    found = files.standard_inputs(args.logs, os.path.exists)
    if not found:
        raise SystemExit(f"no logs in {args.logs}; there may be {', '.join(files.STANDARD)}")
    return dict(found)


def _events(spark: SparkSession, args) -> DataFrame:
    """Enriched events, parsed once."""
    folder = shared(spark)
    scan = files.scan(spark, _inputs(args), args.year, keep=lambda df: written(df, folder, "lines"))
    return written(enrich(scan.events, lookups.load(args.config)), folder, "enriched")


def analyze(spark: SparkSession, args) -> int:
    result = pipeline.run(spark, _inputs(args), args.config, args.year, threshold=args.threshold, live=args.live)
    sinks.export(result, args.out)
    if args.live:
        sinks.blocklist(result.actions.filter("executed").collect(), Path(args.out) / "blocklist.txt")
    figures = report.gather(result)
    print(report.console(figures, colour=not args.plain))
    if args.html:
        Path(args.html).write_text(report.page(figures), encoding="utf-8")
    result.release()
    return 0


def rules(spark: SparkSession | None, args) -> int:
    found = rulebook.load_rules(args.rules, disabled=True)
    if args.coverage:
        for technique, titles in rulebook.coverage([r for r in found if r.enabled]).items():
            print(f"{technique:<12} {', '.join(titles)}")
        return 0
    for r in found:
        print(f"{r.id:<28} {r.level:<14} {'on ' if r.enabled else 'off'} {r.title}")
    for q in rulebook.load_sequences(args.rules):
        print(f"{q.id:<28} {q.level:<14} on  {q.title}")
    return 0


def metrics(spark: SparkSession, args) -> int:
    """Precision, recall and F1 against ground_truth.json; 2 if the gate isn't passed."""
    result = pipeline.run(spark, _inputs(args), args.config, args.year)
    truth = spark.read.schema(corpus.TRUTH_SCHEMA).json(f"{args.logs}/ground_truth.json", multiLine=True)
    row = quality.score(result.alerts, truth).first()
    document = row.asDict() | {
        "passed": quality.passes(row),
        "scenarios": [r.asDict() for r in quality.scenarios(result.alerts, truth).orderBy("scenario").collect()],
        "missed_behaviours": [r.asDict() for r in quality.behaviours(result.alerts, truth).filter("NOT detected").select("scenario", "entity", "expected_rules").collect()],
        "techniques": [r.asDict() for r in report.techniques(result.alerts, 1000).collect()],
    }
    if args.threshold_sweep:
        rule = next(r for r in rulebook.load_rules() if r.id == "ssh_brute_force")
        swept = detect.sweep(result.events, rule, quality.SWEEP)
        known = truth.select("entity", F.lit(True).alias("labelled")).distinct()
        counted = swept.join(known, "entity", "left").groupBy("at").agg(F.count("*").alias("alerts"), F.count("labelled").alias("true_positives"))
        found = {r["at"]: r.asDict() for r in counted.collect()}
        document["sweep"] = [found.get(n, {"at": n, "alerts": 0, "true_positives": 0}) for n in quality.SWEEP]
    print(json.dumps(document, indent=2, default=str))
    if args.out:
        sinks.json_file(document, Path(args.out) / "metrics.json")
    result.release()
    return 0 if document["passed"] else 2


def search(spark: SparkSession | None, args) -> int:
    if args.examples:
        for text, what in EXAMPLES:
            print(f"{what}\n    {text}")
        return 0
    spark = spark or _session(args)
    try:
        found = compile_search(_events(spark, args), args.query or "")
    except QueryError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if args.json:
        for row in sinks.json_rows(found):
            print(row)
    else:
        print(render_table(found, args.limit))
    return 0


def shell(spark: SparkSession, args, read: Callable[[str], str] = input) -> int:
    """Queries one after the other over events that are parsed once."""
    events, history = _events(spark, args), []
    print(SHELL_HELP)
    while True:
        try:
            text = read("> ").strip()
        except (EOFError, KeyboardInterrupt):
            return 0
        if text in (".quit", ".exit"):
            return 0
        if text == ".help":
            print(SHELL_HELP)
        elif text == ".fields":
            print(render_table(report.field_counts(events), 200))
        elif text == ".examples":
            print("\n".join(query for query, _ in EXAMPLES))
        elif text == ".history":
            print("\n".join(f"{i + 1:>3}  {h}" for i, h in enumerate(history)))
        elif text:
            history.append(text)
            try:
                print(render_table(compile_search(events, text), args.limit))
            except QueryError as e:
                print(f"error: {e}")


def stream(spark: SparkSession, args) -> int:
    """Detect on growing logs, or replay them through the streaming detections."""
    from .streaming import correlate, run
    from .streaming import detect as live
    from .streaming.tail import Tail

    found, rules_ = lookups.load(args.config), rulebook.load_rules()
    if args.replay:
        folder = shared(spark)
        scan = files.scan(spark, _inputs(args), args.year, keep=lambda df: written(df, folder, "lines"))
        flat = scan.events.withColumn("_seq", F.xxhash64("_seq"))
        events = run.paced(flat, folder, args.batches, args.speed, args.limit or None)
    else:
        spark.dataSource.register(Tail)
        sources = _inputs(args)
        start = "earliest" if args.from_start else "latest"
        lines = spark.readStream.format("tail").option("path", ",".join(sources)).option("startingOffset", start).option("shared", str(args.shared).lower()).load()
        events = run.events_of(lines, sources, args.year)

    def show(alerts: DataFrame) -> None:
        for a in alerts.orderBy("ts").select("ts", "severity", "entity", "rule_name").toLocalIterator():
            print(f"{a['ts']:%m-%d %H:%M:%S}  {a['severity']:<9} {a['entity']:<18} {a['rule_name']}", flush=True)

    def case(opened: DataFrame) -> None:
        for c in opened.collect():  # the cases of one batch
            print(f"CASE {c['case_id']}  {c['title']}", flush=True)

    out = f"{args.out.rstrip('/')}/stream"
    sink = correlate.Correlator(out, rulebook.load_sequences(), args.threshold, show, case)
    parts = live.detectors(enrich(events, found, novelty=False), rules_)
    queries = run.live(parts, sink, out, None if args.replay and not args.speed else f"{args.poll} seconds")
    run.wait(queries, args.max_seconds, on_status=(lambda s: print(s, file=sys.stderr)) if args.verbose else None)
    print(f"alerts {sink.status.alerts}  chains {sink.status.chains}  cases {len(sink.status.cases)}")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="watchmere", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def add(name: str, *, logs: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.add_argument("--master", default=os.environ.get("SPARK_MASTER", "local[*]"))
        if logs:
            c.add_argument("--logs", default="logs", help="directory of the standard log files")
            c.add_argument("--config", default=str(pipeline.CONFIG))
            c.add_argument("--year", type=int, default=dt.date.today().year, help="year of lines that have none")
            c.add_argument("--out", default="out")
        return c

    c = add("analyze")
    c.add_argument("--threshold", type=float, default=100)
    c.add_argument("--live", action="store_true", help="execute the playbook's actions")
    c.add_argument("--plain", action="store_true", help="no colours")
    c.add_argument("--html", help="write the report as a page")
    c = add("rules", logs=False)
    c.add_argument("--rules", default=str(rulebook.RULES))
    c.add_argument("--coverage", action="store_true")
    c = add("metrics")
    c.add_argument("--threshold-sweep", action="store_true")
    c = add("search")
    c.add_argument("query", nargs="?")
    c.add_argument("--json", action="store_true")
    c.add_argument("--examples", action="store_true")
    c.add_argument("--limit", type=int, default=50)
    c = add("shell")
    c.add_argument("--limit", type=int, default=50)
    c = add("stream")
    c.add_argument("--threshold", type=float, default=100)
    c.add_argument("--from-start", action="store_true")
    c.add_argument("--shared", action="store_true", help="the logs lie where every executor sees them, and executors read them")
    c.add_argument("--replay", action="store_true")
    c.add_argument("--speed", type=float, default=0.0, help="seconds of log time a second; 0: as fast as it goes")
    c.add_argument("--limit", type=int, default=0, help="replay so many events only; 0: all")
    c.add_argument("--batches", type=int, default=16, help="replay in so many batches of equal time")
    c.add_argument("--poll", type=float, default=1.0)
    c.add_argument("--max-seconds", type=float)
    c.add_argument("--verbose", action="store_true", help="print the stream's status")
    return p


def _session(args) -> SparkSession:
    spark = session("watchmere", spark__master=args.master, spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    needs = args.command not in ("rules", "search")
    spark = spark or (_session(args) if needs else None)
    return {"analyze": analyze, "rules": rules, "metrics": metrics, "search": search, "shell": shell, "stream": stream}[args.command](spark, args)
