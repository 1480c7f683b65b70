"""The search language's errors, the labelled corpus from logs to cases, and tailing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from watchmere import cli, report, sinks
from watchmere.operators import quality
from watchmere.plans import contract, pipeline
from watchmere.plans.search import EXAMPLES, QueryError, compile_search, render_table
from watchmere.sources import corpus, files, rulebook
from watchmere.streaming import detect as live
from watchmere.streaming import run as streams
from watchmere.streaming.tail import Tail, TailReader, read_lines


@pytest.mark.parametrize("text", ["source.ip = = =", "| stats nonsense_agg by x", "| frobnicate", "a = 'x' )", "| head x", "| timechart span=oops count"])
def test_bad_queries(spark, small, text):
    with pytest.raises(QueryError):
        compile_search(contract.events(spark, small), text)


def test_examples_compile_and_render(spark, small):
    e = contract.events(spark, small)
    for text, _ in EXAMPLES:
        assert render_table(compile_search(e, text), 3)


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    return corpus.write(tmp_path_factory.mktemp("logs"))


@pytest.fixture(scope="module")
def result(spark, logs):
    inputs = {str(k): v for k, v in files.standard_inputs(str(logs), lambda p: os.path.exists(p)).items()}
    found = pipeline.run(spark, inputs)
    yield found
    found.release()


def test_corpus_is_detected(spark, logs, result):
    truth = spark.read.json(f"{logs}/ground_truth.json", multiLine=True)
    row = quality.score(result.alerts, truth).first()
    assert quality.passes(row), row
    assert row["recall"] == 1.0, row


def test_corpus_counts(result):
    stats = {r["file"].rsplit("/", 1)[-1]: (r["parsed"], r["skipped"]) for r in result.file_stats.collect()}
    assert all(skipped == 0 for _, skipped in stats.values()), stats
    assert result.summary()["cases_opened"] > 0
    assert result.alerts.count() == result.alerts.select("fingerprint").distinct().count()


def test_tail_holds_partial_lines_and_starts_over(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("one\ntwo\nthr")
    lines, inode, at = read_lines(str(log), 0, 0)
    assert lines == ["one", "two"]
    with log.open("a") as fh:
        fh.write("ee\n")
    lines, inode, at = read_lines(str(log), inode, at)
    assert lines == ["three"]
    log.write_text("new\n")  # shorter: truncated
    assert read_lines(str(log), inode, at)[0] == ["new"]
    (tmp_path / "b.log").write_text("rotated in, and longer than before\n")
    os.replace(tmp_path / "b.log", log)
    assert read_lines(str(log), inode, 4)[0] == ["rotated in, and longer than before"]
    assert read_lines(str(tmp_path / "missing"), 7, 9) == ([], 7, 9)


def test_tail_reads_a_batch_again(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("one\ntwo\n")
    reader = TailReader({"path": str(log), "startingOffset": "earliest"})
    start = reader.initialOffset()
    rows, end = reader.read(start)
    assert list(rows) == list(reader.readBetweenOffsets(start, end)) == [("one", str(log)), ("two", str(log))]


def test_tail_stream(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_text("one\n\ntwo\n")
    spark.dataSource.register(Tail)
    df = spark.readStream.format("tail").option("path", str(log)).option("startingOffset", "earliest").load()
    q = df.writeStream.format("memory").queryName("tailed").start()
    try:
        q.processAllAvailable()
        assert {r["value"] for r in spark.table("tailed").collect()} == {"one", "two"}
    finally:
        q.stop()


def test_stateless_stream_alerts_once_an_hour(spark, tmp_path):
    rule = contract.rulebook.rule({"id": "r", "level": "low", "detection": {"selection": {"event_type": "error"}}})
    rows = [(i, "error", "10.0.0.1", i * 60) for i in range(30)]
    df = spark.createDataFrame(rows, "_seq long, event_type string, ip string, s long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    e = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    e = e.select("_seq", "event_type", F.struct("ip").alias("source"), F.timestamp_seconds("s").alias("@timestamp"))
    assert streams.replay(live.stateless(e, [rule])).count() == 1


def test_every_rule_fires_on_the_corpus(logs, result):
    fired = {r["rule_id"] for r in result.raw_alerts.select("rule_id").distinct().collect()}
    want = {r.id for r in rulebook.load_rules()} | {q.id for q in rulebook.load_sequences()}
    assert want <= fired, want - fired


def test_report_and_exports(result, tmp_path):
    figures = report.gather(result)
    text, page = report.console(figures, colour=False), report.page(figures)
    assert all(c["case_id"] in text and c["case_id"] in page for c in figures.cases) and figures.cases
    assert "<script" not in page
    paths = sinks.export(result, tmp_path)
    summary = json.loads(open(paths["summary.json"]).read())
    assert summary["alerts"] == result.alerts.count() and len(list((tmp_path / "cases").iterdir())) == len(figures.cases)
    docs = [json.loads(line) for part in (tmp_path / "alerts.ndjson").glob("part-*") for line in part.read_text().splitlines()]
    assert len(docs) == summary["alerts"] and all(d["rule"]["id"] and d["entity"]["id"] for d in docs)


def test_alerts_are_searchable(result):
    found = compile_search(result.alerts, "severity = critical and entity_type = ip | stats count by entity")
    want = {r["entity"] for r in result.alerts.collect() if r["severity"] == "critical" and r["entity_type"] == "ip"}
    assert {r["entity"] for r in found.collect()} == want and want


def test_command_line(spark, logs, tmp_path, capsys):
    where = ["--logs", str(logs), "--year", "2026", "--out", str(tmp_path)]
    assert cli.main(["rules", "--coverage"]) == 0 and "T1190" in capsys.readouterr().out
    assert cli.main(["search", "--examples"]) == 0
    assert cli.main(["search", 'event.outcome = failure and source.ip = "192.0.2.77" | stats count', *where], spark) == 0
    assert "28" in capsys.readouterr().out
    assert cli.main(["search", "| nonsense", *where], spark) == 1
    assert cli.main(["metrics", *where, "--threshold-sweep"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["recall"] == 1.0 and [s["at"] for s in found["sweep"]] == quality.SWEEP


def test_shell(spark, logs, capsys):
    lines = iter([".help", ".fields", "event.action = sudo | stats count", "oops = = ", ".history", ".quit"])
    assert cli.shell(spark, cli.parser().parse_args(["shell", "--logs", str(logs), "--year", "2026"]), lambda _: next(lines)) == 0
    out = capsys.readouterr().out
    assert "@timestamp" in out and "error:" in out and "oops" in out


def test_replay_opens_cases(spark, logs, tmp_path, capsys):
    assert cli.main(["stream", "--replay", "--batches", "4", "--logs", str(logs), "--year", "2026", "--out", str(tmp_path)], spark) == 0
    out = capsys.readouterr().out
    assert "CASE" in out and "198.51.100.140" in out
    history = spark.read.parquet(f"{tmp_path}/stream/history")
    assert history.count() == history.select("fingerprint").distinct().count()
    cases = spark.read.parquet(f"{tmp_path}/stream/cases")
    assert cases.count() == cases.select("case_id").distinct().count() > 0
