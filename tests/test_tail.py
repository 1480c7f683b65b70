"""The tail source that executors read: ranges, partial lines, rotation, truncation, and the live command's events."""

import os

import pytest
from pyspark.sql import functions as F

from watchmere.streaming import run
from watchmere.streaming.tail import Range, SharedTailReader, Tail, whole_lines


def lines(reader, start, end):
    return [row[0] for part in reader.partitions(start, end) for row in reader.read(part)]


@pytest.mark.parametrize("step", [1, 2, 5, 7, 1000])
def test_ranges_hold_each_line_once(tmp_path, step):
    log = tmp_path / "a.log"
    texts = ["one", "a longer line", "x", "", "été", "the last\r", "z" * 40]
    log.write_bytes(("\n".join(texts) + "\nnot yet").encode())
    reader = SharedTailReader({"path": str(log), "startingOffset": "earliest", "chunkBytes": str(step)})
    start, end = reader.initialOffset(), reader.latestOffset()
    found = [row for part in reader.partitions(start, end) for row in reader.read(part)]
    assert [r[0] for r in found] == ["one", "a longer line", "x", "été", "the last", "z" * 40]
    data = log.read_bytes()
    assert all(data[at:].decode().startswith(text) for text, _, at in found)
    assert reader.partitions(end, end) == [] and all(p.hi - p.lo <= step for p in reader.partitions(start, end))


def test_partial_lines_truncation_rotation(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("one\ntwo\nthr")
    reader = SharedTailReader({"path": str(log), "startingOffset": "earliest"})
    a, b = reader.initialOffset(), reader.latestOffset()
    assert lines(reader, a, b) == lines(reader, a, b) == ["one", "two"]
    with log.open("a") as fh:
        fh.write("ee\n")
    c = reader.latestOffset()
    assert lines(reader, b, c) == ["three"]
    log.write_text("new\n")  # shorter: truncated
    d = reader.latestOffset()
    assert lines(reader, c, d) == ["new"]
    (tmp_path / "b.log").write_text("rotated in, and longer than before\n")
    os.replace(tmp_path / "b.log", log)
    e = reader.latestOffset()
    assert lines(reader, d, e) == ["rotated in, and longer than before"]
    log.rename(tmp_path / "gone")
    f = reader.latestOffset()
    assert f == e and lines(reader, e, f) == [] and lines(reader, d, e) == []


def test_start_and_ends(tmp_path):
    log = tmp_path / "a.log"
    assert whole_lines(str(log)) is None
    late = SharedTailReader({"path": str(log)})
    start = late.initialOffset()
    log.write_text("y" * 200_000)
    assert whole_lines(str(log), 1000)[1] == 0
    with log.open("a") as fh:
        fh.write("\nhalf")
    assert whole_lines(str(log), 1000)[1] == 200_001
    assert lines(late, start, late.latestOffset()) == ["y" * 200_000]
    assert SharedTailReader({"path": str(log)}).initialOffset()[str(log)][1] == 200_001
    assert not list(late.read(Range(str(log), 1, 0, 0, 5)))


def test_stream_of_two_files_goes_on_after_a_restart(spark, tmp_path):
    logs = [tmp_path / "auth.log", tmp_path / "second.log"]
    logs[0].write_text("".join(f"Jan 10 08:00:00 web-01 sshd[{n}]: Failed password for root from 203.0.113.9 port 22 ssh2\n" for n in range(40)))
    logs[1].write_text("")
    spark.dataSource.register(Tail)

    def take():
        source = spark.readStream.format("tail").option("path", ",".join(map(str, logs))).option("startingOffset", "earliest").option("shared", "true").option("chunkBytes", "500").load()
        events = run.events_of(source, {str(p): "sshd" for p in logs}).select(F.col("_seq"), F.col("process.pid").alias("pid"), F.col("log.file.path").alias("path"))
        q = events.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return [r["pid"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("_seq").collect()]

    first = take()
    assert len(first) == 40
    with logs[1].open("a") as fh:
        fh.write("Jan 10 08:00:00 web-01 sshd[77]: Failed password for root from 203.0.113.9 port 22 ssh2\n")
    second = take()
    assert sorted(second) == sorted([*first, 77]) and [p for p in second if p != 77] == first
