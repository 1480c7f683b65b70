"""Replaying a table as a stream: batches in time order, equal times together, nothing lost, a pace."""

import time

import pytest
from pyspark.sql import functions as F

from watchmere.streaming import run


@pytest.fixture()
def table(spark):
    times = F.when(F.col("id") < 60, 100).otherwise(F.col("id") * 7 % 200)  # sixty events at one time
    return spark.range(160).select(F.timestamp_seconds(1_700_000_000 + times).alias("@timestamp"), F.col("id").alias("_seq"))


def batches(stream, folder):
    seen = []

    def put(df, n):
        rows = df.collect()
        if rows:
            seen.append(rows)

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination()
    return seen


def test_batches_in_time_order(table, tmp_path):
    seen = batches(run.paced(table, str(tmp_path / "a"), files=4), str(tmp_path / "c"))
    assert 2 <= len(seen) <= 4 and sorted(r["_seq"] for b in seen for r in b) == list(range(160))
    edges = [(min(r["@timestamp"] for r in b), max(r["@timestamp"] for r in b)) for b in seen]
    assert all(a[1] < b[0] for a, b in zip(edges, edges[1:]))


def test_first_events_only_and_none(table, tmp_path):
    seen = batches(run.paced(table, str(tmp_path / "a"), files=3, limit=20), str(tmp_path / "c"))
    expected = sorted(table.collect(), key=lambda r: (r["@timestamp"], r["_seq"]))[:20]
    assert sorted(r["_seq"] for b in seen for r in b) == sorted(r["_seq"] for r in expected)
    assert batches(run.paced(table.limit(0), str(tmp_path / "b"), files=3), str(tmp_path / "d")) == []


def test_more_batches_for_more_rows(table, tmp_path, monkeypatch):
    monkeypatch.setattr(run, "BATCH_ROWS", 20)
    assert len(batches(run.paced(table, str(tmp_path / "a"), files=1), str(tmp_path / "c"))) >= 4


def test_pace(table, tmp_path):
    """All ranges come in the end, and not before their time."""
    folder, spark = str(tmp_path / "a"), table.sparkSession
    began = time.monotonic()
    run.paced(table, folder, files=3, speed=40.0)
    while spark.read.schema(table.schema).parquet(f"{folder}/in").count() < 160 and time.monotonic() - began < 60:
        time.sleep(0.2)
    assert 2 < time.monotonic() - began < 60
