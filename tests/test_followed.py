"""Live risk and chains as keyed state: batches, repeated batches and late alerts against one batch and the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from watchmere.operators import sequence
from watchmere.plans import contract
from watchmere.session import shared
from watchmere.sources import rulebook
from watchmere.streaming import correlate

from .conftest import SMALL

RULE = rulebook.sequence(contract._CHAIN)


@pytest.fixture(scope="module")
def alerts(spark):
    return contract._raw(spark, SMALL).persist()


def _followed(spark, alerts, order, files):
    """What follows from alerts that arrive in this order, a file a batch, and the batches' numbers of rows."""
    folder = shared(spark)
    rows = [r for r in alerts.select("emit.s").collect()]
    rank = {r["s"]: k * files // len(rows) for k, r in enumerate(sorted(rows, key=order))}
    ranks = spark.createDataFrame(list(rank.items()), "s long, part int")
    placed = alerts.join(F.broadcast(ranks), F.col("emit.s") == F.col("s")).drop("s")
    for k in range(files):
        placed.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(alerts.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    sink = correlate.Correlator(f"{folder}/out", [RULE])
    query = sink.follow(stream).writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/run").trigger(availableNow=True).start()
    query.awaitTermination()
    history = spark.read.parquet(f"{folder}/out/history").collect()
    cases = {r["case_id"]: r["severity"] for r in spark.read.parquet(f"{folder}/out/cases").collect()}
    assert sink.status.alerts == len(history) and sorted(sink.status.cases) == sorted(cases)
    return history, cases


def test_batches_equal_one(spark, alerts):
    by_time = lambda r: r["s"]
    one, many = _followed(spark, alerts, by_time, 1), _followed(spark, alerts, by_time, 4)
    key = lambda h: sorted((r["kind"], r["rule_id"], r["entity"], r["ts"], r["event_count"], round(r["score"], 6)) for r in h)
    assert key(one[0]) == key(many[0]) and one[1] == many[1] and one[1]
    want = {(r["entity"], r["ts"].strftime("%Y%m%d%H")) for r in sequence.chains(alerts, RULE).collect()}
    assert want == {(r["entity"], r["ts"].strftime("%Y%m%d%H")) for r in many[0] if r["kind"] == "chain"}


def test_late_alerts_count(spark, alerts):
    """Alerts that come up to half a day late are neither dropped nor break chains; each counts once."""
    rng, at = random.Random(4), {r["s"]: r["t"].timestamp() for r in alerts.select("emit.s", F.col("emit.t").alias("t")).collect()}
    late = {s: t + rng.uniform(0, 43_200) for s, t in at.items()}
    history, _ = _followed(spark, alerts, lambda r: late[r["s"]], 5)
    whole, _ = _followed(spark, alerts, lambda r: r["s"], 1)
    kinds = lambda h, k: {(r["rule_id"], r["entity"], r["ts"].strftime("%Y%m%d%H")) for r in h if r["kind"] == k}
    assert kinds(history, "alert") == kinds(whole, "alert") and len(kinds(whole, "alert")) == sum(r["kind"] == "alert" for r in history)
    assert len(kinds(whole, "chain") - kinds(history, "chain")) <= 0.05 * len(kinds(whole, "chain"))
