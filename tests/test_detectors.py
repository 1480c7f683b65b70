"""Detectors on made-up events against plain loops, with their evidence."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchmere.operators import detect, segments, sequence, stateful
from watchmere.sources import rulebook

START = dt.datetime(2026, 3, 2, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def made():
    """Bursts of logins of a hot address and some others, many at the same instant."""
    rng, at, rows = random.Random(5), 0, []
    for i in range(6000):
        at += rng.choice([0, 0, 1, 5, 20, 90] if i % 400 else [4000])
        ip = "192.0.2.1" if rng.random() < 0.5 else f"192.0.2.{rng.randrange(2, 7)}"
        rows.append((i, START + dt.timedelta(seconds=at), ip, "success" if rng.random() < 0.12 else "failure", rng.choice(["ann", "bob", "cy", "dee", None])))
    return rows


@pytest.fixture(scope="module")
def logins(spark, made):
    df = spark.createDataFrame(made, "_seq long, ts timestamp, ip string, outcome string, user string").repartition(5)
    return df.select(
        F.struct(F.lit("f").alias("file"), F.col("_seq").alias("at")).alias("_seq"), F.col("ts").alias("@timestamp"), F.struct("ip").alias("source"), F.struct(F.lit("authentication").alias("category"), "outcome").alias("event"),
        F.struct(F.col("user").alias("name")).alias("user"), F.struct(F.lit("h").alias("name")).alias("host"),
    )


def stamp(ts):
    return ts.strftime("%H:%M:%S")


@pytest.mark.parametrize("rows", [segments.ROWS, 1000, 150])
def test_success_after_failures(logins, made, rows):
    want, kept = [], {}
    for _, ts, ip, outcome, user in made:
        mine = [f for f in kept.get(ip, []) if ts - f[0] <= dt.timedelta(minutes=2)]
        if outcome == "failure":
            mine.append((ts, user))
        elif len(mine) >= 5:
            tried = len({str(u) for _, u in mine})
            want.append((ip, ts.replace(tzinfo=None), len(mine) + 1, tried, [(str(u), stamp(t)) for t, u in mine[-4:]] + [(str(user), stamp(ts))]))
            mine = []
        kept[ip] = mine
    got = []
    for r in stateful.success_after_failures(logins, threshold=5, minutes=2, rows=rows).collect():
        tried = int(r["description"].split(" failures against ")[1].split()[0])
        parts = [e.split(": ", 1)[1].split(" at ") for e in r["evidence"]]
        got.append((r["entity"], r["ts"], r["event_count"], tried, [(u, t) for u, t in parts]))
    trim = lambda rows: sorted((ip, n, tried, [(u, t[-8:]) for u, t in ev]) for ip, _, n, tried, ev in rows)
    assert len(want) > 50 and trim(got) == trim(want)


@pytest.mark.parametrize("distinct", [None, "user.name"])
def test_thresholds(logins, made, distinct):
    count, window = 5, 120
    hits, want = {}, []
    for row in made:
        if row[3] == "failure":
            hits.setdefault((row[2], row[4]) if not distinct else (row[2],), []).append(row)
    for group, rows in hits.items():
        for i, row in enumerate(rows):
            near = [r for r in rows[: i + 1] if (row[1] - r[1]).total_seconds() <= window]
            if len({str(r[4]) for r in near} if distinct else near) >= count:
                want.append((group[0], len(rows), [f"user.name={r[4]}" if r[4] else "" for r in rows[:5]]))
                break
    limit = {"group_by": ["source.ip"] if distinct else ["source.ip", "user.name"], "count": count, "window": f"{window}s"} | ({"distinct": distinct} if distinct else {})
    rule = rulebook.rule({"id": "r", "level": "low", "detection": {"selection": {"event.outcome": "failure"}, "threshold": limit, "condition": "selection"}, "evidence_fields": ["user.name"]})
    got = [(r["entity"], r["event_count"], r["evidence"]) for r in detect.thresholds(logins, [rule]).collect()]
    assert 0 < len(want) < len(hits)
    assert sorted((e, n, [x if x else "" for x in ev]) for e, n, ev in got) == sorted(want)


@pytest.mark.parametrize("cut", [segments.ROWS, 300, 20])
def test_chains_of_three(spark, cut):
    rng, at, rows = random.Random(8), 0, []
    for i in range(1500):
        at += rng.choice([0, 3, 30, 200])
        rows.append((i, START + dt.timedelta(seconds=at), rng.choice(["a", "b", "hot", "hot", "hot"]), rng.choice(["look", "peek", "push", "take", "other"])))
    stages, want, state = [["look", "peek"], ["push"], ["take"]], [], {}
    for i, ts, who, rule_id in rows:
        chain = state.get(who, [])
        if rule_id in stages[len(chain)]:
            if chain and (ts - chain[0][1]).total_seconds() > 600:
                chain = []
            else:
                chain = [*chain, (i, ts, rule_id)]
                if len(chain) == 3:
                    want.append((who, [f"{stamp(t)} [low] {r}" for _, t, r in chain]))
                    chain = []
        state[who] = chain
    df = spark.createDataFrame(rows, "i long, ts timestamp, entity string, rule_id string").repartition(4)
    alerts = df.select(
        "ts", "entity", "rule_id", F.col("rule_id").alias("rule_name"), F.lit("low").alias("severity"), F.lit("ip").alias("entity_type"), F.lit(1).cast("long").alias("event_count"),
        F.struct(F.lit("x").alias("c")).alias("context"), F.lit(0).alias("stage_ord"), F.lit(0).alias("rule_ord"), F.struct(F.col("ts").alias("t"), F.col("i").alias("s")).alias("emit"),
    )
    rule = rulebook.sequence({"id": "c", "title": "C", "sequence": {"ordered": True, "within": "10m", "stages": [{"name": str(k), "rule_id": s} for k, s in enumerate(stages)]}})
    got = [(r["entity"], r["evidence"]) for r in sequence.chains(alerts, rule, rows=cut).collect()]
    assert len(want) > 20 and sorted(got) == sorted(want)
    assert sequence.chains(alerts.limit(0), rule).count() == 0


@pytest.mark.parametrize("rows", [segments.ROWS, 400, 60])
def test_escalation_after_login(logins, made, rows):
    """Successes of some addresses are external logins, failures are privileged actions."""
    far = F.col("source.ip").isin("192.0.2.1", "192.0.2.3")
    events = logins.withColumns({"source": F.col("source").withField("internal", ~far), "event": F.col("event").withField("action", F.when(F.col("event.outcome") == "failure", "sudo"))})
    want, open_ = [], {}
    for _, ts, ip, outcome, user in made:
        if user and outcome == "success" and ip in ("192.0.2.1", "192.0.2.3"):
            open_[user] = (ts, ip)
        elif user and outcome == "failure" and user in open_:
            at, address = open_.pop(user)
            if (ts - at).total_seconds() <= 120:
                want.append((address, user, stamp(ts), stamp(at)))
    got = [(r["entity"], r["description"].split("'")[1], r["ts"].strftime("%H:%M:%S"), r["evidence"][0][-8:]) for r in stateful.escalation_after_login(events, minutes=2, rows=rows).collect()]
    assert len(want) > 50 and sorted(got) == sorted(want)


def test_hot_keys_are_cut(spark):
    """One key has half of all rows, in order of nothing; its segments are within twice the wanted size, and the carried sums are exact."""
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"), (F.col("id") * 7_000_000).alias("us"), F.lit(1).alias("n"))
    cuts = segments.hot(df, "key", rows=500)
    assert [r["key"] for r in cuts.collect()] == ["hot"]
    cut = segments.segmented(df, "key", cuts)
    sizes = {(r["key"], r["seg"]): r["count"] for r in cut.groupBy("key", "seg").count().collect()}
    assert sum(sizes.values()) == 20_000 and max(sizes.values()) <= 1000 and sum(k == "hot" for k, _ in sizes) >= 19
    assert max(v for (k, _), v in sizes.items() if k == "hot") <= 2 * sorted(sizes.values())[len(sizes) // 2]
    parts = cut.filter("key = 'hot'").groupBy("key", "seg").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("key", "seg").orderBy("us"))
    whole = F.row_number().over(Window.partitionBy("key").orderBy("us"))
    rows = cut.filter("key = 'hot'").join(segments.carried(parts, "key", {"before": F.sum("n")}), ["key", "seg"]).select((total + F.coalesce("before", F.lit(0))).alias("a"), whole.alias("b"))
    assert rows.filter("a <> b").count() == 0
    assert segments.hot(df, "key", rows=10_000) is None


def test_segments_are_found_by_bits(spark):
    """Segments follow each other in time and hold what they should, with thousands of cuts, crowded minutes, gaps and times before 1970; no row goes through a list of cuts."""
    rng, minute, rows = random.Random(3), -70_000, []
    for _ in range(3000):
        minute += rng.choice([1, 1, 1, 2, 63, 64, 65, 1000])
        rows += [("hot", minute * segments.MINUTE + rng.randrange(segments.MINUTE), minute)] * rng.choice([1, 2, 5, 40])
    rows += [("cold", m, 0) for m in range(10)] + [(None, 5, 0)] * 30 + [("odd", None, 0)]
    df = spark.createDataFrame(rows, "key string, us long, minute int").repartition(4)
    cut = segments.segmented(df, "key", segments.hot(df, "key", rows=10))
    assert "lambda" not in cut._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in cut.select("key", "us", "minute", "seg").collect()]
    assert sorted(map(str, (r[:3] for r in got))) == sorted(map(str, rows))
    assert {seg for key, _, _, seg in got if key != "hot"} == {0}
    sizes, seg_of = {}, {}
    for key, _, at, seg in got:
        if key == "hot":
            sizes[seg] = sizes.get(seg, 0) + 1
            assert seg_of.setdefault(at, seg) == seg
    order = [seg_of[m] for m in sorted(seg_of)]
    assert order == sorted(order) and len(sizes) > 1000 and max(sizes.values()) <= 10 + 40
