"""Detections over streams of events: the batch rules' Columns, with keyed state where a rule looks back.

The watermark trails the newest event by the horizon: the longest window of the rules,
half an hour at least, and some slack.  A group's state goes when the watermark passes
its last event by the horizon; events older than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.fields import resolve
from ..functions.text import fingerprint
from ..operators import alerts as A
from ..operators import detect
from ..sources.rulebook import Rule

SLACK_MINUTES, LEAST_MINUTES = 5, 30
FIRED = "rule_id string, entity string, ts timestamp, event_count long"


def horizon(rules: list[Rule]) -> float:
    """Seconds that the state looks back: the longest window, half an hour at least, and some slack."""
    return max([LEAST_MINUTES * 60, *[r.threshold.window for r in rules if r.threshold]]) + SLACK_MINUTES * 60


def _expires(state: GroupState, last_us: int, seconds: float) -> None:
    """Let the state go when the watermark passes its last event by so many seconds."""
    state.setTimeoutTimestamp(max(int(last_us // 1000 + seconds * 1000), state.getCurrentWatermarkMs() + 1))


def stateless(events: DataFrame, rules: list[Rule]) -> DataFrame | None:
    """Alerts of the rules without a threshold, one for each fingerprint within the watermark; None if there is no such rule."""
    found = detect.stateless(events, rules)
    if found is None:
        return None
    marked = found.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("entity"), F.col("ts")))
    return marked.withWatermark("ts", f"{int(horizon(rules))} seconds").dropDuplicatesWithinWatermark(["fingerprint"])


def thresholds(events: DataFrame, rules: list[Rule]) -> DataFrame | None:
    """rule_id, entity, ts, event_count: a group's alert at the event that reaches the threshold, once for each group.

    The state of a group is its hits inside the window, at most as many as the
    threshold for counts, and whether it has fired; after that, only the mark.
    """
    chosen = [(i, r) for i, r in enumerate(rules) if r.threshold]
    if not chosen:
        return None
    limits = {i: (r.id, r.threshold.count, round(r.threshold.window * 1_000_000), bool(r.threshold.distinct)) for i, r in chosen}
    back = horizon(rules)
    hits = detect._hits(events, chosen).withWatermark("ts", f"{int(back)} seconds").select("rule_ord", "group", "ts", "entity", F.coalesce("value", F.lit("None")).alias("value"), F.col("seq").cast("string").alias("seq"), F.unix_micros("ts").alias("us"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, count, window, distinct = limits[key[0]]
        if state.hasTimedOut:
            state.remove()
            return
        kept, fired = ([], False) if not state.exists else (list(zip(*state.get[:2])), state.get[2])
        rows = pd.concat(frames).sort_values(["us", "seq"], kind="stable")
        if not fired:
            for us, value, entity, ts in rows[["us", "value", "entity", "ts"]].itertuples(index=False):
                kept = [k for k in kept if us - k[0] <= window] + [(us, value)]
                if distinct:  # the latest hit of each value stands for it
                    kept = [(u, v) for v, u in {v: u for u, v in kept}.items()]
                if len(kept) >= count:
                    yield pd.DataFrame({"rule_id": [name], "entity": [entity], "ts": [ts], "event_count": [len(kept)]})
                    kept, fired = [], True
                    break
        state.update(([k[0] for k in kept], [k[1] for k in kept], fired))
        _expires(state, int(rows["us"].max()), back)

    return hits.groupBy("rule_ord", "group").applyInPandasWithState(step, FIRED, "us array<long>, value array<string>, fired boolean", "append", GroupStateTimeout.EventTimeTimeout)


def success_after_failures(events: DataFrame, threshold: int = 8, minutes: int = 10) -> DataFrame:
    """rule_id, entity, ts, event_count: a success after that many failures of its address within the window, which clears them.

    State: the times of an address's failures inside the window.
    """
    span = minutes * 60_000_000
    e = events.select(
        resolve(events, "source.ip").alias("ip"), F.col("`@timestamp`").alias("ts"), F.unix_micros("`@timestamp`").alias("us"), F.col("_seq").cast("string").alias("seq"),
        (resolve(events, "event.outcome") == "failure").alias("failed"), resolve(events, "event.category").alias("category"), resolve(events, "event.outcome").alias("outcome"),
    ).filter((F.col("category") == "authentication") & (F.col("ip") != "") & F.col("outcome").isin("failure", "success"))
    back = max(minutes, LEAST_MINUTES) * 60 + SLACK_MINUTES * 60
    e = e.withWatermark("ts", f"{back} seconds")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(frames).sort_values(["us", "seq"], kind="stable")
        for us, failed, ts in rows[["us", "failed", "ts"]].itertuples(index=False):
            kept = [k for k in kept if us - k <= span]
            if failed:
                kept.append(us)
            elif len(kept) >= threshold:
                yield pd.DataFrame({"rule_id": ["auth_success_after_failures"], "entity": [key[0]], "ts": [ts], "event_count": [len(kept) + 1]})
                kept = []
        state.update((kept,))
        _expires(state, int(rows["us"].max()), back)

    return e.select("ip", "ts", "us", "seq", "failed").groupBy("ip").applyInPandasWithState(step, FIRED, "us array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def detectors(events: DataFrame, rules: list[Rule]) -> dict[str, DataFrame]:
    """All detections of a stream as rows of the alert table, by detector: each with state needs a query of its own."""
    from .correlate import as_alerts

    plain = stateless(events, rules)
    found = {"stateless": None if plain is None else plain.drop("fingerprint")}
    for name, fired in (("thresholds", thresholds(events, rules)), ("logins", success_after_failures(events))):
        found[name] = None if fired is None else as_alerts(fired, rules)
    emit = F.struct(F.col("emit.t").alias("t"), F.unix_micros("emit.t").alias("s")).alias("emit")
    return {name: df.select(*A.COLUMNS[:-1], emit) for name, df in found.items() if df is not None}
