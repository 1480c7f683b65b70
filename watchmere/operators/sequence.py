"""Sequence correlation: chains of alerts of one entity, ordered or not."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.rulebook import Sequence
from . import alerts as A
from . import segments

CHAIN_SCORE = 95


def _key(rule: Sequence) -> str:
    return rule.group_by if rule.group_by in A.COLUMNS else "entity"


class Fold:
    """One entity's segment of alerts in time order: when each was, and which stages it fits (bits).

    A state is the chain begun: (us, seg, place) of each alert taken.
    """

    def __init__(self, seg: int, places: list[int], us: list[int], fits: list[int], stages: int, span: int):
        self.seg, self.places, self.us, self.fits, self.stages, self.span = seg, places, us, fits, stages, span

    def item(self, i: int) -> list[int]:
        return [self.us[i], self.seg, self.places[i]]

    def walk(self, state: list, begin: int = 0, done: list | None = None) -> list:
        """The state after the rows from begin on; completed chains go to done."""
        state, us, fits, span = list(state), self.us, self.fits, self.span
        for i in range(begin, len(us)):
            if not fits[i] >> len(state) & 1:
                continue
            if state and us[i] - state[0][0] > span:
                state = []
                continue
            state.append(self.item(i))
            if len(state) == self.stages:
                if done is not None:
                    done.append(state)
                state = []
        return state

    def effect(self) -> list:
        """What the segment does to a state, by the number of alerts it has.

        The first entry is the state that follows an empty one.  For others: when each
        further stage is first met, a chain begun before the limit is dropped there and what
        follows is known; else the chain goes on, and what follows its end is known, or it
        is still open with these alerts more.
        """
        ends: dict[int, list] = {}

        def after(i: int) -> list:
            if i not in ends:
                ends[i] = self.walk([], i)
            return ends[i]

        out: list = [after(0)]
        for k in range(1, self.stages):
            drops, more, i = [], [], 0
            for m in range(k, self.stages):
                while i < len(self.us) and not self.fits[i] >> m & 1:
                    i += 1
                if i == len(self.us):
                    break
                drops.append([self.us[i] - self.span, after(i + 1)])
                more.append(self.item(i))
                i += 1
            out.append([drops, more, after(i) if len(more) == self.stages - k else None])
        return out


def _follow(state: list, effect: list) -> list:
    """The state after a segment of this effect."""
    if not state:
        return effect[0]
    drops, more, end = effect[len(state)]
    for limit, then in drops:
        if state[0][0] < limit:
            return then
    return state + more if end is None else end


def _folds(batches, stages: int, span: int):
    """(key, fold, start) of every segment; rows come sorted by key, segment and place, and a segment is as long as the cuts allow."""
    at, rows = None, []
    for batch in batches:
        for key, seg, place, us, fits, start in zip(*(batch[c] for c in ("k", "seg", "place", "us", "fits", "start"))):
            if at is not None and (key, seg) != at[:2]:
                yield at[0], Fold(at[1], *map(list, zip(*rows)), stages, span), at[2]
                rows = []
            at = (key, seg, start)
            rows.append((place, us, fits))
    if rows:
        yield at[0], Fold(at[1], *map(list, zip(*rows)), stages, span), at[2]


def _effects(stages: int, span: int):
    def walk(batches):
        for key, fold, _ in _folds(batches, stages, span):
            yield pd.DataFrame({"k": [key], "seg": [fold.seg], "effect": [json.dumps(fold.effect())]})

    return walk


def _composed(batches):
    """k, seg, start: the state that each segment begins with; segments come sorted by key, a row each."""
    key, state = None, []
    for batch in batches:
        starts = []
        for k, effect in zip(batch["k"], batch["effect"]):
            if k != key:
                key, state = k, []
            starts.append(json.dumps(state))
            state = _follow(state, json.loads(effect))
        yield batch[["k", "seg"]].assign(start=starts)


def _taken(stages: int, span: int):
    """k, seg, place of the alerts that complete chains, with the place of each one's last."""

    def walk(batches):
        for key, fold, start in _folds(batches, stages, span):
            done: list = []
            fold.walk(json.loads(start) if start else [], done=done)
            rows = [(key, seg, place, *chain[-1][1:]) for chain in done for _, seg, place in chain]
            if rows:
                yield pd.DataFrame(rows, columns=["k", "seg", "place", "end_seg", "end_place"])

    return walk


def _ordered(used: DataFrame, rule: Sequence, span: int, cell: list[str], rows: int) -> DataFrame:
    """key and c, the alerts of each completed chain in order."""
    fits = reduce(lambda a, b: a + b, [F.when(F.col("rule_id").isin(stage), 1 << i).otherwise(0) for i, stage in enumerate(rule.stages)])
    used = used.withColumns({"fits": fits, "k": F.coalesce(F.concat(F.lit("="), "key"), F.lit(""))}).filter("fits > 0")
    cuts = segments.hot(used.select("k", "us"), "k", rows=rows)
    placed = segments.segmented(used, "k", cuts)
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("k", "seg").orderBy("ts", "ord", "rule_id")).cast("long"))
    narrow = placed.select("k", "seg", "place", "us", "fits")
    order = lambda df: df.repartition("k", "seg").sortWithinPartitions("k", "seg", "place")
    if cuts is None:
        narrow = narrow.withColumn("start", F.lit(None).cast("string"))
    else:
        mine = narrow.join(cuts.select("k"), "k", "left_semi").withColumn("start", F.lit(None).cast("string"))
        effects = order(mine).mapInPandas(_effects(len(rule.stages), span), "k string, seg int, effect string")
        starts = effects.repartition("k").sortWithinPartitions("k", "seg").mapInPandas(_composed, "k string, seg int, start string")
        narrow = narrow.join(starts, ["k", "seg"], "left")
    taken = order(narrow).mapInPandas(_taken(len(rule.stages), span), "k string, seg int, place long, end_seg int, end_place long")
    links = placed.join(taken, ["k", "seg", "place"])
    return links.groupBy("k", "end_seg", "end_place").agg(F.first("key").alias("key"), F.array_sort(F.collect_list(F.struct(*cell))).alias("c")).select("key", "c")


def chains(alerts: DataFrame, rule: Sequence, order: int = 0, rows: int = segments.ROWS) -> DataFrame:
    """Chain alerts of one sequence rule.

    Ordered: alerts of an entity in time order; one that fits the current stage is
    taken, unless it comes later than the limit after the first taken, which drops
    the chain and that alert with it; the last stage completes a chain and the next
    begins afresh.  Unordered: if no ordered chain is left complete, every stage
    must have an alert among the entity's, all of which must lie within the limit.

    The state is the chain begun.  An entity of more than ``rows`` alerts is cut into
    time segments: each tells what it does to any state, which is a few outcomes for each
    stage, these are composed in order, and the segments then run side by side.  Only an
    unordered chain is as long as its entity has alerts, as its evidence is.
    """
    span = round(rule.within * 1_000_000)
    cell = ["ts", "ord", "rule_id", "rule_name", "severity", "entity_type", "event_count", "context"]
    used = alerts.select(F.col(_key(rule)).cast("string").alias("key"), F.unix_micros("ts").alias("us"), F.struct("stage_ord", "rule_ord", "emit").alias("ord"), *[c for c in cell if c != "ord"])
    found = _ordered(used, rule, span, cell, rows)
    if not rule.ordered:
        # which entities qualify is told by aggregates; only theirs are put together
        every = [F.max(F.col("rule_id").isin(stage)).alias(f"s{i}") for i, stage in enumerate(rule.stages)]
        whole = used.groupBy("key").agg(F.min("us").alias("begins"), F.max("us").alias("ends"), *every).filter(F.col("ends") - F.col("begins") <= span)
        for i in range(len(rule.stages)):
            whole = whole.filter(f"s{i}")
        has = found.select(F.col("key").alias("other"))
        whole = whole.join(has, F.col("key").eqNullSafe(F.col("other")), "left_anti").select(F.col("key").alias("other"))
        rest = used.join(whole, F.col("key").eqNullSafe(F.col("other")), "left_semi")
        found = found.unionByName(rest.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*cell))).alias("c")))
    found = found.withColumnRenamed("key", "entity")
    last, first = F.element_at("c", -1), F.element_at("c", 1)
    mins = F.floor((F.unix_micros(last["ts"]) - F.unix_micros(first["ts"])) / 60_000_000)
    return found.select(
        F.lit(rule.id).alias("rule_id"), F.lit(rule.title).alias("rule_name"), F.lit(rule.level).alias("severity"), last["ts"].alias("ts"), F.col("entity").cast("string").alias("entity"), first["entity_type"].alias("entity_type"),
        F.concat(F.lit(f"{rule.description} Chain of "), F.size("c").cast("string"), F.lit(" stages completed in "), mins.cast("string"), F.lit(" minutes.")).alias("description"),
        F.array(*[F.lit(t) for t in rule.tags]).cast("array<string>").alias("tags"),
        F.transform("c", lambda x: F.concat(F.date_format(x["ts"], "HH:mm:ss"), F.lit(" ["), x["severity"], F.lit("] "), x["rule_name"])).alias("evidence"),
        F.aggregate("c", F.lit(0).cast("long"), lambda acc, x: acc + x["event_count"]).alias("event_count"), first["context"].alias("context"),
        F.lit(None).cast("boolean").alias("first_honeypot"), F.lit(None).cast("boolean").alias("first_business_hours"),
        F.lit(CHAIN_SCORE).alias("base_score"), F.lit(A.CHAIN).alias("stage_ord"), F.lit(order).alias("rule_ord"), last["ord"]["emit"].alias("emit"),
    )


def run(alerts: DataFrame, rules: list[Sequence]) -> DataFrame | None:
    """Chain alerts of all sequence rules over alerts as they were before dedup."""
    return reduce(DataFrame.unionByName, [chains(alerts, r, i) for i, r in enumerate(rules)]) if rules else None
