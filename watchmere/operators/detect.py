"""Detection rules as plans: every rule is a Column, and all rules share one scan.

Conditions are folded strictly from left to right, as the rule language has it.
Stateless rules: each event is tagged with its matches, which are exploded.
Threshold rules: their hits go through one shuffle by rule, group and stretch of
time.  A hit stands in its own stretch (as long as the rule's window) and, as
context, in the next, so every window lies in one stretch and a hot group is
spread over as many tasks as it has stretches.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fields import context, resolve, shown
from ..functions.predicates import rule_match
from ..functions.text import show_duration
from ..sources.rulebook import Rule
from . import alerts as A
from . import ruleindex
from .ruleindex import MESSAGE, sort

EVIDENCE = 5
#: More rules than this are rows that an index proposes, and no longer expressions of the plan.
MANY = 100
HIT = ("rule_ord", "entity", "entity_type", "evidence", "group", "value")


def block(df: DataFrame, fields: dict) -> Column:
    """All keys of a block hold; of a list one value must match, with |all every value."""
    if not fields:
        return F.lit(False)
    tests = []
    for key, expected in fields.items():
        field, *modifiers = key.split("|")
        every = "all" in modifiers
        modifier = next((m for m in modifiers if m != "all"), None)
        values = expected if isinstance(expected, list) else [expected]
        parts = [rule_match(df, field, modifier, v) for v in values]
        tests.append(reduce(lambda a, b: a & b if every else a | b, parts) if parts else F.lit(every))
    return reduce(lambda a, b: a & b, tests)


def terms(rule: Rule) -> list[tuple[bool, bool, bool, list[str]]]:
    """A condition's terms: joined to those before by and (else or), negated, all of its blocks (else one), and the blocks' names."""
    names = [name for name, fields in rule.blocks.items() if isinstance(fields, dict)]
    words = rule.condition.split()
    found, both, negate, i = [], True, False, 0
    while i < len(words):
        word = words[i].lower()
        if word in ("and", "or"):
            both = word == "and"
        elif word == "not":
            negate = not negate
        else:
            if word in ("all", "1", "any") and i + 2 < len(words) and words[i + 1].lower() == "of":
                prefix = words[i + 2].rstrip("*")
                found.append((both, negate, word == "all", [n for n in names if prefix == "them" or n.startswith(prefix)]))
                i += 2
            else:
                found.append((both, negate, False, [words[i]] if words[i] in names else []))
            negate = False
        i += 1
    return found


def condition(df: DataFrame, rule: Rule) -> Column:
    """A rule's condition: terms joined by and / or from left to right, ``not``, ``all of p*``, ``1 of p*``."""
    blocks = {name: block(df, fields) for name, fields in rule.blocks.items() if isinstance(fields, dict)}
    result = None
    for both, negate, every, names_ in terms(rule):
        term = reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), [blocks[n] for n in names_], F.lit(every))
        term = ~term if negate else term
        result = term if result is None else result & term if both else result | term
    return F.lit(False) if result is None else result


def entity(df: DataFrame, field: str) -> tuple[Column, Column]:
    """Entity and its type: the rule's field, else host.name, else user.name, else unattributed."""
    own = F.nullif(F.nullif(resolve(df, field).cast("string"), F.lit("")), F.lit("-"))
    choices = [(own, field)] + [(F.nullif(resolve(df, f).cast("string"), F.lit("")), f) for f in ("host.name", "user.name")]
    kinds = [F.when(c.isNotNull(), F.lit(sort(f))) for c, f in choices]
    return F.coalesce(*[c for c, _ in choices], F.lit("unattributed")), F.coalesce(*kinds, F.lit(sort(field)))


def evidence(df: DataFrame, fields: list[str]) -> Column:
    """f=v of the fields that have a value, else the start of the message."""
    parts = F.concat_ws(" ", *[F.when(resolve(df, f).isNotNull(), F.concat(F.lit(f"{f}="), shown(df, f))) for f in fields])
    return F.when(parts != "", parts).otherwise(F.substring(F.coalesce(resolve(df, "message").cast("string"), F.lit("")), 1, MESSAGE))


def tagged(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """events with ``rules``: ids of the rules whose condition holds, in order."""
    if not rules:
        return events.withColumn("rules", F.array().cast("array<string>"))
    return events.withColumn("rules", F.array_compact(F.array(*[F.when(condition(events, r), F.lit(r.id)) for r in rules])))


def _meta(rules: list[tuple[int, Rule]], pick, type_: str) -> Column:
    """A property of the row's rule, from a literal by rule_ord; of many rules from one literal array."""
    if len(rules) > MANY:
        values = [None] * (1 + max(i for i, _ in rules))
        for i, r in rules:
            values[i] = pick(r)
        return F.from_json(F.lit(json.dumps(values)), f"array<{type_}>")[F.col("rule_ord")]
    literal = lambda v: F.array(*[F.lit(t) for t in v]) if isinstance(v, list) else F.lit(v)
    return F.create_map(*[x for i, r in rules for x in (F.lit(i), literal(pick(r)).cast(type_))])[F.col("rule_ord")]


def _hits(events: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """A row for each event and rule whose condition holds of it."""
    if len(rules) > MANY:
        return ruleindex.hits(events, rules, terms)

    def cell(i: int, r: Rule) -> Column:
        who, sort = entity(events, r.entity)
        t = r.threshold
        return F.when(condition(events, r), F.struct(
            F.lit(i).alias("rule_ord"), who.alias("entity"), sort.alias("entity_type"), evidence(events, r.evidence_fields).alias("evidence"),
            (F.to_json(F.array(*[shown(events, f) for f in t.group_by])) if t else F.lit(None).cast("string")).alias("group"),
            (shown(events, t.distinct) if t and t.distinct else F.lit(None).cast("string")).alias("value"),
        ))

    first = F.struct(context(events).alias("context"), resolve(events, "honeypot").cast("boolean").alias("first_honeypot"), resolve(events, "event.business_hours").cast("boolean").alias("first_business_hours"))
    cells = F.array_compact(F.array(*[cell(i, r) for i, r in rules]))
    # the context goes through the generator whole: pruned to single fields around it, the optimizer loses their struct
    carried = events.select(F.col("`@timestamp`").alias("ts"), F.col("_seq").alias("seq"), first.alias("first"), cells.alias("cells"))
    return carried.select(F.explode(F.transform("cells", lambda c: F.struct(F.col("ts"), F.col("seq"), F.col("first"), *[c[f].alias(f) for f in HIT]))).alias("h")).select("h.*")


def _alerts(df: DataFrame, rules: list[tuple[int, Rule]], description) -> DataFrame:
    severity = _meta(rules, lambda r: r.level, "string")
    return df.select(
        _meta(rules, lambda r: r.id, "string").alias("rule_id"), _meta(rules, lambda r: r.title, "string").alias("rule_name"), severity.alias("severity"),
        "ts", "entity", "entity_type", _meta(rules, description, "string").alias("description"),
        _meta(rules, lambda r: r.tags, "array<string>").alias("tags"),
        "evidence", F.col("event_count").cast("long").alias("event_count"), F.col("first.context").alias("context"), F.col("first.first_honeypot").alias("first_honeypot"), F.col("first.first_business_hours").alias("first_business_hours"),
        A.score(severity).alias("base_score"), F.lit(A.ATOMIC).alias("stage_ord"), "rule_ord", F.struct(F.col("ts").alias("t"), F.col("seq").alias("s")).alias("emit"),
    )


def stateless(events: DataFrame, rules: list[Rule]) -> DataFrame | None:
    """One alert per event and matching rule without a threshold."""
    chosen = [(i, r) for i, r in enumerate(rules) if not r.threshold]
    if not chosen:
        return None
    hits = _hits(events, chosen).withColumns({"evidence": F.array("evidence"), "event_count": F.lit(1)})
    return _alerts(hits, chosen, lambda r: r.description or r.title)


def _stretches(hits: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """hits in the stretches they stand in: us, w, b, and ``hit``, which only a hit's own row holds.  One shuffle."""
    window = _meta(rules, lambda r: round(r.threshold.window * 1_000_000), "long")
    whole = F.struct("ts", "seq", "entity", "entity_type", "evidence", "first")
    placed = hits.select("rule_ord", "group", "value", "seq", F.unix_micros("ts").alias("us"), F.greatest(window, F.lit(1)).alias("w"), whole.alias("hit"))
    placed = placed.withColumn("k", F.floor(F.col("us") / F.col("w"))).withColumn("b", F.explode(F.array("k", F.col("k") + 1)))
    return placed.withColumn("hit", F.when(F.col("b") == F.col("k"), F.col("hit"))).drop("k").repartition("rule_ord", "group", "b")


def _present(placed: DataFrame, distinct: Column) -> DataFrame:
    """placed with ``present``: how many values of a distinct rule's group lie in the window that ends here.

    A value enters with a hit that no equal one precedes within the window, and
    leaves a window after a hit that no equal one follows within it; the running
    sum of both counts the values without keeping a set.
    """
    same = Window.partitionBy("rule_ord", "group", "b", "value").orderBy("us", "seq")
    enters = F.coalesce(F.col("us") - F.lag("us").over(same) > F.col("w"), F.lit(True)).cast("int")
    leaves = distinct & F.coalesce(F.lead("us").over(same) - F.col("us") > F.col("w"), F.lit(True))
    moved = placed.withColumns({"enters": enters, "leaves": leaves}).withColumn("leaving", F.explode(F.when(F.col("leaves"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    gone = F.col("leaving") == 1
    moved = moved.withColumns({"hit": F.when(~gone, F.col("hit")), "us": F.col("us") + F.when(gone, F.col("w")).otherwise(0), "change": F.when(gone, -1).otherwise(F.col("enters"))})
    order = Window.partitionBy("rule_ord", "group", "b").orderBy("us", "leaving", "seq")
    return moved.withColumn("present", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def grouped(hits: DataFrame, rules: list[tuple[int, Rule]], measured: bool = False) -> DataFrame:
    """rule_ord, event_count, evidence and the first hit's columns of the groups that reach their rule's threshold.

    measured: of all groups of the one rule, with ``most``, the greatest number that a
    window of theirs holds: whatever the threshold, a group reaches it if this does.

    hits are evaluated once.  Each stretch of a group becomes one row of bounded
    size (its count, first hit, first evidence and whether a window that ends in it
    reaches the threshold); those rows make up the group.
    """
    placed, reached = _stretches(hits, rules), F.lit(False)
    wide = [(i, r.threshold.count) for i, r in rules if r.threshold.distinct]
    leaving = []
    if wide:
        placed, leaving = _present(placed, F.col("rule_ord").isin([i for i, _ in wide])), ["leaving"]
    order = Window.partitionBy("rule_ord", "group", "b").orderBy("us", *leaving, "seq")
    for n in sorted({n for _, n in wide}):
        reached = reached | (F.col("rule_ord").isin([i for i, m in wide if m == n]) & (F.col("present") >= n))
    for n in sorted({r.threshold.count for _, r in rules if not r.threshold.distinct}):
        mine = [i for i, r in rules if not r.threshold.distinct and r.threshold.count == n]
        before = F.lag("us", n - 1).over(order) if n > 1 else F.col("us")
        reached = reached | (F.col("rule_ord").isin(mine) & (F.col("us") - before <= F.col("w")))
    if measured:
        (_, rule_), = rules
        near = Window.partitionBy("rule_ord", "group", "b").orderBy("us").rangeBetween(-round(rule_.threshold.window * 1_000_000), 0)
        placed = placed.withColumn("most", F.col("present") if wide else F.count(F.lit(1)).over(near))
    most = [F.max("most").alias("most")] if measured else []
    counted = placed.withColumns({"reached": F.coalesce(reached, F.lit(False)), "n": F.count("hit").over(order.rowsBetween(Window.unboundedPreceding, 0))}).filter(F.col("hit").isNotNull())
    cell = F.struct("n", F.col("hit.evidence").alias("evidence"))
    stretches = counted.groupBy("rule_ord", "group", "b").agg(
        F.count("*").alias("event_count"), F.max("reached").alias("reached"), F.min_by("hit", "n").alias("f"), *most,
        F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= EVIDENCE, cell))), lambda x: x["evidence"]).alias("evidence"),
    )
    # the first hits of a group lie in its first stretches
    early = F.row_number().over(Window.partitionBy("rule_ord", "group").orderBy("b")) <= EVIDENCE
    shown_ = F.array_sort(F.collect_list(F.when(F.col("early"), F.struct("b", "evidence"))))
    groups = stretches.withColumn("early", early).groupBy("rule_ord", "group").agg(
        F.sum("event_count").alias("event_count"), F.max("reached").alias("reached"), F.min_by("f", "b").alias("f"), *most,
        F.slice(F.flatten(F.transform(shown_, lambda x: x["evidence"])), 1, EVIDENCE).alias("evidence"),
    )
    found = groups if measured else groups.filter("reached")
    return found.select("rule_ord", "event_count", "evidence", *(["most"] if measured else []), *[F.col(f"f.{c}").alias(c) for c in ("ts", "seq", "entity", "entity_type", "first")])


def thresholds(events: DataFrame, rules: list[Rule]) -> DataFrame | None:
    """One alert per group that reaches a rule's threshold: its first event's time, entity and context, and the whole group's count."""
    chosen = [(i, r) for i, r in enumerate(rules) if r.threshold]
    if not chosen:
        return None
    return _alerts(grouped(_hits(events, chosen), chosen), chosen, _measure)


def _measure(r: Rule) -> str:
    t = r.threshold
    measure = f"{t.count} distinct {t.distinct}" if t.distinct else f"{t.count} events"
    return f"{r.description or r.title} ({measure} within {show_duration(t.window)})"


def run(events: DataFrame, rules: list[Rule]) -> DataFrame | None:
    """Alerts of all rules; None if there are none."""
    parts = [p for p in (stateless(events, rules), thresholds(events, rules)) if p is not None]
    return A.union(parts) if parts else None


def sweep(events: DataFrame, rule: Rule, counts: list[int]) -> DataFrame:
    """Alerts of a threshold rule at several counts: column ``at`` beside the alert.

    Hits are found and grouped once; the greatest number in any window of a group
    tells which counts it reaches.
    """
    import dataclasses

    groups = grouped(_hits(events, [(0, rule)]), [(0, rule)], measured=True)
    variants = [(i, dataclasses.replace(rule, threshold=dataclasses.replace(rule.threshold, count=n))) for i, n in enumerate(counts)]
    reached = F.array_compact(F.array(*[F.when(F.col("most") >= n, F.lit(i)) for i, n in enumerate(counts)]))
    found = _alerts(groups.withColumn("rule_ord", F.explode(reached)), variants, _measure)
    return found.select(F.element_at(F.array(*[F.lit(n) for n in counts]), F.col("rule_ord") + 1).alias("at"), *[F.lit(0).alias(c) if c == "rule_ord" else c for c in A.COLUMNS])


def names(rules: list[Rule]) -> dict[str, str]:
    return {r.id: re.sub(r"\s+", " ", r.title) for r in rules}
