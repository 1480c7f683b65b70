"""Rules as rows against rules as expressions, and what the index takes from texts and patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from watchmere.functions.fields import nested
from watchmere.operators import detect, ruleindex
from watchmere.sources import rulebook

WORDS = ["alpha", "Beta", "ALPHA beta", "kelvin", "Kelvin", "taıl", "İndex", "index", "paſs", "pass word", "a", "", "-", "12", "12.0", "1e1", "nan", "--x", "Straße", "déjà", None]
FIELDS = ["event.action", "user.name", "http.response.body.bytes", "source.internal", "message", "no.such.field"]
VALUES = [w for w in WORDS if w] + [12, 0, 7.5, True, False, None, "True", "[bc]eta", "pa(s|ss) ?w", "(?:al|be)[pt]h?a", "a|\\d+", "^index$", "k.lvin", "x{2,}|dex", "\\bta", ""]
MODIFIERS = ["", "", "", "|contains", "|startswith", "|endswith", "|re", "|gt", "|lte", "|contains|all", "|re|all", "|nosuch"]
CONDITIONS = ["a", "a", "a and b", "a or b", "a and not b", "not a", "a or not b and c", "all of them", "1 of b*", "a and 1 of them", "nothing", "a and nothing", "not nothing", ""]


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(WORDS), rng.choice(WORDS), rng.choice([None, 0, 12, 7]), rng.choice([None, True, False]), " ".join(w for w in rng.choices(WORDS, k=3) if w)) for i in range(150)]
    t = spark.createDataFrame(rows, "i int, a string, u string, n long, b boolean, m string")
    leaves = {"@timestamp": F.timestamp_seconds(F.col("i") * 60), "event.action": F.col("a"), "user.name": F.col("u"), "http.response.body.bytes": F.col("n"), "source.internal": F.col("b"), "message": F.col("m")}
    return t.select(*nested(leaves), F.col("i").alias("_seq"))


def made(n, seed=1):
    rng = random.Random(seed)

    def block():
        found = {}
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            modifier = rng.choice(MODIFIERS)
            pick = lambda: rng.choice([v for v in VALUES if "re" not in modifier.split("|") or isinstance(v, str)])  # noqa: E731, B023
            found[rng.choice(FIELDS) + modifier] = [pick() for _ in range(rng.choice([0, 1, 2, 3]))] if rng.random() < 0.6 else pick()
        return found

    return [
        rulebook.rule({"id": f"r{i}", "level": rng.choice(["low", "high"]), "tags": ["attack.t1"] * (i % 2), "entity": rng.choice(["user.name", "source.ip", "host.name"]), "evidence_fields": rng.choice([[], ["event.action", "user.name"]]),
                       "detection": {"a": block(), "b": block(), "b2": block(), "c": block(), "condition": rng.choice(CONDITIONS)} | ({"threshold": {"group_by": ["user.name"], "count": 2, "window": "1h", "distinct": rng.choice([None, "event.action"])}} if i % 3 == 0 else {})})
        for i in range(n)
    ]


def rows(df):
    return sorted((str(r) for r in df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_and_expressions_match_alike(events, seed):
    rules = list(enumerate(made(60, seed)))
    expected = detect._hits(events, rules)
    got = ruleindex.hits(events, rules, detect.terms).select(expected.columns)
    expected = rows(expected)
    assert expected and rows(got) == expected


def test_all_rules_alike(events, monkeypatch):
    rules = made(30, 3)
    expected = rows(detect.run(events, rules))
    monkeypatch.setattr(detect, "MANY", 2)
    assert expected and rows(detect.run(events, rules)) == expected


def test_no_rule_and_no_event(events):
    never = [(i, r) for i, r in enumerate(rulebook.rule({"id": f"n{i}", "detection": {"selection": {}}}) for i in range(3))]
    assert not ruleindex.hits(events, never, detect.terms).count()
    assert not ruleindex.hits(events.limit(0), list(enumerate(made(5))), detect.terms).count()


def test_plan_does_not_grow(events):
    """Two thousand rules make a plan of as many nodes as two hundred."""
    nodes = []
    for n in (200, 2000):
        rules = [(i, rulebook.rule({"id": f"r{i}", "detection": {"selection": {"user.name": f"name {i}", "message|contains": f"text {i:05d}"}}})) for i in range(n)]
        plan = ruleindex.hits(events, rules, detect.terms)._jdf.queryExecution().optimizedPlan()
        nodes.append(re.sub(r"[ \d#]+", " ", plan.treeString()).count("\n"))
    assert nodes[0] == nodes[1]


def test_few_rules_are_proposed(events):
    """A rule that needs an equal value goes by it, one that needs a text by the piece that fewest rules share."""
    rules = [rulebook.rule({"id": str(i), "detection": {"selection": s, "other": {"user.name": "x"}, "condition": c}}) for i, (s, c) in enumerate([({"message|contains": "union select"}, "selection"), ({"message|contains": "union all"}, "selection or other"), ({"message|contains": "a", "user.name": "Root"}, "selection"), ({"message": "x"}, "not selection")])]
    conditions = [ruleindex._spec(events, ruleindex._Fields(), i, r, detect.terms(r))["terms"] for i, r in enumerate(rules)]
    keys = [ruleindex._Keys(conditions).of(c) for c in conditions]
    assert [len(k) if k else k for k in keys] == [1, 2, 1, None]
    assert keys[0][0]["lit"] not in ("uni", "nio", "ion", "on ") and len(keys[0][0]["lit"]) == 3 and keys[2][0]["lit"] == "root"


def test_texts_of_patterns():
    assert ruleindex.texts("sel(ect|ion) +from") == [["sel"], ["ect", "ion"], [" "], ["from"]]
    assert ruleindex.texts("cat|dog") == [["cat", "dog"]]
    assert ruleindex.texts("(abc)?x*") == [] and ruleindex.texts("cat|.*") == [] and ruleindex.texts("(") == []
    for pattern, text in (("ab+c(?=d)", "ABBCD"), ("(foo|ba[rz])-\\d", "x BAZ-1"), ("^a.c$", "abc")):
        assert re.search(pattern, text, re.I) and all(any(t in text.lower() for t in choice) for choice in ruleindex.texts(pattern))


def test_lookalikes_are_all():
    """The letters beyond ASCII that fold to a single ASCII letter are those that are stated."""
    alone = {c for c in map(chr, range(128, 0x110000)) if (c.upper().lower() if len(c.upper()) == 1 else "").isascii() and len(c.upper()) == 1 and len(c.upper().lower()) == 1}
    assert alone | {"İ"} == set(ruleindex.LOOKALIKES)


def test_equal_conditions_are_evaluated_once(events):
    """Rules of equal conditions share one, each with its own entity and level; an event's keys are made once."""
    rules = [(i, rulebook.rule({"id": f"r{i}", "entity": ["user.name", "host.name"][i % 2], "detection": {"selection": {"user.name|contains": ["alpha", "e"][i // 2 % 2], "event.action": "index"}, "other": {"message|re": "k.lvin"}, "condition": "selection or other"}})) for i in range(120)]
    fields = ruleindex._Fields()
    specs = [ruleindex._spec(events, fields, i, r, detect.terms(r)) for i, r in rules]
    assert len(ruleindex._conditions(specs)) == 2 and [s["cond"] for s in specs] == [i // 2 % 2 for i in range(120)]
    got = ruleindex.hits(events, rules, detect.terms)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("flatten(") == 1
    expected = rows(detect._hits(events, rules[:4]).drop("rule_ord"))
    assert expected and rows(got.drop("rule_ord").select(detect._hits(events, rules[:4]).drop("rule_ord").columns)) == sorted(expected * 30)
