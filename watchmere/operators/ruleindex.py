"""Many rules as data: an index over the texts that a rule cannot do without proposes rules, and only those are evaluated.

A rule becomes a row: its condition as nested arrays of tests, which one expression
interprets, so the plan does not grow with the rules.  Rules of equal conditions share
one.  From the condition follow keys of which every event that it matches has one: an
equal value, or a piece of three characters of a text that must occur (of a regular
expression, too).  Keys of events meet keys of conditions in a hash join; each proposed
condition is then evaluated in full, so keys decide only what is evaluated.  A condition
without keys (a negation or a comparison alone) is proposed for every event.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from re import _constants as _re
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import context, kind, resolve, shown
from ..functions.predicates import CASELESS, as_text, number, truth
from ..sources.rulebook import Rule

#: Rules and index are broadcast up to this many bytes of JSON each; beyond, the join's sides are shuffled as Spark chooses.
BROADCAST = 32 << 20
#: Characters of a piece.
PIECE = 3
#: Characters of a message that stand for evidence where a rule's fields have no value.
MESSAGE = 160
#: The letters beyond ASCII that equal an ASCII letter where case is ignored, and those letters.
LOOKALIKES, LETTERS = "İıſK", "iisk"

_ATOM = "struct<f:int,op:string,lit:string,num:string>"
_CONDITION = f"cond:int,terms:array<struct<both:boolean,negate:boolean,every:boolean,blocks:array<array<struct<every:boolean,atoms:array<{_ATOM}>>>>>>"
_SPEC = "cond:int,rule_ord:int,entity:int,sort:string,evidence:array<struct<f:int,name:string>>,grouped:boolean,group:array<int>,value:int"
_KEY = "cond:int,keys:array<struct<f:int,kind:string,lit:string,num:string>>"

# ---- what a condition cannot do without: a list of alternatives, or None where there is nothing; the empty list is never met


def texts(pattern: str) -> list[list[str]]:
    """Lists of lower-case ASCII texts; whatever the pattern matches, ignoring case, holds one of each list."""
    try:
        return _texts(_parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return []


def _texts(items) -> list[list[str]]:
    found, run = [], ""
    for op, arg in [*items, (None, None)]:
        if op is _re.LITERAL:
            run += chr(arg)
            continue
        if op is _re.AT:
            continue
        found += [[part.lower()] for part in re.split(r"[^\x00-\x7f]+", run) if part]
        run = ""
        if op is _re.SUBPATTERN:
            found += _texts(arg[3])
        elif op in (_re.MAX_REPEAT, _re.MIN_REPEAT, _re.POSSESSIVE_REPEAT) and arg[0] >= 1:
            found += _texts(arg[2])
        elif op is _re.BRANCH:
            sides = [max(_texts(side), key=lambda s: min(map(len, s)), default=None) for side in arg[1]]
            if None not in sides:
                found.append([t for side in sides for t in side])
    return found


#: Weight of a key that says next to nothing, and by how much a piece weighs more for each character that it lacks.
VAGUE, SHORTER = 1_000_000, 16


class _Keys:
    """Chooses each rule's keys: those that the fewest rules share, as each sharer is proposed with the rule."""

    def __init__(self, conditions: list[list]):
        atoms = lambda terms: [a for t in terms if not t["negate"] for b in t["blocks"] for k in b for a in k["atoms"]]
        self.seen = Counter()
        for terms in conditions:
            own = [k for a in atoms(terms) for choice in _choices(a) for k in choice]
            self.seen.update({(k["f"], k["kind"], p) for k in own for p in self.parts(k)})

    @staticmethod
    def parts(k: dict) -> set:
        lit = k["num"] if k["kind"] == "num" else k["lit"]
        return {lit[i : i + PIECE] for i in range(max(1, len(lit) - PIECE + 1))} if k["kind"] == "piece" else {lit}

    def weight(self, k: dict) -> int:
        if k["kind"] in ("null", "truth"):
            return VAGUE
        lacking = PIECE + 1 - min(PIECE, len(k["lit"])) if k["kind"] == "piece" else 0
        return min(self.seen[k["f"], k["kind"], p] for p in self.parts(k)) * SHORTER**lacking

    def cut(self, k: dict) -> dict:
        """A text's key cut down to one piece of it."""
        return dict(k, lit=min(self.parts(k), key=lambda p: (self.seen[k["f"], "piece", p], p))) if k["kind"] == "piece" else k

    def all(self, parts: list) -> list | None:
        return min((p for p in parts if p is not None), key=lambda keys: sum(map(self.weight, keys)), default=None)

    def any(self, parts: list) -> list | None:
        return None if any(p is None for p in parts) else [k for p in parts for k in p]

    def of(self, terms: list) -> list | None:
        """Keys of a condition, its terms joined from left to right; a condition without terms is never met."""
        found = []
        for i, t in enumerate(terms):
            blocks = [self.all([(self.all if k["every"] else self.any)([self.all(_choices(a)) for a in k["atoms"]]) for k in b]) for b in t["blocks"]]
            own = None if t["negate"] else (self.all if t["every"] else self.any)(blocks)
            found = own if i == 0 else self.all([found, own]) if t["both"] else self.any([found, own])
        return found and [self.cut(k) for k in found]


def _choices(a: dict) -> list[list]:
    """Lists of keys, of each of which every event has one that the test holds of."""
    key = lambda kind_, lit=None, num=None: {"f": a["f"], "kind": kind_, "lit": lit, "num": num}
    if a["op"] == "false":
        return [[]]
    if a["op"] in ("null", "truth"):
        return [[key(a["op"], a["lit"])]]
    if a["op"] == "eq":
        return [[key("eq", a["lit"])]]
    if a["op"] == "num":
        return [[key("num", num=a["num"]), key("eq", a["lit"])]]
    if a["op"] == "re":
        return [[key("piece", t) for t in choice] for choice in texts(a["lit"])]
    if a["op"] in ("contains", "startswith", "endswith"):
        return [[key("piece", part)] for part in re.split(r"[^\x00-\x7f]+", a["lit"]) if part]
    return []


# ---- rules as rows


def _number(expected) -> float | None:
    try:
        return float(expected)
    except (TypeError, ValueError):
        return None


def _atom(df: DataFrame, f: int, name: str, modifier: str | None, expected) -> dict:
    """One test of one field, as functions.predicates.rule_match makes it of the same arguments."""
    atom = lambda op, lit=None, num=None: {"f": f, "op": op, "lit": lit, "num": num}
    if expected is None:
        return atom("null")
    lower, n = str(expected).lower(), _number(expected)
    if modifier in (None, ""):
        if isinstance(expected, bool) or isinstance(kind(df, name), T.BooleanType):
            return atom("truth", "true" if expected else "false")
        return atom("eq", lower) if n is None else atom("num", lower, str(n))
    if modifier in ("contains", "startswith", "endswith"):
        return atom(modifier, lower)
    if modifier == "re":
        return atom("re", str(expected))
    if modifier in ("gt", "gte", "lt", "lte") and n is not None:
        return atom(modifier, None, str(n))
    return atom("false")


class _Fields(dict):
    """Names of fields by their place."""

    def __missing__(self, name: str) -> int:
        self[name] = len(self)
        return self[name]


def _block(df: DataFrame, fields: _Fields, block: dict) -> list:
    made = []
    for key, expected in block.items():
        name, *modifiers = key.split("|")
        modifier = next((m for m in modifiers if m != "all"), None)
        values = expected if isinstance(expected, list) else [expected]
        made.append({"every": "all" in modifiers, "atoms": [_atom(df, fields[name], name, modifier, v) for v in values]})
    return made or [{"every": False, "atoms": []}]


def _spec(df: DataFrame, fields: _Fields, i: int, r: Rule, terms: list) -> dict:
    blocks = {name: _block(df, fields, b) for name, b in r.blocks.items() if isinstance(b, dict)}
    t = r.threshold
    return {
        "rule_ord": i, "terms": [{"both": both, "negate": negate, "every": every, "blocks": [blocks[n] for n in names]} for both, negate, every, names in terms],
        "entity": fields[r.entity], "sort": sort(r.entity), "evidence": [{"f": fields[f], "name": f} for f in r.evidence_fields],
        "grouped": t is not None, "group": [fields[f] for f in t.group_by] if t else [], "value": fields[t.distinct] if t and t.distinct else None,
    }


def _conditions(specs: list[dict]) -> list[list]:
    """The different conditions; specs get the place of theirs as cond, and lose the terms."""
    places: dict[str, int] = {}
    found = []
    for s in specs:
        terms = s.pop("terms")
        s["cond"] = places.setdefault(json.dumps(terms), len(places))
        if s["cond"] == len(found):
            found.append(terms)
    return found


def sort(field: str) -> str:
    """What an entity of this field is."""
    return "ip" if "ip" in field else "user" if "user" in field else "host"


def _table(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """rows as a table from one literal, to be broadcast if it is small enough."""
    text = json.dumps(rows)
    made = df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))
    return F.broadcast(made) if len(text) <= BROADCAST else made


# ---- events against them


def _forms(df: DataFrame, name: str) -> Column:
    """What the tests and the alerts take of a field."""
    column, type_ = resolve(df, name), kind(df, name)
    raw = as_text(column, type_)
    return F.struct(
        column.isNull().alias("gone"), raw.alias("raw"), F.lower(raw).alias("text"), number(column, type_).alias("num"), truth(column, type_).alias("truth"),
        column.cast("string").alias("plain"), shown(df, name).alias("shown"),
    )


def _key(f, kind_, rest: Column) -> Column:
    return F.concat_ws(":", f, kind_, rest)


def _figure(num: Column) -> Column:
    """A number as text, equal for equal numbers (0 and -0 are)."""
    return (num + F.lit(0.0)).cast("string")


def _event_keys(df: DataFrame, name: str, f: int, kinds: dict[str, set]) -> list[Column]:
    """Arrays of the keys that an event has by one field, of the kinds that rules ask for; null or empty where it has none."""
    column, type_ = resolve(df, name), kind(df, name)
    text, num, true = F.lower(as_text(column, type_)), number(column, type_), truth(column, type_)
    at = lambda kind_, rest: F.concat(F.lit(f"{f}:{kind_}:"), rest)
    own = {
        "eq": F.when(text.isin(sorted(kinds.get("eq", ()))), F.array(at("eq", text))), "num": F.when(num.isNotNull(), F.array(at("num", _figure(num)))),
        "null": F.when(column.isNull(), F.array(F.lit(f"{f}:null:"))), "truth": F.when(true.isNotNull(), F.array(at("truth", true.cast("string")))),
    }
    found = [c for kind_, c in own.items() if kind_ in kinds]
    folded = F.lower(F.translate(as_text(column, type_), LOOKALIKES, LETTERS))
    for size in sorted({len(p) for p in kinds.get("piece", ())}):
        wanted = sorted(p for p in kinds["piece"] if len(p) == size)
        held = lambda text: F.when(F.length(text) >= size, F.transform(_held(text, size, wanted), lambda p: at("piece", p)))  # noqa: E731, B023
        found.append(F.transform(F.array(folded), held)[0])  # bound, else the field's expression is evaluated for each piece
    return found


def _held(text: Column, size: int, wanted: list[str]) -> Column:
    """Which of the wanted pieces of one size a text holds."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda p: F.substring(text, p, F.lit(size)))
    return F.array_distinct(F.filter(cut, lambda p: p.isin(wanted)))


def _holds(vals: Column, a: Column) -> Column:
    """Whether a test holds of an event."""
    v, num = vals[a["f"]], a["num"].cast("double")
    cases = {
        "eq": v["text"] == a["lit"], "num": F.coalesce(v["num"] == num, v["text"] == a["lit"]), "null": v["gone"], "truth": v["truth"] == (a["lit"] == "true"),
        "contains": F.contains(v["text"], a["lit"]), "startswith": F.startswith(v["text"], a["lit"]), "endswith": F.endswith(v["text"], a["lit"]),
        "re": F.rlike(v["raw"], F.concat(F.lit(CASELESS), a["lit"])), "gt": v["num"] > num, "gte": v["num"] >= num, "lt": v["num"] < num, "lte": v["num"] <= num,
    }
    chosen = None
    for op, test in cases.items():
        chosen = F.when(a["op"] == op, test) if chosen is None else chosen.when(a["op"] == op, test)
    return F.coalesce(chosen, F.lit(False))


def _fires(vals: Column, terms: Column) -> Column:
    """Whether a rule's condition holds of an event: its terms joined from left to right."""
    key = lambda k: F.when(k["every"], F.forall(k["atoms"], lambda a: _holds(vals, a))).otherwise(F.exists(k["atoms"], lambda a: _holds(vals, a)))
    block = lambda b: F.forall(b, key)
    term = lambda t: F.when(t["every"], F.forall(t["blocks"], block)).otherwise(F.exists(t["blocks"], block)) != t["negate"]
    join = lambda so_far, t: F.when(so_far.isNull(), term(t)).when(t["both"], so_far & term(t)).otherwise(so_far | term(t))
    return F.coalesce(F.aggregate(terms, F.lit(None).cast("boolean"), join), F.lit(False))


def _known(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def hits(events: DataFrame, rules: list[tuple[int, Rule]], terms) -> DataFrame:
    """Rows of the rules that match an event, as detect has them; ``terms`` gives a rule's condition as terms.

    One pass over the events, three hash joins with tables made of the rules, no
    shuffle while these are small enough to be broadcast.
    """
    fields = _Fields()
    host, user, _ = fields["host.name"], fields["user.name"], fields["message"]
    specs = [_spec(events, fields, i, r, terms(r)) for i, r in rules]
    conditions = _conditions(specs)
    chosen = _Keys(conditions)
    keys = [chosen.of(terms) for terms in conditions]
    rows = [{"cond": i, "keys": [{"f": -1, "kind": "any", "lit": None, "num": None}] if k is None else k} for i, k in enumerate(keys)]
    kinds: dict[int, dict[str, set]] = {}
    for k in (k for row in rows for k in row["keys"]):
        kinds.setdefault(k["f"], {}).setdefault(k["kind"], set()).add(k["lit"])

    rest = lambda k: F.coalesce(_figure(k["num"].cast("double")), k["lit"], F.lit(""))
    index = _table(events, rows, _KEY).select("cond", F.transform("keys", lambda k: F.concat_ws(":", k["f"].cast("string"), k["kind"], rest(k))).alias("keys"))
    index = index.select("cond", F.array_distinct("keys").alias("keys")).select("cond", "keys", F.explode("keys").alias("key"))
    index = F.broadcast(index) if len(json.dumps(rows)) <= BROADCAST else index

    own = [c for name, f in fields.items() if f in kinds for c in _event_keys(events, name, f, kinds[f])]
    own += [F.array(F.lit("-1:any:"))] if -1 in kinds else []
    own_keys = F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in own])) if own else F.array().cast("array<string>")
    first = F.struct(context(events).alias("context"), resolve(events, "honeypot").cast("boolean").alias("first_honeypot"), resolve(events, "event.business_hours").cast("boolean").alias("first_business_hours"))
    carried = events.select(F.col("`@timestamp`").alias("ts"), F.col("_seq").alias("seq"), first.alias("first"), F.array(*[_forms(events, name) for name in fields]).alias("vals"), own_keys.alias("own"))
    # what is exploded is no bare column: of one Spark infers filters, and evaluates all keys once more for each
    met = carried.select("*", F.explode(F.array_distinct("own")).alias("key")).join(index, "key")
    # an event that has several keys of a condition is evaluated at the least of them only
    met = met.filter((F.size("keys") == 1) | (F.col("key") == F.array_min(F.array_intersect("own", "keys")))).drop("own", "keys", "key")
    tests = _table(events, [{"cond": i, "terms": terms} for i, terms in enumerate(conditions)], _CONDITION)
    found = met.join(tests, "cond").filter(_fires(F.col("vals"), F.col("terms"))).drop("terms").join(_table(events, specs, _SPEC), "cond")

    at = lambda f: F.col("vals")[f]
    who = F.nullif(_known(at(F.col("entity"))["plain"]), F.lit("-"))
    by_host, by_user = _known(at(host)["plain"]), _known(at(user)["plain"])
    told = F.array_join(F.filter(F.transform("evidence", lambda e: F.when(~at(e["f"])["gone"], F.concat(e["name"], F.lit("="), at(e["f"])["shown"]))), lambda e: e.isNotNull()), " ")
    return found.select(
        "ts", "seq", "first", "rule_ord", F.coalesce(who, by_host, by_user, F.lit("unattributed")).alias("entity"),
        F.when(who.isNotNull(), F.col("sort")).when(by_host.isNotNull(), "host").when(by_user.isNotNull(), "user").otherwise(F.col("sort")).alias("entity_type"),
        F.when(told != "", told).otherwise(F.substring(F.coalesce(at(fields["message"])["plain"], F.lit("")), 1, MESSAGE)).alias("evidence"),
        F.when(F.col("grouped"), F.to_json(F.transform("group", lambda f: at(f)["shown"]))).alias("group"),
        F.when(F.col("value").isNotNull(), at(F.col("value"))["shown"]).alias("value"),
    )
