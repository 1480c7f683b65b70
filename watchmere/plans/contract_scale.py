"""Registered queries over hot keys, over both kinds of addresses, and over files that are written from the tables and loaded again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import resolve
from ..operators import alerts as A
from ..operators import detect, risk, sequence, stateful
from ..operators.enrich import enrich
from ..session import shared
from ..sources import lookups, rulebook
from ..sources.lookups import Lookups
from .contract import _RAW, EV, SQL, SQL_STAMP, _plain, as_events, events, register
from .contract_logs import _CHAIN, _CHAIN_RULE, raw

SEGMENT = 300

# ---- hot keys: half of all events are of one address and one user, and keys of more than SEGMENT rows are cut

HOT = EV.replace("CASE WHEN user_id % 11 <> 0 THEN 'u' || user_id END AS usr, '10.0.0.' || (user_id % 50) AS ip", "CASE WHEN event_id % 2 = 0 THEN 'u1' WHEN user_id % 11 <> 0 THEN 'u' || user_id END AS usr, CASE WHEN event_id % 2 = 0 THEN '10.0.0.11' ELSE '10.0.0.' || (user_id % 50) END AS ip")


def hot_events(spark, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    hot = F.col("_seq") % 2 == 0
    named = lambda column, field, value: F.col(column).withField(field, F.when(hot, value).otherwise(F.col(f"{column}.{field}")))
    return e.withColumns({"source": named("source", "ip", "10.0.0.11"), "user": named("user", "name", "u1")})


@register("hot_success_after_failures", HOT + SQL["success_after_failures"].removeprefix(EV))
def hot_success_after_failures(spark, sf_dir):
    return _plain(stateful.success_after_failures(hot_events(spark, sf_dir), threshold=4, minutes=24 * 60, rows=SEGMENT))


@register("hot_priv_esc", HOT + SQL["priv_esc_asof"].removeprefix(EV))
def hot_priv_esc(spark, sf_dir):
    e = hot_events(spark, sf_dir)
    e = e.withColumn("event", F.col("event").withField("action", F.when(F.col("event.action") == "purchase", "sudo").otherwise(F.col("event.action"))))
    return _plain(stateful.escalation_after_login(e, minutes=24 * 60, rows=SEGMENT))


@register("hot_chain", HOT + _RAW + _CHAIN + f"SELECT 'fail_then_view' AS rule_id, entity, strftime(fired, '{SQL_STAMP}') AS ts, CAST(2 AS BIGINT) AS event_count FROM fold")
def hot_chain(spark, sf_dir):
    return _plain(sequence.chains(raw(spark, sf_dir, hot_events(spark, sf_dir)), rulebook.sequence(_CHAIN_RULE), rows=SEGMENT))


# ---- both stateful detectors at their shipped limits, over events a thousand times as dense

_DENSE = EV.replace("SELECT event_id AS id, ts,", "SELECT event_id AS id, make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 1000) AS ts,")
_BOTH = ((SQL["success_after_failures"], (("len(k) >= 4", "len(k) >= 8"), ("86400000000", "600000000"))), (SQL["priv_esc_asof"], (("86400000000", "900000000"),)))


def _replaced(sql: str, changes: tuple) -> str:
    for old, new in changes:
        sql = sql.replace(old, new)
    return sql


@register("stateful_both", " UNION ALL ".join(f"SELECT * FROM ({_DENSE}{_replaced(sql.removeprefix(EV), changes)})" for sql, changes in _BOTH))
def stateful_both(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = 1_704_067_200_000_000
    e = as_events(t.withColumn("ts", F.timestamp_micros(start + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - start) / 1000))))
    e = e.withColumn("event", F.col("event").withField("action", F.when(F.col("event.action") == "purchase", "sudo").otherwise(F.col("event.action"))))
    return _plain(stateful.run(e))


# ---- addresses of both kinds

_PLACES = [("2001:db8:2::/127", "Tiny"), ("2001:db8:1::/48", "One"), ("203.0.113.0/28", "Low"), ("2001:db8::/32", "All"), ("2001:db8:3::/48", "Never"), ("203.0.113.0/24", "Rest"), ("203.0.113.1/24", "Bad")]


@register("enrich_networks", EV + """, x AS (SELECT id, usr IS NULL AS four, CAST(substr(ip, 8) AS INTEGER) % 7 AS a, id % 50 AS b FROM ev)
SELECT CAST(id AS INTEGER) AS event_code, CASE WHEN four THEN CASE WHEN b < 16 THEN 'Low' ELSE 'Rest' END WHEN a = 6 THEN NULL WHEN a = 2 AND b < 2 THEN 'Tiny' WHEN a = 1 THEN 'One' ELSE 'All' END AS country FROM x""")  # fmt: skip
def enrich_networks(spark, sf_dir):
    """IPv6 and IPv4 addresses in overlapping networks, of which the first in the file counts."""
    e = events(spark, sf_dir)
    a, b = F.substring_index("source.ip", ".", -1).cast("int") % 7, (F.col("_seq") % 50).cast("long")
    six = F.concat(F.when(a == 6, "2001:db9:").otherwise(F.concat(F.lit("2001:DB8:"), a.cast("string"))), F.lit("::"), F.lower(F.hex(b)))
    four = F.concat(F.lit("203.0.113."), b.cast("string"))
    e = e.withColumn("source", F.col("source").withField("ip", F.when(F.col("user.name").isNull(), four).otherwise(F.regexp_replace(six, ":::", "::"))))
    e = enrich(e, Lookups(networks=[(cidr, (name, None, None)) for cidr, name in _PLACES]), novelty=False)
    return e.select(resolve(e, "event.code").alias("event_code"), resolve(e, "source.geo.country_name").alias("country"))


# ---- rules, sequences and lookups written from the events to files, and loaded


def _rules(spark, sf_dir: str, rows) -> str:
    """A folder with a file for each row's document; rows: id, doc (JSON, which is YAML as well)."""
    folder = f"{shared(spark)}/rules"
    rows.write.partitionBy("id").text(folder)
    return folder


def _doc(id_, level: str, tags, block) -> F.Column:
    return F.to_json(F.struct(id_.alias("id"), id_.alias("title"), F.lit(level).alias("level"), tags.alias("tags"), F.struct(block.alias("selection"), F.lit("selection").alias("condition")).alias("detection")))


@register("rule_files", EV + f""", hits AS (SELECT 'on_' || action AS rule_id, ip AS entity, ts, id FROM ev WHERE NOT internal),
 a AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, id) AS n FROM hits WHERE rule_id IN ('on_error', 'on_purchase')),
 fold AS (SELECT * FROM (WITH RECURSIVE s AS (SELECT DISTINCT entity, 0::BIGINT AS n, 0 AS stage, NULL::TIMESTAMP AS began, NULL::TIMESTAMP AS fired FROM a
   UNION ALL SELECT a.entity, a.n, CASE WHEN stage = 0 THEN CASE WHEN rule_id = 'on_error' THEN 1 ELSE 0 END WHEN rule_id = 'on_purchase' THEN 0 ELSE 1 END, CASE WHEN stage = 0 THEN a.ts ELSE began END,
     CASE WHEN stage = 1 AND rule_id = 'on_purchase' AND epoch_us(a.ts) - epoch_us(began) <= 86400000000 THEN a.ts END FROM s JOIN a ON a.entity = s.entity AND a.n = s.n + 1) SELECT * FROM s) WHERE fired IS NOT NULL)
SELECT rule_id, 'high' AS severity, count(*) AS alerts FROM hits GROUP BY rule_id UNION ALL SELECT 'then', 'low', count(*) FROM fold HAVING count(*) > 0""")  # fmt: skip
def rule_files(spark, sf_dir):
    """A rule file for each action that occurs and a sequence file, loaded and run: alerts by rule."""
    actions = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().filter("event_type IS NOT NULL")
    block = F.struct(F.col("event_type").alias("event.action"), F.lit(False).alias("source.internal"))
    rows = actions.select(F.concat(F.lit("on_"), "event_type").alias("id"), _doc(F.concat(F.lit("on_"), "event_type"), "high", F.array().cast("array<string>"), block).alias("doc"))
    chain = '{"id": "then", "level": "low", "sequence": {"within": "1d", "stages": [{"rule_id": "on_error"}, {"rule_id": ["on_purchase", "none"]}]}}'
    folder = _rules(spark, sf_dir, rows.unionAll(spark.createDataFrame([("then", chain)], "id string, doc string")))
    alerts = detect.run(events(spark, sf_dir), rulebook.load_rules(folder, spark=spark))
    found = sequence.run(alerts, rulebook.load_sequences(folder, spark=spark))
    return A.union([alerts, found]).groupBy("rule_id", "severity").agg(F.count("*").alias("alerts"))


@register("rule_coverage", EV + """, r AS (SELECT DISTINCT host, 'T100' || (CAST(substr(host, 2) AS INTEGER) % 2) AS technique FROM ev WHERE host IS NOT NULL)
SELECT technique, count(DISTINCT r.host) AS rules, count(*) AS alerts FROM r JOIN ev USING (host) GROUP BY technique""")
def rule_coverage(spark, sf_dir):
    """Techniques of the rules in files, one for each host that occurs: how many rules cover each, and their alerts."""
    e = events(spark, sf_dir)
    hosts = e.select(F.col("host.name").alias("h")).filter("h IS NOT NULL").distinct()
    tags = F.array(F.concat(F.lit("attack.t100"), F.substring("h", 2, 9).cast("int") % 2))
    folder = _rules(spark, sf_dir, hosts.select(F.col("h").alias("id"), _doc(F.concat(F.lit("on_"), "h"), "low", tags, F.struct(F.col("h").alias("host.name"))).alias("doc")))
    rules = rulebook.load_rules(folder, spark=spark)
    covered = spark.createDataFrame([(t, len(titles)) for t, titles in rulebook.coverage(rules).items()], "technique string, rules long")
    fired = detect.run(e, rules).select(F.explode("tags").alias("technique")).groupBy("technique").agg(F.count("*").alias("alerts"))
    return covered.join(fired, "technique")


@register("lookup_files", EV + """, known AS (SELECT DISTINCT ip FROM ev WHERE CAST(substr(ip, 8) AS INTEGER) % 3 = 0)
SELECT CAST(id AS INTEGER) AS event_code, CASE WHEN CAST(substr(ip, 8) AS INTEGER) < 32 THEN 'Low' WHEN ip IS NOT NULL THEN 'High' END AS country, CASE WHEN k.ip IS NOT NULL THEN 'feed' END AS intel,
 CASE WHEN host IS NOT NULL THEN CASE WHEN host < 'h2' THEN 'crown_jewel' ELSE 'medium' END END AS criticality, CASE WHEN usr IS NOT NULL THEN 'service' END AS user_type FROM ev LEFT JOIN known k USING (ip)""")  # fmt: skip
def lookup_files(spark, sf_dir):
    """Assets, identities, networks and indicators written from the events to files, loaded and used."""
    e = events(spark, sf_dir)
    public = F.regexp_replace("source.ip", "^10", "100")
    hosts, users = e.select(F.col("host.name").alias("k")).distinct(), e.select(F.col("user.name").alias("k")).distinct()
    addresses = e.select(public.alias("k")).distinct().filter(F.substring_index("k", ".", -1).cast("int") % 3 == 0)
    folder = f"{shared(spark)}/lookups"
    put = lambda df, name: df.coalesce(1).write.text(f"{folder}/{name}")  # noqa: E731  (lookup tables: a row a host, user or indicator)
    put(hosts.filter("k IS NOT NULL").select(F.concat("k", F.when(F.col("k") < "h2", ": {criticality: crown_jewel}").otherwise(": {}"))), "assets.yml")
    put(users.filter("k IS NOT NULL").select(F.concat("k", F.lit(": {type: service}"))), "identities.yml")
    put(addresses.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", F.struct(F.lit("feed").alias("source"), F.lit("scan").alias("category"))))))), "threat_intel.json")
    nets = spark.createDataFrame([("100.0.0.0/27", "Low", "LO", "a"), ("100.0.0.0/8", "High", "HI", "b")], "network string, country string, country_code string, asn_org string")
    nets.coalesce(1).write.option("header", True).csv(f"{folder}/geoip.csv")
    e = enrich(e.withColumn("source", F.col("source").withField("ip", public)), lookups.load(folder, spark), novelty=False)
    return e.select(
        resolve(e, "event.code").alias("event_code"), resolve(e, "source.geo.country_name").alias("country"), resolve(e, "threat.indicator.source").alias("intel"), resolve(e, "host.criticality").alias("criticality"), resolve(e, "user.type").alias("user_type"),
    )


# ---- advice and rounding over alerts of the events

_ADVICE = "(VALUES " + ", ".join(f"('{rule}', {i}, '{text}')" for rule in ("ssh_brute_force", "honeypot_command") for i, text in enumerate(risk.RESPONSES[rule])) + ") t(rule, i, text)"


def _told(spark, sf_dir: str) -> DataFrame:
    """The alerts under the names of two rules of the library and of one that it lacks."""
    a = A.dedup(raw(spark, sf_dir))
    name = F.when(F.col("rule_id") == "outside_failure", "ssh_brute_force").when(F.col("emit.s") % 3 == 0, "unknown_rule").otherwise("honeypot_command")
    return a.withColumn("rule_id", name)


@register("case_advice", EV + _RAW + f""", told AS (SELECT entity, ts, o, id, base * CASE WHEN internal THEN 1.0 ELSE 1.2 END AS amount, CASE WHEN rule_id = 'outside_failure' THEN 'ssh_brute_force' WHEN id % 3 = 0 THEN 'unknown_rule' ELSE 'honeypot_command' END AS rule FROM dd),
 top AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round_even(amount, 0) DESC, ts, o, id) AS n FROM told QUALIFY n <= 3),
 firsts AS (SELECT entity, rule, min(n) AS n FROM top GROUP BY ALL)
SELECT entity, coalesce(string_agg(text, '|' ORDER BY n, i), '') AS actions FROM firsts LEFT JOIN {_ADVICE} USING (rule) GROUP BY entity""")
def case_advice(spark, sf_dir):
    """What to do about each entity's three riskiest alerts."""
    return risk.entities(_told(spark, sf_dir)).select("entity", F.array_join("actions", "|").alias("actions"))


@register("case_timelines", EV + _RAW + """, told AS (SELECT entity, rule_id, ts, row_number() OVER (PARTITION BY entity ORDER BY ts, o, id) AS n FROM dd)
SELECT entity, n AS place, rule_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM told JOIN scored USING (entity) WHERE n <= 8 AND score >= 100""")
def case_timelines(spark, sf_dir):
    """The first eight alerts of every case."""
    a = A.dedup(raw(spark, sf_dir))
    found = risk.with_timelines(risk.cases(risk.entities(a)), a, 8)
    rows = found.select("entity", F.posexplode("timeline").alias("k", "t"))
    return rows.select("entity", (F.col("k") + 1).cast("long").alias("place"), F.col("t.rule_id").alias("rule_id"), F.date_format("t.ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@register("risk_rounding", EV + _RAW + """, x AS (SELECT *, base * (CASE WHEN id % 2 = 0 THEN 1.5 ELSE 1.0 END::DOUBLE * CASE WHEN internal THEN 1.0 ELSE 1.2 END::DOUBLE * CASE id % 5 WHEN 0 THEN 2.0 WHEN 1 THEN 1.5 WHEN 2 THEN 0.7 ELSE 1.0 END::DOUBLE
  * CASE WHEN id % 7 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE * CASE WHEN id % 3 = 0 THEN 1.2 ELSE 1.0 END::DOUBLE) AS amount FROM dd)
SELECT id, CAST(round_even(amount, 0) AS BIGINT) AS risk_score, round(amount, 6) AS contribution FROM x""")  # fmt: skip
def risk_rounding(spark, sf_dir):
    """Every factor of a score, by the event's number, and its rounding."""
    n = F.col("emit.s")
    level = F.when(n % 5 == 0, "crown_jewel").when(n % 5 == 1, "high").when(n % 5 == 2, "low").otherwise("other")
    a = A.dedup(raw(spark, sf_dir)).withColumns({
        "context": F.col("context").withField("user_privileged", n % 2 == 0).withField("host_criticality", level),
        "first_honeypot": n % 7 == 0, "first_business_hours": n % 3 != 0,
    })
    return risk.scored(a).select(n.alias("id"), "risk_score", F.round("contribution", 6).alias("contribution"))


# ---- two thousand rules: more than an expression for each would bear

_RULES, _PARTS = 2000, ("rro", "LIC", "urch", "iew", "ign")


def _generated(k: int) -> dict:
    """A rule of one of four kinds: equal user and amount, end of address and part of action, pattern and exception, threshold."""
    m, made = k // 4, {"id": f"r{k}", "level": "high" if k % 3 else "low"}
    kinds = (
        {"selection": {"user.name": f"U{m}", "http.response.body.bytes|gte": k % 20}},
        {"selection": {"source.ip|endswith": f".{m % 50}", "event.action|contains": _PARTS[m % 5]}, "nameless": {"user.name": None}, "condition": "selection and not nameless"},
        {"selection": {"user.name|re": f"^u{m}[0-9]?$"}, "quiet": {"host.name": f"h{k % 5}"}, "condition": "selection and not quiet"},
        {"selection": {"user.name": f"u{m}", "event.outcome": "FAILURE"}, "threshold": {"group_by": ["source.ip"], "count": 3, "window": "1d"}},
    )
    return made | {"detection": kinds[k % 4]}


@register("rules_many", EV + f""", k AS (SELECT range AS k, range // 4 AS m FROM range({_RULES})), e AS (SELECT *, CAST(substr(usr, 2) AS BIGINT) AS u FROM ev), hits AS (
 SELECT k, 1 AS alerts, 1 AS n FROM k JOIN e ON u = m AND bytes >= k % 20 WHERE k % 4 = 0
 UNION ALL SELECT k, 1, 1 FROM k JOIN e ON ip = '10.0.0.' || (m % 50) AND contains(action, (['rro', 'lic', 'urch', 'iew', 'ign'])[m % 5 + 1]) WHERE k % 4 = 1 AND usr IS NOT NULL
 UNION ALL SELECT k, 1, 1 FROM k JOIN e ON u = m WHERE k % 4 = 2 AND coalesce(host <> 'h' || (k % 5), true)
 UNION ALL SELECT k, 1, 1 FROM k JOIN e ON u // 10 = m AND u >= 10 WHERE k % 4 = 2 AND coalesce(host <> 'h' || (k % 5), true)
 UNION ALL SELECT k, 1, count(*) FROM (SELECT k, ip, epoch_us(ts) - epoch_us(lag(ts, 2) OVER (PARTITION BY k, ip ORDER BY ts, id)) <= 86400000000 AS hit FROM k JOIN e ON u = m AND outcome = 'failure' WHERE k % 4 = 3) GROUP BY k, ip HAVING bool_or(hit))
SELECT 'r' || k AS rule_id, CASE WHEN k % 3 > 0 THEN 'high' ELSE 'low' END AS severity, CAST(sum(alerts) AS BIGINT) AS alerts, CAST(sum(n) AS BIGINT) AS event_count FROM hits GROUP BY k""")  # fmt: skip
def rules_many(spark, sf_dir):
    """Two thousand rules, which an index proposes for each event: alerts and events by rule."""
    alerts = detect.run(events(spark, sf_dir), [rulebook.rule(_generated(k)) for k in range(_RULES)])
    return alerts.groupBy("rule_id", "severity").agg(F.count("*").alias("alerts"), F.sum("event_count").alias("event_count"))
