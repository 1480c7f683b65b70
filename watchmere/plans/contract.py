"""The engine's queries over the tables of the driver, each with SQL of the same result.

``events`` is read as security events: errors are failures, signups and errors are
authentication, purchases are privileged actions.  Every eleventh user has no name
and every thirteenth event no value, so nulls meet every comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import nested, resolve
from ..functions.text import url_decode
from ..operators import alerts as A
from ..operators import baseline, detect, quality, risk, sequence, stateful
from ..operators.enrich import business_hours, enrich, first_seen
from ..sources import rulebook
from ..sources.lookups import Lookups
from .search import compile_search

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

STAMP, SQL_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"
FAILURE, LOGIN = "failure", "authentication"
DAY = 86_400_000_000

EV = """WITH ev AS (SELECT event_id AS id, ts, event_type AS action,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome,
  CASE WHEN event_type IN ('view', 'click') THEN 'web' WHEN event_type = 'purchase' THEN 'iam' ELSE 'authentication' END AS category,
  CASE WHEN user_id % 11 <> 0 THEN 'u' || user_id END AS usr, '10.0.0.' || (user_id % 50) AS ip, user_id % 50 < 10 AS internal,
  CASE WHEN event_id % 13 <> 0 THEN CAST(trunc(value) AS BIGINT) END AS bytes,
  'h' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) AS host FROM events)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as canonical events; only the columns of a query are read."""
    return as_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_events(e: DataFrame) -> DataFrame:
    """Rows of the table, a stream or not, as canonical events."""
    kind = F.col("event_type")
    user = F.col("user_id")
    leaves = {
        "@timestamp": F.col("ts").cast("timestamp"), "event.code": F.col("event_id"), "event.action": kind,
        "event.outcome": F.when(kind == "error", FAILURE).otherwise("success"),
        "event.category": F.when(kind.isin("view", "click"), "web").when(kind == "purchase", "iam").otherwise(LOGIN),
        "user.name": F.when(user % 11 != 0, F.concat(F.lit("u"), user)), "source.ip": F.concat(F.lit("10.0.0."), user % 50), "source.internal": user % 50 < 10,
        "http.response.body.bytes": F.when(F.col("event_id") % 13 != 0, F.col("value").cast("long")),
        "host.name": F.concat(F.lit("h"), F.get_json_object("props", "$.k").cast("int") % 5),
    }
    return e.select(*nested(leaves), F.col("event_id").alias("_seq"))


def stamp(column: Column | str) -> Column:
    return F.date_format(column, STAMP)


def flat(df: DataFrame, **names: str) -> DataFrame:
    """Columns with underscores for dots; further names by keyword, without ``_seq``."""
    keep = [c for c in df.columns if c != "_seq"]
    return df.select(*[F.col(f"`{c}`").alias(names.get(c.replace(".", "_"), c.replace(".", "_"))) for c in keep])


def register(name: str, sql: str | None = None):
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return put


# ---- the search language


def _search(name: str, text: str, sql: str, **names: str) -> None:
    register(name, EV + sql)(lambda spark, sf_dir: flat(compile_search(events(spark, sf_dir), text), **names))


_ID = " | fields event.code"
_PICK = {
    "search_eq": ("event.outcome = FAILURE and user.name = U5", "outcome = 'failure' AND usr = 'u5'"),
    "search_neq_null": ("user.name != u5", "usr IS NULL OR usr <> 'u5'"),
    "search_in": ("event.action in [view, Click] or user.name in [u7, u8]", "action IN ('view', 'click') OR usr IN ('u7', 'u8')"),
    "search_contains": ("user.name contains U1", "contains(usr, 'u1')"),
    "search_starts_ends": ("event.action startswith PU and user.name endswith 3", "action LIKE 'pu%' AND usr LIKE '%3'"),
    "search_regex": ('user.name =~ "^U(1|2)[0-4]$"', "regexp_matches(usr, '^u(1|2)[0-4]$', 'i')"),
    "search_exists": ("http.response.body.bytes and user.name = *", "bytes IS NOT NULL AND usr IS NOT NULL"),
    "search_absent": ("user.name != * or no.such.field = 1", "usr IS NULL"),
    "search_num_cmp": ("http.response.body.bytes >= 20 and http.response.body.bytes < 70.5", "bytes >= 20 AND bytes < 70.5"),
    "search_time_cmp": ('@timestamp >= "2024-01-10T12:00:00" and @timestamp < "2024-01-12"', "ts >= TIMESTAMP '2024-01-10 12:00:00' AND ts < TIMESTAMP '2024-01-12'"),
    "search_bool_not": ("source.internal = true and not (user.name = u5 or http.response.body.bytes > 30)", "internal AND NOT (coalesce(usr = 'u5', false) OR coalesce(bytes > 30, false))"),
}
for _name, (_text, _where) in _PICK.items():
    _search(_name, _text + _ID, f"SELECT CAST(id AS INTEGER) AS event_code FROM ev WHERE {_where}")

_search("search_where", "event.outcome = failure | where user.name = *" + _ID, "SELECT CAST(id AS INTEGER) AS event_code FROM ev WHERE outcome = 'failure' AND usr IS NOT NULL")
_search("stats_count_dc", "stats count, count(user.name) as rows, dc(user.name) as users by event.action",
        "SELECT action AS event_action, count(*) AS count, count(*) AS rows, count(DISTINCT usr) AS users FROM ev GROUP BY action")
_search("stats_sum_avg", "stats sum(http.response.body.bytes) as total, avg(http.response.body.bytes) as mean by user.name",
        "SELECT coalesce(usr, 'None') AS user_name, round(coalesce(sum(bytes), 0)::DOUBLE, 2) AS total, round(coalesce(avg(bytes), 0), 2) AS mean FROM ev GROUP BY 1")
_search("stats_min_max", "stats min(http.response.body.bytes) as low, max(http.response.body.bytes) as high by event.category, event.outcome",
        "SELECT category AS event_category, outcome AS event_outcome, min(bytes) AS low, max(bytes) AS high FROM ev GROUP BY 1, 2")
_search("stats_values", "stats values(user.name) as names by source.ip",
        "SELECT ip AS source_ip, coalesce(array_to_string(list_sort(list(DISTINCT usr) FILTER (usr IS NOT NULL))[1:10], ', '), '') AS names FROM ev GROUP BY 1")
_search("stats_empty", "event.action = nothing | stats count", "SELECT count(*) AS count FROM ev WHERE action = 'nothing' HAVING count(*) > 0")
_SHARE = "SELECT usr AS user_name, count(*) AS count, printf('%.1f%%', 100.0 * count(*) / sum(count(*)) OVER ()) AS percent FROM ev WHERE usr IS NOT NULL GROUP BY usr ORDER BY count {}, usr LIMIT {}"
_search("top_n", "top user.name 7", _SHARE.format("DESC", 7))
_search("rare_n", "rare user.name 5", _SHARE.format("ASC", 5))
_search("sort_head", "event.outcome = failure | sort -http.response.body.bytes | head 20 | fields event.code, http.response.body.bytes",
        "SELECT CAST(id AS INTEGER) AS event_code, bytes AS http_response_body_bytes FROM ev WHERE outcome = 'failure' ORDER BY bytes DESC NULLS LAST, id LIMIT 20")
_search("tail_n", "event.category = web | tail 15" + _ID, "SELECT CAST(id AS INTEGER) AS event_code FROM ev WHERE category = 'web' ORDER BY id DESC LIMIT 15")
_search("fields_eval", "eval who = user.name | fields event.code, who, missing.field",
        "SELECT CAST(id AS INTEGER) AS event_code, usr AS who, CAST(NULL AS VARCHAR) AS missing_field FROM ev")
_search("timechart_1h_by", "timechart span=1h count by event.category",
        "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS time, category AS event_category, count(*) AS count FROM ev GROUP BY 1, 2")

_ORDERED = "SELECT CAST(id AS INTEGER) AS event_code, {0} AS {1} FROM ev{2} ORDER BY {3}"
_search("sort_fields_head", "sort -http.response.body.bytes | fields event.code, http.response.body.bytes | head 9", _ORDERED.format("bytes", "http_response_body_bytes", "", "bytes DESC NULLS LAST, id LIMIT 9"))
_search("sort_eval_head", "sort http.response.body.bytes | eval http.response.body.bytes = event.action | fields event.code, event.action | head 12",
        _ORDERED.format("action", "event_action", "", "bytes ASC NULLS LAST, id LIMIT 12"))
_search("sort_text_desc", "event.outcome = failure | sort -user.name | head 15 | fields event.code, user.name", _ORDERED.format("usr", "user_name", " WHERE outcome = 'failure'", "usr DESC NULLS FIRST, id DESC LIMIT 15"))
_search("tail_after_sort", "sort user.name | tail 11 | fields event.code, user.name", _ORDERED.format("usr", "user_name", "", "usr DESC NULLS FIRST, id DESC LIMIT 11"))
_search("head_but_last", "event.category = iam | head -30 | fields event.code, event.action",
        "SELECT CAST(id AS INTEGER) AS event_code, action AS event_action FROM ev WHERE category = 'iam' QUALIFY row_number() OVER (ORDER BY id DESC) > 30")
_search("tail_but_first", "event.category = iam | sort -@timestamp | tail -30 | fields event.code, event.action",
        "SELECT CAST(id AS INTEGER) AS event_code, action AS event_action FROM ev WHERE category = 'iam' QUALIFY row_number() OVER (ORDER BY ts DESC, id) > 30")
_search("search_string_cmp", "user.name >= u20 and host.name < h3" + _ID, "SELECT CAST(id AS INTEGER) AS event_code FROM ev WHERE usr >= 'u20' AND host < 'h3'")
_search("search_infinite", "http.response.body.bytes < inf and not http.response.body.bytes > nan" + _ID, "SELECT CAST(id AS INTEGER) AS event_code FROM ev WHERE bytes IS NOT NULL")
_search("search_truth", "user.name = true and http.response.body.bytes != true" + _ID, "SELECT CAST(id AS INTEGER) AS event_code FROM ev WHERE usr IS NOT NULL AND (bytes IS NULL OR bytes = 0)")
_search("timechart_plain", "event.outcome = failure | timechart span=1d avg(http.response.body.bytes)", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS time, count(*) AS count FROM ev WHERE outcome = 'failure' GROUP BY 1")
_search("stats_head", "stats count by user.name, event.action | head 9",
        "SELECT user_name, event_action, count FROM (SELECT coalesce(usr, 'None') AS user_name, action AS event_action, count(*) AS count, min(id) AS first FROM ev GROUP BY 1, 2) ORDER BY first LIMIT 9")


# ---- enrichment


@register("enrich_lookup", EV + """, x AS (SELECT id, '203.0.113.' || (CAST(substr(ip, 8) AS INTEGER)) AS ip, usr, host, ts FROM ev)
SELECT CAST(id AS INTEGER) AS event_code, CASE WHEN CAST(substr(ip, 11) AS INTEGER) < 16 THEN 'Aland' WHEN CAST(substr(ip, 11) AS INTEGER) < 32 THEN 'Borduria' END AS country,
  CASE WHEN ip = '203.0.113.7' THEN 'feed' END AS intel, CASE WHEN ip = '203.0.113.7' THEN 50 END AS confidence,
  CASE host WHEN 'h1' THEN 'high' WHEN 'h2' THEN 'medium' END AS criticality,
  CASE WHEN usr IS NOT NULL THEN usr = 'u3' END AS privileged, CASE WHEN usr IS NOT NULL THEN CASE WHEN usr = 'u3' THEN 'admin' ELSE 'unknown' END END AS user_type,
  hour(ts) BETWEEN 8 AND 18 AND isodow(ts) < 6 AS business_hours FROM x""")  # fmt: skip
def enrich_lookup(spark, sf_dir):
    found = Lookups(
        assets={"h1": {"criticality": "high"}, "h2": {"role": "web"}}, identities={"u3": {"privileged": True, "type": "admin"}},
        networks=[("203.0.113.0/28", ("Aland", "AX", "A")), ("203.0.113.0/27", ("Borduria", "BO", "B"))], intel={"203.0.113.7": {"source": "feed", "category": "scan"}},
    )
    e = events(spark, sf_dir)
    e = e.withColumn("source", F.col("source").withField("ip", F.regexp_replace("source.ip", "^10\\.0\\.0", "203.0.113")))
    e = enrich(e, found, novelty=False)
    return e.select(
        resolve(e, "event.code").alias("event_code"), resolve(e, "source.geo.country_name").alias("country"), resolve(e, "threat.indicator.source").alias("intel"), resolve(e, "threat.indicator.confidence").alias("confidence"),
        resolve(e, "host.criticality").alias("criticality"), resolve(e, "user.privileged").alias("privileged"), resolve(e, "user.type").alias("user_type"), resolve(e, "event.business_hours").alias("business_hours"),
    )


@register("first_seen", EV + """SELECT CAST(id AS INTEGER) AS event_code, row_number() OVER (PARTITION BY ip ORDER BY ts, id) = 1 AS new_ip,
  CASE WHEN usr IS NOT NULL THEN row_number() OVER (PARTITION BY usr, host ORDER BY ts, id) = 1 END AS new_host FROM ev""")  # fmt: skip
def first_seen_query(spark, sf_dir):
    e = events(spark, sf_dir)
    e = e.select("`@timestamp`", "_seq", F.col("event.code").alias("event_code"), F.col("source.ip").alias("ip"), F.col("user.name").alias("usr"), F.col("host.name").alias("host"))
    return first_seen(e, {"new_ip": ["ip"], "new_host": ["usr", "host"]}).select("event_code", "new_ip", "new_host")


@register("business_hours", EV + "SELECT hour(ts) BETWEEN 8 AND 18 AND isodow(ts) < 6 AS business, count(*) AS n FROM ev GROUP BY 1")
def business_hours_query(spark, sf_dir):
    return events(spark, sf_dir).groupBy(business_hours(F.col("`@timestamp`")).alias("business")).agg(F.count("*").alias("n"))


@register("url_decode", "SELECT page_id, url_decode(url || '?q=%41+%zz%C3%A9%2') AS decoded FROM pages")
def url_decode_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", url_decode(F.concat("url", F.lit("?q=%41+%zz%C3%A9%2"))).alias("decoded"))


# ---- rules

_CONDITION = {
    "id": "odd_event", "title": "Odd", "level": "high", "entity": "user.name",
    "detection": {"a": {"event.action": ["view", "error"], "source.internal": False}, "b": {"user.name|re": "^U[0-4]+$"}, "c": {"http.response.body.bytes|gte": 90, "user.name|contains|all": ["u", "1"]},
                  "condition": "a and not b or c"},
}
_IS_ODD = "(action IN ('view', 'error') AND NOT internal AND NOT coalesce(regexp_matches(usr, '^u[0-4]+$', 'i'), false)) OR coalesce(bytes >= 90 AND contains(usr, 'u') AND contains(usr, '1'), false)"


@register("rule_condition", EV + f"SELECT CAST(id AS INTEGER) AS event_code FROM ev WHERE {_IS_ODD}")
def rule_condition(spark, sf_dir):
    e = detect.tagged(events(spark, sf_dir), [rulebook.rule(_CONDITION)])
    return e.filter(F.array_contains("rules", "odd_event")).select(F.col("event.code").alias("event_code"))


@register("web_payload_rules", """SELECT doc_id, rule FROM (SELECT doc_id, unnest(list_filter([CASE WHEN regexp_matches(text, '[a-z]+@[a-z]+', 'is') THEN 'mail' END,
  CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'password') THEN 'words' END], lambda x: x IS NOT NULL)) AS rule FROM documents)""")  # fmt: skip
def web_payload_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = [rulebook.rule({"id": "mail", "detection": {"selection": {"text|re": "[a-z]+@[a-z]+"}}}), rulebook.rule({"id": "words", "detection": {"selection": {"text|contains": ["license", "password"]}, "condition": "1 of sel*"}})]
    return detect.tagged(docs, rules).select("doc_id", F.explode("rules").alias("rule"))


def _threshold(count: int, window: str, distinct: str | None = None) -> rulebook.Rule:
    limit = {"group_by": ["source.ip"], "count": count, "window": window} | ({"distinct": distinct} if distinct else {})
    return rulebook.rule({"id": "bursts", "title": "Bursts", "level": "high", "detection": {"selection": {"event.outcome": FAILURE}, "threshold": limit, "condition": "selection"}})


def _plain(alerts: DataFrame) -> DataFrame:
    return alerts.select("rule_id", "entity", stamp("ts").alias("ts"), "event_count")


_BURST = """, near AS (SELECT *, {} AS hit FROM ev WHERE outcome = 'failure')
SELECT 'bursts' AS rule_id, ip AS entity, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS ts, count(*) AS event_count FROM near GROUP BY ip HAVING bool_or(hit)"""
_WITHIN = "coalesce(epoch_us(ts) - epoch_us(lag(ts, {}) OVER (PARTITION BY ip ORDER BY ts, id)) <= {}, false)"


@register("threshold_count", EV + _BURST.format(_WITHIN.format(4, DAY)))
def threshold_count(spark, sf_dir):
    return _plain(detect.thresholds(events(spark, sf_dir), [_threshold(5, "1d")]))


@register("threshold_distinct", EV + _BURST.format("count(DISTINCT coalesce(usr, 'None')) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) >= 3"))
def threshold_distinct(spark, sf_dir):
    return _plain(detect.thresholds(events(spark, sf_dir), [_threshold(3, "12h", "user.name")]))


_COUNTS = [3, 5, 8]


@register("threshold_sweep", EV + " UNION ALL ".join(
    f"SELECT {n} AS at, count(*) AS alerts FROM (SELECT ip FROM (SELECT ip, {_WITHIN.format(n - 1, DAY)} AS hit FROM ev WHERE outcome = 'failure') GROUP BY ip HAVING bool_or(hit)) HAVING count(*) > 0" for n in _COUNTS))
def threshold_sweep(spark, sf_dir):
    return detect.sweep(events(spark, sf_dir), _threshold(5, "1d"), _COUNTS).groupBy("at").agg(F.count("*").alias("alerts"))


# ---- stateful, sequences, baselines


@register("priv_esc_asof", EV + """, e AS (SELECT *, category = 'authentication' AND outcome = 'success' AND NOT internal AS login FROM ev WHERE usr IS NOT NULL),
 p AS (SELECT *, last_value(CASE WHEN login THEN {'ts': ts, 'id': id, 'ip': ip} END IGNORE NULLS) OVER (PARTITION BY usr ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM e WHERE login OR action = 'purchase'),
 f AS (SELECT *, row_number() OVER (PARTITION BY usr, prior.id ORDER BY ts, id) AS n FROM p WHERE action = 'purchase' AND prior IS NOT NULL)
SELECT 'priv_esc_after_external_login' AS rule_id, prior.ip AS entity, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, CAST(1 AS BIGINT) AS event_count FROM f WHERE n = 1 AND epoch_us(ts) - epoch_us(prior.ts) <= 86400000000""")  # fmt: skip
def priv_esc_asof(spark, sf_dir):
    e = events(spark, sf_dir)
    e = e.withColumn("event", F.col("event").withField("action", F.when(F.col("event.action") == "purchase", "sudo").otherwise(F.col("event.action"))))
    return _plain(stateful.escalation_after_login(e, minutes=24 * 60))


@register("success_after_failures", EV + """, a AS (SELECT ip, ts, id, outcome, row_number() OVER (PARTITION BY ip ORDER BY ts, id) AS n FROM ev WHERE category = 'authentication'),
 r AS (SELECT ip, 0::BIGINT AS n, []::BIGINT[] AS kept, false AS fires, NULL::TIMESTAMP AS ts, 0::BIGINT AS size FROM (SELECT DISTINCT ip FROM a)),
 fold AS (SELECT * FROM (WITH RECURSIVE s AS (SELECT * FROM r UNION ALL SELECT ip, n, CASE WHEN outcome = 'failure' THEN list_append(k, us) WHEN len(k) >= 4 THEN [] ELSE k END, outcome = 'success' AND len(k) >= 4, ts, len(k)
   FROM (SELECT a.ip, a.n, a.ts, a.outcome, epoch_us(a.ts) AS us, list_filter(s.kept, lambda x: epoch_us(a.ts) - x <= 86400000000) AS k FROM s JOIN a ON a.ip = s.ip AND a.n = s.n + 1)) SELECT * FROM s))
SELECT 'auth_success_after_failures' AS rule_id, ip AS entity, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, size + 1 AS event_count FROM fold WHERE fires""")  # fmt: skip
def success_after_failures(spark, sf_dir):
    return _plain(stateful.success_after_failures(events(spark, sf_dir), threshold=4, minutes=24 * 60))


_RAW_RULES = [
    rulebook.rule({"id": "outside_failure", "title": "Outside failure", "level": "medium", "detection": {"selection": {"event.outcome": FAILURE, "source.internal": False}}}),
    rulebook.rule({"id": "large_view", "title": "Large view", "level": "high", "detection": {"selection": {"event.action": "view", "http.response.body.bytes|gt": 30}}}),
]


def _raw(spark, sf_dir) -> DataFrame:
    """Stateless alerts: failures of outside addresses, and large web events."""
    return detect.stateless(events(spark, sf_dir), _RAW_RULES)


_RAW = """, raw AS (SELECT 'outside_failure' AS rule_id, 0 AS o, ip AS entity, ts, id, internal, 35 AS base FROM ev WHERE outcome = 'failure' AND NOT internal
 UNION ALL SELECT 'large_view', 1, ip, ts, id, internal, 60 FROM ev WHERE action = 'view' AND bytes > 30),
 dd AS (SELECT *, substr(sha256(rule_id || '|' || entity || '|' || strftime(ts, '%Y-%m-%dT%H')), 1, 16) AS fingerprint FROM raw
   QUALIFY row_number() OVER (PARTITION BY rule_id, entity, date_trunc('hour', ts) ORDER BY ts, id) = 1),
 ends AS (SELECT entity, max(ts) AS last FROM dd GROUP BY entity),
 scored AS (SELECT entity, sum(base * CASE WHEN internal THEN 1.0 ELSE 1.2 END * pow(0.5, (epoch_us(last) - epoch_us(ts)) / 86400000000.0)) AS score, count(*) AS alerts, max(ts) AS last FROM dd JOIN ends USING (entity) GROUP BY entity)
"""


@register("fingerprint_dedup", EV + _RAW + f"SELECT fingerprint, rule_id, entity, strftime(ts, '{SQL_STAMP}') AS ts FROM dd")
def fingerprint_dedup(spark, sf_dir):
    return A.dedup(_raw(spark, sf_dir)).select("fingerprint", "rule_id", "entity", stamp("ts").alias("ts"))


@register("risk_decay", EV + _RAW + "SELECT entity, round(score, 3) AS score, alerts FROM scored")
def risk_decay(spark, sf_dir):
    return risk.entities(risk.scored(A.dedup(_raw(spark, sf_dir)))).select("entity", F.round("score", 3).alias("score"), "alerts")


@register("case_severity", EV + _RAW + """SELECT 'CASE-' || strftime(last, '%Y%m%d') || '-' || upper(substr(sha256('ip:' || entity), 1, 6)) AS case_id, entity,
  CASE WHEN score >= 180 THEN 'critical' WHEN score >= 130 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN score >= 180 THEN 1 WHEN score >= 130 THEN 4 ELSE 24 END AS sla_hours FROM scored WHERE score >= 100""")  # fmt: skip
def case_severity(spark, sf_dir):
    found = risk.cases(risk.entities(risk.scored(A.dedup(_raw(spark, sf_dir)))))
    return found.select("case_id", "entity", "severity", "sla_hours")


@register("severity_summary", EV + _RAW + "SELECT CASE rule_id WHEN 'large_view' THEN 'high' ELSE 'medium' END AS severity, count(*) AS n FROM dd GROUP BY 1")
def severity_summary(spark, sf_dir):
    return A.dedup(_raw(spark, sf_dir)).groupBy("severity").agg(F.count("*").alias("n"))


_CHAIN = {"id": "fail_then_view", "title": "Failure, then large view", "sequence": {"ordered": True, "within": "1d", "stages": [{"name": "a", "rule_id": "outside_failure"}, {"name": "b", "rule_id": "large_view"}]}}


@register("sequence_chain")
def sequence_chain(spark, sf_dir):
    return _plain(sequence.chains(_raw(spark, sf_dir), rulebook.sequence(_CHAIN)))


_BASE = """, cut AS (SELECT *, row_number() OVER (ORDER BY ts, id) <= (SELECT count(*) // 2 FROM ev) AS train FROM ev),
 prof AS (SELECT usr, list(DISTINCT hour(ts)) AS hours, list(DISTINCT host) AS hosts FROM cut WHERE train AND usr IS NOT NULL AND outcome = 'success' GROUP BY usr),
 test AS (SELECT c.*, hours, hosts FROM cut c JOIN prof USING (usr) WHERE NOT train AND outcome = 'success' AND category = 'authentication')
"""


@register("baseline_hour", EV + _BASE + f"SELECT usr AS entity, strftime(min(ts), '{SQL_STAMP}') AS ts FROM test WHERE NOT list_contains(hours, hour(ts)) AND NOT internal GROUP BY usr")
def baseline_hour(spark, sf_dir):
    return baseline.unusual_hour(baseline.logins(baseline.split(events(spark, sf_dir)))).select("entity", stamp("ts").alias("ts"))


@register("baseline_host", EV + _BASE + f"SELECT usr AS entity, strftime(min(ts), '{SQL_STAMP}') AS ts FROM test WHERE NOT list_contains(hosts, host) GROUP BY usr, host")
def baseline_host(spark, sf_dir):
    parts = baseline.split(events(spark, sf_dir))
    return baseline.new_host(baseline.logins(parts), baseline.hosts(parts)).select("entity", stamp("ts").alias("ts"))


@register("volume_outlier", EV + _BASE + f""", tr AS (SELECT ip, count(*) AS n FROM cut WHERE train AND NOT internal GROUP BY ip),
 lim AS (SELECT avg(n) + 0.5 * coalesce(nullif(stddev_pop(n), 0), 1) AS lim, count(*) AS k FROM tr)
SELECT ip AS entity, strftime(min(ts), '{SQL_STAMP}') AS ts FROM cut, lim WHERE NOT train GROUP BY ip, lim, k HAVING count(*) > lim AND k >= 5 AND NOT arg_min(internal, (ts, id))""")  # fmt: skip
def volume_outlier(spark, sf_dir):
    return baseline.volume_outlier(baseline.split(events(spark, sf_dir)), sigma=0.5).select("entity", stamp("ts").alias("ts"))


@register("quality_metrics", EV + _RAW + """, truth AS (SELECT '10.0.0.' || i AS entity, CASE WHEN i % 2 = 0 THEN 'outside_failure' ELSE 'never' END AS want FROM range(5, 25) t(i)),
 c AS (SELECT (SELECT count(*) FROM dd WHERE entity IN (SELECT entity FROM truth)) AS tp, (SELECT count(*) FROM dd WHERE entity NOT IN (SELECT entity FROM truth)) AS fp,
  (SELECT count(*) FROM truth t WHERE EXISTS (SELECT 1 FROM dd WHERE dd.entity = t.entity AND dd.rule_id = t.want)) AS hit),
 r AS (SELECT *, tp / (tp + fp) AS p, hit / 20 AS r FROM c)
SELECT tp AS true_positives, fp AS false_positives, hit AS detected, 20 - hit AS missed, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM r""")  # fmt: skip
def quality_metrics(spark, sf_dir):
    truth = spark.range(5, 25).select(F.concat(F.lit("10.0.0."), "id").alias("entity"), F.array(F.when(F.col("id") % 2 == 0, "outside_failure").otherwise("never")).alias("expected_rules"))
    return quality.score(A.dedup(_raw(spark, sf_dir)), truth)
