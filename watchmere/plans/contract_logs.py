"""Further registered queries: log parsers over lines written from the tables, alert texts, chains, cases, reports and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import report, sinks
from ..functions.fields import CONTEXT, resolve
from ..operators import alerts as A
from ..operators import detect, quality, risk, sequence, stateful
from ..operators.enrich import enrich
from ..sources import files, lookups, parsers, rulebook
from ..sources.lookups import Lookups
from ..session import shared
from . import pipeline
from .contract import _RAW, EV, FAILURE, SQL, SQL_STAMP, _plain, _threshold, events, flat, register, stamp

YEAR = 2024
SECOND = "strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')"


def _table(spark, sf_dir: str) -> DataFrame:
    """The table's rows with the parts that lines are written from."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumns({"day": F.concat(F.date_format("ts", "MMM "), F.lpad(F.dayofmonth("ts").cast("string"), 2, " "), F.date_format("ts", " HH:mm:ss")), "u": F.col("user_id"), "id": F.col("event_id")})


def _parsed(lines: DataFrame, source: str, fields: list[str]) -> DataFrame:
    """Leaves of the lines in column ``line``, flat; rejects are left out."""
    got = lines.select(parsers.parse(F.col("line"), source, YEAR).alias("p")).filter("p IS NOT NULL")
    cell = lambda f: F.date_format(F.col("p").getField(f), "yyyy-MM-dd HH:mm:ss") if f == "@timestamp" else F.col("p").getField(f)
    return got.select(*[cell(f).alias(f.replace("@", "").replace(".", "_")) for f in fields])


# ---- parsers


@register("parse_sshd", f"""SELECT CAST(event_id AS INTEGER) AS process_pid, {SECOND} AS timestamp, 'h' || (user_id % 7) AS host_name, '10.1.' || (user_id % 9) || '.' || (event_id % 200) AS source_ip,
  CAST(1024 + event_id % 60000 AS INTEGER) AS source_port, 'u' || user_id AS user_name, user_id % 11 = 0 AS user_invalid, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS event_outcome, 'password' AS auth_method FROM events""")  # fmt: skip
def parse_sshd(spark, sf_dir):
    line = F.format_string(
        "%s h%d sshd[%d]: %s Password for %su%d from 10.1.%d.%d port %d ssh2", "day", F.col("u") % 7, "id", F.when(F.col("event_type") == "error", "Failed").otherwise("Accepted"),
        F.when(F.col("u") % 11 == 0, "invalid user ").otherwise(""), "u", F.col("u") % 9, F.col("id") % 200, 1024 + F.col("id") % 60000,
    )
    return _parsed(_table(spark, sf_dir).select(line.alias("line")), "auth", ["process.pid", "@timestamp", "host.name", "source.ip", "source.port", "user.name", "user.invalid", "event.outcome", "auth.method"])


@register("parse_sshd_key", f"""SELECT 'h' || event_id AS host_name, {SECOND} AS timestamp, '10.1.0.' || (user_id % 200) AS source_ip, 'u' || user_id AS user_name, 'publickey' AS auth_method, 'success' AS event_outcome,
  CAST(NULL AS INTEGER) AS source_port FROM events""")  # fmt: skip
def parse_sshd_key(spark, sf_dir):
    line = F.format_string("%s h%d sshd[77]: Accepted publickey for u%d from 10.1.0.%d", "day", "id", "u", F.col("u") % 200)
    return _parsed(_table(spark, sf_dir).select(line.alias("line")), "auth", ["host.name", "@timestamp", "source.ip", "user.name", "auth.method", "event.outcome", "source.port"])


@register("parse_sudo", f"""SELECT 'h' || event_id AS host_name, {SECOND} AS timestamp, 'u' || user_id AS user_name, CASE WHEN user_id % 5 = 0 THEN 'failure' ELSE 'success' END AS event_outcome,
  CASE WHEN user_id % 5 = 0 THEN 'root' ELSE 't' || (user_id % 3) END AS user_target, CASE WHEN user_id % 5 = 0 THEN '' ELSE '/bin/cat /x y' || user_id END AS process_command_line, 'process' AS event_category FROM events""")  # fmt: skip
def parse_sudo(spark, sf_dir):
    refused = F.lit("user NOT in sudoers ; TTY=pts/0")
    granted = F.format_string("TTY=pts/0 ; PWD=/home/x ; USER=t%d ; COMMAND=/bin/cat /x y%d", F.col("u") % 3, "u")
    line = F.format_string("%s h%d sudo:    u%d : %s", "day", "id", "u", F.when(F.col("u") % 5 == 0, refused).otherwise(granted))
    return _parsed(_table(spark, sf_dir).select(line.alias("line")), "auth", ["host.name", "@timestamp", "user.name", "event.outcome", "user.target", "process.command_line", "event.category"])


@register("parse_access", f"""SELECT '10.2.0.' || (user_id % 250) AS source_ip, {SECOND} AS timestamp, CASE WHEN user_id % 4 = 0 THEN 'u' || user_id END AS user_name, 'POST' AS http_request_method, CAST(200 + 100 * (user_id % 4) AS INTEGER) AS http_response_status_code,
  CASE WHEN event_id % 13 = 0 THEN 0 ELSE event_id END AS http_response_body_bytes, '/a%20b+c/%zz?id=' || event_id AS url_original, '/a b+c/%zz?id=' || event_id AS url_path, CASE WHEN user_id % 4 < 2 THEN 'success' ELSE 'failure' END AS event_outcome,
  CASE WHEN user_id % 2 = 0 THEN 'curl/8 (x)' ELSE '' END AS user_agent_original FROM events""")  # fmt: skip
def parse_access(spark, sf_dir):
    line = F.concat(
        F.lit("10.2.0."), F.col("u") % 250, F.lit(" - "), F.when(F.col("u") % 4 == 0, F.concat(F.lit("u"), "u")).otherwise("-"), F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0500] "POST /a%20b+c/%zz?id='),
        "id", F.lit(' HTTP/1.1" '), 200 + 100 * (F.col("u") % 4), F.lit(" "), F.when(F.col("id") % 13 == 0, "-").otherwise(F.col("id").cast("string")), F.when(F.col("u") % 2 == 0, ' "-" "curl/8 (x)"').otherwise(""),
    )
    return _parsed(_table(spark, sf_dir).select(line.alias("line")), "nginx", ["source.ip", "@timestamp", "user.name", "http.request.method", "http.response.status_code", "http.response.body.bytes", "url.original", "url.path", "event.outcome", "user_agent.original"])


@register("parse_windows", f"""SELECT 'W' || event_id AS host_name, {SECOND} AS timestamp, CAST(c AS INTEGER) AS event_code, CASE c WHEN 4624 THEN 'logon' WHEN 4625 THEN 'logon' WHEN 4672 THEN 'special_privileges_assigned' WHEN 1102 THEN 'audit_log_cleared' ELSE 'event_9999' END AS event_action,
  CASE c WHEN 4624 THEN 'authentication' WHEN 4625 THEN 'authentication' WHEN 4672 THEN 'iam' ELSE 'configuration' END AS event_category, CASE c WHEN 4625 THEN 'failure' WHEN 9999 THEN 'unknown' ELSE 'success' END AS event_outcome,
  CASE WHEN user_id % 11 <> 0 THEN '10.3.0.' || (user_id % 250) END AS source_ip, CASE WHEN user_id % 3 = 0 THEN 's' ELSE 'u' END || user_id AS user_name,
  CASE user_id % 12 WHEN 0 THEN NULL WHEN 1 THEN '1' WHEN 2 THEN 'interactive' WHEN 3 THEN 'network' WHEN 4 THEN 'batch' WHEN 5 THEN 'service' WHEN 6 THEN '6' WHEN 7 THEN 'unlock' WHEN 8 THEN 'network_cleartext' WHEN 9 THEN 'new_credentials' WHEN 10 THEN 'remote_interactive' ELSE 'cached_interactive' END AS winlog_logon_type
  FROM (SELECT *, CASE event_type WHEN 'view' THEN 4624 WHEN 'click' THEN 4625 WHEN 'purchase' THEN 4672 WHEN 'signup' THEN 9999 ELSE 1102 END AS c FROM events)""")  # fmt: skip
def parse_windows(spark, sf_dir):
    code = F.create_map(*[F.lit(x) for kv in {"view": 4624, "click": 4625, "purchase": 4672, "signup": 9999, "error": 1102}.items() for x in kv])[F.col("event_type")]
    user = F.concat(F.lit("u"), "u")
    data = F.struct(
        F.when(F.col("u") % 3 != 0, user).alias("TargetUserName"), F.concat(F.lit("s"), "u").alias("SubjectUserName"), F.when(F.col("u") % 11 == 0, "-").otherwise(F.concat(F.lit("10.3.0."), F.col("u") % 250)).alias("IpAddress"), (F.col("u") % 12).alias("LogonType"),
    )
    head = [F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("TimeCreated"), F.concat(F.lit("W"), "id").alias("Computer")]
    nested, flat_ = F.to_json(F.struct(code.alias("EventID"), *head, data.alias("EventData"))), F.to_json(F.struct(code.alias("event_id"), *head, data["TargetUserName"].alias("TargetUserName"), data["SubjectUserName"].alias("SubjectUserName"), data["IpAddress"].alias("IpAddress"), data["LogonType"].alias("LogonType")))
    line = F.when(F.col("id") % 2 == 0, nested).otherwise(flat_)
    return _parsed(_table(spark, sf_dir).select(line.alias("line")), "winlog", ["host.name", "@timestamp", "event.code", "event.action", "event.category", "event.outcome", "source.ip", "user.name", "winlog.logon_type"])


@register("parse_suricata", f"""SELECT event_id AS rule_signature_id, {SECOND} AS timestamp, '10.4.0.' || (user_id % 250) AS source_ip, CAST(user_id AS INTEGER) AS source_port, CAST(22 AS INTEGER) AS destination_port, 'tcp' AS network_protocol, 'sig ' || user_id AS rule_name,
  CAST(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 3 END AS INTEGER) AS event_severity, 'alert' AS event_kind FROM events WHERE event_type = 'error'""")  # fmt: skip
def parse_suricata(spark, sf_dir):
    alert = F.struct(F.concat(F.lit("sig "), "u").alias("signature"), F.col("id").alias("signature_id"), F.when(F.col("u") % 2 == 0, F.lit(1)).alias("severity"))
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0200'").alias("timestamp"), F.when(F.col("event_type") == "error", "alert").otherwise("flow").alias("event_type"),
        F.concat(F.lit("10.4.0."), F.col("u") % 250).alias("src_ip"), F.col("u").alias("src_port"), F.lit("10.0.0.1").alias("dest_ip"), F.lit(22).alias("dest_port"), F.lit("TCP").alias("proto"), alert.alias("alert"),
    ))
    return _parsed(_table(spark, sf_dir).select(line.alias("line")), "suricata", ["rule.signature_id", "@timestamp", "source.ip", "source.port", "destination.port", "network.protocol", "rule.name", "event.severity", "event.kind"])


@register("parse_cowrie", f"""SELECT 's' || event_id AS host_name, {SECOND} AS timestamp, '10.5.0.' || (user_id % 250) AS source_ip, 'u' || user_id AS user_name, true AS honeypot, CASE event_type WHEN 'view' THEN 'connection' WHEN 'click' THEN 'command_executed' ELSE 'ssh_login' END AS event_action,
  CASE event_type WHEN 'view' THEN 'unknown' WHEN 'error' THEN 'failure' ELSE 'success' END AS event_outcome, CASE event_type WHEN 'view' THEN 'network' WHEN 'click' THEN 'process' ELSE 'authentication' END AS event_category FROM events WHERE event_type <> 'signup'""")  # fmt: skip
def parse_cowrie(spark, sf_dir):
    name = F.create_map(*[F.lit(x) for kv in {"view": "session.connect", "click": "command.input", "purchase": "login.success", "error": "login.failed", "signup": "session.closed"}.items() for x in kv])[F.col("event_type")]
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.concat(F.lit("cowrie."), name).alias("eventid"), F.concat(F.lit("10.5.0."), F.col("u") % 250).alias("src_ip"), F.concat(F.lit("s"), "id").alias("sensor"), F.concat(F.lit("u"), "u").alias("username")))
    return _parsed(_table(spark, sf_dir).select(line.alias("line")), "cowrie", ["host.name", "@timestamp", "source.ip", "user.name", "honeypot", "event.action", "event.outcome", "event.category"])


@register("scan_files", """SELECT 'auth' AS source, count(*) FILTER (event_id % 10 <> 0) AS parsed, count(*) FILTER (event_id % 10 = 0) AS skipped FROM events
 UNION ALL SELECT 'nginx', count(*), CAST(0 AS BIGINT) FROM events WHERE event_type = 'view'""")  # fmt: skip
def scan_files(spark, sf_dir):
    """Two folders of log files, their sources found from their lines."""
    e, folder = _table(spark, sf_dir), shared(spark)
    auth = F.when(F.col("id") % 10 == 0, "kernel: nothing to see").otherwise(F.format_string("%s h sshd[1]: Failed password for u%d from 10.1.1.1 port 22", "day", "u"))
    e.select(auth.alias("value")).write.text(f"{folder}/a")
    web = F.concat(F.lit("10.2.0.1 - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET / HTTP/1.1" 200 5'))
    e.filter("event_type = 'view'").select(web.alias("value")).write.text(f"{folder}/b")
    found = files.scan(spark, {f"{folder}/a": None, f"{folder}/b": None}, YEAR)
    return found.stats.groupBy("source").agg(F.sum("parsed").alias("parsed"), F.sum("skipped").alias("skipped"))


# ---- enrichment and rules


@register("internal_addresses", """SELECT event_id, CASE user_id % 7 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN true ELSE false END AS internal FROM events""")
def internal_addresses(spark, sf_dir):
    from ..functions.net import is_internal

    known = F.array(*[F.lit(x) for x in ("10.9.9.9", "172.31.0.1", "172.32.0.1", "192.168.255.255", "::1", "10.0.0.300")], F.lit(None).cast("string"))
    return _table(spark, sf_dir).select("event_id", is_internal(F.get(known, (F.col("u") % 7).cast("int"))).alias("internal"))


@register("new_source_ip", EV + """SELECT CAST(id AS INTEGER) AS event_code, row_number() OVER (PARTITION BY ip ORDER BY ts, id) = 1 AS source_first_seen,
  CASE WHEN usr IS NOT NULL THEN row_number() OVER (PARTITION BY usr, ip ORDER BY ts, id) = 1 END AS user_new_source_ip FROM ev""")  # fmt: skip
def new_source_ip(spark, sf_dir):
    e = enrich(events(spark, sf_dir), Lookups())
    return flat(e.select(*[resolve(e, f).alias(f) for f in ("event.code", "source.first_seen", "user.new_source_ip")]))


_MODIFIERS = {"a1": {"user.name|startswith": "U1", "http.response.body.bytes|lt": 60}, "a2": {"user.name|endswith": ["3", "7"], "http.response.body.bytes|lte": "40"}, "b": {"user.name": None}, "c": {"http.response.body.bytes|gt": 95, "host.name|contains": None}, "condition": "all of a* or b or c or 1 of z*"}


@register("rule_modifiers", EV + """SELECT CAST(id AS INTEGER) AS event_code FROM ev WHERE usr IS NULL OR usr LIKE 'u1%' AND bytes < 60 AND (usr LIKE '%3' OR usr LIKE '%7') AND bytes <= 40""")
def rule_modifiers(spark, sf_dir):
    e = detect.tagged(events(spark, sf_dir), [rulebook.rule({"id": "m", "detection": dict(_MODIFIERS)})])
    return e.filter(F.array_contains("rules", "m")).select(F.col("event.code").alias("event_code"))


_ALERTED = {"id": "seen", "title": "Seen", "level": "low", "description": "A purchase.", "tags": ["attack.t1078", "attack.persistence"], "entity": "user.name", "evidence_fields": ["event.action", "http.response.body.bytes", "source.internal"], "detection": {"selection": {"event.action": "purchase"}}}


@register("alert_columns", EV + f"""SELECT 'seen' AS rule_id, 'Seen' AS rule_name, 'low' AS severity, strftime(ts, '{SQL_STAMP}') AS ts, coalesce(usr, host) AS entity, CASE WHEN usr IS NULL THEN 'host' ELSE 'user' END AS entity_type, 'A purchase.' AS description,
  'T1078,attack.persistence' AS tags, 'event.action=purchase' || coalesce(' http.response.body.bytes=' || bytes, '') || ' source.internal=' || CASE WHEN internal THEN 'True' ELSE 'False' END AS evidence, CAST(1 AS BIGINT) AS event_count, CAST(15 AS INTEGER) AS base_score, internal AS context_internal,
  CAST(NULL AS VARCHAR) AS context_country FROM ev WHERE action = 'purchase'""")  # fmt: skip
def alert_columns(spark, sf_dir):
    a = detect.stateless(events(spark, sf_dir), [rulebook.rule(_ALERTED)])
    return a.select("rule_id", "rule_name", "severity", stamp("ts").alias("ts"), "entity", "entity_type", "description", F.array_join("tags", ",").alias("tags"), F.array_join("evidence", ";").alias("evidence"), "event_count", "base_score", F.col("context.source_internal").alias("context_internal"), F.col("context.source_geo_country_name").alias("context_country"))


@register("threshold_text", EV + """, near AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts, 4) OVER (PARTITION BY ip ORDER BY ts, id)) <= 86400000000, false) AS hit FROM ev WHERE outcome = 'failure')
SELECT ip AS entity, 'Bursts (5 events within 1d)' AS description, array_to_string(list('source.ip=' || ip || coalesce(' user.name=' || usr, '') ORDER BY ts, id)[1:5], ';') AS evidence FROM near GROUP BY ip HAVING bool_or(hit)""")  # fmt: skip
def threshold_text(spark, sf_dir):
    rule = _threshold(5, "1d")
    rule.evidence_fields = ["source.ip", "user.name"]
    return detect.thresholds(events(spark, sf_dir), [rule]).select("entity", "description", F.array_join("evidence", ";").alias("evidence"))


@register("run_all_rules", EV + """, near AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts, 4) OVER (PARTITION BY ip ORDER BY ts, id)) <= 86400000000, false) AS hit FROM ev WHERE outcome = 'failure')
SELECT 'seen' AS rule_id, count(*) AS n FROM ev WHERE action = 'purchase' UNION ALL SELECT 'bursts', count(*) FROM (SELECT ip FROM near GROUP BY ip HAVING bool_or(hit)) HAVING count(*) > 0""")  # fmt: skip
def run_all_rules(spark, sf_dir):
    return detect.run(events(spark, sf_dir), [rulebook.rule(_ALERTED), _threshold(5, "1d")]).groupBy("rule_id").agg(F.count("*").alias("n"))


# ---- stateful and chains

_CHAIN = """, a AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, o, id) AS n FROM raw),
 fold AS (SELECT * FROM (WITH RECURSIVE s AS (SELECT DISTINCT entity, 0::BIGINT AS n, 0 AS stage, NULL::TIMESTAMP AS began, NULL::TIMESTAMP AS fired, NULL::TIMESTAMP AS was FROM a
   UNION ALL SELECT a.entity, a.n, CASE WHEN stage = 0 THEN CASE WHEN rule_id = 'outside_failure' THEN 1 ELSE 0 END WHEN rule_id = 'large_view' THEN 0 ELSE 1 END, CASE WHEN stage = 0 THEN a.ts ELSE began END,
     CASE WHEN stage = 1 AND rule_id = 'large_view' AND epoch_us(a.ts) - epoch_us(began) <= 86400000000 THEN a.ts END, began FROM s JOIN a ON a.entity = s.entity AND a.n = s.n + 1) SELECT * FROM s) WHERE fired IS NOT NULL)
"""
_CHAIN_RULE = {"id": "fail_then_view", "title": "Failure, then large view", "description": "Both.", "tags": ["attack.t1110"], "sequence": {"ordered": True, "within": "1d", "stages": [{"name": "a", "rule_id": "outside_failure"}, {"name": "b", "rule_id": "large_view"}]}}


@register("chain_alert", EV + _RAW + _CHAIN + f"""SELECT 'fail_then_view' AS rule_id, entity, strftime(fired, '{SQL_STAMP}') AS ts, CAST(2 AS BIGINT) AS event_count, 'ip' AS entity_type, 'critical' AS severity, CAST(95 AS INTEGER) AS base_score,
 'Both. Chain of 2 stages completed in ' || CAST(floor((epoch_us(fired) - epoch_us(was)) / 60000000) AS BIGINT) || ' minutes.' AS description, strftime(was, '%H:%M:%S') || ' [medium] Outside failure;' || strftime(fired, '%H:%M:%S') || ' [high] Large view' AS evidence FROM fold""")  # fmt: skip
def chain_alert(spark, sf_dir):
    found = sequence.chains(raw(spark, sf_dir), rulebook.sequence(_CHAIN_RULE))
    return found.select("rule_id", "entity", stamp("ts").alias("ts"), "event_count", "entity_type", "severity", "base_score", "description", F.array_join("evidence", ";").alias("evidence"))


@register("chain_unordered", EV + f"""SELECT 'both' AS rule_id, ip AS entity, strftime(max(ts), '{SQL_STAMP}') AS ts, count(*) AS event_count FROM ev WHERE outcome = 'failure' AND NOT internal AND (ts < TIMESTAMP '2024-01-12' OR ts >= TIMESTAMP '2024-01-19')
 GROUP BY ip HAVING bool_or(ts < TIMESTAMP '2024-01-12') AND bool_or(ts >= TIMESTAMP '2024-01-19') AND epoch_us(max(ts)) - epoch_us(min(ts)) <= 28 * 86400000000""")  # fmt: skip
def chain_unordered(spark, sf_dir):
    a = detect.stateless(events(spark, sf_dir), [rulebook.rule({"id": "x", "level": "low", "detection": {"selection": {"event.outcome": FAILURE, "source.internal": False}}})])
    when = F.when(F.col("ts") < "2024-01-12", "early").when(F.col("ts") >= "2024-01-19", "late")
    rule = rulebook.sequence({"id": "both", "sequence": {"ordered": False, "within": "28d", "stages": [{"rule_id": "late"}, {"rule_id": "early"}]}})
    return _plain(sequence.chains(a.withColumn("rule_id", when).filter("rule_id IS NOT NULL"), rule))


# ---- risk, cases, reports, sinks


def raw(spark, sf_dir, of: DataFrame | None = None) -> DataFrame:
    """The stateless alerts of two tagged rules over the events, or over those given."""
    rules = [
        rulebook.rule({"id": "outside_failure", "title": "Outside failure", "level": "medium", "tags": ["attack.t1110"], "detection": {"selection": {"event.outcome": FAILURE, "source.internal": False}}}),
        rulebook.rule({"id": "large_view", "title": "Large view", "level": "high", "tags": ["attack.t1059", "attack.x"], "detection": {"selection": {"event.action": "view", "http.response.body.bytes|gt": 30}}}),
    ]
    return detect.stateless(events(spark, sf_dir) if of is None else of, rules)


_SPAN = "(epoch_us(last) - epoch_us(first)) // 60000000"
_CASES = _RAW + f""", more AS (SELECT entity, min(ts) AS first, bool_or(rule_id = 'large_view') AS big, bool_or(rule_id = 'outside_failure') AS fails FROM dd GROUP BY entity),
 c AS (SELECT *, {_SPAN} AS mins, CASE WHEN score >= 180 THEN 'critical' WHEN score >= 130 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN big THEN 'Large view' ELSE 'Outside failure' END AS worst,
   'CASE-' || strftime(last, '%Y%m%d') || '-' || upper(substr(sha256('ip:' || entity), 1, 6)) AS case_id FROM scored JOIN more USING (entity) WHERE score >= 100),
 d AS (SELECT *, upper(severity) || ': ip ' || entity || ' - ' || worst AS title, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 4 ELSE 24 END AS sla FROM c)
"""


def _entities(spark, sf_dir) -> DataFrame:
    return risk.entities(risk.scored(A.dedup(raw(spark, sf_dir))))


@register("case_text", EV + _CASES + """SELECT case_id, title, 'Entity ' || entity || ' (ip) accumulated a risk score of ' || CAST(round_even(score, 0) AS BIGINT) || ' from ' || alerts || ' alerts spanning ' ||
  CASE WHEN mins < 60 THEN mins || ' minutes' WHEN mins < 1440 THEN mins // 60 || 'h ' || mins % 60 || 'm' ELSE mins // 1440 || 'd ' || (mins % 1440) // 60 || 'h' END || ', covering ' || (big::INT + fails::INT) || ' ATT&CK techniques (' ||
  CASE WHEN big AND fails THEN 'T1059, T1110' WHEN big THEN 'T1059' ELSE 'T1110' END || '). Highest-severity finding: ' || worst || '.' AS summary FROM d""")  # fmt: skip
def case_text(spark, sf_dir):
    return risk.cases(_entities(spark, sf_dir)).select("case_id", "title", "summary")


@register("case_actions", EV + _CASES + """SELECT case_id, CAST(0 AS INTEGER) AS n, 'create_case' AS action, entity AS target, case_id || '.json' AS detail, true AS executed, 'dry-run' AS mode FROM d
 UNION ALL SELECT case_id, 1, 'notify', entity, '[' || upper(severity) || '] ' || title || ' | SLA ' || sla || 'h', false, 'dry-run' FROM d
 UNION ALL SELECT case_id, 2, 'block_ip', entity, 'HELD FOR ANALYST APPROVAL - critical but not honeypot-confirmed', false, 'dry-run' FROM d WHERE severity = 'critical'""")  # fmt: skip
def case_actions(spark, sf_dir):
    return risk.actions(risk.cases(_entities(spark, sf_dir)))


@register("top_entities", EV + _RAW + """SELECT 'ip' AS entity_type, entity, round(score, 3) AS score, CASE WHEN score >= 180 THEN 'critical' WHEN score >= 100 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS band, alerts FROM scored ORDER BY scored.score DESC, entity LIMIT 10""")
def top_entities(spark, sf_dir):
    return report.top_entities(_entities(spark, sf_dir)).select("entity_type", "entity", F.round("score", 3).alias("score"), "band", "alerts")


@register("worst_alerts", EV + _RAW + f"SELECT rule_id, entity, strftime(ts, '{SQL_STAMP}') AS ts FROM dd ORDER BY base DESC, dd.ts, rule_id, entity LIMIT 25")
def worst_alerts(spark, sf_dir):
    return report.worst_alerts(A.dedup(raw(spark, sf_dir))).select("rule_id", "entity", stamp("ts").alias("ts"))


@register("report_figures", EV + _RAW + """, n AS (SELECT rule_id, count(*) AS n FROM dd GROUP BY rule_id)
SELECT 'rule' AS what, CASE rule_id WHEN 'large_view' THEN 'Large view' ELSE 'Outside failure' END AS name, CAST(n AS DOUBLE) AS value FROM n
 UNION ALL SELECT 'technique', CASE rule_id WHEN 'large_view' THEN 'T1059' ELSE 'T1110' END, n FROM n
 UNION ALL SELECT 'share', CASE rule_id WHEN 'large_view' THEN 'high' ELSE 'medium' END, round(n / sum(n) OVER (), 6) FROM n""")  # fmt: skip
def report_figures(spark, sf_dir):
    a = A.dedup(raw(spark, sf_dir))
    row = lambda df, what, name, value: df.select(F.lit(what).alias("what"), F.col(name).alias("name"), F.round(F.col(value).cast("double"), 6).alias("value"))
    return row(report.top_rules(a), "rule", "rule_name", "n").unionAll(row(report.techniques(a), "technique", "technique", "n")).unionAll(row(report.shares(a), "share", "severity", "share"))


@register("alert_timeline", EV + _RAW + f"""SELECT entity, rule, strftime(ts, '{SQL_STAMP}') AS ts, round((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM dd)) / (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM dd), 6) AS x
 FROM (SELECT *, CASE rule_id WHEN 'large_view' THEN 'Large view' ELSE 'Outside failure' END AS rule FROM dd) ORDER BY epoch_us(ts), rule, entity LIMIT 100""".replace("ORDER BY epoch_us(ts)", "ORDER BY 3"))  # fmt: skip
def alert_timeline(spark, sf_dir):
    t = report.timeline(A.dedup(raw(spark, sf_dir)), 100)
    return t.select("entity", F.col("rule_name").alias("rule"), stamp("ts").alias("ts"), F.round("x", 6).alias("x"))


@register("field_counts", EV + """SELECT path, n FROM (SELECT count(*) AS rows, count(usr) AS users, count(bytes) AS sized FROM ev), LATERAL (VALUES ('@timestamp', rows), ('event.action', rows), ('event.category', rows), ('event.outcome', rows), ('event.code', rows), ('host.name', rows),
 ('source.ip', rows), ('source.internal', rows), ('user.name', users), ('http.response.body.bytes', sized)) t(path, n)""")  # fmt: skip
def field_counts(spark, sf_dir):
    return report.field_counts(events(spark, sf_dir), None)


@register("scenario_recall", EV + _RAW + """, truth AS (SELECT '10.0.0.' || i AS entity, CASE WHEN i % 2 = 0 THEN 'outside_failure' ELSE 'never' END AS want, 's' || (i % 3) AS scenario FROM range(5, 25) t(i)),
 hit AS (SELECT scenario, EXISTS (SELECT 1 FROM dd WHERE dd.entity = t.entity AND dd.rule_id = t.want) AS found FROM truth t)
SELECT scenario, count(*) AS behaviours, count(*) FILTER (found) AS detected, round(count(*) FILTER (found) / count(*), 3) AS recall FROM hit GROUP BY scenario""")  # fmt: skip
def scenario_recall(spark, sf_dir):
    truth = spark.range(5, 25).select(F.concat(F.lit("10.0.0."), "id").alias("entity"), F.array(F.when(F.col("id") % 2 == 0, "outside_failure").otherwise("never")).alias("expected_rules"), F.concat(F.lit("s"), F.col("id") % 3).alias("scenario"))
    return quality.scenarios(A.dedup(raw(spark, sf_dir)), truth)


def _field(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path)


@register("alert_documents", EV + _RAW + """SELECT fingerprint, rule_id, entity, CAST(base AS BIGINT) AS risk, CASE rule_id WHEN 'large_view' THEN '["T1059"]' ELSE '["T1110"]' END AS techniques, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS second FROM dd""")
def alert_documents(spark, sf_dir):
    """Signal documents, written as lines and read back."""
    path = f"{shared(spark)}/alerts"
    sinks.alerts_ndjson(A.dedup(raw(spark, sf_dir)), path)
    doc = F.col("value")
    return spark.read.text(path).select(_field(doc, "$.signal.fingerprint").alias("fingerprint"), _field(doc, "$.rule.id").alias("rule_id"), _field(doc, "$.entity.id").alias("entity"), _field(doc, "$.event.risk_score").cast("long").alias("risk"), _field(doc, "$.threat.technique.id").alias("techniques"), F.substring(_field(doc, "$.@timestamp"), 1, 19).alias("second"))


@register("bulk_file", EV + _RAW + "SELECT 'signals' AS target, count(*) AS actions FROM dd UNION ALL SELECT 'events', count(*) FROM ev")
def bulk_file(spark, sf_dir):
    path = f"{shared(spark)}/bulk"
    sinks.bulk(A.dedup(raw(spark, sf_dir)), events(spark, sf_dir), path, signals="signals", events_index="events")
    lines = spark.read.text(path)
    target = _field(F.col("value"), "$.index._index")
    return lines.select(target.alias("target")).filter("target IS NOT NULL").groupBy("target").agg(F.count("*").alias("actions"))



SQL["sequence_chain"] = EV + _RAW + _CHAIN + f"SELECT 'fail_then_view' AS rule_id, entity, strftime(fired, '{SQL_STAMP}') AS ts, CAST(2 AS BIGINT) AS event_count FROM fold"
