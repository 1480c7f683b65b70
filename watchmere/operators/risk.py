"""Risk of entities with decay, cases and recommended actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import digest, show_span

# Multipliers, half-life, thresholds and service levels.
HALF_LIFE_HOURS = 24.0
CASE, CRITICAL, HIGH_FACTOR = 100, 180, 1.3
CRITICALITY = {"crown_jewel": 2.0, "high": 1.5, "medium": 1.0, "low": 0.7}
INTEL, PRIVILEGED, EXTERNAL, OFF_HOURS, HONEYPOT = 1.6, 1.5, 1.2, 1.2, 2.0
SLA_HOURS = {"critical": 1, "high": 4, "medium": 24}
ACTIONS, TOP_ALERTS, SUMMARY_TECHNIQUES = 8, 3, 6

# What to do about an alert.
RESPONSES: dict[str, list[str]] = {
    "ssh_brute_force": [
        "Block source IP at the perimeter firewall",
        "Verify whether any authentication from this source succeeded",
        "Enable fail2ban or equivalent rate limiting on the target host",
    ],
    "ssh_password_spray": [
        "Identify which sprayed accounts exist and are enabled",
        "Force password reset on any account that authenticated",
        "Review password policy and enable MFA on exposed services",
    ],
    "auth_success_after_failures": [
        "ISOLATE the target host from the network",
        "Rotate credentials for the compromised account immediately",
        "Revoke active sessions and authorised SSH keys",
        "Capture volatile memory before reboot for forensics",
        "Hunt for persistence: cron, systemd units, authorized_keys, new accounts",
    ],
    "win_audit_log_cleared": [
        "Preserve the host; treat as active intrusion cleanup",
        "Reconstruct activity from SIEM-forwarded logs prior to the clear",
        "Identify the account that cleared the log and its logon source",
    ],
    "win_privileged_group_add": [
        "Verify an approved change ticket exists for this membership",
        "Remove the membership if unapproved and investigate the granting account",
    ],
    "web_sql_injection": [
        "Review response codes for successful injection (200 on injected parameter)",
        "Check database audit logs for unauthorised queries at matching timestamps",
        "Deploy a WAF rule for the affected endpoint",
    ],
    "web_sensitive_paths": [
        "Confirm the probed files are not actually served",
        "Rotate any secret that was exposed via a 200 response",
    ],
    "chain_recon_to_compromise": [
        "PAGE the on-call analyst - confirmed intrusion pattern",
        "Activate the incident response plan and assign an incident commander",
        "Isolate affected hosts and begin evidence preservation",
    ],
    "honeypot_command": [
        "Extract downloaded payload hashes and submit to threat intel",
        "Record the command sequence as adversary tradecraft",
        "Block the source permanently; honeypot contact is definitionally hostile",
    ],
}


def multiplier(chain: bool = False) -> Column:
    """Factor of an alert's score by its context and its first event; chains have no event of their own."""
    c = F.col("context")
    on = lambda test, factor: F.when(F.coalesce(test, F.lit(False)), F.lit(factor)).otherwise(1.0)
    levels = F.create_map(*[F.lit(x) for kv in CRITICALITY.items() for x in kv])
    around = on(c["threat_indicator_source"] != "", INTEL) * on(c["user_privileged"], PRIVILEGED) * on(~c["source_internal"], EXTERNAL) * F.coalesce(levels[c["host_criticality"]], F.lit(1.0))
    return around if chain else around * on(F.col("first_honeypot"), HONEYPOT) * on(~F.col("first_business_hours"), OFF_HOURS)


def scored(alerts: DataFrame) -> DataFrame:
    """alerts with contribution and risk_score (the contribution rounded, halves to even)."""
    return alerts.withColumn("contribution", F.col("base_score") * multiplier()).withColumn("risk_score", F.bround("contribution", 0).cast("long"))


def decayed(ts: Column, last: Column, amount: Column, half_life: float = HALF_LIFE_HOURS) -> Column:
    """What is left at time last of an amount of time ts."""
    hours = (F.unix_micros(last) - F.unix_micros(ts)) / F.lit(3_600_000_000.0)
    return amount * F.pow(F.lit(0.5), hours / F.lit(half_life))


def entities(alerts: DataFrame, half_life: float = HALF_LIFE_HOURS) -> DataFrame:
    """entity_type, entity, score, first_seen, last_seen, alerts, techniques, worst, honeypot and actions of every entity.

    The decayed score is the closed form of the running one: each contribution
    decays from its own time to the entity's last.  Last times are aggregated first
    and joined, so contributions are summed by partial aggregates.  Actions follow from the
    TOP_ALERTS riskiest alerts alone, a rank limit that cuts before the shuffle.
    """
    df = scored(alerts)
    keys = ["entity_type", "entity"]
    ends = df.groupBy(*keys).agg(F.max("ts").alias("last_seen"))
    # the first alert of highest risk
    best = F.struct(F.col("risk_score").alias("r"), (-F.unix_micros("ts")).alias("t"), (-F.col("stage_ord")).alias("a"), (-F.col("rule_ord")).alias("b"))
    tags = F.filter(F.col("tags"), lambda t: F.upper(F.substring(t, 1, 1)) == "T")
    out = df.join(ends, keys).groupBy(*keys).agg(
        F.sum(decayed(F.col("ts"), F.col("last_seen"), F.col("contribution"), half_life)).alias("score"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.count("*").alias("alerts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(tags)))).alias("techniques"), F.max_by("rule_name", best).alias("worst"),
        F.max(F.col("rule_id").startswith("honeypot")).alias("honeypot"),
    )
    library = F.create_map(*[x for k, v in RESPONSES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    top = ranked(df.select(*keys, "rule_id", "risk_score", _order().alias("o")), [F.desc("risk_score"), "o"], TOP_ALERTS)
    advice = F.transform(F.array_sort(F.collect_list(F.struct("n", "rule_id"))), lambda x: F.coalesce(library[x["rule_id"]], F.array().cast("array<string>")))
    advised = top.groupBy(*keys).agg(F.slice(F.array_distinct(F.flatten(advice)), 1, ACTIONS).alias("actions"))
    other = advised.select(F.col("entity_type").alias("__t"), F.col("entity").alias("__e"), "actions")
    return out.join(other, F.col("entity_type").eqNullSafe(F.col("__t")) & F.col("entity").eqNullSafe(F.col("__e")), "left").drop("__t", "__e")


def _order() -> Column:
    return F.struct("ts", "stage_ord", "rule_ord", "emit")


def ranked(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows of each entity, with their number n; rows beyond go before the shuffle."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy("entity_type", "entity").orderBy(*order))).filter(F.col("n") <= n)


def timelines(alerts: DataFrame, n: int | None = None) -> DataFrame:
    """entity_type, entity, ts, severity, rule_id, rule_name, risk_score, description, o: a row an alert, o their order; n: each entity's first n."""
    rows = scored(alerts).select("entity_type", "entity", "ts", "severity", "rule_id", "rule_name", "risk_score", "description", _order().alias("o"))
    return rows if n is None else ranked(rows, ["o"], n).drop("n")


def with_timelines(cases_: DataFrame, alerts: DataFrame, n: int | None = None) -> DataFrame:
    """cases with ``timeline``, their entities' first n alerts; None: all, as a case's document holds them."""
    cell = ["ts", "severity", "rule_id", "rule_name", "risk_score", "description"]
    mine = alerts.join(cases_.select("entity_type", "entity"), ["entity_type", "entity"], "left_semi")
    lists = timelines(mine, n).groupBy("entity_type", "entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", *cell))), lambda x: x.dropFields("o")).alias("timeline"))
    return cases_.join(lists, ["entity_type", "entity"], "left")


def cases(entities_: DataFrame, threshold: float = CASE) -> DataFrame:
    """A case for every entity of at least the threshold."""
    e = entities_.filter(F.col("score") >= threshold)
    severity = F.when(F.col("score") >= CRITICAL, "critical").when(F.col("score") >= threshold * HIGH_FACTOR, "high").otherwise("medium")
    e = e.withColumn("severity", severity)
    stamp = F.upper(digest(6, F.concat_ws(":", "entity_type", "entity")))
    listed = F.array_join(F.slice("techniques", 1, SUMMARY_TECHNIQUES), ", ")
    return e.select(
        F.concat(F.lit("CASE-"), F.date_format("last_seen", "yyyyMMdd"), F.lit("-"), stamp).alias("case_id"), "entity_type", "entity", "severity", F.round("score", 1).alias("score"), F.col("last_seen").alias("opened_at"),
        F.concat(F.upper("severity"), F.lit(": "), F.col("entity_type"), F.lit(" "), F.col("entity"), F.lit(" - "), F.col("worst")).alias("title"),
        F.concat(F.lit("Entity "), F.col("entity"), F.lit(" ("), F.col("entity_type"), F.lit(") accumulated a risk score of "), F.format_string("%.0f", F.bround("score", 0)), F.lit(" from "), F.col("alerts").cast("string"), F.lit(" alerts spanning "), show_span(F.col("first_seen"), F.col("last_seen")), F.lit(", covering "), F.size("techniques").cast("string"), F.lit(" ATT&CK techniques ("), F.when(listed != "", listed).otherwise("none mapped"), F.lit("). Highest-severity finding: "), F.col("worst"), F.lit(".")).alias("summary"),
        F.col("actions").alias("recommended_actions"), F.create_map(*[F.lit(x) for kv in SLA_HOURS.items() for x in kv])[F.col("severity")].alias("sla_hours"), "alerts", "techniques", "honeypot", "first_seen", "last_seen",
    )


def actions(cases_: DataFrame, live: bool = False) -> DataFrame:
    """The playbook's actions: case_id, n, action, target, detail, executed, mode.

    Every case is filed and notified; an address that touched a honeypot is
    blocked, a critical one otherwise held for an analyst.
    """
    row = lambda n, action, detail, executed: F.struct(F.lit(n).alias("n"), F.lit(action).alias("action"), F.col("entity").alias("target"), detail.alias("detail"), F.lit(executed).alias("executed"))
    notice = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("title"), F.lit(" | SLA "), F.col("sla_hours").cast("string"), F.lit("h"))
    reason = F.concat(F.lit("honeypot interaction - "), F.col("case_id"))
    block = row(2, "block_ip", reason if live else F.concat(F.lit("would block: "), reason), live)
    held = row(2, "block_ip", F.lit("HELD FOR ANALYST APPROVAL - critical but not honeypot-confirmed"), False)
    is_ip = F.col("entity_type") == "ip"
    third = F.when(is_ip & F.col("honeypot"), block).when(is_ip & (F.col("severity") == "critical"), held)
    listed = F.array_compact(F.array(row(0, "create_case", F.concat(F.col("case_id"), F.lit(".json")), True), row(1, "notify", notice, live), third))
    return cases_.select("case_id", F.explode(listed).alias("a")).select("case_id", "a.*", F.lit("live" if live else "dry-run").alias("mode"))
