"""Behavioural baselines: what is normal in the first part of the events, and what departs from it in the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fields import context, resolve
from . import alerts as A

LEAST_EVENTS, LEAST_SOURCES = 40, 5


def split_at(events: DataFrame, ratio: float = 0.5):
    """Time and seq of the first event of the test part, whose events number all but int(n * ratio); None if there is no event.

    Counts per second are aggregated first, so the cut is found by a running sum
    over seconds on the cluster and only the cut's own second is ranked.
    """
    n = events.count()
    if not n:
        return None
    k = int(n * ratio)
    # a running sum over coarse stretches first, then within the one that holds the cut
    width = 3600
    low, before = None, 0
    ts = F.unix_seconds(F.col("`@timestamp`").cast("timestamp"))
    rows = events.groupBy(F.floor(ts / width).alias("h")).count().orderBy("h")
    for r in rows.toLocalIterator():  # one row an hour
        if before + r["count"] > k:
            low = r["h"]
            break
        before += r["count"]
    if low is None:
        return None
    hour = events.filter(F.floor(ts / width) == low).select(F.col("`@timestamp`").alias("ts"), F.col("_seq").alias("seq"))
    seconds = hour.groupBy(F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).count().orderBy("s").collect()  # 3,600 rows at most
    for r in seconds:
        if before + r["count"] > k:
            row = hour.filter(F.unix_seconds(F.col("ts").cast("timestamp")) == r["s"]).orderBy("ts", "seq").limit(k - before + 1).orderBy(F.desc("ts"), F.desc("seq")).first()
            return row["ts"], row["seq"]
        before += r["count"]
    return None


def split(events: DataFrame, ratio: float = 0.5) -> DataFrame:
    """events with ``train``: is the event before the cut?"""
    cut = split_at(events, ratio)
    if cut is None:
        return events.withColumn("train", F.lit(True))
    spark = events.sparkSession
    schema = events.select(F.col("`@timestamp`").alias("cut_ts"), F.col("_seq").alias("cut_seq")).schema
    one = F.broadcast(spark.createDataFrame([cut], schema))  # one row
    joined = events.join(one)
    before = (F.col("`@timestamp`") < F.col("cut_ts")) | ((F.col("`@timestamp`") == F.col("cut_ts")) & (F.col("_seq") < F.col("cut_seq")))
    return joined.select(*[F.col(f"`{c}`") for c in events.columns], before.alias("train"))


def _narrow(events: DataFrame) -> DataFrame:
    return events.select(
        "train", F.col("`@timestamp`").alias("ts"), F.col("_seq").alias("seq"), F.nullif(resolve(events, "user.name"), F.lit("")).alias("user"), F.nullif(resolve(events, "host.name"), F.lit("")).alias("host"),
        F.nullif(resolve(events, "source.ip"), F.lit("")).alias("ip"), resolve(events, "source.internal").cast("boolean").alias("internal"), resolve(events, "event.category").alias("category"), resolve(events, "event.outcome").alias("outcome"),
        context(events).alias("context"), resolve(events, "honeypot").cast("boolean").alias("first_honeypot"), resolve(events, "event.business_hours").cast("boolean").alias("first_business_hours"),
    )


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("None"))


def _list(column: Column, quoted: bool) -> Column:
    show = (lambda x: F.concat(F.lit("'"), x, F.lit("'"))) if quoted else (lambda x: x.cast("string"))
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(column), show), ", "), F.lit("]"))


def _alert(df: DataFrame, rule: str, title: str, severity: str, entity: str, kind: str, description: Column, tags: list[str], evidence: Column, order: int) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule_id"), F.lit(title).alias("rule_name"), F.lit(severity).alias("severity"), "ts", F.col(entity).alias("entity"), F.lit(kind).alias("entity_type"), description.alias("description"),
        F.array(*[F.lit(t) for t in tags]).alias("tags"), F.array(evidence).alias("evidence"), F.lit(1).cast("long").alias("event_count"), "context", "first_honeypot", "first_business_hours",
        F.lit(A.SEVERITY[severity][0]).alias("base_score"), F.lit(A.BEHAVIOUR).alias("stage_ord"), F.lit(order).alias("rule_ord"), F.struct(F.col("ts").alias("t"), F.col("seq").alias("s")).alias("emit"),
    )


def logins(events: DataFrame) -> DataFrame:
    """Logins of the test part with the user's training hours."""
    e = _narrow(events)
    hours = _learned(e).groupBy("user").agg(F.collect_set(F.hour("ts")).alias("hours"))  # 24 at most
    tested = e.filter(~F.col("train") & F.col("user").isNotNull() & (F.col("outcome") == "success") & (F.col("category") == "authentication"))
    return tested.join(hours, "user")


def _learned(narrow: DataFrame) -> DataFrame:
    return narrow.filter(F.col("train") & F.col("user").isNotNull() & (F.col("outcome") == "success"))


def hosts(events: DataFrame) -> DataFrame:
    """user, host: the hosts that each user logged in to in the training part."""
    return _learned(_narrow(events)).filter("host IS NOT NULL").select("user", "host").distinct()


def unusual_hour(known: DataFrame) -> DataFrame:
    """A user's first login at an hour not among the training hours; not for internal or unknown addresses."""
    odd = known.filter((F.size("hours") > 0) & ~F.array_contains("hours", F.hour("ts")) & F.col("ip").isNotNull() & ~F.coalesce("internal", F.lit(False)))
    one = odd.withColumn("n", F.row_number().over(Window.partitionBy("user").orderBy("ts", "seq"))).filter("n = 1")
    text = F.concat(F.lit("User '"), F.col("user"), F.lit("' authenticated at "), F.date_format("ts", "HH"), F.lit(":00; baseline activity hours are "), _list(F.col("hours"), False))
    return _alert(one, "behavior_unusual_hour", "Authentication at Unusual Hour for User", "medium", "user", "user", text, ["T1078", "ATTACK.DEFENSE_EVASION"], F.concat(F.lit("host="), _text(F.col("host")), F.lit(" ip="), _text(F.col("ip"))), 0)


def new_host(known: DataFrame, usual: DataFrame) -> DataFrame:
    """A user's first login to each host not among the training hosts, for users who have some.

    New pairs are told by an anti-join; only users with an alert have their hosts listed.
    """
    odd = known.filter(F.col("host").isNotNull()).join(usual, ["user", "host"], "left_anti").drop("hours")
    first = F.min_by(F.struct(*[c for c in odd.columns if c not in ("user", "host")]), F.struct("ts", "seq")).alias("f")
    one = odd.groupBy("user", "host").agg(first)
    lists = usual.join(one.select("user").distinct(), "user", "left_semi").groupBy("user").agg(F.collect_list("host").alias("hosts"))
    one = one.join(lists, "user").select("user", "host", "hosts", "f.*")
    text = F.concat(F.lit("User '"), F.col("user"), F.lit("' authenticated to '"), F.col("host"), F.lit("' for the first time; baseline hosts are "), _list(F.col("hosts"), True))
    evidence = F.concat(F.lit("new host="), F.col("host"), F.lit(" ip="), _text(F.col("ip")))
    return _alert(one, "behavior_new_host", "User Authenticated to Host Never Used Before", "medium", "user", "user", text, ["T1021", "ATTACK.LATERAL_MOVEMENT"], evidence, 1)


def volume_outlier(events: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Addresses with more test events than the mean of the training counts plus sigma deviations (of one at least)."""
    e = _narrow(events).filter("ip IS NOT NULL")
    counts = e.filter(F.col("train") & ~F.coalesce("internal", F.lit(False))).groupBy("ip").count()
    limit = counts.agg(F.avg("count").alias("mean"), F.coalesce(F.nullif(F.stddev_pop("count"), F.lit(0.0)), F.lit(1.0)).alias("dev"), F.count("*").alias("sources"))
    first = F.min_by(F.struct("ts", "seq", "internal", "context", "first_honeypot", "first_business_hours"), F.struct("ts", "seq")).alias("f")
    tested = e.filter(~F.col("train")).groupBy("ip").agg(F.count("*").alias("n"), first)
    out = tested.join(F.broadcast(limit)).withColumn("limit", F.col("mean") + F.lit(float(sigma)) * F.col("dev"))  # one row
    out = out.filter((F.col("sources") >= LEAST_SOURCES) & (F.col("n") > F.col("limit")) & ~F.coalesce("f.internal", F.lit(False))).select("ip", "n", "mean", "limit", "f.*")
    text = F.concat(F.col("n").cast("string"), F.lit(" events from this source versus a baseline mean of "), F.format_string("%.1f", "mean"), F.lit(" (threshold "), F.format_string("%.1f", "limit"), F.lit(f" at {float(sigma)} sigma)"))
    return _alert(out, "behavior_volume_outlier", "Anomalous Event Volume From Source", "low", "ip", "ip", text, ["T1595"], F.concat(F.lit("event count="), F.col("n").cast("string")), 2)


def run(events: DataFrame, ratio: float = 0.5, sigma: float = 3.0) -> DataFrame | None:
    """Alerts of all baselines; None for LEAST_EVENTS events or fewer."""
    if events.limit(LEAST_EVENTS + 1).count() <= LEAST_EVENTS:
        return None
    parts = split(events, ratio)
    known = logins(parts)
    return A.union([unusual_hour(known), new_host(known, hosts(parts)), volume_outlier(parts, sigma)])
