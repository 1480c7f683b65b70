"""Enrichment of events: networks, threat intelligence, assets, identities, novelty and working hours."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fields import resolve, with_fields
from ..functions.net import address_key, disjoint, is_internal
from ..sources import lookups as L
from . import segments

PLACE = "g_country string, g_code string, g_org string"


def business_hours(ts):
    """8:00 to 18:59, Monday to Friday."""
    return F.hour(ts).between(8, 18) & (F.weekday(ts) < 5)


def first_seen(df: DataFrame, flags: dict[str, list[str]], ts: str = "@timestamp", seq: str = "_seq") -> DataFrame:
    """df with a boolean column for each flag: is this the first row, by time and then seq, with these key columns?

    A flag is null where a key is null or empty.  First rows are found by partial
    aggregates and marked by one join on time and seq, so a hot key is no hot task.
    """
    ready = lambda keys: reduce(lambda a, b: a & b, [F.coalesce(F.col(k).cast("string") != "", F.lit(False)) for k in keys])
    marks = None
    for flag, keys in flags.items():
        firsts = df.filter(ready(keys)).groupBy(*keys).agg(F.min(F.struct(F.col(f"`{ts}`").alias("t"), F.col(seq).alias("s"))).alias("m")).select("m", F.lit(flag).alias("flag"))
        marks = firsts if marks is None else marks.unionAll(firsts)
    marked = marks.groupBy("m.t", "m.s").agg(*[F.max(F.col("flag") == f).alias(f"__{f}") for f in flags]).select(F.col("t").alias("__t"), F.col("s").alias("__s"), *[f"__{f}" for f in flags])
    joined = df.join(marked, (F.col(f"`{ts}`") == F.col("__t")) & (F.col(seq) == F.col("__s")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[F.when(ready(keys), F.coalesce(F.col(f"__{f}"), F.lit(False))).alias(f) for f, keys in flags.items()])


def located(keys: DataFrame, networks: DataFrame) -> DataFrame:
    """key, g_country, g_code, g_org of the distinct address keys that lie in a network: an as-of join of keys and disjoint intervals.

    Keys and intervals' first keys are sorted together within buckets of the first 20 bits;
    the last interval before a key is in its bucket, or the last of the buckets before.
    No interval is written more than once, however wide.
    """
    net = F.struct("g_lo", "g_hi", "g_country", "g_code", "g_org")
    points = keys.select("key", F.lit(1).alias("kind"), F.lit(None).cast(networks.select(net.alias("net")).schema["net"].dataType).alias("net")).filter("key IS NOT NULL").distinct()
    both = networks.select(F.col("g_lo").alias("key"), F.lit(0).alias("kind"), net.alias("net")).unionAll(points)
    both = both.withColumns({"version": F.substring("key", 1, 1), "seg": F.conv(F.substring("key", 2, 5), 16, 10).cast("int")})
    parts = both.groupBy("version", "seg").agg(F.max_by("net", F.when(F.col("kind") == 0, F.col("key"))).alias("net"))
    ahead = segments.carried(parts, "version", {"ahead": F.last("net", ignorenulls=True)})
    last = F.last("net", ignorenulls=True).over(Window.partitionBy("version", "seg").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("last", last).filter("kind = 1").join(ahead, ["version", "seg"], "left").withColumn("net", F.coalesce("last", "ahead"))
    return found.filter(F.col("key") <= F.col("net.g_hi")).select("key", "net.g_country", "net.g_code", "net.g_org")


def _looked_up(found: L.Lookups):
    """The same for a stream, whose rows can't be sorted: keys are searched in the sorted intervals, a batch of rows at a time."""
    rows = disjoint(found.networks)
    if len(rows) > L.BROADCAST_ROWS:
        raise ValueError(f"a stream looks addresses up in {L.BROADCAST_ROWS} network intervals at most; there are {len(rows)}")
    lo, hi = np.array([r[0] for r in rows] or [""]), np.array([r[1] for r in rows] or [""])
    places = [tuple(None if v is None else str(v) for v in r[2]) for r in rows] or [(None, None, None)]

    @F.pandas_udf(PLACE)
    def look(keys: pd.Series) -> pd.DataFrame:
        text = keys.fillna("").to_numpy(dtype=str)
        at = np.maximum(np.searchsorted(lo, text, side="right") - 1, 0)
        inside = (text != "") & (lo[at] <= text) & (text <= hi[at])
        return pd.DataFrame([places[k] if ok else (None, None, None) for k, ok in zip(at, inside)], columns=["g_country", "g_code", "g_org"], dtype=object)

    return look


def enrich(events: DataFrame, found: L.Lookups, novelty: bool = True) -> DataFrame:
    """Events with all enrichment fields; null or unknown keys leave theirs null.

    novelty=False leaves out the first-seen flags (a stream keeps those as state).
    """
    spark = events.sparkSession
    df = events.withColumns({
        "__ip": F.when(resolve(events, "source.ip") != "", resolve(events, "source.ip")),
        "__user": F.when(resolve(events, "user.name") != "", resolve(events, "user.name")),
        "__host": F.when(resolve(events, "host.name") != "", resolve(events, "host.name")),
    })
    df = df.withColumns({"__internal": F.when(F.col("__ip").isNotNull(), is_internal(F.col("__ip")))})
    outside = F.coalesce(~F.col("__internal"), F.lit(False))
    if events.isStreaming:
        df = df.withColumn("__place", _looked_up(found)(F.when(outside, address_key(F.col("__ip"))))).select("*", "__place.*")
    elif found.networks:
        # each address is located once, however many events it has
        each = df.filter(outside).select(F.col("__ip").alias("g_ip")).distinct().withColumn("key", address_key(F.col("g_ip")))
        places = each.join(located(each, L.networks(spark, found)), "key").select("g_ip", "g_country", "g_code", "g_org")
        df = df.join(places, F.col("__ip") == F.col("g_ip"), "left")
    else:
        df = df.withColumns({c: F.lit(None).cast("string") for c in ("g_country", "g_code", "g_org")})
    df = df.join(L.intel(spark, found), outside & (F.col("__ip") == F.col("t_ip")), "left")
    df = df.join(L.assets(spark, found), F.col("__host") == F.col("a_host"), "left")
    df = df.join(L.identities(spark, found), F.col("__user") == F.col("i_user"), "left")
    named = F.col("__user").isNotNull()
    values = {
        "source.internal": F.col("__internal"),
        "source.geo.country_name": F.col("g_country"), "source.geo.country_iso_code": F.col("g_code"), "source.as.organization.name": F.col("g_org"),
        "threat.indicator.matched": F.when(F.col("t_ip").isNotNull(), F.lit(True)), "threat.indicator.source": F.col("t_source"),
        "threat.indicator.category": F.col("t_category"), "threat.indicator.confidence": F.col("t_confidence"),
        "host.criticality": F.col("a_criticality"), "host.role": F.col("a_role"), "host.environment": F.col("a_environment"), "host.owner": F.col("a_owner"),
        "user.privileged": F.when(named, F.coalesce("i_privileged", F.col("__user").isin(*L.PRIVILEGED_USERS))), "user.type": F.when(named, F.coalesce("i_type", F.lit("unknown"))),
        "user.department": F.col("i_department"), "user.enabled": F.when(named, F.coalesce("i_enabled", F.lit(True))),
        "event.business_hours": business_hours(F.col("`@timestamp`")),
    }
    if novelty:
        df = first_seen(df, {"__new_ip": ["__ip"], "__new_pair": ["__user", "__ip"], "__new_host": ["__user", "__host"]})
        values |= {"source.first_seen": F.col("__new_ip"), "user.new_source_ip": F.col("__new_pair"), "user.new_host": F.col("__new_host")}
    df = with_fields(df, values)
    tops = {path.split(".")[0] for path in values}
    return df.select(*[F.col(f"`{c}`") for c in events.columns], *[F.col(c) for c in sorted(tops - set(events.columns))])
