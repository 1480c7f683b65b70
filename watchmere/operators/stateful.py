"""Stateful detectors over ordered events, as windows and folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fields import context, resolve
from ..functions.text import show_time
from . import alerts as A
from . import segments

MINUTE = 60_000_000


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("None"))


def _first(events: DataFrame) -> list[Column]:
    return [context(events).alias("context"), resolve(events, "honeypot").cast("boolean").alias("first_honeypot"), resolve(events, "event.business_hours").cast("boolean").alias("first_business_hours")]


def events_of(events: DataFrame, span: int) -> DataFrame:
    """ip, us, failed, gone: the rows that success_after_failures numbers, as narrow as its sums need."""
    ip, outcome = resolve(events, "source.ip"), resolve(events, "event.outcome")
    e = events.filter((resolve(events, "event.category") == "authentication") & (ip != "") & outcome.isin("failure", "success")).select(ip.alias("ip"), F.unix_micros("`@timestamp`").alias("us"), (outcome == "failure").cast("int").alias("failed"), F.lit(0).alias("gone"))
    return e.unionAll(e.filter("failed = 1").select("ip", F.col("us") + span + 1, F.lit(0), F.lit(1)))


def _pieces(batches, *columns):
    """(key, seg, batch, rows) of each run of a segment's rows in the batches, which come sorted by key and segment."""
    for batch in batches:
        key, seg = batch[columns[0]].to_numpy(), batch["seg"].to_numpy()
        if not len(key):
            continue
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (seg[1:] != seg[:-1]), [True]]))
        for lo, hi in zip(edges[:-1], edges[1:]):
            yield key[lo], seg[lo], batch, slice(lo, hi)


def _alerting(threshold: int):
    """Of successes sorted by address and time, those that alert; low: the number of the newest failure that each doesn't count.

    Each success has threshold failures within the window, so the next one to alert is
    the first whose number of failures is threshold above that at the last alert.
    """

    def walk(batches):
        at, cleared = None, 0
        for ip, seg, batch, rows in _pieces(batches, "ip"):
            total, old = batch["total"].to_numpy()[rows], batch["old"].to_numpy()[rows]
            if (ip, seg) != at:
                at, cleared = (ip, seg), batch["start"].to_numpy()[rows][0]
            chosen, lows, i = [], [], 0
            while True:
                i = max(i, int(np.searchsorted(total, cleared + threshold)))
                if i >= len(total):
                    break
                chosen.append(rows.start + i)
                lows.append(max(int(old[i]), cleared))
                cleared, i = int(total[i]), i + 1
            yield batch.iloc[chosen][["ip", "seg", "place", "total"]].assign(low=lows)

    return walk


def _summed(threshold: int):
    """ip, seg, bounds, outs: what a segment does to the number of failures at the last alert, as a step function.

    A number up to bounds[k] (and above those before) leaves as outs[k]; a greater one than all stays.
    """

    def flush(at, totals):
        total = np.concatenate(totals)
        following = np.maximum(np.arange(len(total)) + 1, np.searchsorted(total, total + threshold)).tolist()
        end = total.tolist()
        for j in range(len(end) - 1, -1, -1):
            if following[j] < len(end):
                end[j] = end[following[j]]
        end = np.array(end)
        last = np.flatnonzero(np.concatenate([end[1:] != end[:-1], [True]]))
        return pd.DataFrame({"ip": [at[0]], "seg": [at[1]], "bounds": [(total[last] - threshold).tolist()], "outs": [end[last].tolist()]})

    def walk(batches):
        at, totals = None, []
        for ip, seg, batch, rows in _pieces(batches, "ip"):
            if (ip, seg) != at:
                if totals:
                    yield flush(at, totals)
                at, totals = (ip, seg), []
            totals.append(batch["total"].to_numpy()[rows])
        if totals:
            yield flush(at, totals)

    return walk


def _composed(batches):
    """ip, seg, start: the state that each segment begins with; segments come sorted by address, a row each."""
    ip, state = None, 0
    for batch in batches:
        starts = []
        for key, bounds, outs in zip(batch["ip"], batch["bounds"], batch["outs"]):
            if key != ip:
                ip, state = key, 0
            starts.append(state)
            k = int(np.searchsorted(bounds, state))
            state = int(outs[k]) if k < len(outs) else state
        yield batch[["ip", "seg"]].assign(start=starts)


def success_after_failures(events: DataFrame, threshold: int = 8, minutes: int = 10, rows: int = segments.ROWS) -> DataFrame:
    """A login that succeeds after at least ``threshold`` failures of its address within the window; it clears them.

    A success's remembered failures are the newest of its address: those neither
    older than the window nor counted by the last success that alerted.  So an address's
    failures are numbered, and a row a window after each counts those that are too old; which
    successes alert is told from numbers alone, and failures are then assigned to the
    alert that follows them.  No row or state grows with a session.

    An address of more than ``rows`` rows is cut into time segments that run side by side.
    The state is the number of failures at the last alert; a segment's effect on it is
    a step function, and these are composed in order.
    """
    span = minutes * MINUTE
    # what the alert takes from the first remembered failure (for risk) and from the success (for context)
    e = events.select(
        F.col("`@timestamp`").alias("ts"), F.unix_micros("`@timestamp`").alias("us"), F.col("_seq").alias("seq"), resolve(events, "source.ip").alias("ip"),
        resolve(events, "event.category").alias("category"), resolve(events, "event.outcome").alias("outcome"), resolve(events, "user.name").alias("user"), resolve(events, "host.name").alias("host"), *_first(events),
    ).filter((F.col("category") == "authentication") & (F.col("ip") != "") & F.col("outcome").isin("failure", "success"))
    failure = (F.col("outcome") == "failure").cast("int")
    aged = e.filter("outcome = 'failure'").select("ip", (F.col("us") + span + 1).alias("us"), F.lit(0).alias("failed"), F.lit(1).alias("gone"))
    e = e.withColumns({"failed": failure, "gone": F.lit(0)}).unionByName(aged, allowMissingColumns=True)
    cuts = segments.hot(events_of(events, span), "ip", rows=rows)
    e = segments.segmented(e, "ip", cuts)
    here = Window.partitionBy("ip", "seg")
    until = here.orderBy("us", F.desc("gone"), "seq").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumns({"place": F.row_number().over(here.orderBy("us", F.desc("gone"), "seq")).cast("long"), "total": F.sum("failed").over(until), "old": F.sum("gone").over(until)}).filter("gone = 0")
    if cuts is not None:
        # sums are counted from the address's first row
        parts = segments.segmented(events_of(events, span), "ip", cuts).join(cuts.select("ip"), "ip", "left_semi").groupBy("ip", "seg").agg(F.sum("failed").alias("f"), F.sum("gone").alias("g"))
        e = e.join(segments.carried(parts, "ip", {"f": F.sum("f"), "g": F.sum("g")}), ["ip", "seg"], "left")
        e = e.withColumns({"total": F.col("total") + F.coalesce("f", F.lit(0)), "old": F.col("old") + F.coalesce("g", F.lit(0))}).drop("f", "g")
    able = e.filter((F.col("outcome") == "success") & (F.col("total") - F.col("old") >= threshold)).select("ip", "seg", "place", "total", "old")
    ordered = lambda df: df.repartition("ip", "seg").sortWithinPartitions("ip", "seg", "place")
    if cuts is None:
        able = able.withColumn("start", F.lit(0).cast("long"))
    else:
        effects = ordered(able.join(cuts.select("ip"), "ip", "left_semi")).mapInPandas(_summed(threshold), "ip string, seg int, bounds array<long>, outs array<long>")
        starts = effects.repartition("ip").sortWithinPartitions("ip", "seg").mapInPandas(_composed, "ip string, seg int, start long")
        able = able.join(starts, ["ip", "seg"], "left").withColumn("start", F.coalesce("start", F.lit(0).cast("long")))
    alerting = ordered(able).mapInPandas(_alerting(threshold), "ip string, seg int, place long, total long, low long")
    fires = alerting.select("ip", "seg", "place", F.struct("total", "low").alias("fire"))
    marked = e.join(fires, ["ip", "seg", "place"], "left")
    following = F.last("fire", ignorenulls=True).over(here.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0))
    if cuts is not None:
        # a segment without an alert has a row as well
        every = segments.segmented(events_of(events, span), "ip", cuts).join(cuts.select("ip"), "ip", "left_semi").select("ip", "seg").distinct()
        begins = every.join(fires.groupBy("ip", "seg").agg(F.min("fire").alias("fire")), ["ip", "seg"], "left")
        later = segments.carried(begins, "ip", {"later": F.last("fire", ignorenulls=True)}, forward=False)
        marked = marked.join(later, ["ip", "seg"], "left")
        following = F.coalesce(following, "later")
    marked = marked.withColumn("next", following).filter(F.col("fire").isNotNull() | ((F.col("outcome") == "failure") & (F.col("total") > F.col("next.low"))))
    failed, success = F.col("fire").isNull(), F.struct("ts", "seq", "user", "host", "context")
    shown_ = F.struct("total", F.concat(F.lit("failed: "), _text(F.col("user")), F.lit(" at "), show_time(F.col("ts"))).alias("text"))
    oldest = failed & (F.col("total") == F.col("next.low") + 1)
    hit = marked.groupBy("ip", "next").agg(
        F.count(F.when(failed, 1)).alias("n"), F.count_distinct(F.when(failed, _text(F.col("user")))).alias("tried"), F.first(F.when(~failed, success), ignorenulls=True).alias("success"),
        F.array_sort(F.collect_list(F.when(failed & (F.col("total") > F.col("next.total") - 4), shown_))).alias("last"),
        F.max(F.when(oldest, F.col("first_honeypot"))).alias("first_honeypot"), F.max(F.when(oldest, F.col("first_business_hours"))).alias("first_business_hours"),
    )
    n, tried = F.col("n"), F.col("tried")
    last = F.transform("last", lambda f: f["text"])
    return hit.select(
        F.lit("auth_success_after_failures").alias("rule_id"), F.lit("Successful Authentication After Repeated Failures").alias("rule_name"), F.lit("critical").alias("severity"),
        F.col("success.ts").alias("ts"), F.col("ip").alias("entity"), F.lit("ip").alias("entity_type"),
        F.concat(F.lit("Authentication SUCCEEDED as '"), _text(F.col("success.user")), F.lit("' on "), _text(F.col("success.host")), F.lit(" after "), n.cast("string"), F.lit(" failures against "), tried.cast("string"), F.lit(f" account(s) in the preceding {minutes} minutes")).alias("description"),
        F.array(*[F.lit(t) for t in ("T1078", "T1110", "ATTACK.INITIAL_ACCESS")]).alias("tags"),
        F.array_append(last, F.concat(F.lit("SUCCESS: "), _text(F.col("success.user")), F.lit(" at "), show_time(F.col("success.ts")))).alias("evidence"),
        (n + 1).cast("long").alias("event_count"), F.col("success.context").alias("context"), "first_honeypot", "first_business_hours",
        F.lit(A.SEVERITY["critical"][0]).alias("base_score"), F.lit(A.STATEFUL).alias("stage_ord"), F.lit(0).alias("rule_ord"), F.struct(F.col("success.ts").alias("t"), F.col("success.seq").alias("s")).alias("emit"),
    )


def escalation_after_login(events: DataFrame, minutes: int = 15, rows: int = segments.ROWS) -> DataFrame:
    """The first privileged action of a user within the window of the latest external login.

    An as-of join with consumption: the login before an action is the last one
    seen, and only the first action after a login can alert, since it takes the
    login or comes too late, as all later ones then do.  So an action that may alert
    is one whose row before, of all logins and actions of its user, is a login.  A
    user of more than ``rows`` rows is cut into time segments; the row before a segment's
    first is the last of those before.
    """
    e = events.select(
        F.col("`@timestamp`").alias("ts"), F.unix_micros("`@timestamp`").alias("us"), F.col("_seq").alias("seq"), resolve(events, "user.name").alias("user"), resolve(events, "source.ip").alias("ip"),
        resolve(events, "process.command_line").alias("command"), *_first(events),
        F.coalesce((resolve(events, "event.category") == "authentication") & (resolve(events, "event.outcome") == "success") & ~resolve(events, "source.internal").cast("boolean"), F.lit(False)).alias("login"),
        F.coalesce(resolve(events, "event.action").isin("sudo", "special_privileges_assigned"), F.lit(False)).alias("action"),
    ).filter((F.col("user") != "") & (F.col("login") | F.col("action")))
    cuts = segments.hot(e.select("user", "us"), "user", rows=rows)
    seen = F.when(F.col("login"), F.struct("ts", "seq", "ip", "context", "first_honeypot", "first_business_hours"))
    e = segments.segmented(e, "user", cuts).withColumn("row", F.struct(seen.alias("login")))
    before = F.lag("row").over(Window.partitionBy("user", "seg").orderBy("ts", "seq"))
    if cuts is not None:
        ends = e.join(cuts.select("user"), "user", "left_semi").groupBy("user", "seg").agg(F.max_by("row", F.struct("ts", "seq")).alias("row"))
        e = e.join(segments.carried(ends, "user", {"ahead": F.last("row")}), ["user", "seg"], "left")
        before = F.coalesce(before, "ahead")
    first = e.withColumn("prior", before["login"]).filter(F.col("action") & ~F.col("login") & F.col("prior").isNotNull())
    late = F.unix_micros("ts") - F.unix_micros("prior.ts")
    return first.filter(late <= minutes * MINUTE).select(
        F.lit("priv_esc_after_external_login").alias("rule_id"), F.lit("Privilege Escalation Shortly After External Login").alias("rule_name"), F.lit("high").alias("severity"),
        "ts", _text(F.col("prior.ip")).alias("entity"), F.lit("ip").alias("entity_type"),
        F.concat(F.lit("User '"), F.col("user"), F.lit("' escalated privileges "), F.floor(late / MINUTE).cast("string"), F.lit("m after logging in from external address "), _text(F.col("prior.ip"))).alias("description"),
        F.array(F.lit("T1548"), F.lit("ATTACK.PRIVILEGE_ESCALATION")).alias("tags"),
        F.array(F.concat(F.lit("login from "), _text(F.col("prior.ip")), F.lit(" at "), show_time(F.col("prior.ts"))), F.concat(F.lit("command: "), _text(F.col("command")))).alias("evidence"),
        F.lit(1).cast("long").alias("event_count"), F.col("prior.context").alias("context"), F.col("prior.first_honeypot").alias("first_honeypot"), F.col("prior.first_business_hours").alias("first_business_hours"),
        F.lit(A.SEVERITY["high"][0]).alias("base_score"), F.lit(A.STATEFUL).alias("stage_ord"), F.lit(1).alias("rule_ord"), F.struct(F.col("ts").alias("t"), F.col("seq").alias("s")).alias("emit"),
    )


def run(events: DataFrame) -> DataFrame:
    return A.union([success_after_failures(events), escalation_after_login(events)])
