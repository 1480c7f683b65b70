"""Text, time and digest helpers shared by operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: the optimizer would write it out wherever it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def seconds(text: str | float) -> float:
    """Seconds of a duration such as 30s, 5m, 1h or 1d; a bare number is seconds."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([smhd]?)\s*", str(text))
    if not m:
        raise ValueError(f"bad duration: {text!r}")
    return float(m[1]) * UNITS.get(m[2], 1)


def micros(text: str | float) -> int:
    return round(seconds(text) * 1_000_000)


def show_duration(span: float) -> str:
    """Seconds in the largest unit that divides them."""
    whole = int(span)
    for unit in ("d", "h", "m"):
        if whole and whole % UNITS[unit] == 0:
            return f"{whole // UNITS[unit]}{unit}"
    return f"{whole}s"


def url_decode(column: Column) -> Column:
    """Percent-decoding that leaves plus signs and malformed escapes alone and replaces bad UTF-8."""
    escaped = F.regexp_replace(F.regexp_replace(column, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(escaped), column)


def digest(length: int, *parts: Column, sep: str = "|") -> Column:
    """First hex digits of the SHA-256 of the joined parts."""
    return F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, length)


def fingerprint(rule_id: Column, entity: Column, ts: Column) -> Column:
    """Identity of an alert: rule, entity and hour."""
    return digest(16, rule_id, entity, F.date_format(ts, "yyyy-MM-dd'T'HH"))


def show_span(first: Column, last: Column) -> Column:
    """Time between two times: minutes, hours and minutes, or days and hours."""
    mins = F.floor((F.unix_micros(last) - F.unix_micros(first)) / 60_000_000)
    return (
        F.when(first.isNull() | last.isNull(), "unknown")
        .when(mins < 60, F.concat(mins.cast("string"), F.lit(" minutes")))
        .when(mins < 1440, F.concat(F.floor(mins / 60).cast("string"), F.lit("h "), (mins % 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(F.floor(mins / 1440).cast("string"), F.lit("d "), F.floor((mins % 1440) / 60).cast("string"), F.lit("h")))
    )


def show_time(ts: Column) -> Column:
    """Date and time with microseconds where there are any."""
    micro = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.when(micro != "000000", F.concat(F.lit("."), micro)).otherwise(""))
