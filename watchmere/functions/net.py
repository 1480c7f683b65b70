"""Addresses: numbers and keys that sort as these, internal ranges and disjoint CIDR intervals."""

from __future__ import annotations

import heapq
import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Private and loopback networks.
INTERNAL = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8")
INTERNAL_V6 = ("::1",)

_OCTET = "^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


def ipv4(column: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    octet = lambda p, k: p[k].cast("long") * (1 << 8 * (3 - k))
    number = lambda p: F.when((F.size(p) == 4) & F.forall(p, lambda o: o.rlike(_OCTET)), octet(p, 0) + octet(p, 1) + octet(p, 2) + octet(p, 3))
    return let(F.split(column, r"\.", 5), number)


def _hex4(n: Column) -> Column:
    return F.lpad(F.lower(F.hex(n)), 4, "0")


def _ipv6(s: Column) -> Column:
    """Hex digits of an IPv6 address in lower case, whose last groups aren't written as IPv4."""

    def of(halves: Column) -> Column:
        groups = lambda part: F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))
        sides = F.struct(groups(halves[0]).alias("left"), groups(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit(""))).alias("right"), F.size(halves).alias("halves"))
        return let(sides, whole)

    def whole(p: Column) -> Column:
        left, right = p["left"], p["right"]
        count = F.size(left) + F.size(right)
        good = F.when(p["halves"] == 2, count <= 7).otherwise((p["halves"] == 1) & (count == 8))
        every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - count, F.lit(0))), right)
        return F.when(good & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    return let(F.split(s, "::"), of)


def address_key(column: Column) -> Column:
    """An address as a text that sorts as its number: 4 and 8 hex digits, or 6 and 32; null for anything else."""

    def spelled(p: Column) -> Column:
        return F.when(p["tail"].isNull(), p["s"]).otherwise(F.concat(F.regexp_replace(p["s"], r"[0-9.]+$", ""), _hex4(F.floor(p["tail"] / 65536)), F.lit(":"), _hex4(p["tail"] % 65536)))

    s = F.lower(F.regexp_replace(column, "%.+$", ""))  # a zone says where, not which
    v6 = let(F.struct(s.alias("s"), ipv4(F.regexp_extract(s, r":([0-9.]+)$", 1)).alias("tail")), lambda p: let(spelled(p), _ipv6))
    v4 = let(ipv4(column), lambda n: F.concat(F.lit("4"), F.lpad(F.lower(F.hex(n)), 8, "0")))
    return F.when(F.contains(column, F.lit(":")), F.concat(F.lit("6"), v6)).otherwise(v4)


def key_of(version: int, number: int) -> str:
    """The key of an address given as a number."""
    return f"{version}{number:0{8 if version == 4 else 32}x}"


def _span(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def is_internal(column: Column) -> Column:
    """Whether an address is internal; false for nulls and for text that is no address."""
    spans = [_span(cidr) for cidr in INTERNAL]
    inside = let(ipv4(column), lambda n: reduce(lambda a, b: a | b, [n.between(lo, hi) for lo, hi in spans]))
    return F.coalesce(column.isin(*INTERNAL_V6) | F.coalesce(inside, F.lit(False)), F.lit(False))


def disjoint(networks: list[tuple[str, tuple]]) -> list[tuple[str, str, tuple]]:
    """Intervals of address keys (first, last, attributes) without overlaps; where networks overlap the earlier one counts.

    Networks that can't be read, or have bits beyond their prefix, are left out.
    """
    spans: dict[int, list[tuple[int, int, int, tuple]]] = {4: [], 6: []}
    for order, (cidr, attributes) in enumerate(networks):
        try:
            net = ipaddress.ip_network(cidr)
        except ValueError:
            continue
        spans[net.version].append((int(net.network_address), int(net.broadcast_address), order, attributes))
    out = []
    for version, mine in spans.items():
        edges = sorted({s for s, *_ in mine} | {e + 1 for _, e, *_ in mine})
        starts, k = sorted(mine, key=lambda x: x[:3]), 0
        live: list[tuple[int, int, tuple]] = []  # order, last, attributes; the earliest on top, those past go when they come up
        for lo, after in zip(edges, edges[1:]):
            while k < len(starts) and starts[k][0] <= lo:
                heapq.heappush(live, (starts[k][2], starts[k][1], starts[k][3]))
                k += 1
            while live and live[0][1] < lo:
                heapq.heappop(live)
            if live:
                out.append((key_of(version, lo), key_of(version, after - 1), live[0][2]))
    return out
