"""Addresses and networks, IPv4 and IPv6, against the standard library."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from watchmere.functions import net
from watchmere.operators.enrich import _looked_up, located
from watchmere.sources import lookups

ODD = ["::", "::1", "1::", "2001:db8::1", "2001:DB8:0:0:0:0:0:1", "::ffff:192.0.2.1", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.256", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "g::1", "12345::", ":1", "1:", "",
       "1.2.3.4", "255.255.255.255", "01.2.3.4", "1.2.3", "x", None, "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "1:2:3:4:5:6:7::8", "1.2.3.4:5"]


@pytest.fixture(scope="module")
def networks():
    """Overlapping networks of both kinds, some of which can't be read; the order decides."""
    rng, out = random.Random(3), []
    for k in range(300):
        n = rng.randrange(8, 30)
        out.append((str(ipaddress.ip_network((rng.getrandbits(16) << 16 & (1 << 32) - (1 << 32 - n), n))), (f"c{k}", "cc", "org")))
        n = rng.randrange(12, 60)
        out.append((str(ipaddress.ip_network((0x2A00 << 112 | rng.getrandbits(20) << 92) >> 128 - n << 128 - n).supernet(new_prefix=n)), (f"d{k}", "cc", "org")))
    return [*out, ("::/0", ("rest", None, None)), ("bad", ("x", "y", "z")), ("10.0.0.1/8", ("x", "y", "z"))]


def _place(address, networks):
    for cidr, attributes in networks:
        try:
            if address in ipaddress.ip_network(cidr):
                return attributes[0]
        except ValueError:
            continue
    return None


def test_keys(spark):
    def want(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None
        return net.key_of(a.version, int(a))

    rng = random.Random(1)
    texts = ODD + [str(ipaddress.ip_address(rng.getrandbits(128) & rng.getrandbits(128) & ~(0xFFFFFFFF << 32 * rng.randrange(4)))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", net.address_key(F.col("t")).alias("k")).collect()
    assert [(r["t"], r["k"]) for r in rows] == [(t, want(t) if t is not None else None) for t in texts]


def test_located(spark, networks):
    """The as-of join and the stream's search both give each address the first network that holds it."""
    rng, addresses = random.Random(2), []
    for cidr, _ in networks[:-3]:
        n = ipaddress.ip_network(cidr)
        addresses += [n.network_address, n.broadcast_address, n[rng.randrange(n.num_addresses)]]
    addresses += [ipaddress.ip_address(rng.getrandbits(32)) for _ in range(200)] + [ipaddress.ip_address(rng.getrandbits(128)) for _ in range(50)]
    want = {net.key_of(a.version, int(a)): _place(a, networks) for a in addresses}
    found = lookups.Lookups(networks=networks)
    keys = spark.createDataFrame([(k,) for k in want] + [(None,)], "key string").repartition(5)
    got = {r["key"]: r["g_country"] for r in located(keys, lookups.networks(spark, found)).collect()}
    assert got == {k: v for k, v in want.items() if v is not None} and len(set(got.values())) > 100
    rows = keys.select("key", _looked_up(found)(F.col("key")).alias("p")).collect()
    assert {r["key"]: r["p"]["g_country"] for r in rows if r["key"]} == want
