"""Addresses and nested networks against Python's own, address by address."""

from __future__ import annotations

import ipaddress
import random

from pyspark.sql import functions as F

from tracewright.sources import networks


def _texts() -> list[str]:
    rng = random.Random(5)
    out = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:0:0:2:0:0:0:3", "1:0:0:2:3:0:0:4", "1:0:2:0:3:0:4:0", "FE80::AbCd", "::ffff:1.2.3.4", "64:ff9b::192.0.2.1", "10.0.0.1", "255.255.255.255", "0.0.0.0", "::1.2.3.4"]
    for _ in range(300):
        n = rng.getrandbits(128) if rng.random() < 0.3 else sum(rng.choice([0, 0, 1, 0xFFFF, rng.getrandbits(16)]) << (16 * k) for k in range(8))
        a = ipaddress.IPv6Address(n)
        out += [str(a), a.exploded.upper(), str(ipaddress.IPv4Address(rng.getrandbits(32)))]
    return out


def _canonical(text: str) -> str:
    a = ipaddress.ip_address(text)
    mapped = getattr(a, "ipv4_mapped", None)
    return str(mapped or a)


def _n(text: str) -> int:
    a = ipaddress.ip_address(text)
    return int(a) if a.version == 6 else int(a) + (0xFFFF << 32)


def test_numbers_and_canonical_texts(spark):
    texts = _texts()
    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", networks.number(F.col("ip")).alias("n"), networks.canonical_ip(F.col("ip")).alias("c"))
    for r in rows.collect():
        assert (r["n"]["hi"] % 2**64 << 64) + r["n"]["lo"] % 2**64 == _n(r["ip"]), r
        assert r["c"] == _canonical(r["ip"]), r


def test_what_is_no_address(spark):
    bad = ["", " ", ":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8:9", "12345::", "g::", "1.2.3", "1.2.3.4.5", "256.1.1.1", "1.2.3.4:80", "u1.onion", "1:", ":1", "fe80::1%eth0", None]
    rows = spark.createDataFrame([(t,) for t in bad], "ip string").select("ip", networks.number(F.col("ip")).alias("n"), networks.canonical_ip(F.col("ip")).alias("c"))
    assert [r for r in rows.collect() if r["n"] is not None or r["c"] is not None] == []
    nets = spark.createDataFrame([("10.0.0.0", 1), ("10.0.0.0/33", 2), ("x/8", 3), ("::/129", 4), (None, 5), ("10.0.0.0/", 6)], "cidr string, asn int")
    assert networks.prefixes(nets).count() == 0


def test_narrowest_network(spark):
    """Nested networks of both kinds, a default route, hot networks, repeats: each address by trying all networks."""
    rng = random.Random(7)
    nets = [("0.0.0.0/0", 9000), ("2000::/3", 9001), ("10.0.0.0/8", 3), ("10.0.0.0/8", 2), ("10.0.0.77/8", 5)]
    for k in range(120):
        v4 = ipaddress.IPv4Address((10 << 24) + rng.getrandbits(12))
        v6 = ipaddress.IPv6Address((0x20010DB8 << 96) + (rng.getrandbits(4) << 80) + rng.getrandbits(6))
        nets += [(f"{v4}/{rng.randint(8, 32)}", k), (f"{v6}/{rng.randint(20, 128)}", 200 + k)]
    ips = [str(ipaddress.IPv4Address((10 << 24) + rng.getrandbits(13))) for _ in range(300)]
    ips += [str(ipaddress.IPv6Address((0x20010DB8 << 96) + (rng.getrandbits(4) << 80) + rng.getrandbits(7))) for _ in range(300)]
    ips += ["8.8.8.8", "::ffff:10.0.0.1", "fe80::1", "u1.onion", "", None] + ips[:50]
    got = {r["ip"]: (r["length"], r["told"] and r["told"]["asn"]) for r in networks.narrowest(spark.createDataFrame([(i,) for i in ips], "ip string"), spark.createDataFrame(nets, "cidr string, asn int")).collect()}
    assert set(got) == set(ips)
    for ip in set(ips):
        best = (None, None)
        if ip and not ip.endswith("onion"):
            for cidr, asn in nets:
                base, size = cidr.split("/")
                length = int(size) + (0 if ":" in base else 96)
                if _n(ip) >> (128 - length) == _n(base) >> (128 - length) and (best[0] is None or (length, -asn) > (best[0], -best[1])):
                    best = (length, asn)
        assert got[ip] == best, ip


def test_enriched_rows(spark):
    nets = spark.createDataFrame([("10.0.0.0/8", 64500, "DE"), ("10.1.0.0/16", None, "FR")], "cidr string, asn int, country string")
    rows = spark.createDataFrame([("10.0.0.1", 1, "XX", "a"), ("10.1.0.1", 2, "XX", "b"), ("9.9.9.9", 3, None, "c"), ("9.9.9.9", None, "YY", "d"), (None, None, None, "e"), ("10.0.0.1", 1, "XX", "a")], "src_ip string, asn int, geo_country string, ip string")
    got = sorted(tuple(r) for r in networks.enriched(rows, nets).select("ip", "asn", "geo_country", "asn_source").collect())
    assert got == [("a", 64500, "DE", "geoip"), ("a", 64500, "DE", "geoip"), ("b", 2, "FR", "dataset"), ("c", 3, None, "dataset"), ("d", None, "YY", "none"), ("e", None, None, "none")]
    bare = networks.enriched(rows.select("src_ip"), nets.limit(0))
    assert bare.columns == ["src_ip", "asn", "geo_country", "asn_source"] and bare.where("asn_source <> 'none'").count() == 0 and bare.count() == 6
    assert networks.enriched(rows.limit(0), nets).count() == 0
