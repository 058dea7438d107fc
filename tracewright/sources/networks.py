"""Addresses as 128-bit numbers, and networks of any length that may nest.

An IPv4 address is its IPv6-mapped one, so both kinds share one number space and one table of networks. A number is two
longs, compared by their bits.

Defined results: what is no address (host names, onion names, null, empty text) has no number, no canonical form and lies in
no network; text that is no network, or has a length out of range, is left out of a table of networks; bits of a network
behind its length are ignored; of repeated networks the one with the least columns counts, null being least.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_QUAD = r"(?:^|:)((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))$"
_MAPPED = 96


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def groups(ip: Column) -> Column:
    """array<long>: the eight groups of an address, which may be shortened or end in an IPv4 address; null for all else."""

    def spelled(quad: Column) -> Column:
        """The address in lower case, its IPv4 part as two groups."""
        octets = F.transform(F.split(quad, r"\."), lambda x: x.try_cast("int"))
        pairs = _let(octets, lambda o: F.concat_ws(":", *[F.lower(F.hex(F.get(o, F.lit(k)) * 256 + F.get(o, F.lit(k + 1)))) for k in (0, 2)]))
        head = F.when(quad == ip, F.lit("::ffff:")).otherwise(F.substr(ip, F.lit(1), F.length(ip) - F.length(quad)))
        return F.lower(F.when(quad == "", ip).otherwise(F.concat(head, pairs)))

    none = F.array().cast("array<string>")
    parts = lambda half: F.when(half == "", none).otherwise(F.split(half, ":", -1))

    def filled(sides: Column) -> Column:
        """The groups of one side or two, with zeros between two."""
        left, right = F.get(sides, F.lit(0)), F.coalesce(F.get(sides, F.lit(1)), none)
        return _let(
            8 - F.size(left) - F.size(right),
            lambda gap: F.when(
                F.when(F.size(sides) == 2, gap > 0).otherwise((F.size(sides) == 1) & (gap == 0)) & F.forall(F.flatten(sides), lambda g: g.rlike("^[0-9a-f]{1,4}$")),
                F.concat(left, F.array_repeat(F.lit("0"), gap), right),
            ),
        )

    text = _let(F.regexp_extract(ip, _QUAD, 1), spelled)
    every = _let(F.transform(F.split(text, "::", -1), parts), filled)
    return F.transform(every, lambda g: F.conv(g, 16, 10).cast("long"))


def number(ip: Column) -> Column:
    """struct<hi, lo> of an address."""
    half = lambda g, start: F.aggregate(F.slice(g, start, 4), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 16).bitwiseOR(x))
    return _let(groups(ip), lambda g: F.when(g.isNotNull(), F.struct(half(g, 1).alias("hi"), half(g, 5).alias("lo"))))


def canonical_ip(ip: Column) -> Column:
    """One text per address: IPv4 dotted, also where it was mapped; IPv6 in lower case, its longest run of zero groups (two at
    least, the first of equal ones) as ``::``."""

    def shortened(text: Column) -> Column:
        """``:a:b:...:h:`` without its longest run of zeros and the colons at its ends."""
        out = text
        for k in range(2, 9):
            run = ":0" * k + ":"
            before = F.substring_index(text, run, 1)
            out = F.when(text.contains(run), F.concat(before, F.lit("::"), F.substr(text, F.length(before) + len(run) + 1))).otherwise(out)  # longer runs are asked first
        return F.regexp_replace(F.regexp_replace(out, "^:(?!:)", ""), "(?<!:):$", "")

    def written(g: Column) -> Column:
        octets = F.flatten(F.transform(F.slice(g, 7, 2), lambda x: F.array(F.shiftright(x, 8).cast("string"), (x % 256).cast("string"))))
        mapped = (F.get(g, F.lit(5)) == 65535) & F.forall(F.slice(g, 1, 5), lambda x: x == 0)
        text = F.concat(F.lit(":"), F.array_join(F.transform(g, lambda x: F.lower(F.hex(x))), ":"), F.lit(":"))
        return F.when(mapped, F.array_join(octets, ".")).otherwise(_let(text, shortened))

    return _let(groups(ip), written)


def _masks(length: Column) -> tuple[Column, Column]:
    """The upper and the lower half of the mask of a length."""
    ones = F.lit(-1).cast("long")
    half = lambda n: F.when(n <= 0, F.lit(0).cast("long")).when(n >= 64, ones).otherwise(F.call_function("shiftleft", ones, (64 - n).cast("int")))
    return half(length), half(length - 64)


def prefixes(networks: DataFrame) -> DataFrame:
    """length, hi, lo, told: the networks of a column cidr, each once; told holds the other columns."""
    base = F.substring_index("cidr", "/", 1)
    size = F.when(F.col("cidr").rlike(r"^[^/]+/\d{1,3}$"), F.substring_index("cidr", "/", -1).cast("int"))
    length = size + F.when(base.contains(":"), 0).otherwise(_MAPPED)
    told = F.struct(*[networks[c] for c in networks.columns if c != "cidr"])
    rows = networks.select(number(base).alias("at"), length.alias("length"), told.alias("told")).where("at is not null and length <= 128")
    high, low = _masks(F.col("length"))
    rows = rows.select("length", F.col("at.hi").bitwiseAND(high).alias("hi"), F.col("at.lo").bitwiseAND(low).alias("lo"), "told")
    return rows.groupBy("length", "hi", "lo").agg(F.min("told").alias("told"))


def narrowest(ips: DataFrame, networks: DataFrame, salts: int = 16) -> DataFrame:
    """Each distinct ip of ips with length and told of the narrowest network that holds it, null where none does.

    One equi-join: an address asks once for every length that the table has (129 at most, those of 96 and more for IPv4). A wide
    network with most of the addresses is no hot key, as networks are repeated for each of some salts.
    """
    nets = prefixes(networks)
    lengths = sorted(r["length"] for r in nets.select("length").distinct().collect())  # 129 rows at most
    one = ips.select("ip").distinct().withColumn("at", number(F.col("ip")))
    levels = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    mapped = (F.col("at.hi") == 0) & (F.shiftright("at.lo", 32) == 65535)
    levels = F.when(F.col("at").isNotNull(), F.filter(levels, lambda n: ~mapped | (n >= _MAPPED)))
    asked = one.select("ip", "at", F.explode_outer(levels).alias("length"), F.pmod(F.xxhash64("ip"), F.lit(salts)).cast("int").alias("salt"))
    high, low = _masks(F.col("length"))
    asked = asked.select("ip", "length", "salt", F.col("at.hi").bitwiseAND(high).alias("hi"), F.col("at.lo").bitwiseAND(low).alias("lo"))
    held = nets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("held", F.lit(True))
    met = asked.join(held, ["length", "hi", "lo", "salt"], "left")
    best = F.when(F.col("held"), F.col("length"))
    return met.groupBy("ip").agg(F.max(best).alias("length"), F.max_by("told", best).alias("told"))


def enriched(rows: DataFrame, networks: DataFrame, ip: str = "src_ip") -> DataFrame:
    """rows with asn, geo_country and asn_source: the networks' (cidr, asn, country) first, else the rows' own columns.

    asn_source is geoip, dataset or none by what gave the asn. Rows keep their other columns and their number.
    """
    found = narrowest(rows.select(rows[ip].alias("ip")), networks).select(F.struct("ip", F.col("told.asn").cast("long").alias("asn"), F.col("told.country").alias("country")).alias("_net"))
    own = lambda c, t: (rows[c] if c in rows.columns else F.lit(None)).cast(t)
    kept = [rows[c] for c in rows.columns if c not in ("asn", "geo_country", "asn_source")]
    asn, country = F.col("_net.asn"), F.col("_net.country")
    source = F.when(asn.isNotNull(), "geoip").when(own("asn", "long").isNotNull(), "dataset").otherwise("none")
    return rows.join(found, rows[ip].eqNullSafe(F.col("_net.ip")), "left").select(
        *kept, F.coalesce(asn, own("asn", "long")).alias("asn"), F.coalesce(country, own("geo_country", "string")).alias("geo_country"), source.alias("asn_source")
    )
