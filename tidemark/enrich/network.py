"""IP addresses: private ranges, network lookup, datacenters and bot marks."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Autonomous systems of hosting providers.
DATACENTERS = (16509, 14618, 8075, 15169, 13335, 14061, 24940, 20473, 63949, 396982)


def ip_number(ip: Column) -> Column:
    """IPv4 address as a number, null otherwise."""
    ok = ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    p = F.split(ip, r"\.")
    n = sum((F.get(p, F.lit(i)).try_cast("bigint") * F.lit(256 ** (3 - i)) for i in range(1, 4)), F.get(p, F.lit(0)).try_cast("bigint") * F.lit(256 ** 3))
    return F.when(ok, n)


# Address blocks that never leave a local network (first address, prefix length).
LOCAL_BLOCKS = (("127.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16))


def is_local(ip: Column) -> Column:
    """Blank, loopback, private or link-local."""
    n = ip_number(ip)
    hit = ip.isNull() | ip.isin("", "localhost", "::1") | ip.rlike(r"(?i)^(fc|fd|fe[89ab])[0-9a-f:]+$")
    for first, bits in LOCAL_BLOCKS:
        lo = sum(int(part) << shift for part, shift in zip(first.split("."), (24, 16, 8, 0)))
        hit = hit | F.coalesce(n.between(lo, lo + (1 << (32 - bits)) - 1), F.lit(False))
    return hit


@F.pandas_udf(StringType())
def ip_digits(texts: pd.Series) -> pd.Series:
    """IPv6 addresses as 32 hexadecimal digits, null for what is none. Digits of one width compare as the addresses do. Only distinct
    addresses and range ends pass through here."""
    def one(text):
        try:
            return ipaddress.IPv6Address(text).packed.hex() if text and "%" not in text else None
        except ValueError:
            return None
    return texts.map(one, na_action="ignore")


_PLACE = ["country", "city", "latitude", "longitude", "asn"]


def _found4(asked: DataFrame, networks: DataFrame) -> DataFrame:
    block = 1 << 16
    cut = networks.select("start", "end", *_PLACE, F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))).alias("_block"))
    asked = asked.select("_ip", ip_number(F.col("_ip")).alias("_n")).where(F.col("_n").isNotNull())
    found = asked.withColumn("_block", F.floor(F.col("_n") / block)).join(cut, "_block").where(F.col("_n").between(F.col("start"), F.col("end")))
    return found.groupBy("_ip").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("w"), *_PLACE)).alias("_g")).select("_ip", *[F.col(f"_g.{c}").alias(c) for c in _PLACE])


def _found6(asked: DataFrame, networks: DataFrame) -> DataFrame:
    """A range is filed under the digits that its ends share; an address asks under each of its beginnings."""
    ends = networks.select(ip_digits("start").alias("start"), ip_digits("end").alias("end"), *_PLACE).where("start IS NOT NULL AND end IS NOT NULL")
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(32)), lambda i: F.substr(F.col("start"), F.lit(1), i) == F.substr(F.col("end"), F.lit(1), i)))
    filed = ends.withColumn("_block", F.substr(F.col("start"), F.lit(1), same))
    asked = asked.where(F.col("_ip").contains(":")).select("_ip", ip_digits("_ip").alias("_n")).where(F.col("_n").isNotNull())
    blocks = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda i: F.substr(F.col("_n"), F.lit(1), i))
    found = asked.select("_ip", "_n", F.explode(blocks).alias("_block")).join(filed, "_block").where(F.col("_n").between(F.col("start"), F.col("end")))
    # Among nested ranges the one that starts last, and of these the one that ends first, is the narrowest.
    place = F.struct(*[F.col(c) for c in _PLACE])
    best = found.groupBy("_ip", "start").agg(F.min(F.struct(F.col("end"), place.alias("g"))).alias("_e"))
    best = best.groupBy("_ip").agg(F.max(F.struct(F.col("start"), F.col("_e.g").alias("g")))["g"].alias("_g"))
    return best.select("_ip", *[F.col(f"_g.{c}").alias(c) for c in _PLACE])


def with_network(df: DataFrame, networks: DataFrame, ip: str = "ip", networks6: DataFrame | None = None) -> DataFrame:
    """Add location and provider of each address from ``networks`` (start, end, country, city, latitude, longitude, asn; IPv4 as numbers,
    inclusive) and ``networks6`` (the same with IPv6 addresses as text).

    IPv4 ranges are cut at /16 borders and IPv6 ranges filed under their common beginning, so the lookup is an equi-join with a range test
    instead of comparing every address with every range. Addresses in no range keep nulls; among nested ranges the narrowest wins.
    Addresses are looked up once each; those that are none take no part in the join back, as each input task's go to a key of its own.
    """
    asked = df.select(F.col(ip).alias("_ip")).distinct()
    best = _found4(asked, networks)
    if networks6 is not None:
        best = best.unionByName(_found6(asked, networks6))
    valid = ip_number(F.col(ip)).isNotNull() | (F.lit(networks6 is not None) & F.col(ip).contains(":"))
    key = F.when(valid, F.col(ip)).otherwise(F.concat(F.lit("-"), F.spark_partition_id().cast("string")))
    out = df.withColumn("_key", key).join(best, F.col("_key") == F.col("_ip"), "left")
    return out.select(*[df[c] for c in df.columns], *[best[c].alias(f"geo_{c}") for c in _PLACE])


def is_datacenter(asn: Column) -> Column:
    return F.coalesce(asn.isin(*DATACENTERS), F.lit(False))


def bot_reasons(bot_agent: Column, asn: Column, anomalies: Column | None = None) -> Column:
    """Why a request looks automated: agent pattern, datacenter address, header anomalies."""
    known = F.coalesce(asn, F.lit(0))
    number = F.when(known == 0, F.lit("unknown")).otherwise(known.cast("string"))
    own = F.array(F.when(bot_agent, F.lit("ua:bot_pattern")), F.when(is_datacenter(asn), F.concat(F.lit("datacenter_ip:AS"), number)))
    extra = anomalies if anomalies is not None else F.array().cast("array<string>")
    return F.concat(F.filter(own, lambda x: x.isNotNull()), F.coalesce(extra, F.array().cast("array<string>")))


def is_bot(reasons: Column) -> Column:
    """A bot agent decides alone; otherwise two kinds of signs are needed."""
    kinds = F.array_distinct(F.transform(reasons, lambda r: F.element_at(F.split(r, ":", 2), 1)))
    return F.array_contains(reasons, "ua:bot_pattern") | (F.size(kinds) >= 2)


def mark_bots(properties: Column, reasons: Column) -> Column:
    """Properties without client-sent bot marks and with the server's own."""
    clean = F.map_filter(properties, lambda k, v: ~k.startswith("__bot"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    flag = F.when(is_bot(reasons), F.create_map(F.lit("__bot"), F.lit("1"))).otherwise(empty)
    why = F.when(F.size(reasons) > 0, F.create_map(F.lit("__bot_reasons"), F.array_join(reasons, ","))).otherwise(empty)
    return F.map_concat(clean, flag, why)
