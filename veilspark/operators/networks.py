"""Addresses as BINARY (4 or 16 bytes) and networks by prefix, for both families.

A network is the pair of its prefix length and its first bits; an address is in it if its own first bits are the same.
So a list of networks of any length is joined by equality: each distinct address gives one key for every prefix length that the list has.

Nulls and texts that are no address have no bytes, and are in no network. Zones (%eth0) and brackets do not count.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.sources.shared import written

from .spans import let


#: A dotted quad; the groups of an address, with :: once at most. Every text is read by few expressions, each of them once: a split that stands in several branches is done in each.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_GROUPS = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"


def v4_bytes(ip: Column) -> Column:
    """Four bytes of a dotted quad; null for other texts."""
    return F.when(ip.rlike(f"^{_QUAD}$"), F.unhex(_quad_hex(ip)))


def _quad_hex(quad: Column) -> Column:
    """Eight digits of what is a dotted quad."""
    return let(F.split(quad, "\\."), lambda p: F.lpad(F.hex(reduce(lambda a, b: a * 256 + b, [F.get(p, F.lit(i)).try_cast("bigint") for i in range(4)])), 8, "0"))


def v6_bytes(ip: Column) -> Column:
    """Sixteen bytes of an address of RFC 4291, with :: and a dotted quad at the end or without; null for other texts."""
    bare = F.lower(F.when(ip.rlike(r"^\[|[%\]]"), F.regexp_replace(ip, r"^\[|(?:%[^\]]*)?\]?$", "")).otherwise(ip))

    def in_hex(text: Column) -> Column:
        start = F.length(F.substring_index(text, ":", -1))
        digits = _quad_hex(F.substring_index(text, ":", -1))
        return F.concat(F.substring(text, F.lit(1), F.length(text) - start), let(digits, lambda d: F.concat(F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4))))

    def padded(text: Column) -> Column:
        """Groups of four digits without the signs between them, :: stays."""
        longer = F.regexp_replace(text, "([0-9a-f]+)", "000$1")
        return F.regexp_replace(longer, "[0-9a-f]{0,3}([0-9a-f]{4})(?::(?!:))?", "$1")

    def whole(digits: Column) -> Column:
        filled = F.concat(F.substring_index(digits, "::", 1), F.repeat(F.lit("0"), F.lit(34) - F.length(digits)), F.substring_index(digits, "::", -1))
        return F.when(digits.contains("::"), F.when(F.length(digits) <= 30, filled)).when(F.length(digits) == 32, digits)

    def of(text: Column) -> Column:
        return F.when(text.rlike(f"^(?:{_GROUPS})?(?:::(?:{_GROUPS})?)?$"), F.unhex(let(padded(text), whole)))

    return let(bare, lambda text: let(F.when(text.rlike(f":{_QUAD}$"), F.lower(in_hex(text))).otherwise(text), of))


def address_bytes(ip: Column) -> Column:
    """Four or sixteen bytes; null for what is no address."""
    return F.when(ip.contains(":"), v6_bytes(ip)).otherwise(v4_bytes(ip))


def prefix(address: Column, bits: int) -> Column:
    """The first bits of an address: whole bytes, and a last byte of which the rest is zero."""
    whole, rest = divmod(bits, 8)
    start = F.substring(address, 1, whole)
    if not rest:
        return start
    byte = F.conv(F.hex(F.substring(address, whole + 1, 1)), 16, 10).cast("int").bitwiseAND(256 - (1 << (8 - rest)))
    return F.concat(start, F.unhex(F.lpad(F.hex(byte), 2, "0")))


def in_network(address: Column, cidr: str) -> Column:
    """Whether an address (bytes) is in one network; false, never null."""
    net = ipaddress.ip_network(cidr, strict=False)
    packed = net.network_address.packed
    wanted = F.unhex(F.lit(packed[: -(-net.prefixlen // 8)].hex()))
    return F.coalesce((F.octet_length(address) == len(packed)) & (prefix(address, net.prefixlen) == wanted), F.lit(False))


def parsed(networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """networks with family (4 or 16 bytes), bits and address; rows that are no network go. No prefix length means a single address."""
    text = F.col(cidr)
    address = address_bytes(F.substring_index(text, "/", 1))
    bits = F.when(text.contains("/"), F.substring_index(text, "/", -1).try_cast("int")).otherwise(8 * F.octet_length("address"))
    rows = networks.withColumn("address", address).withColumn("family", F.octet_length("address")).withColumn("bits", bits)
    return rows.where("address IS NOT NULL AND bits BETWEEN 0 AND 8 * family")


def named_addresses(addresses: DataFrame, networks: DataFrame, column: str = "ip") -> DataFrame:
    """(column, name, bits) of each distinct address that lies in a network (cidr, name): the longest prefix decides, then the least name."""
    nets = written(parsed(networks).select("family", "bits", "address", "name"))
    lengths = sorted(tuple(r) for r in nets.select("family", "bits").distinct().collect())  # 162 at most
    keyed = reduce(lambda k, x: k.when((F.col("family") == x[0]) & (F.col("bits") == x[1]), prefix(F.col("address"), x[1])), lengths, F.when(F.lit(False), F.lit(None).cast("binary")))
    keys = nets.select("family", "bits", keyed.alias("prefix"), "name").groupBy("family", "bits", "prefix").agg(F.min("name").alias("name"))
    told = addresses.select(column).distinct().withColumn("address", address_bytes(F.col(column))).where("address IS NOT NULL")
    each = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(b).alias("bits"), F.when(F.octet_length("address") == f, prefix(F.col("address"), b)).alias("prefix")) for f, b in lengths] or [F.struct(F.lit(0).alias("family"), F.lit(0).alias("bits"), F.lit(None).cast("binary").alias("prefix"))])
    asked = told.select(column, F.explode(each).alias("k")).where("k.prefix IS NOT NULL").select(column, "k.*")
    met = asked.join(keys, ["family", "bits", "prefix"])
    return met.groupBy(column).agg(F.max_by("name", "bits").alias("name"), F.max("bits").alias("bits"))
