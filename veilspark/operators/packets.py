"""Packet tables: filters, pseudonyms by order of first appearance, reports. No capture codec."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.sources.shared import written

from .networks import in_network, v6_bytes
from .report import ranked

#: Services by port.
SERVICES = {20: "ftp", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 67: "dhcp", 68: "dhcp", 80: "http", 110: "pop3", 123: "ntp", 137: "netbios", 138: "netbios", 139: "netbios", 143: "imap", 161: "snmp", 443: "https", 445: "smb", 587: "smtp", 993: "imaps", 3306: "mysql", 3389: "rdp", 5060: "sip", 5432: "postgres", 6379: "redis", 8080: "http"}
WARNED = {"ftp": "clear-text file transfer", "telnet": "clear-text terminal", "http": "clear-text web", "smtp": "mail", "dns": "names looked up", "netbios": "machine names", "smb": "file shares"}
#: Networks of the documentation ranges for pseudonyms; beyond them 198.18.0.0/15.
DOC_NETS = ("192.0.2", "198.51.100", "203.0.113")


def v4_number(ip: Column) -> Column:
    """The number of a dotted quad; null for other texts, IPv6 ones among them."""
    p = F.split(ip, "\\.")
    # A part with a colon is no number; without the test each costs an exception.
    return reduce(lambda a, b: a * 256 + b, [F.when(~F.get(p, i).contains(":"), F.get(p, i).try_cast("bigint")) for i in range(4)])


def is_private_v4(ip: Column) -> Column:
    """10/8, 172.16/12, 192.168/16, 127/8, 169.254/16; a port is cut off first."""
    n = v4_number(F.substring_index(ip, ":", 1))
    ranges = ((10 << 24, 8), (0xAC100000, 12), (0xC0A80000, 16), (127 << 24, 8), (0xA9FE0000, 16))
    return reduce(lambda a, b: a | b, [n.between(lo, lo + (1 << (32 - bits)) - 1) for lo, bits in ranges])


def is_private_v6(ip: Column) -> Column:
    low = F.lower(ip)
    mapped = F.regexp_extract(low, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    return (low == "::1") | low.rlike("^fe[89ab]") | low.rlike("^f[cd]") | F.when(mapped != "", is_private_v4(mapped)).otherwise(False)


def cidr_range(cidr: str) -> tuple[int, int]:
    ip, _, bits = cidr.partition("/")
    n = reduce(lambda a, b: a * 256 + int(b), ip.split("."), 0)
    span = 1 << (32 - int(bits or 32))
    return n // span * span, n // span * span + span - 1


def filtered(packets: DataFrame, protocols=(), cidrs=(), ports=(), invert: bool = False) -> DataFrame:
    """packets with keep and reason: protocol, then address (networks of both families), then port; any hit removes the packet, or with invert keeps it."""
    by_protocol = F.col("proto").isin(list(protocols)) if protocols else F.lit(False)
    by_address, by_port = F.lit(False), F.lit(False)
    # Each side is read once, as columns of their own: inside the tests it would be read again for every network.
    read = {}
    for side in ("src", "dst"):
        if any(":" not in c for c in cidrs):
            read[f"__{side}_v4"] = v4_number(F.col(f"{side}_ip"))
        if any(":" in c for c in cidrs):
            read[f"__{side}_v6"] = F.when(F.col(f"{side}_ip").contains(":"), v6_bytes(F.col(f"{side}_ip")))
    for cidr in cidrs:
        for side in ("src", "dst"):
            if ":" in cidr:
                by_address = by_address | in_network(F.col(f"__{side}_v6"), cidr)
            else:
                by_address = by_address | F.coalesce(F.col(f"__{side}_v4").between(*cidr_range(cidr)), F.lit(False))
    for lo, hi in ports:
        by_port = by_port | F.col("src_port").between(lo, hi) | F.col("dst_port").between(lo, hi)
    reason = F.when(by_protocol, "protocol").when(by_address, "address").when(by_port, "port")
    out = packets.withColumns(read).withColumn("reason", reason).drop(*read)
    out = out.withColumn("keep", F.col("reason").isNull())
    keep, why = turned(F.col("keep")) if invert else (F.col("keep"), F.col("reason"))
    return out.select(*packets.drop("keep", "reason").columns, keep.alias("keep"), why.alias("reason"))


def turned(keep: Column) -> tuple[Column, Column]:
    """keep and reason of a filter that is turned round, from keep of the plain one."""
    return ~keep, F.when(keep, "inverted")


#: Blocks of networks that are broadcast.
FEW_BLOCKS = 500_000


def in_networks(packets: DataFrame, networks: DataFrame, column: str) -> DataFrame:
    """Packets with an address in a table of networks (lo, hi, name), for lists too long for an expression.

    Each range is cut to blocks of powers of two (a network is one, any range at most two of each size), which do not overlap. So a
    packet is joined by its own block of each size in use, and nothing that does not match leaves the join.
    Up to FEW_BLOCKS blocks are broadcast, with the networks of each as one list, so that no packet is shuffled; more are joined by shuffle.
    """
    sizes = F.sequence(F.lit(0), F.lit(62))
    ranges = networks.where("lo IS NOT NULL AND hi IS NOT NULL").withColumn("__a", F.greatest("lo", F.lit(0).cast("bigint"))).withColumn("__b", F.least("hi", F.lit((1 << 62) - 1)) + 1)

    def ends(k: Column) -> Column:
        left, right = -F.call_function("shiftright", -F.col("__a"), k), F.call_function("shiftright", F.col("__b"), k)
        block = lambda n, held: F.when((left < right) & held, F.struct(k.alias("size"), n.alias("block")))
        return F.array(block(left, left % 2 == 1), block(right - 1, right % 2 == 1))

    blocks = ranges.withColumn("__x", F.explode(F.array_compact(F.flatten(F.transform(sizes, ends))))).select(*networks.columns, F.col("__x.size").alias("__size"), F.col("__x.block").alias("__block"))
    blocks = written(blocks.drop("lo", "hi"))
    named = [c for c in networks.columns if c not in ("lo", "hi")]
    used = sorted(r[0] for r in blocks.select("__size").distinct().collect())  # 63 at most
    n = packets.withColumn("__n", v4_number(F.col(column))).where("__n >= 0")
    each = F.array(*[F.struct(F.lit(k).alias("size"), F.shiftright("__n", k).alias("block")) for k in used] or [F.struct(F.lit(-1).alias("size"), F.col("__n").alias("block"))])
    asked = n.withColumn("__x", F.explode(each)).withColumn("__size", F.col("__x.size")).withColumn("__block", F.col("__x.block")).drop("__n", "__x")
    if blocks.count() > FEW_BLOCKS:
        return asked.join(blocks, ["__size", "__block"]).drop("__size", "__block")
    lists = blocks.groupBy("__size", "__block").agg(F.collect_list(F.struct(F.lit(True).alias("__x"), *named)).alias("__held"))
    met = asked.join(F.broadcast(lists), ["__size", "__block"])
    return met.select(*packets.columns, F.explode("__held").alias("__net")).select(*packets.columns, *[F.col("__net")[c].alias(c) for c in named])


def first_numbers(packets: DataFrame, sides: list[str]) -> DataFrame:
    """(value, number): values of several columns numbered by first packet, then side (then value, where packet numbers repeat).

    Distinct values only are numbered, in two passes over range partitions, so no task orders all of them.
    """
    at = F.explode(F.array(*[F.struct(F.col(c).alias("value"), F.lit(i).alias("side")) for i, c in enumerate(sides)]))
    first = packets.select("packet_no", at.alias("x")).where("x.value is not null").groupBy("x.value").agg(F.min(F.struct("packet_no", "x.side")).alias("f"))
    return ranked(first.select("value", "f.packet_no", "f.side", F.lit(0).alias("all")), "all", ["packet_no", "side", "value"]).select("value", "number")


def _beyond(n: Column, what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"no {what} left for number "), n.cast("string")))


def v4_pseudonym(n: Column) -> Column:
    """n from 1: hosts 1 to 254 of three documentation networks, then 198.18.0.0/15, then 240.0.0.0/4; an error beyond, as no two may share one."""
    m = n - 1
    out = F.when(F.lit(False), F.lit(""))
    for i, net in enumerate(DOC_NETS):
        out = out.when(F.floor(m / 254) == i, F.concat(F.lit(net + "."), (m % 254 + 1).cast("string")))
    r = m - 254 * len(DOC_NETS)

    def address(first: Column, x: Column) -> Column:
        return F.concat(first.cast("string"), F.lit("."), (F.shiftright(x, 16) % 256).cast("string"), F.lit("."), (F.shiftright(x, 8) % 256).cast("string"), F.lit("."), (x % 256).cast("string"))

    bench, free = 1 << 17, r - (1 << 17)
    out = out.when(r < bench, address(F.lit(198), r + (18 << 16)))
    return out.when(free < 15 << 24, address(240 + F.shiftright(free, 24), free)).otherwise(_beyond(n, "address"))


def v6_pseudonym(n: Column) -> Column:
    return F.concat(F.lit("2001:db8::"), F.lower(F.hex(n)))


def mac_pseudonym(n: Column, value: Column) -> Column:
    """02 and the number in five octets; broadcast, zero and multicast addresses stay."""
    kept = (F.lower(value) == "ff:ff:ff:ff:ff:ff") | (value == "00:00:00:00:00:00") | F.lower(value).rlike("^.[13579bdf]")
    octets = F.regexp_replace(F.lpad(F.lower(F.hex(n)), 10, "0"), "(..)", ":$1")
    return F.when(kept, value).when(n >= 1 << 40, _beyond(n, "hardware address")).otherwise(F.concat(F.lit("02"), octets))


def port_pseudonym(n: Column, port: Column, keep_known: bool = True) -> Column:
    """49152 to 65535 first, then 1024 to 49151, then, unless known ports are kept, 1 to 1023."""
    kept = (port == 0) | ((port < 1024) if keep_known else F.lit(False))
    out = F.when(kept, port).when(n <= 16384, (49151 + n).cast("int")).when(n <= 64512, (n - 16384 + 1023).cast("int"))
    return (out if keep_known else out.when(n <= 65535, (n - 64512).cast("int"))).otherwise(_beyond(n, "port").cast("int"))


def domain_pseudonym(n: Column, name: Column) -> Column:
    number = n.cast("string")
    return F.when(name.isin("", "."), name).otherwise(F.concat(F.lit("anon"), F.lpad(number, F.greatest(F.length(number), F.lit(5)), F.lit("0")), F.lit(".example.com")))


def service(port: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for p, name in SERVICES.items():
        out = out.when(port == p, name)
    return out


def application(src_port: Column, dst_port: Column) -> Column:
    return F.coalesce(service(dst_port), service(src_port), F.lit("other"))


def summary(src: Column, dst: Column, proto: Column, src_port: Column, dst_port: Column, size: Column) -> Column:
    name = F.when(proto == 6, "TCP").when(proto == 17, "UDP").when(proto == 1, "ICMP").otherwise(F.concat(F.lit("IP"), proto.cast("string")))
    return F.concat(name, F.lit(" "), src, F.lit(":"), src_port.cast("string"), F.lit(" > "), dst, F.lit(":"), dst_port.cast("string"), F.lit(" len "), size.cast("string"))


def payload_hits(packets: DataFrame, term: str, reach: int = 32, most: int = 100) -> DataFrame:
    """The first place of a text in each packet's payload, any case, with what stands around it; at most n packets."""
    t = F.lower(F.col("payload"))
    at = F.instr(t, F.lit(term.lower()))
    rows = packets.withColumn("at", at).where("at > 0")
    context = F.substring(F.col("payload"), F.greatest(F.col("at") - reach, F.lit(1)), F.least(F.col("at") - 1, F.lit(reach)) + len(term) + reach)
    return rows.select("packet_no", (F.col("at") - 1).alias("offset"), context.alias("context")).orderBy("packet_no").limit(most)
