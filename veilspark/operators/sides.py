"""Frames with all their addresses: counters, one dictionary for every side, and frames rewritten through it.

A frame is a row (packet_no, ethertype, dst_mac, src_mac, arp_sender_mac, arp_sender_ip, arp_target_mac, arp_target_ip, src_ip, dst_ip, proto, src_port, dst_port,
pppoe, payload as BINARY). Columns that a frame does not have are null; a null address is counted nowhere and stays null, a frame of null kind counts as other. Frames with the same number are frames
of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.sources.shared import written

from .packets import mac_pseudonym, v4_pseudonym, v6_pseudonym
from .report import ranked

# Frame kinds, protocols by number, services by port; the sides in the order in which their addresses are numbered within a frame.
ARP, IPV4, IPV6 = 0x0806, 0x0800, 0x86DD
PORTS = {"dns": (53,), "http": (80,), "https": (443,), "ftp": (21,), "ssh": (22,), "telnet": (23,), "smtp": (25,), "dhcp": (67, 68), "netbios": (137, 138, 139), "smb": (445,)}
MAC_SIDES = ("dst_mac", "src_mac", "arp_sender_mac", "arp_target_mac")
IP_SIDES = ("src_ip", "dst_ip", "arp_sender_ip", "arp_target_ip")


def _byte(payload: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(payload, at + 1, 1)), 16, 10).cast("int")


def client_hello(payload: Column) -> Column:
    """Whether a payload begins with a whole handshake record whose first message is a client's greeting (RFC 8446, 4 and 5.1)."""
    length = _byte(payload, 3) * 256 + _byte(payload, 4)
    return (F.octet_length(payload) > 10) & (_byte(payload, 0) == 0x16) & (_byte(payload, 5) == 1) & (length > 4) & (F.octet_length(payload) >= 6 + length)


def counters(frames: DataFrame) -> DataFrame:
    """(name, n) of 21 counters, in one pass. A service counts once for each side whose port is its own."""
    kind, proto = F.col("ethertype"), F.col("proto")
    ip4, ip6, arp = kind == IPV4, kind == IPV6, kind == ARP
    known = (ip4 & proto.isin(1, 6, 17)) | (ip6 & proto.isin(6, 17, 58))
    transport = (ip4 | ip6) & proto.isin(6, 17)
    tests = {
        "ethernet": F.lit(True), "arp": arp, "pppoe": ~arp & F.col("pppoe"), "ipv4": ip4, "ipv6": ip6, "icmp": ip4 & (proto == 1), "icmpv6": ip6 & (proto == 58), "tcp": (ip4 | ip6) & (proto == 6), "udp": (ip4 | ip6) & (proto == 17),
        "other": ~F.coalesce(arp | known, F.lit(False)), "tls_client_hello": transport & (proto == 6) & ((F.col("src_port") == 443) | (F.col("dst_port") == 443)) & client_hello(F.col("payload")),
    }
    sums = {name: F.count_if(F.coalesce(test, F.lit(False))) for name, test in tests.items()}
    for name, ports in PORTS.items():
        sums[name] = sum((F.count_if(F.coalesce(transport & F.col(side).isin(*ports), F.lit(False))) for side in ("src_port", "dst_port")), F.lit(0))
    row = frames.agg(*[s.cast("long").alias(n) for n, s in sums.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in sums])))


def _kind(side: str) -> Column:
    return F.lit("mac") if side in MAC_SIDES else F.when(F.col(side).contains(":"), "ipv6").otherwise("ipv4")


def _sides(frames: DataFrame, *keep: str) -> DataFrame:
    """(keep.., side, rank, kind, value): a row for each address of each frame."""
    def of(side: str, rank: int) -> Column:
        return F.struct(F.lit(side).alias("side"), F.lit(rank).alias("rank"), _kind(side).alias("kind"), F.lower(side).alias("value"))

    each = [of(s, i) for sides in (MAC_SIDES, IP_SIDES) for i, s in enumerate(sides)]
    return frames.select(*keep, F.explode(F.array(*each)).alias("x")).select(*keep, "x.*").where("value IS NOT NULL")


def dictionary(frames: DataFrame) -> DataFrame:
    """(kind, value, number, replacement) of all addresses, numbered for each kind by first frame, then side, in any case."""
    first = _sides(frames, "packet_no").groupBy("kind", "value").agg(F.min(F.struct("packet_no", "rank")).alias("f")).select("kind", "value", "f.*")
    numbered = ranked(first, "kind", ["packet_no", "rank", "value"]).select("kind", "value", "number")
    new = F.when(F.col("kind") == "mac", mac_pseudonym(F.col("number"), F.col("value"))).when(F.col("kind") == "ipv6", v6_pseudonym(F.col("number"))).otherwise(v4_pseudonym(F.col("number")))
    return numbered.withColumn("replacement", new)


#: Addresses of a dictionary that is broadcast to the frames; a larger one is met by shuffle.
BROADCAST_BOUND = 200_000


def _met(frames: DataFrame, known: DataFrame) -> DataFrame:
    """anonymised() by a dictionary that every task holds: each side looks its address up, and no frame moves."""
    changed: dict[str, Column] = {k: F.lit(0) for k in ("mac", "ipv4", "ipv6")}
    out, sides = frames, (*MAC_SIDES, *IP_SIDES)
    for i, s in enumerate(sides):
        out = out.withColumns({f"__k{i}": _kind(s), f"__v{i}": F.lower(s)})
        mine = known.select(F.col("kind").alias(f"__kind{i}"), F.col("value").alias(f"__value{i}"), F.col("replacement").alias(f"__new{i}"))
        out = out.join(F.broadcast(mine), (F.col(f"__k{i}") == F.col(f"__kind{i}")) & (F.col(f"__v{i}") == F.col(f"__value{i}")), "left")
        for k in changed:
            changed[k] = changed[k] + F.when((F.col(f"__k{i}") == k) & (F.col(f"__v{i}") != F.col(f"__new{i}")), 1).otherwise(0)
    out = out.withColumns({n: changed[k].cast("long") for k, n in (("mac", "n_macs"), ("ipv4", "n_ipv4"), ("ipv6", "n_ipv6"))} | {s: F.col(f"__new{i}") for i, s in enumerate(sides)})
    out = out.withColumn("changed", F.col("n_macs") + F.col("n_ipv4") + F.col("n_ipv6") > 0)
    return out.drop(*[f"__{c}{i}" for i in range(len(sides)) for c in ("k", "v", "kind", "value", "new")])


def anonymised(frames: DataFrame) -> DataFrame:
    """frames with every address from the one dictionary, and n_macs, n_ipv4, n_ipv6 (addresses that changed) and changed.

    The dictionary is counted: a small one goes to the frames. For a large one the sides leave the frames as rows,
    meet the dictionary once, and come back as a map.
    """
    known = written(dictionary(frames).drop("number"))
    if known.count() <= BROADCAST_BOUND:
        return _met(frames, known)
    held = written(frames.withColumn("__rid", F.monotonically_increasing_id()))
    met = _sides(held, "__rid").join(known, ["kind", "value"])

    def changed(kind: str) -> Column:
        return F.count_if((F.col("kind") == kind) & (F.col("value") != F.col("replacement")))

    back = met.groupBy(F.col("__rid").alias("__of")).agg(F.map_from_entries(F.collect_list(F.struct("side", "replacement"))).alias("__new"), *[changed(k).alias(n) for k, n in (("mac", "n_macs"), ("ipv4", "n_ipv4"), ("ipv6", "n_ipv6"))])
    out = held.join(back, F.col("__rid") == F.col("__of"), "left")
    out = out.withColumns({s: F.col("__new")[s] for s in (*MAC_SIDES, *IP_SIDES)}).fillna(0, ["n_macs", "n_ipv4", "n_ipv6"])
    return out.withColumn("changed", F.col("n_macs") + F.col("n_ipv4") + F.col("n_ipv6") > 0).drop("__rid", "__of", "__new")
