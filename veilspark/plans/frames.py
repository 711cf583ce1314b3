"""Frames with ARP and both address families, made from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import sides

from .registry import query, table

_S = "cast({} as varchar(20))".format
_ARP, _V6 = "l_linenumber = 1", "l_linenumber in (2, 3)"


def _frames(hex_of: str) -> tuple[str, ...]:
    """The columns that both engines read alike; hex_of: how a number is written in hexadecimal digits."""
    h = hex_of.format
    return (
        "l_orderkey * 8 + l_linenumber as packet_no",
        f"cast(case when {_ARP} then 2054 when {_V6} then 34525 when l_linenumber = 7 then 35020 else 2048 end as int) as ethertype",
        f"case when l_suppkey % 50 = 0 then 'ff:ff:ff:ff:ff:ff' else concat('00:1A:2b:3c:4d:', {_S('10 + l_suppkey % 80')}) end as dst_mac",
        f"concat('00:1a:2b:3c:4d:', {_S('10 + l_partkey % 80')}) as src_mac",
        f"case when {_ARP} then concat('00:1a:2b:3c:4d:', {_S('10 + l_partkey % 80')}) end as arp_sender_mac",
        f"case when {_ARP} then concat('10.0.', {_S('l_partkey % 50')}, '.', {_S('l_suppkey % 50')}) end as arp_sender_ip",
        f"case when {_ARP} and l_partkey % 3 > 0 then '00:00:00:00:00:00' end as arp_target_mac",
        f"case when {_ARP} then concat('10.0.', {_S('l_suppkey % 50')}, '.', {_S('l_partkey % 50')}) end as arp_target_ip",
        f"case when {_ARP} or l_linenumber = 7 then null when {_V6} then concat('2001:db8::', {h('l_partkey % 300 + 1')}) else concat('10.0.', {_S('l_partkey % 50')}, '.', {_S('l_suppkey % 50')}) end as src_ip",
        f"case when {_ARP} or l_linenumber = 7 then null when {_V6} then concat('2001:DB8::', {h('l_suppkey % 300 + 1')}) else concat('8.8.', {_S('l_suppkey % 50')}, '.', {_S('l_partkey % 50')}) end as dst_ip",
        f"cast(case when {_ARP} or l_linenumber = 7 then null when l_partkey % 5 = 0 then 17 when l_partkey % 7 = 0 and {_V6} then 58 when l_partkey % 11 = 0 then 1 else 6 end as int) as proto",
        "cast(case l_suppkey % 13 when 0 then 53 when 1 then 80 when 2 then 443 when 3 then 21 when 4 then 22 when 5 then 23 when 6 then 25 when 7 then 67 when 8 then 68 when 9 then 137 when 10 then 139 when 11 then 445 else 50000 end as int) as dst_port",
        "cast(case l_partkey % 4 when 0 then 443 when 1 then 53 when 2 then 138 else 40000 end as int) as src_port",
        "l_partkey % 17 = 0 as pppoe",
        "unhex(concat(case when l_orderkey % 2 = 0 then '160301' else '170301' end, case when l_partkey % 6 = 0 then '00FF' else '0006' end, case when l_suppkey % 3 = 0 then '02' else '01' end, '0000000000000000')) as payload",
    )


_CTE = f"frames as (select {', '.join(_frames('lower(to_hex({}))'))} from lineitem)"


def frame_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_frames("lower(hex({}))"))


def _both(*ports: int) -> str:
    one = "count(*) filter (proto in (6, 17) and {} in (" + ", ".join(map(str, ports)) + "))"
    return f"{one.format('src_port')} + {one.format('dst_port')}"


_COUNTS = {
    "ethernet": "count(*)", "arp": "count(*) filter (ethertype = 2054)", "pppoe": "count(*) filter (ethertype <> 2054 and pppoe)", "ipv4": "count(*) filter (ethertype = 2048)", "ipv6": "count(*) filter (ethertype = 34525)",
    "icmp": "count(*) filter (ethertype = 2048 and proto = 1)", "icmpv6": "count(*) filter (ethertype = 34525 and proto = 58)", "tcp": "count(*) filter (proto = 6)", "udp": "count(*) filter (proto = 17)",
    "other": "count(*) filter (ethertype = 35020 or (ethertype = 34525 and proto = 1))", "dns": _both(53), "http": _both(80), "https": _both(443), "ftp": _both(21), "ssh": _both(22), "telnet": _both(23), "smtp": _both(25), "dhcp": _both(67, 68), "netbios": _both(137, 138, 139), "smb": _both(445),
    "tls_client_hello": "count(*) filter (proto = 6 and (src_port = 443 or dst_port = 443) and starts_with(hex(payload), '160301000601'))",
}


@query(oracle=f"with {_CTE} " + " union all ".join(f"select '{n}' as name, cast({c} as bigint) as n from frames" for n, c in _COUNTS.items()))
def frame_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 counters; a service counts once for each side (AGG-10, PKT-07)."""
    return sides.counters(frame_table(spark, sf_dir))


_SIDES = "s as (" + " union all ".join(
    f"select packet_no, rn, {i} as rank, '{s}' as side, {chr(39) + 'mac' + chr(39) if s in sides.MAC_SIDES else f'case when contains({s}, chr(58)) then {chr(39)}ipv6{chr(39)} else {chr(39)}ipv4{chr(39)} end'} as kind, lower({s}) as value from frames where {s} is not null"
    for some in (sides.MAC_SIDES, sides.IP_SIDES) for i, s in enumerate(some)
) + ")"
_V4 = "case when n <= 762 then (case (n - 1) // 254 when 0 then '192.0.2.' when 1 then '198.51.100.' else '203.0.113.' end) || ((n - 1) % 254 + 1) else '198.' || (18 + (n - 763) // 65536 % 2) || '.' || ((n - 763) // 256 % 256) || '.' || ((n - 763) % 256) end"
_MAC = "case when value in ('ff:ff:ff:ff:ff:ff', '00:00:00:00:00:00') then value else '02:00:00:' || lpad(lower(to_hex(n // 65536)), 2, '0') || ':' || lpad(lower(to_hex(n // 256 % 256)), 2, '0') || ':' || lpad(lower(to_hex(n % 256)), 2, '0') end"
_DICTIONARY = f"""{_CTE.replace(' from lineitem)', ', row_number() over () as rn from lineitem)')}, {_SIDES}, f as (select kind, value, min({{'p': packet_no, 'r': rank}}) as f from s group by kind, value),
  num as (select kind, value, row_number() over (partition by kind order by f, value) as n from f), d as (select kind, value, n as number, case kind when 'mac' then {_MAC} when 'ipv6' then '2001:db8::' || lower(to_hex(n)) else {_V4} end as replacement from num)"""


@query(oracle=f"with {_DICTIONARY} select * from d")
def frame_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address of every side in one dictionary, numbered by first frame and side (AGG-11, WIN-04, PKT-01 to PKT-03)."""
    return sides.dictionary(frame_table(spark, sf_dir))


@query(oracle=f"""with {_DICTIONARY}, m as (select rn, side, s.kind, replacement, replacement <> s.value as moved from s join d using (kind, value)),
  g as (select rn, {', '.join(f"max(replacement) filter (side = '{s}') as {s}" for s in (*sides.MAC_SIDES, *sides.IP_SIDES))}, count(*) filter (kind = 'mac' and moved) as n_macs, count(*) filter (kind = 'ipv4' and moved) as n_ipv4, count(*) filter (kind = 'ipv6' and moved) as n_ipv6 from m group by rn)
  select f.packet_no, {', '.join(f'g.{s}' for s in (*sides.MAC_SIDES, *sides.IP_SIDES))}, n_macs, n_ipv4, n_ipv6, n_macs + n_ipv4 + n_ipv6 > 0 as changed from frames f join g using (rn)""")
def anonymised_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames rewritten through the dictionary, ARP sides too, with what changed (PKT-09, J-13)."""
    done = sides.anonymised(frame_table(spark, sf_dir))
    return done.select("packet_no", *sides.MAC_SIDES, *sides.IP_SIDES, *[F.col(c).cast("long").alias(c) for c in ("n_macs", "n_ipv4", "n_ipv6")], "changed")
