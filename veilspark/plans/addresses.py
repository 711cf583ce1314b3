"""Networks of both families, payloads as bytes, and headers, on packets made from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import networks, packets, payloads
from veilspark.sources.shared import dealt

from .registry import query, table

# Addresses in every form that is in use, from the keys; the twin makes their bits from the same keys and never reads the text.
_A, _B, _C = (f"cast({x} as bigint)" for x in ("l_partkey % 65536", "l_suppkey % 65536", "l_linenumber"))


def _address(hex_of: str, a: str, b: str) -> str:
    c, h = _C, hex_of.format
    return (
        f"case l_linenumber % 5 when 0 then concat('2001:db8:', lower({h(a)}), '::', lower({h(b)})) when 1 then concat('2001:0DB8:', lpad({h(a)}, 4, '0'), ':0000:0000:0000:0000:', lpad({h(b)}, 4, '0')) "
        f"when 2 then concat('[fe80::', lower({h(a)}), ':', lower({h(b)}), '%eth0]') when 3 then concat('::ffff:10.1.', cast({b} % 256 as varchar(9)), '.', cast({c} as varchar(9))) else concat('10.2.', cast({a} % 256 as varchar(9)), '.', cast({b} % 256 as varchar(9))) end"
    )


def _bits(a: str, b: str) -> str:
    """DuckDB's bits of the address."""

    def group(x: str) -> str:
        return f"lpad(bin({x}), 16, '0')"

    zero = "0" * 16
    base = f"'{int('20010db8', 16):032b}'"
    return (
        f"case when l_linenumber % 5 in (0, 1) then {base} || {group(a)} || '{zero * 4}' || {group(b)} when l_linenumber % 5 = 2 then '{0xFE80:016b}{zero * 5}' || {group(a)} || {group(b)} "
        f"when l_linenumber % 5 = 3 then '{zero * 5}{0xFFFF:016b}{0x0A01:016b}' || {group(f'({b} % 256) * 256 + {_C}')} else '{0x0A02:016b}' || {group(f'({a} % 256) * 256 + {b} % 256')} end"
    )


def address_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.selectExpr("l_orderkey * 8 + l_linenumber as packet_no", f"{_address('hex({})', _A, _B)} as src_ip", f"{_address('hex({})', _B, _A)} as dst_ip", "cast(1024 + l_partkey % 60000 as int) as src_port", "cast(443 as int) as dst_port", "cast(6 as int) as proto")


_ADDRESSES = f"packets as (select l_orderkey * 8 + l_linenumber as packet_no, {_bits(_A, _B)} as src, {_bits(_B, _A)} as dst, {_address('to_hex({})', _A, _B)} as src_ip, {_address('to_hex({})', _B, _A)} as dst_ip, 1024 + l_partkey % 60000 as src_port from lineitem)"


def _net(cidr: str) -> str:
    """The first bits of a network, by Python's own reader."""
    import ipaddress

    net = ipaddress.ip_network(cidr)
    return f"{int(net.network_address):0{net.max_prefixlen}b}"[: net.prefixlen]


FILTERED = ("10.2.64.0/18", "2001:db8:40::/43", "::ffff:10.1.8.0/117", "fe80::3:0/112")


def _hit(bits: str) -> str:
    return "(" + " or ".join(f"(length({bits}) = {128 if ':' in c else 32} and starts_with({bits}, '{_net(c)}'))" for c in FILTERED) + ")"


@query(oracle=f"""with {_ADDRESSES}, h as (select packet_no, {_hit('src')} or {_hit('dst')} as a, src_port between 2000 and 2050 as o from packets)
  select packet_no, not (a or o) as keep, case when a then 'address' when o then 'port' end as reason, a or o as keep_inverted, case when not (a or o) then 'inverted' end as reason_inverted from h""")
def packet_filter_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks of both families in one filter, and the filter turned round (FLT-10)."""
    plain = packets.filtered(address_table(spark, sf_dir), (), FILTERED, ((2000, 2050),))
    keep, reason = packets.turned(F.col("keep"))
    return plain.select("packet_no", "keep", "reason", keep.alias("keep_inverted"), reason.alias("reason_inverted"))


_SUPPLIER_BITS = f"'{int('20010db8', 16):032b}' || lpad(bin(cast(s_suppkey % 65536 as bigint)), 16, '0')"
NAMED = (("2001:db8::/32", "documentation"), ("fe80::/10", "link"), ("::ffff:10.1.0.0/112", "mapped"), ("10.2.0.0/15", "site"), ("10.2.3.0/25", "desk"), ("2001:DB8:5:0::/64", "lab"), ("no network", "none"), ("10.2.0.0/40", "none"))


@query(oracle=f"""with {_ADDRESSES}, nets(bits, size, name) as (values {', '.join(f"('{_net(c.lower())}', {128 if ':' in c else 32}, '{n}')" for c, n in NAMED if n != 'none')}),
  n as (select bits, size, name from nets union all select {_SUPPLIER_BITS}, 128, 'supplier-' || s_suppkey from supplier), u as (select bits, size, min(name) as name from n group by bits, size),
  w as (select d.dst, u.name, length(u.bits) as bits from (select distinct dst from packets) d join u on length(d.dst) = u.size and starts_with(d.dst, u.bits) qualify row_number() over (partition by d.dst order by length(u.bits) desc) = 1)
  select packet_no, dst_ip, name, cast(bits as int) as bits from packets join w using (dst)""")
def packet_networks_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long list of networks of both families, the most specific of which names an address (J-06)."""
    rows = address_table(spark, sf_dir)
    own = table(spark, sf_dir, "supplier").select(F.concat(F.lit("2001:db8:"), F.hex(F.col("s_suppkey") % 65536), F.lit("::/48")).alias("cidr"), F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("name"))
    nets = own.unionByName(spark.createDataFrame(NAMED, "cidr string, name string"))
    named = networks.named_addresses(rows.select("dst_ip"), nets, "dst_ip")
    return rows.select("packet_no", "dst_ip").join(named, "dst_ip").select("packet_no", "dst_ip", "name", "bits")


# Payloads with bytes that are no text: the key's four bytes, a request with a name in mixed case, and a tail.
_PAYLOAD = "concat(unhex(lpad(hex(l_orderkey), 8, '0')), encode(concat('GeT /pArT', cast(l_partkey % 97 as string), case when l_linenumber % 2 = 0 then ' pArT7' else ' part7' end, ' end'), 'utf-8'), unhex(case when l_suppkey % 3 = 0 then '00fe80ff' else 'c3a900' end))"
_DUCK_PAYLOAD = "unhex(lpad(to_hex(l_orderkey), 8, '0')) || encode(concat('GeT /pArT', cast(l_partkey % 97 as varchar), case when l_linenumber % 2 = 0 then ' pArT7' else ' part7' end, ' end')) || unhex(case when l_suppkey % 3 = 0 then '00fe80ff' else 'c3a900' end)"


def _duck_hits(term: bytes, name: str) -> str:
    """The twin counts in hexadecimal digits, and prints bytes by their codes."""
    ascii_only = all(32 <= b < 127 for b in term)
    text = f"instr(lower(shown), '{term.decode('latin-1').lower()}')" if ascii_only else "0"
    return f"""select '{name}' as term, packet_no, cast(place - 1 as int) as "offset", exact, substr(shown, greatest(place - 32, 1), place - greatest(place - 32, 1) + 32) as context from (
      select packet_no, shown, h <> '' or starts_with(x, '{term.hex().upper()}') as exact, cast(case when h <> '' or starts_with(x, '{term.hex().upper()}') then length(h) / 2 + 1 else {text} end as int) as place
      from (select packet_no, x, regexp_extract(x, '^((?:..)*?){term.hex().upper()}', 1) as h, array_to_string(list_transform(range(1, length(x) // 2 + 1), lambda i: case when cast('0x' || substr(x, 2 * i - 1, 2) as int) between 32 and 126 then chr(cast('0x' || substr(x, 2 * i - 1, 2) as int)) else '.' end), '') as shown from p)) where place > 0"""


TERMS = {"part7": b"part7", "bytes": b"\xfe\x80", "start": b"get /"}


@query(oracle=f"with p as (select l_orderkey * 8 + l_linenumber as packet_no, hex({_DUCK_PAYLOAD}) as x from lineitem) " + " union all ".join(f'(select * from ({_duck_hits(t, n)}) order by packet_no, "offset", context limit 100)' for n, t in TERMS.items()))
def payload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes first, then what is printable in any case, places in bytes; the first hundred packets of each term are the feature (FLT-20, TOP-05)."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 8 + l_linenumber as packet_no", f"{_PAYLOAD} as payload")
    out = None
    for name, term in TERMS.items():
        hits = payloads.byte_hits(rows, term).select(F.lit(name).alias("term"), "packet_no", "offset", "exact", "context")
        out = hits if out is None else out.unionByName(hits)
    return out


_REQUEST = (
    "concat('GET /p', cast(l_partkey as varchar(20)), ' HTTP/1.1\r\nHost: Part', cast(l_suppkey % 40 as varchar(20)), '.Example.com:8080\r\nCOOKIE: id=', cast(l_orderkey as varchar(20)), '\r\nX-Forwarded-For: 10.0.0.1\r\nReferer: https://part', "
    "cast(l_partkey % 30 as varchar(20)), '.example.com/a?b=c\r\nAccept: */*\r\nauthorization:Basic abc\r\n\r\nCookie: in the body ', cast(l_linenumber as varchar(20)))"
)
_REQUESTS = f"l_orderkey * 8 + l_linenumber as packet_no, cast(case when l_linenumber % 4 = 3 then 17 else 6 end as int) as proto, cast(case l_suppkey % 3 when 0 then 80 when 1 then 8080 else 443 end as int) as dst_port, cast(40000 as int) as src_port, case when l_partkey % 5 = 0 then concat('X', {_REQUEST}) else {_REQUEST} end as payload"
_NAMED = "(select 'anon' || lpad(cast(n as varchar), greatest(5, length(cast(n as varchar)))::int, '0') || '.example.com' from names where host = {})"


@query(oracle=f"""with q as (select {_REQUESTS}, l_suppkey % 40 as s, l_partkey % 30 as k, l_partkey, l_orderkey, l_linenumber, proto_ok from (select *, l_linenumber % 4 <> 3 and l_suppkey % 3 < 2 and l_partkey % 5 <> 0 as proto_ok from lineitem)),
  h as (select 'part' || s || '.example.com' as host, packet_no, 1 as line_no from q where proto_ok union all select 'part' || k || '.example.com', packet_no, 4 from q where proto_ok),
  f as (select host, min((packet_no, line_no)) as f from h group by host), names as (select host, row_number() over (order by f, host) as n from f),
  a as (select host, 'anon' || lpad(cast(n as varchar), greatest(5, length(cast(n as varchar)))::int, '0') || '.example.com' as new from names)
  select packet_no, case when proto_ok then 'GET /p' || l_partkey || ' HTTP/1.1\r\nHost: ' || x.new || '\r\nCOOKIE: [REDACTED]\r\nX-Forwarded-For: [ANONYMIZED-IP]\r\nReferer: ' || y.new || '\r\nAccept: */*\r\nauthorization: [REDACTED]\r\n\r\nCookie: in the body ' || l_linenumber else payload end as payload, cast(case when proto_ok then 5 else 0 end as bigint) as n_headers
  from q left join a x on x.host = 'part' || s || '.example.com' left join a y on y.host = 'part' || k || '.example.com'""")
def web_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cookies, credentials, forwarded addresses and hosts of requests to web ports (FLT-19)."""
    return payloads.redacted_headers(dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).selectExpr(*_select_list())).select("packet_no", "payload", "n_headers")


def _select_list() -> list[str]:
    text = _REQUEST.replace("\r", "\\r").replace("\n", "\\n")
    return ["l_orderkey * 8 + l_linenumber as packet_no", "cast(case when l_linenumber % 4 = 3 then 17 else 6 end as int) as proto", "cast(case l_suppkey % 3 when 0 then 80 when 1 then 8080 else 443 end as int) as dst_port", "cast(40000 as int) as src_port", f"case when l_partkey % 5 = 0 then concat('X', {text}) else {text} end as payload"]
