"""Packets, mail, spam, tracks, entities, words, JSON and CSV context, on tables made from the given ones.

A made table is a list of expressions that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilspark.operators import context, packets, records
from veilspark.sources.shared import dealt
from veilspark.streaming import windows

from .registry import query, table

_S = "cast({} as varchar(20))".format

PACKETS = (
    "l_orderkey * 8 + l_linenumber as packet_no",
    f"concat('10.', {_S('l_partkey % 200')}, '.', {_S('l_suppkey % 250')}, '.', {_S('l_linenumber')}) as src_ip",
    f"case when l_partkey % 3 = 0 then concat('192.168.', {_S('l_suppkey % 250')}, '.', {_S('l_linenumber')}) when l_partkey % 3 = 1 then concat('8.8.', {_S('l_suppkey % 250')}, '.', {_S('l_linenumber')}) else concat('172.20.1.', {_S('l_linenumber')}) end as dst_ip",
    f"case when l_suppkey % 50 = 0 then 'ff:ff:ff:ff:ff:ff' else concat('00:1a:2b:3c:4d:', {_S('10 + l_suppkey % 80')}) end as dst_mac",
    f"concat('00:1a:2b:3c:5e:', {_S('10 + l_partkey % 80')}) as src_mac",
    "cast(1024 + l_partkey % 60000 as int) as src_port",
    "cast(case l_suppkey % 10 when 0 then 21 when 1 then 23 when 2 then 25 when 3 then 53 when 4 then 80 when 5 then 443 when 6 then 139 when 7 then 445 when 8 then 0 else 9999 end as int) as dst_port",
    "cast(case when l_linenumber % 3 = 0 then 17 else 6 end as int) as proto",
    "cast(l_quantity as int) * 20 as size",
    f"concat('GET /p', {_S('l_partkey')}, ' Host: Part', {_S('l_suppkey')}, '.example.com  token=', {_S('l_orderkey')}) as payload",
    "l_shipdate as ts",
)
PACKETS_CTE = f"packets as (select {', '.join(PACKETS)} from lineitem)"


def packet_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*PACKETS)


def _n4(ip: str) -> str:
    return "(" + " + ".join(f"cast(string_split({ip}, '.')[{i + 1}] as bigint) * {256 ** (3 - i)}" for i in range(4)) + ")"


@query(oracle=f"""with {PACKETS_CTE}, h as (select *, proto = 17 as p, ({_n4('src_ip')} between 167772160 + 65536 and 167772160 + 131071) or ({_n4('dst_ip')} between {8 * 2**24 + 8 * 65536} and {8 * 2**24 + 8 * 65536 + 4095}) or ({_n4('src_ip')} between {8 * 2**24 + 8 * 65536} and {8 * 2**24 + 8 * 65536 + 4095}) or ({_n4('dst_ip')} between 167772160 + 65536 and 167772160 + 131071) as a, (src_port between 20 and 25 or dst_port between 20 and 25 or src_port = 443 or dst_port = 443) as o from packets)
  select packet_no, not (p or a or o) as keep, case when p then 'protocol' when a then 'address' when o then 'port' end as reason from h""")
def packet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10, J-06's short form."""
    return packets.filtered(packet_table(spark, sf_dir), (17,), ("10.1.0.0/16", "8.8.0.0/20"), ((20, 25), (443, 443))).select("packet_no", "keep", "reason")


@query(oracle=f"with {PACKETS_CTE}, n as (select s_suppkey as id, 134217728 + 524288 + s_suppkey % 250 * 256 as lo, 134217728 + 524288 + s_suppkey % 250 * 256 + 255 as hi from supplier) select packet_no, id from packets join n on {_n4('dst_ip')} between lo and hi")
def packet_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long list of networks, by equal /16 block and range (J-06)."""
    lo = F.col("s_suppkey") % 250 * 256 + (134217728 + 524288)
    nets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), lo.alias("lo"), (lo + 255).alias("hi"))
    return packets.in_networks(packet_table(spark, sf_dir), nets, "dst_ip").select("packet_no", "id")


def _first(sides: list[str]) -> str:
    union = " union all ".join(f"select packet_no, {i} as side, {c} as value from packets" for i, c in enumerate(sides))
    return f"f as (select value, arg_min(side, (packet_no, side)) as side, min(packet_no) as packet_no from ({union}) group by value), num as (select value, row_number() over (order by packet_no, side, value) as n from f)"


_V4 = "case when n <= 762 then (case (n - 1) // 254 when 0 then '192.0.2.' when 1 then '198.51.100.' else '203.0.113.' end) || ((n - 1) % 254 + 1) when n <= 131834 then '198.' || (18 + (n - 763) // 65536 % 2) || '.' || ((n - 763) // 256 % 256) || '.' || ((n - 763) % 256) when n <= 251790074 then (240 + (n - 131835) // 16777216) || '.' || ((n - 131835) // 65536 % 256) || '.' || ((n - 131835) // 256 % 256) || '.' || ((n - 131835) % 256) else error('no address left for number ' || n) end"


@query(oracle=f"with {PACKETS_CTE}, {_first(['src_ip', 'dst_ip'])} select value as original, n as number, {_V4} as replacement, '2001:db8::' || lower(to_hex(n)) as v6 from num")
def ip_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses numbered by first packet, sources first (WIN-04, PKT-01, PKT-02, AGG-11's distinct list, SET-05)."""
    numbers = packets.first_numbers(packet_table(spark, sf_dir), ["src_ip", "dst_ip"])
    return numbers.select(F.col("value").alias("original"), "number", packets.v4_pseudonym(F.col("number")).alias("replacement"), packets.v6_pseudonym(F.col("number")).alias("v6"))


@query(oracle=f"with {PACKETS_CTE}, {_first(['dst_mac', 'src_mac'])} select value as original, case when value = 'ff:ff:ff:ff:ff:ff' then value else '02:00:00:' || substr(lpad(lower(to_hex(n)), 6, '0'), 1, 2) || ':' || substr(lpad(lower(to_hex(n)), 6, '0'), 3, 2) || ':' || substr(lpad(lower(to_hex(n)), 6, '0'), 5, 2) end as replacement from num")
def mac_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations first (PKT-03)."""
    numbers = packets.first_numbers(packet_table(spark, sf_dir), ["dst_mac", "src_mac"])
    return numbers.select(F.col("value").alias("original"), packets.mac_pseudonym(F.col("number"), F.col("value")).alias("replacement"))


@query(oracle=f"with {PACKETS_CTE}, {_first(['src_ip', 'dst_ip'])}, d as (select value, {_V4} as r from num) select packet_no, s.r as src_new, t.r as dst_new from packets p join d s on p.src_ip = s.value join d t on p.dst_ip = t.value")
def anonymised_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides through one dictionary (J-01, J-13, PKT-09)."""
    rows = packet_table(spark, sf_dir)
    d = packets.first_numbers(rows, ["src_ip", "dst_ip"]).select("value", packets.v4_pseudonym(F.col("number")).alias("r"))
    s, t = (d.select(F.col("value").alias(f"{x}_ip"), F.col("r").alias(f"{x}_new")) for x in ("src", "dst"))
    return rows.select("packet_no", "src_ip", "dst_ip").join(s, "src_ip").join(t, "dst_ip").select("packet_no", "src_new", "dst_new")


@query(oracle=f"""with {PACKETS_CTE}, f as (select *, row_number() over (order by src_port) as x from (select distinct src_port from packets)), g as (select src_port, x as n from f)
  select src_port, case when src_port < 1024 then src_port when n <= 16384 then cast(49151 + n as int) else cast(n - 16384 + 1023 as int) end as port, 'anon' || lpad(cast(n as varchar), greatest(5, length(cast(n as varchar)))::int, '0') || '.example.com' as domain from g""")
def port_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PKT-04, PKT-05. There are 65,536 ports at most, so one window numbers them."""
    d = packet_table(spark, sf_dir).select("src_port").distinct().withColumn("n", F.row_number().over(W.orderBy("src_port")))
    return d.select("src_port", packets.port_pseudonym(F.col("n"), F.col("src_port")).alias("port"), packets.domain_pseudonym(F.col("n"), F.lit("host")).alias("domain"))


_SERVICE = "case {} " + " ".join(f"when {p} then '{n}'" for p, n in packets.SERVICES.items()) + " end"


@query(oracle=f"with {PACKETS_CTE} select coalesce({_SERVICE.format('dst_port')}, {_SERVICE.format('src_port')}, 'other') as app, proto, count(*) as n, cast(sum(size) as bigint) as bytes, count(*) filter (proto = 17) as udp from packets group by app, proto")
def protocol_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10, AGG-14, PKT-07."""
    rows = packet_table(spark, sf_dir).withColumn("app", packets.application(F.col("src_port"), F.col("dst_port")))
    return rows.groupBy("app", "proto").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.count_if(F.col("proto") == 17).alias("udp"))


@query(oracle=f"with {PACKETS_CTE} (select 'src' as side, src_port as port, count(*) as n from packets where src_port <> 0 group by src_port order by n desc, port limit 10) union all (select 'dst', dst_port, count(*) as n from packets where dst_port <> 0 group by dst_port order by n desc, dst_port limit 10)")
def top_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12, TOP-04."""
    rows = packet_table(spark, sf_dir)

    def top(side: str) -> DataFrame:
        n = rows.where(f"{side}_port <> 0").groupBy(F.col(f"{side}_port").alias("port")).agg(F.count(F.lit(1)).alias("n"))
        return n.orderBy(F.col("n").desc(), "port").limit(10).select(F.lit(side).alias("side"), "port", "n")

    return top("src").unionByName(top("dst"))


@query(oracle=f"with {PACKETS_CTE}, a as (select distinct coalesce({_SERVICE.format('dst_port')}, {_SERVICE.format('src_port')}) as app from packets) select app, case app {' '.join(f'''when '{k}' then '{v}' ''' for k, v in packets.WARNED.items())} end as warning from a where app in ({', '.join(repr(k) for k in packets.WARNED)})")
def traffic_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13."""
    apps = packet_table(spark, sf_dir).select(packets.application(F.col("src_port"), F.col("dst_port")).alias("app")).distinct()
    known = spark.createDataFrame(list(packets.WARNED.items()), "app string, warning string")
    return apps.join(F.broadcast(known), "app")


@query(oracle=f"with {PACKETS_CTE} select packet_no, case proto when 6 then 'TCP' when 17 then 'UDP' end || ' ' || src_ip || ':' || src_port || ' > ' || dst_ip || ':' || dst_port || ' len ' || size as line, substr(payload, 1, 20) as head, length(payload) > 20 as cut from packets")
def packet_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PKT-08, FLT-18."""
    c = [F.col(x) for x in ("src_ip", "dst_ip", "proto", "src_port", "dst_port", "size")]
    return packet_table(spark, sf_dir).select("packet_no", packets.summary(*c).alias("line"), F.substring("payload", 1, 20).alias("head"), (F.length("payload") > 20).alias("cut"))


@query(oracle=f"with {PACKETS_CTE}, h as (select packet_no, payload, instr(lower(payload), 'part7') as p from packets) select packet_no, p - 1 as \"offset\", substr(payload, greatest(p - 32, 1), least(p - 1, 32) + 5 + 32) as context from h where p > 0 order by packet_no limit 100")
def payload_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-20, TOP-05: the first hundred hits are the feature."""
    return packets.payload_hits(packet_table(spark, sf_dir), "part7")


@query(oracle=f"with {PACKETS_CTE} select packet_no, regexp_replace(regexp_replace(payload, 'token=[^ ]+', 'token=[REDACTED]', 'g'), 'Host: [^ ]+', 'Host: anon.example.com', 'g') as payload from packets where dst_port in (80, 8080)")
def header_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-19: on web ports only."""
    p = F.regexp_replace(F.regexp_replace("payload", "token=[^ ]+", "token=[REDACTED]"), "Host: [^ ]+", "Host: anon.example.com")
    return packet_table(spark, sf_dir).where(F.col("dst_port").isin(80, 8080)).select("packet_no", p.alias("payload"))


@query(oracle=f"with {PACKETS_CTE} select packet_no, greatest(ts - interval 900000000 second, timestamp '1970-01-01') as ts from packets")
def packet_time_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIM-08: clamped at the epoch."""
    moved = F.timestamp_seconds(F.greatest(F.unix_timestamp("ts") - 900000000, F.lit(0)))
    return packet_table(spark, sf_dir).select("packet_no", moved.alias("ts"))


def _private(n: str) -> str:
    return "(" + " or ".join(f"{n} between {lo} and {lo + 2 ** (32 - b) - 1}" for lo, b in ((10 << 24, 8), (0xAC100000, 12), (0xC0A80000, 16), (127 << 24, 8), (0xA9FE0000, 16))) + ")"


@query(oracle=f"with {PACKETS_CTE} select packet_no, {_private(_n4('src_ip'))} as src_private, {_private(_n4('dst_ip'))} as dst_private, dst_ip like '172%' as v6_private from packets")
def private_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-03, FLT-04, PKT-06; the port of ip:port is cut off first."""
    v6 = F.when(F.col("dst_ip").startswith("172"), F.concat(F.lit("::ffff:"), F.col("dst_ip"))).otherwise("2001:db8::1")
    return packet_table(spark, sf_dir).select("packet_no", packets.is_private_v4(F.concat("src_ip", F.lit(":80"))).alias("src_private"), packets.is_private_v4(F.col("dst_ip")).alias("dst_private"), packets.is_private_v6(v6).alias("v6_private"))


# Mail: three hops for each customer, with seconds between them from the key.
_KEY = "c_custkey"
MAILS = (
    f"{_KEY} as mail_id",
    f"concat('Received: from c.example ([10.0.0.', {_S(_KEY + ' % 250')}, '])\n\tby d.example (Postfix) with ESMTPS;\n\tMon, 12 Jan 2026 16:', {_S('30 + ' + _KEY + ' % 20')}, ':', {_S('10 + ' + _KEY + ' % 50')}, ' +0100 (CET)\n', "
    f"'Received: from b.example ([192.0.2.7]) (using TLSv1.3 with cipher TLS_AES_256 (256/256 bits)) by c.example (Exim 4.96) with ESMTP id x; Mon, 12 Jan 2026 15:', {_S('20 + ' + _KEY + ' % 9')}, ':00 +0000\n', "
    f"'Received: from a.example by b.example with SMTP', case when {_KEY} % 7 = 0 then '' else '; 12 Jan 2026 10:10:05 -0500' end, '\n', 'Subject: hello\n', "
    f"'X-Spamd-Result: default: False [', {_S(_KEY + ' % 9')}, '.10 / 15.00]; RULE_A(', {_S(_KEY + ' % 5')}, '.50)[x]; RULE_B(-0.', {_S('10 + ' + _KEY + ' % 80')}, ')[]\n', 'Content analysis details: (1.2 points)\n pts rule\n ', {_S(_KEY + ' % 4')}, '.1 BAYES_', {_S(_KEY + ' % 3')}, ' body\n -1.0 ALL_TRUSTED relay\n') as headers",
)


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "customer").select("c_custkey")).selectExpr(*[m.replace("\n", "\\n").replace("\t", "\\t") for m in MAILS])


_HOPS = """hops as (
  select c_custkey as mail_id, 1 as hop_no, 'a.example' as from_host, case when c_custkey % 7 = 0 then null else timestamp '2026-01-12 15:10:05' end as "at", null as ip, 'SMTP' as protocol, null as tls, null as software from customer union all
  select c_custkey, 2, 'b.example', timestamp '2026-01-12 15:20:00' + to_minutes(c_custkey % 9), '192.0.2.7', 'ESMTP', 'TLSv1.3', 'Exim 4.96' from customer union all
  select c_custkey, 3, 'c.example', timestamp '2026-01-12 15:30:10' + to_minutes(c_custkey % 20) + to_seconds(c_custkey % 50), '10.0.0.' || (c_custkey % 250), 'ESMTPS', null, 'Postfix' from customer),
 d as (select *, cast(epoch("at") - epoch(lag("at") over (partition by mail_id order by hop_no)) as bigint) as delay from hops)"""


@query(oracle=f"with {_HOPS} select mail_id, hop_no, from_host, \"at\", ip, protocol, tls, software, delay, case when delay < 0 then 'clock' when delay <= 10 then 'fast' when delay <= 60 then 'normal' when delay <= 300 then 'slow' when delay > 300 then 'very slow' end as class from d")
def mail_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header text to hops with zone-aware times and delays (MAIL-01 to MAIL-04, WIN-06, WIN-07)."""
    rows = records.hops(mails(spark, sf_dir)).withColumn("class", records.delay_class(F.col("delay")))
    return rows.select("mail_id", "hop_no", "from_host", "at", "ip", "protocol", "tls", "software", "delay", "class")


@query(oracle=f"with {_HOPS} select mail_id, cast(epoch(arg_max(\"at\", hop_no)) - epoch(arg_min(\"at\", hop_no)) as bigint) as total, true as several_zones from d where \"at\" is not null group by mail_id")
def mail_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18."""
    rows = records.hops(mails(spark, sf_dir)).where("at is not null")
    total = F.unix_timestamp(F.max_by("at", "hop_no")) - F.unix_timestamp(F.min_by("at", "hop_no"))
    return rows.groupBy("mail_id").agg(total.alias("total"), (F.count_distinct("zone") > 1).alias("several_zones"))


_SPAM = """s as (select c_custkey as mail_id, 'rspamd' as engine, 'RULE_A' as name, c_custkey % 5 + 0.5 as score from customer union all select c_custkey, 'rspamd', 'RULE_B', -cast('0.' || (10 + c_custkey % 80) as double) from customer
  union all select c_custkey, 'spamassassin', 'BAYES_' || (c_custkey % 3), c_custkey % 4 + 0.1 from customer union all select c_custkey, 'spamassassin', 'ALL_TRUSTED', -1.0 from customer)"""


@query(oracle=f"with {_SPAM} select engine, name, count(*) as n, round(avg(score), 4) as mean, round(sum(score), 2) as total, count(*) filter (score > 0) as positive, count(*) filter (score < 0) as negative from s group by engine, name")
def spam_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAIL-05 to MAIL-07, AGG-17, AGG-19, TOP-06."""
    s = records.spam_symbols(mails(spark, sf_dir))
    return s.groupBy("engine", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.round(F.sum("score"), 2).alias("total"), F.count_if(F.col("score") > 0).alias("positive"), F.count_if(F.col("score") < 0).alias("negative"))


POINTS = ("user_id as track_id", "event_id as point_no", "((event_id * 37) % 14000) / 100.0 - 70.0 as lat", "((event_id * 91) % 34000) / 100.0 - 170.0 as lon", "event_id % 900 * 1.0 as ele", "ts", "cast(event_id * 99991 % 2147483647 as bigint) as raw", "event_id % 11 = 0 as no_fix")
POINTS_CTE = f"points as (select {', '.join(POINTS)} from events)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr(*POINTS)
    return rows.withColumn("lat", F.col("lat").cast("double")).withColumn("lon", F.col("lon").cast("double")).withColumn("ele", F.col("ele").cast("double"))


@query(oracle=f"with {POINTS_CTE} select track_id, count(*) as n, round(avg(lat), 10) as lat, round(avg(lon), 10) as lon, min(lat) as south, max(lat) as north, min(lon) as west, max(lon) as east, min(ele) as lowest, max(ele) as highest, round((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 60, 4) as minutes from points group by track_id".replace("min(lat)", "cast(min(lat) as double)").replace("max(lat)", "cast(max(lat) as double)").replace("min(lon)", "cast(min(lon) as double)").replace("max(lon)", "cast(max(lon) as double)").replace("min(ele)", "cast(min(ele) as double)").replace("max(ele)", "cast(max(ele) as double)"))
def track_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15."""
    s = records.track_statistics(points(spark, sf_dir))
    return s.withColumns({"lat": F.round("lat", 10), "lon": F.round("lon", 10), "minutes": F.round("minutes", 4)})


@query(oracle=f"""with {POINTS_CTE}, p as (select *, cast(lat as double) as la, cast(lon as double) as lo from points), c as (select track_id, avg(la) as cla, avg(lo) as clo from p group by track_id), m as (select point_no, lo + 170.0 - clo as x, la + 60.0 - cla as y from p join c using (track_id))
  select point_no, round(x - 360 * floor((x + 180) / 360), 4) as lon, round(greatest(least(y, 90.0), -90.0), 4) as lat from m""")
def moved_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRK-01: wrapped and clamped."""
    return records.moved_tracks(points(spark, sf_dir), 60.0, 170.0).select("point_no", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"))


@query(oracle=f"""with {POINTS_CTE}, c as (select case {' '.join(f"when lat between {s} and {n} and lon between {w} and {e} then '{name}'" for name, s, n, w, e in records.CONTINENTS)} else 'unknown' end as continent, no_fix, raw from points)
  select continent, count(*) as n, count(*) filter (not no_fix) as with_fix, round(max(case when not no_fix then round(raw * (180.0 / 2147483648), 6) end), 4) as most from c group by continent""")
def continents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRK-02, TRK-03, TRK-04."""
    rows = points(spark, sf_dir).withColumn("continent", records.continent(F.col("lat"), F.col("lon")))
    raw = F.when(F.col("no_fix"), F.lit(0x7FFFFFFF)).otherwise(F.col("raw"))
    rows = rows.withColumn("deg", records.semicircles(raw))
    return rows.groupBy("continent").agg(F.count(F.lit(1)).alias("n"), F.count("deg").alias("with_fix"), F.round(F.max("deg"), 4).alias("most"))


@query(oracle="select event_id, timestamp '1989-12-31' + to_seconds(event_id * 61) as at from events")
def device_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIM-09."""
    return table(spark, sf_dir, "events").select("event_id", F.timestamp_seconds(F.col("event_id") * 61 + 631065600).alias("at"))


# Tokens: labels by position, so that runs, breaks, pieces and low scores all occur.
TOKENS = (
    "o_custkey as doc_id", "o_orderkey as token_no", "case o_orderkey % 7 when 0 then 'B-PER' when 1 then 'I-PER' when 2 then 'O' when 3 then 'B-LOC' when 4 then 'I-LOC' when 5 then 'I-ORG' else 'B-PER' end as label",
    f"case when o_orderkey % 7 in (1, 4) then concat('##', {_S('o_orderkey % 1000')}) else concat('w', {_S('o_orderkey % 1000')}) end as word", "cast(o_orderkey % 10 as double) / 10 as score", "cast(o_orderkey % 100000 as int) as start", "cast(o_orderkey % 100000 + 4 as int) as end_at",
)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*TOKENS).withColumnRenamed("end_at", "end")


_ENTITIES = f"""t as (select {', '.join(TOKENS)} from orders), k as (select *, split_part(label, '-', -1) as kind, label[1] as mark from t),
  l as (select *, lag(kind) over w as pk, lag(mark) over w as pm from k window w as (partition by doc_id order by token_no)),
  n as (select *, sum(case when mark = 'I' and pk = kind and pm in ('B', 'I') then 0 else 1 end) over (partition by doc_id order by token_no) as island from l),
  e as (select doc_id, island, min(kind) as kind, replace(string_agg(word, ' ' order by token_no), ' ##', '') as word, avg(score) as score, min(start) as start, max(end_at) as "end" from n where mark <> 'O' group by doc_id, island)"""


@query(oracle=f"with {_ENTITIES} select doc_id, kind, word, round(score, 6) as score, start, \"end\" from e where score >= 0.5 and length(word) >= 2 and \"end\" - start between 1 and 100")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-12, WIN-09, FLT-13, D108-D116's input."""
    return records.entities(tokens(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(oracle=f"""with {_ENTITIES}, g as (select * from e where score >= 0.5 and length(word) >= 2 and "end" - start between 1 and 100), s as (select o_custkey as doc_id, cast(o_orderkey % 100000 + 2 as int) as a, cast(o_orderkey % 100000 + 9 as int) as b from orders where o_orderkey % 3 = 0)
  select doc_id, word, start from g where not exists (select 1 from s where s.doc_id = g.doc_id and g.start < s.b and g."end" > s.a)""")
def untouched_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-02, SET-04: equal document, range test."""
    at = F.col("o_orderkey") % 100000
    pattern = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("doc_id"), (at + 2).cast("int").alias("start"), (at + 9).cast("int").alias("end"))
    return records.untouched(records.entities(tokens(spark, sf_dir)), pattern).select("doc_id", "word", "start")


@query(oracle="""with l as (select doc_id as page_id, unnest(range(1, len(x) + 1)) as line_no, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents)),
  w as (select page_id, line_no, unnest(range(1, len(y) + 1)) as k, unnest(y) as text from (select page_id, line_no, list_filter(string_split(line, ' '), lambda z: z <> '') as y from l)),
  o as (select *, row_number() over (partition by page_id order by line_no, k) as word_no from w),
  p as (select *, lag(line_no) over (partition by page_id order by word_no) as pl from o),
  q as (select *, sum(length(text) + case when pl is null then 0 else 1 end) over (partition by page_id order by word_no) as e from p)
  select page_id, count(*) as words, cast(max(e) as bigint) as chars, cast(sum(e - length(text)) as bigint) as starts from q group by page_id""")
def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to page text with offsets (X-10)."""
    l = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    w = l.select("page_id", "line_no", F.posexplode(F.filter(F.split("line", " ", -1), lambda z: z != "")).alias("k", "text"))
    w = w.withColumn("word_no", F.row_number().over(W.partitionBy("page_id").orderBy("line_no", "k")))
    return records.page_texts(w).groupBy("page_id").agg(F.count(F.lit(1)).alias("words"), F.max("end").cast("long").alias("chars"), F.sum("start").cast("long").alias("starts"))


@query(oracle="""with w as (select o_custkey as page_id, o_orderkey as word_no, cast(o_orderkey % 5000 as int) as a, cast(o_orderkey % 5000 + 7 as int) as b from orders), s as (select c_custkey as page_id, cast(c_custkey * 13 % 5000 as int) as a, cast(c_custkey * 13 % 5000 + 400 as int) as b from customer)
  select w.page_id, word_no from w join s on w.page_id = s.page_id and w.b > s.a and w.a < s.b""")
def words_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-09, J-03."""
    at = F.col("o_orderkey") % 5000
    w = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("word_no"), at.alias("a"), (at + 7).alias("b")).alias("w")
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), (F.col("c_custkey") * 13 % 5000).alias("a"), (F.col("c_custkey") * 13 % 5000 + 400).alias("b")).alias("s")
    return w.join(s, (F.col("w.page_id") == F.col("s.page_id")) & (F.col("w.b") > F.col("s.a")) & (F.col("w.a") < F.col("s.b"))).select("w.page_id", "word_no")


_JSON = """concat('{"user":{"password":"p', cast(event_id as string), 'x","name":"n', cast(user_id as string), '"},"keys":[{"api_key":"k', cast(event_id % 50 as string), 'zz"},{"api_key":"null"}],"props":', props, '}')"""
_DUCK_JSON = _JSON


@query(oracle="select event_id, '$.user.password' as path, 'password' as key, 'p' || event_id || 'x' as value, 'high' as confidence from events union all select event_id, '$.keys[0].api_key', 'api_key', 'k' || (event_id % 50) || 'zz', 'high' from events")
def json_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspicious keys at any depth of a JSON document (D106, FLT-11, SRC-09, Q16)."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_JSON).alias("text"))
    return context.json_secrets(rows, "event_id").select("event_id", "path", "key", "value", "confidence")


_CSV = "concat('id;First Name;note\n', {k}, ';', {n}, ';\"a;b\"\n', {k}, ';unknown;x\n')"


@query(oracle="select c_custkey as doc_id, 2 as row_no, 'First Name' as header, c_name as value from customer")
def csv_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plausible names under name-like headers, delimiter sniffed (D107, SRC-07, FLT-12)."""
    text = F.concat(F.lit("id;First Name;note\n"), F.col("c_custkey").cast("string"), F.lit(";"), F.col("c_name"), F.lit(';"a;b"\n'), F.col("c_custkey").cast("string"), F.lit(";unknown;x\n"))
    return context.csv_names(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")))


@query(oracle="select s_suppkey as doc_id, 'A' as sheet, 2 as row_no, s_name as cells from supplier union all select s_suppkey, 'A', 3, 'x' from supplier union all select s_suppkey, 'B', 5, 'y,z' from supplier")
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08, WIN-12."""
    text = F.concat(F.lit("=== A ===\n"), F.col("s_name"), F.lit("\nx\n=== B ===\ny,z"))
    return context.sheet_rows(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text")))


_EVENT_RULE = "case event_type when 'error' then 'secret' when 'click' then 'email' else 'other' end"


@query(oracle=f"select time_bucket(interval 1 minute, ts) as window_start, {_EVENT_RULE} as rule, count(*) as n from events group by 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02's batch twin; tests run the stream."""
    return windows.tumbling(table(spark, sf_dir, "events").withColumn("rule", F.expr(_EVENT_RULE)), "1 minute")


@query(oracle=f"select s.w as window_start, {_EVENT_RULE} as rule, count(*) as n from events, lateral (select unnest([time_bucket(interval 1 minute, ts) - to_minutes(i) for i in range(0, 10)]) as w) as s group by 1, 2")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03's batch twin."""
    return windows.sliding(table(spark, sf_dir, "events").withColumn("rule", F.expr(_EVENT_RULE)), "10 minutes", "1 minute")


@query(oracle="""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 5 minute then 0 else 1 end as new from events where event_type = 'error'),
  s as (select *, sum(new) over (partition by user_id order by ts) as k from e) select user_id, min(ts) as session_start, count(*) as n from s group by user_id, k""")
def secret_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06's batch twin."""
    return windows.sessions(table(spark, sf_dir, "events").where("event_type = 'error'"), "5 minutes")
