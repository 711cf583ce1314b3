"""Mappings of phrases, networks of both families, payloads as bytes and headers, against plain Python."""

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.operators import mapping, networks, packets, payloads


def brute_mapping(cell, entries):
    tokens = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]", cell)]
    known = {}
    for _, original, new in sorted((e for e in entries if e[1] is not None and e[2] is not None), key=lambda e: (e[0], e[2])):
        known.setdefault(tuple(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]", original.lower())), new)
    known.pop((), None)
    out, at, i, n = [], 0, 0, 0
    while i < len(tokens):
        fits = [k for k in range(1, 8) if tuple(t[0] for t in tokens[i : i + k]) in known and i + k <= len(tokens)]
        if fits:
            k = max(fits)
            out += [cell[at : tokens[i][1]], known[tuple(t[0] for t in tokens[i : i + k])]]
            at, i, n = tokens[i + k - 1][2], i + k, n + 1
        else:
            i += 1
    return "".join(out) + cell[at:], n


def test_mapping_against_plain_python(spark):
    rng = random.Random(2)
    words = ["Ann", "ann", "Lee", "of", "the", "x@y.z", "é", "B-1", "York", "New"]
    say = lambda k: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", ", ", "."]) for _ in range(k))
    rows = [(i, say(rng.choice([0, 1, 5, 60])), rng.choice([None, "", "Ann Lee", say(3)]), i) for i in range(60)] + [(5, None, None, 0), (None, "New York New York", "ann", 1), (99, "ann lee " * 2000, "", 1)]
    entries = [(1, "ann lee", "P1"), (2, "ANN", "P2"), (3, "Ann  Lee", "never"), (4, "new york of the", "P4"), (5, "New York", "P5"), (6, "lee of the york new", "P6"), (7, "x@y.z", "P7"), (8, "é", "P8"), (9, None, "no"), (10, " \n", "no"), (11, "the", None), (12, "york", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cell string, n int").withColumn("rid", F.lit(1))
    known = spark.createDataFrame(entries, "no long, original string, replacement string")
    got = mapping.applied(df, known).collect()
    want = []
    for i, t, c, n in rows:
        new = [(None, 0) if x is None else brute_mapping(x, entries) for x in (t, c)]
        want.append((i, new[0][0], new[1][0], n, 1, new[0][1] + new[1][1]))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sorted(map(repr, map(tuple, mapping.applied(df, known.limit(0)).drop("n_replaced").collect()))) == sorted(map(repr, map(tuple, df.collect())))
    assert mapping.applied(df.limit(0), known).count() == 0
    with pytest.raises(ValueError):
        mapping.applied(df, known, "text")


GOOD = ["::", "::1", "1::", "2001:db8::8:800:200c:417a", "2001:DB8:0:0:8:800:200C:417A", "::ffff:129.144.52.38", "::13.1.68.3", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "fe80::1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]
BAD = ["", ":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "1:2:3:4:5:6:7:8::", "::1.2.3.256", "::1.2.3", "1.2.3.4.5", "1.2.3.256", "1.2.3", "abc", "1.2.3.4:80"]


def test_addresses_as_python_reads_them(spark):
    texts = GOOD + BAD + ["0.0.0.0", "255.255.255.255", "10.1.2.3"]
    got = {r.t: r.b for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", networks.address_bytes(F.col("t")).alias("b")).collect()}
    for t in texts:
        try:
            want = ipaddress.ip_address(t).packed
        except ValueError:
            want = None
        assert (got[t] and bytes(got[t])) == want, t
    odd = spark.createDataFrame([("[fe80::1%eth0]",), ("fe80::1%1",), (None,)], "t string").select(networks.address_bytes(F.col("t")).alias("b")).collect()
    assert [r.b and bytes(r.b) for r in odd] == [ipaddress.ip_address("fe80::1").packed] * 2 + [None]


def test_networks_of_any_length(spark):
    rng = random.Random(4)
    ips = [str(ipaddress.IPv6Address((0x20010DB8 << 96) | rng.getrandbits(12) << 84 | rng.getrandbits(84))) for _ in range(60)] + [str(ipaddress.IPv4Address(0x0A000000 | rng.getrandbits(12) << 12 | rng.getrandbits(12))) for _ in range(60)]
    nets = []
    for ip in ips:
        a = ipaddress.ip_address(ip)
        nets.append(str(ipaddress.ip_network(f"{ip}/{rng.randint(0, a.max_prefixlen)}", strict=False)))
    rows = [(n, f"n{i % 50}") for i, n in enumerate(nets)] + [("junk", "x"), ("10.0.0.0/33", "x"), ("::/129", "x"), ("10.0.0.0/x", "x"), (None, "x"), (ips[0], "alone")]
    known = [(ipaddress.ip_network(n), name) for n, name in rows[: len(nets)] + rows[-1:]]
    got = {r.ip: (r.name, r.bits) for r in networks.named_addresses(spark.createDataFrame([(i,) for i in ips + ["bad", None]], "ip string"), spark.createDataFrame(rows, "cidr string, name string")).collect()}
    for ip in ips:
        a = ipaddress.ip_address(ip)
        fit = [(n.prefixlen, name) for n, name in known if n.version == a.version and a in n]
        want = min((-b, name) for b, name in fit) if fit else None
        assert got.get(ip) == (want and (want[1], -want[0]))
    assert set(got) <= set(ips)
    df = spark.createDataFrame([(i, ip, "junk", 6, 1, 2) for i, ip in enumerate(ips)], "packet_no long, src_ip string, dst_ip string, proto int, src_port int, dst_port int")
    for some in (nets[:3], nets[60:62] + nets[5:6]):
        kept = {r.packet_no: r.keep for r in packets.filtered(df, cidrs=[n for n in some if n.split("/")[1] != "0"]).collect()}
        of = [ipaddress.ip_network(n) for n in some if n.split("/")[1] != "0"]
        assert all(kept[i] == (not any(n.version == a.version and a in n for n in of)) for i, a in enumerate(map(ipaddress.ip_address, ips)))


def test_byte_hits(spark):
    rows = [(1, b"\x00abc\xffAbC"), (2, b"xxABC"), (3, b"\xc3\xa9 none"), (4, None), (5, b""), (6, b"\x01" * 40 + b"abc" + b"z" * 50), (7, b"a\x00c")]
    df = spark.createDataFrame(rows, "packet_no long, payload binary")
    got = [tuple(r) for r in payloads.byte_hits(df, b"abc").collect()]
    assert got == [(1, 1, True, ".abc.AbC"), (2, 2, False, "xxABC"), (6, 40, True, "." * 32 + "abc" + "z" * 29)]
    assert [tuple(r)[:3] for r in payloads.byte_hits(df, b"\xa9 n").collect()] == [(3, 1, True)]
    assert [r.packet_no for r in payloads.byte_hits(df, b"abc", most=2).collect()] == [1, 2] and payloads.byte_hits(df, b"").count() == 0


def test_headers(spark):
    ask = "GET / HTTP/1.1\r\nHost: A.example:80\r\ncookie:x=1; y\r\nX-Forwarded-For: 1.2.3.4\r\nNo colon\r\n\r\nCookie: body"
    rows = [(1, 6, 5, 80, ask), (2, 6, 8080, 5, "HTTP/1.1 200 OK\r\nSet-Cookie: a\r\norigin: https://b.example/x\r\nReferer: http://a.EXAMPLE"), (3, 17, 5, 80, ask), (4, 6, 5, 443, ask), (5, 6, 5, 80, "x" + ask), (6, 6, 5, 80, None), (7, 6, 5, 80, ""), (8, 6, None, 80, "GET /\r\n"), (9, 6, 1, 80, "POST / HTTP/1.1\r\nHost:\r\n\r\n" + "line\r\n" * 20_000)]
    got = {r.packet_no: (r.payload, r.n_headers) for r in payloads.redacted_headers(spark.createDataFrame(rows, "packet_no long, proto int, src_port int, dst_port int, payload string")).collect()}
    assert got[1] == ("GET / HTTP/1.1\r\nHost: anon00001.example.com\r\ncookie: [REDACTED]\r\nX-Forwarded-For: [ANONYMIZED-IP]\r\nNo colon\r\n\r\nCookie: body", 3)
    assert got[2] == ("HTTP/1.1 200 OK\r\nSet-Cookie: [REDACTED]\r\norigin: anon00002.example.com\r\nReferer: anon00001.example.com", 3)
    assert [got[k] for k in (3, 4, 5, 6, 7, 8)] == [(ask, 0), (ask, 0), ("x" + ask, 0), (None, 0), ("", 0), ("GET /\r\n", 0)]
    assert got[9] == ("POST / HTTP/1.1\r\nHost: \r\n\r\n" + "line\r\n" * 20_000, 1)
