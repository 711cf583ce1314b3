"""Frames with nulls, broken payloads and repeated numbers."""

from veilspark.operators import sides

KIND = "packet_no long, ethertype int, dst_mac string, src_mac string, arp_sender_mac string, arp_sender_ip string, arp_target_mac string, arp_target_ip string, src_ip string, dst_ip string, proto int, src_port int, dst_port int, pppoe boolean, payload binary, value string"
HELLO = b"\x16\x03\x01\x00\x06\x01" + b"\0" * 6
NONE = (None,) * 15


def frames(spark):
    v4 = lambda n, **k: (n, 2048, "AA:00:00:00:00:02", "aa:00:00:00:00:04", None, None, None, None, k.get("src", "1.1.1.1"), k.get("dst", "2.2.2.2"), k.get("proto", 6), k.get("sp", 443), k.get("dp", 443), False, k.get("payload", HELLO), "clash")
    return spark.createDataFrame(
        [
            v4(2), v4(2, src="2.2.2.2", dst="3.3.3.3", payload=HELLO[:-1]), v4(3, proto=17, sp=53, dp=53), v4(4, payload=None), v4(5, payload=b"\x16"), v4(6, proto=99, sp=80, dp=80),
            (1, 2054, "ff:ff:ff:ff:ff:ff", "aa:00:00:00:00:02", "aa:00:00:00:00:02", "3.3.3.3", "00:00:00:00:00:00", "2.2.2.2", None, None, None, None, None, True, None, "clash"),
            (7, 34525, None, None, None, None, None, None, "2001:DB8::A", "2001:db8::a", 58, None, None, True, HELLO, "clash"), (None, *NONE),
        ],
        KIND,
    )


def test_counters(spark):
    got = {r.name: r.n for r in sides.counters(frames(spark)).collect()}
    want = {"ethernet": 9, "arp": 1, "pppoe": 1, "ipv4": 6, "ipv6": 1, "icmpv6": 1, "tcp": 4, "udp": 1, "other": 2, "dns": 2, "https": 8, "tls_client_hello": 1}
    assert len(got) == 21 and {k: n for k, n in got.items() if n} == want
    assert all(r.n == 0 for r in sides.counters(frames(spark).limit(0)).collect())


def test_dictionary_and_frames_rewritten(spark):
    got = {r.value: (r.kind, r.number, r.replacement) for r in sides.dictionary(frames(spark)).collect()}
    assert got["3.3.3.3"] == ("ipv4", 1, "192.0.2.1") and got["2.2.2.2"][1] == 2 and got["1.1.1.1"][1] == 3  # the ARP frame is the first, its sender before its target
    assert got["ff:ff:ff:ff:ff:ff"][1:] == (1, "ff:ff:ff:ff:ff:ff") and got["aa:00:00:00:00:02"][1] == 2 and got["2001:db8::a"] == ("ipv6", 1, "2001:db8::1")
    rows = {(r.packet_no, r.dst_ip): r for r in sides.anonymised(frames(spark)).collect()}
    assert len(rows) == 9 and rows[2, "192.0.2.2"].src_ip == "192.0.2.3" and rows[2, "192.0.2.1"].src_ip == "192.0.2.2"
    arp = rows[1, None]
    assert (arp.arp_sender_ip, arp.arp_target_ip, arp.arp_target_mac, arp.dst_mac) == ("192.0.2.1", "192.0.2.2", "00:00:00:00:00:00", "ff:ff:ff:ff:ff:ff") and arp.src_mac == arp.arp_sender_mac == got["aa:00:00:00:00:02"][2]
    assert (arp.n_macs, arp.n_ipv4, arp.n_ipv6, arp.changed) == (2, 2, 0, True) and arp.value == "clash"
    assert rows[7, "2001:db8::1"].n_ipv6 == 2 and not rows[None, None].changed
    assert sides.anonymised(frames(spark).limit(0)).count() == 0
