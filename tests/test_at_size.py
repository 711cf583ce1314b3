"""What larger tables brought out: rules that hold beyond the small numbers, and joins that keep to what matches."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspark.operators import mapping, packets
from veilspark.plans import tables


@pytest.mark.parametrize("query", ["ip_pseudonyms", "anonymised_packets"])
def test_the_twin_has_a_pseudonym_for_every_number(spark, query):
    from veilspark.plans import registry

    assert tables._V4 in registry.ORACLES[query]
    some = [1, 254, 255, 762, 763, 131834, 131835, 131836, 270_000, 16_909_051, 251_790_074]
    new = spark.createDataFrame([(n,) for n in some], "n long").select(packets.v4_pseudonym(F.col("n"))).collect()
    assert duckdb.sql(f"select {tables._V4} from (select unnest({some}) as n)").fetchall() == [tuple(r) for r in new]
    with pytest.raises(duckdb.Error):
        duckdb.sql(f"select {tables._V4} from (select 251790075 as n)").fetchall()


def test_ranges_of_any_ends(spark):
    rng = random.Random(9)
    ends = [(rng.randrange(2**32), rng.randrange(2**32)) for _ in range(20)] + [(x := rng.randrange(2**32), x + rng.randrange(300)) for _ in range(60)] + [(0, 2**32 - 1), (5, 5), (6, 5), (None, 3), (0, None), (134217728, 134217983)]
    ips = [rng.choice([lo, hi, (lo + hi) // 2, lo - 1, hi + 1]) % 2**32 for lo, hi in ends if lo is not None and hi is not None for _ in range(4)]
    rows = spark.createDataFrame([(i, ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))) for i, n in enumerate(ips)] + [(-1, None), (-2, "::1"), (-3, "-1.0.0.0")], "packet_no long, ip string")
    nets = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(ends)], "id int, lo long, hi long")
    got = packets.in_networks(rows, nets, "ip")
    assert got.columns == ["packet_no", "ip", "id"]
    want = [(i, k) for i, n in enumerate(ips) for k, (lo, hi) in enumerate(ends) if lo is not None and hi is not None and lo <= n <= hi]
    assert sorted((r.packet_no, r.id) for r in got.collect()) == sorted(want)
    assert packets.in_networks(rows, nets.limit(0), "ip").count() == 0


def test_networks_of_one_block_meet_only_their_own(spark):
    """A thousand networks in one /16 block: a packet was tested against each of them."""
    nets = spark.range(1000).selectExpr("id", "134217728 + (id % 250) * 256 as lo", "134217728 + (id % 250) * 256 + 255 as hi")
    rows = spark.range(500).selectExpr("id as packet_no", "concat('8.0.', cast(id % 250 as string), '.7') as ip")
    got = packets.in_networks(rows, nets, "ip")
    assert got.count() == 2000 and "BETWEEN" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()).upper() and "<=" not in plan


def test_packets_are_not_shuffled_for_few_networks(spark, monkeypatch):
    """Packets were shuffled and sorted by block as soon as Spark took the networks for large."""
    nets = spark.range(1000).selectExpr("id", "concat('n', id) as ip_name", "134217728 + (id % 250) * 256 as lo", "134217728 + (id % 250) * 256 + 255 as hi")
    rows = spark.range(500).selectExpr("id as packet_no", "concat('8.0.', cast(id % 250 as string), '.7') as ip")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = packets.in_networks(rows, nets, "ip")
        plan = few._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(r) for r in few.collect())
        monkeypatch.setattr(packets, "FEW_BLOCKS", 0, raising=False)
        many = packets.in_networks(rows, nets, "ip")
        assert got == sorted(tuple(r) for r in many.collect()) and few.columns == many.columns == ["packet_no", "ip", "id", "ip_name"] and len(got) == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_addresses_of_a_packet_are_read_once(spark):
    """However many networks: a side was split again for each of them, and for keep and for reason."""
    rows = spark.createDataFrame([("10.1.0.1", "8.8.8.8", 6, 1, 2)], "src_ip string, dst_ip string, proto int, src_port int, dst_port int")

    def reads(nets, what):
        plan = packets.filtered(rows, (17,), nets, ((20, 25),)).select("keep", "reason")
        return plan._jdf.queryExecution().optimizedPlan().toString().count(what)

    for nets, what in ((("10.1.0.0/16", "8.8.0.0/20", "9.9.0.0/16"), "split("), (("fe80::/10", "::1/128", "2001:db8::/32"), "regexp_replace(")):
        assert reads(nets, what) == reads(nets[:1], what) > 0


def test_no_row_of_a_mapping_holds_the_words_of_a_text(spark, monkeypatch):
    """The words of a text went along with each place where an original may begin."""
    seen, written = [], mapping.written
    monkeypatch.setattr(mapping, "written", lambda df: seen.append(df.schema.simpleString()) or written(df))
    cells = spark.createDataFrame([(1, "a b c a b " * 50), (2, None), (3, "")], "cell int, text string")
    nodes = mapping.trie(spark.createDataFrame([(1, "a b", "X"), (2, "b c a", "Y"), (3, "c", "Z")], "no long, original string, replacement string"))
    found = mapping.matches(cells, nodes)
    assert seen and not any("array" in s for s in seen)
    got = sorted((r.start, r.end, r.replacement) for r in found.collect())
    text = "a b c a b " * 50
    want = [(m, m + len(o), n) for o, n in (("a b", "X"), ("b c a", "Y"), ("c", "Z")) for m in range(len(text)) if text.startswith(o, m)]
    assert got == sorted(want)


def test_a_mapping_of_few_nodes_shuffles_nothing(spark, monkeypatch):
    """Every known word of every cell became a row, written and shuffled once a word of the longest original."""
    rng = random.Random(7)
    words = ["a", "B", "c", "x_1", "-", "é", "É", "\u212a", "\U0001f600", "the"]
    say = lambda k: "".join(rng.choice(words) + rng.choice([" ", "", "\n", "\u00a0", "\x0b"]) for _ in range(k))
    rows = spark.createDataFrame([(i, say(rng.choice([0, 1, 40])), rng.choice([None, "", "a b", say(4)])) for i in range(80)] + [(None, "a b c " * 500, "k")], "id long, text string, `a.b` string").withColumn("rid", F.lit(1.5))
    rows = rows.withColumnRenamed("a.b", "row")
    known = spark.createDataFrame([(1, "a b", "X"), (2, "b c a b c", "Y"), (3, "c", "Z"), (4, "a", ""), (5, "é -", "E"), (6, "k", "K"), (7, "x_1", "$1"), (8, "a b -", "W"), (9, "\U0001f600", "S")], "no long, original string, replacement string")
    few = mapping.applied(rows, known)
    plan = few._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(repr, map(tuple, few.collect())))
    monkeypatch.setattr(mapping, "FEW_NODES", 0, raising=False)
    many = mapping.applied(rows, known)
    assert few.schema.simpleString() == many.schema.simpleString() and got == sorted(map(repr, map(tuple, many.collect())))
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
    assert sum(r.n_replaced for r in few.collect()) > 500


def test_quality_bounds_are_fitted_on_all_labels(spark):
    """A sample of 20,000 labels was taken; the fit over tables of any size is the one in memory."""
    import numpy as np

    from veilspark.llm import quality

    rng = np.random.default_rng(4)
    for n, step in ((300, 0.25), (5_000, 0.01), (30_000, 0.001)):
        good = rng.random(n) < 0.8
        place = np.round(rng.normal(np.where(good, 0.0, 0.8), np.where(good, 1.0, 2.5)) / step) * step
        table = spark.createDataFrame([(float(p), bool(g)) for p, g in zip(place, good)], "place double, good boolean")
        for loss in (0.0, 0.01):
            assert quality.fitted_on(table, loss) == quality.fitted(place, good, loss)
    assert quality.fitted_on(table.limit(50), 0.01) is None and quality.fitted_on(table.limit(0), 0.01) is None
    out = spark.range(25_000).selectExpr("id as doc_id", "true as own", "false as base_failed", "rand(1) as log_perplexity", "0.5 as middle", "1.0 as spread", "cast(id as string) as key")
    labels = spark.range(25_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    assert quality.labelled(out, labels, "doc_id").count() == 25_000


def test_statistics_scan_their_spans_once(spark):
    """Hits by value and by document were two scans of all texts."""
    from veilspark.functions import catalogue
    from veilspark.operators import report, spans

    df = spark.createDataFrame([(1, "10.0.0.1 and 10.0.0.2 and 10.0.0.1"), (2, "10.0.0.2"), (3, None)], "doc_id long, text string")
    done = report.statistics(spans.exploded(spans.detect(df, catalogue.rules("ipv4", "email"))))
    assert "regexp_extract_all" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in done.select("rule", "n_hits", "n_distinct", "first_value", "n_documents").collect()] == [("ipv4", 4, 2, "10.0.0.1", 2)]


def test_made_texts_are_dealt_over_all_cores(spark, tmp_path):
    """All keys in one row group made one task of all texts, however many parts the file has."""
    from veilspark.plans import planted

    spark.range(4000).withColumnRenamed("id", "o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        sizes = planted.planted(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 2000


def test_packets_stay_where_they_are_for_few_hosts(spark, monkeypatch):
    """Every packet was shuffled with its lines to meet the names of its hosts."""
    from veilspark.operators import payloads

    rows = spark.range(60).selectExpr("id as packet_no", "6 as proto", "5 as src_port", "80 as dst_port", "concat('GET / HTTP/1.1\\r\\nHost: H', id % 7, '.example\\r\\nCookie: a\\r\\n\\r\\nHost: body') as payload")
    few = payloads.redacted_headers(rows)
    assert "LeftOuter" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(payloads, "FEW_HOSTS", 0)
    many = payloads.redacted_headers(rows)
    assert few.columns == many.columns and sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_equal_texts_are_parsed_once():
    import pandas as pd

    from veilspark.functions import syntax

    seen = []
    out = syntax._each(pd.Series(["a", None, "b", "a", ""]), lambda t: seen.append(t) or (t == "a", None if t == "a" else 3))
    assert sorted(seen) == ["", "a", "b"] and list(out["valid"]) == [True, False, False, True, False] and list(out["line"].fillna(0)) == [0, 3, 3, 0, 3]


def test_frames_stay_where_they_are_for_a_small_dictionary(spark, monkeypatch):
    """All sides of all frames were shuffled, and the frames themselves, whatever the dictionary's size."""
    from veilspark.operators import sides
    from veilspark.plans import frames

    rows = frames.frame_table(spark, "/root/testdata/sf0.001").limit(700)
    few = sides.anonymised(rows)
    assert "Aggregate" not in few.drop("payload")._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(sides, "BROADCAST_BOUND", 0)
    many = sides.anonymised(rows)
    assert set(few.columns) == set(many.columns) and sorted(map(str, few.select(many.columns).collect())) == sorted(map(str, many.collect()))


def test_mails_are_dealt_over_all_cores(spark, tmp_path):
    spark.range(4000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        sizes = tables.mails(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 2000


def test_a_tagger_gets_few_characters_at_a_time(spark):
    """Ten thousand texts came at once, and their tokens were held as Python objects."""
    from veilspark.operators import entities

    df = spark.range(300).selectExpr("id as doc_id", "case when id % 50 = 7 then null when id = 11 then repeat('y', 900000) else repeat('x', 5000) end as text").coalesce(1)
    got = entities.tagged(df, lambda texts: [[("B-PER", str(int(texts.str.len().sum())), 1.0, 0, len(t))] for t in texts]).collect()
    assert sorted(r.doc_id for r in got) == list(range(300)) and all(r.end == (0 if r.doc_id % 50 == 7 else 900000 if r.doc_id == 11 else 5000) for r in got)
    assert max(int(r.word) for r in got) <= 2 * entities.BATCH_CHARS + 900_000 and sum(int(r.word) > entities.BATCH_CHARS + 5000 for r in got) < 110
