"""Literals of any length; numbers by two passes; pseudonyms that no two values share; a dictionary that grows by batches."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions import catalogue
from veilspark.operators import lookup, packets, replace, report
from veilspark.streaming import windows


def test_literals_of_any_length(spark):
    rng = random.Random(5)
    words = ["ab", "abc", "b", "é", "👍x", "cab", "a.b", "c\td", "b\nb"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(60)] + [(60, None), (61, ""), (62, "x" * 200_000 + " tail end here now")]
    literals = [(i, " ".join(rng.choices(words, k=1 + i % 8))) for i in range(60)] + [(60, "b"), (61, "b a"), (62, ""), (63, "tail end here"), (64, None), (65, " b "), (66, "ab")]
    got = lookup.literal_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(literals, "item_id long, literal string"))
    assert sorted(map(tuple, got.collect())) == sorted((d, i) for d, t in docs for i, x in literals if t is not None and x and x in t)


def test_ranked_over_many_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 7919 % 5003).alias("x")).repartition(7)
    got = {}
    for r in report.ranked(rows, "g", ["x"]).collect():
        got.setdefault(r.g, []).append((r.x, r.number))
    assert all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values()) and len(got) == 3


def test_pseudonyms_are_one_to_one(spark):
    n = spark.range(1, 300_001).withColumn("n", F.col("id"))
    cols = [packets.v4_pseudonym(F.col("n")), packets.mac_pseudonym(F.col("n") * 1000, F.lit("00:11:22:33:44:55")), packets.domain_pseudonym(F.col("n"), F.lit("h")), replace.fake(F.lit("ipv4"), F.col("n")), replace.fake(F.lit("credit_card"), F.col("n"))]
    told = n.select(*[F.count_distinct(c).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    assert set(told) == {300_000}
    ports = spark.range(1, 64_513).select(packets.port_pseudonym(F.col("id"), F.lit(2000)).alias("p"))
    assert ports.distinct().count() == 64_512 and ports.agg(F.min("p"), F.max("p")).first() == (1024, 65_535)
    with pytest.raises(Exception, match="no port left"):
        spark.range(1).select(packets.port_pseudonym(F.lit(70_000), F.lit(2000))).collect()


def test_every_rule_has_a_fake(spark):
    rows = spark.createDataFrame([(r.id,) for r in catalogue.RULES], "rule string").crossJoin(spark.range(1, 4).withColumnRenamed("id", "n"))
    told = rows.select("rule", replace.fake(F.col("rule"), F.col("n")).alias("f")).groupBy("rule").agg(F.count_distinct("f").alias("k"), F.max(F.length("f")).alias("longest"))
    assert {r.rule for r in told.collect() if r.k < 3} <= {"sip_realm"} and told.agg(F.min("longest")).first()[0] > 4


def test_numbered_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "dictionary")
    for values in (["b", "a", "b"], ["c", "a"], ["d"]):
        spark.createDataFrame([("email", v) for v in values], "rule string, value string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("rule string, value string").option("maxFilesPerTrigger", 1).parquet(source)
    windows.numbered_batches(stream, out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r.value: r.number for r in spark.read.parquet(out).collect()}
    assert sorted(got) == ["a", "b", "c", "d"] and sorted(got.values()) == [1, 2, 3, 4]


def test_few_literals_are_searched_where_they_stand(spark, monkeypatch):
    """Texts were cut into all their runs of characters for a list of a few short words; both ways give the same hits."""
    docs = spark.createDataFrame([(1, "the apache license, version 2"), (2, "cherry pie"), (3, None), (4, ""), (4, "a pie"), (4, "a pie")], "doc_id long, text string")
    literals = spark.createDataFrame([(1, "apache license, version"), (2, "pie"), (2, "cherry"), (3, "e"), (4, "pie"), (5, ""), (6, None), (7, "herry p")], "item_id int, literal string")
    few = lookup.literal_hits(docs, literals)
    assert "regexp_extract_all" not in few._jdf.queryExecution().optimizedPlan().toString() and few.schema["item_id"].dataType.simpleString() == "int"
    monkeypatch.setattr(lookup, "FEW", 0)
    many = lookup.literal_hits(docs, literals)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == [(1, 1), (1, 3), (2, 2), (2, 3), (2, 4), (2, 7), (4, 2), (4, 3), (4, 4)]
