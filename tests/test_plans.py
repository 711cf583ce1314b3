"""Plans: each expression runs once a row; long texts with many finds stay linear."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from veilspark.functions import catalogue
from veilspark.operators import replace, spans, sql_functions
from veilspark.plans import planted

RULES = catalogue.rules("email", "ipv4", "hostname", "generic_secret")


def optimised(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("overlap", ["greedy", "cover"])
def test_exploded_spans_keep_one_expression_a_rule(spark, overlap):
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    docs = spark.createDataFrame([(1, "mail a@b.cd")], "doc_id long, text string")
    found = spans.detect(docs, RULES).withColumn("spans", spans.resolved(F.col("spans"), overlap))
    assert optimised(spans.exploded(found)).count("regexp_extract_all") == len(RULES)
    assert optimised(spans.exploded(found).groupBy("rule").count()).count("regexp_extract_all") == len(RULES)


def test_a_long_text_with_many_finds(spark):
    n = 20_000
    docs = spark.range(1).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("é mail u"), (i % 5000).cast("string"), F.lit("@x.org, "))), "").alias("text"))
    found = spans.detect(docs, catalogue.rules("email"))
    found = replace.with_value_numbers(found.withColumn("spans", spans.resolved(F.col("spans"))))
    labels = F.transform("numbers", lambda k: replace.label(k["rule"], k["n"]))
    row = found.select(spans.applied(F.col("text"), F.col("spans"), labels).alias("out"), F.size("spans").alias("n"), replace.position_numbers(F.col("spans"))[n - 1].alias("last")).first()
    assert (row.n, row.last) == (n, n)
    assert row.out == "".join(f"é mail [EMAIL-{i % 5000 + 1}], " for i in range(n))


SHAPED = [r for r in catalogue.RULES if r.shape]
FINDS = {
    "ipv4": ["1.2.3.4", "x 255.249.199.0:80."],
    "hostname": ["a.b.co", "see mail-1.example.co.uk."],
    "credit_card": ["4222222222225", "5500000000000004 378282246310005"],
    "phone_us": ["(212)555-0123", "+1 212.555.0123", "212 5550123"],
}


def test_shapes_are_in_each_find_and_not_in_prose(spark):
    assert {r.id for r in SHAPED} == set(FINDS)
    rows = [(i, t.replace("{k}", k)) for i, t in enumerate([*planted.SHAPES, *(t for texts in FINDS.values() for t in texts)]) for k in ("0123", "9998")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in SHAPED:
        v, w = spans.values(F.col("text"), r), spans.values(F.col("text"), dataclasses.replace(r, shape=""))
        got = df.select(F.count_if(v != w).alias("other"), F.count_if(F.size(v) > 0).alias("n")).first()
        assert got.other == 0 and got.n >= 2 * len(FINDS[r.id]), r.id
    prose = spark.createDataFrame([("On page 12. See e.g. fig. 3.1, 1.5.2 and room 212. Nothing else.",)], "text string")
    assert prose.select(*[spans.gated(F.col("text"), r).alias(r.id) for r in SHAPED]).first() == (False, False, False, False)


def test_shapes_stand_before_the_expressions_in_sql():
    assert all(f"rlike(t, {spans.sql_string(r.shape)})" in sql_functions.located("t", r, 0) for r in SHAPED)
    text = sql_functions.found("t", "rules", {"few": SHAPED})
    assert all(spans.sql_string(r.shape) in text for r in SHAPED)
