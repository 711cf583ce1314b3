"""All rules in one plan, gates, users' expressions, and the SQL functions against the DataFrame operators."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions import catalogue, presets
from veilspark.operators import spans, sql_functions
from veilspark.plans.planted import SHAPES
from veilspark.plans.redaction import resolved_documents


def finds(spark, texts, rules):
    """{(text number, rule): values}, before validators."""
    df = spark.createDataFrame(list(enumerate(texts)), "n long, t string")
    held = df.select("n", *[spans.values(F.col("t"), r).alias(f"v{i}") for i, r in enumerate(rules)])
    return {(r["n"], rule.id): r[f"v{i}"] for r in held.collect() for i, rule in enumerate(rules)}


def test_gates_change_no_result(spark):
    from dataclasses import replace

    ungated = [replace(r, gate=()) for r in catalogue.RULES]
    lone = ["github_pat_" + "a" * 22 + "_" + "b" * 59, "ghs_" + "x" * 36]
    texts = [s.replace("{k}", "1234") for s in SHAPES] + lone
    values = sorted({v for found in finds(spark, texts, ungated).values() for v in found})  # each find as a text of its own
    for some in (texts, values):
        assert finds(spark, some, catalogue.RULES) == finds(spark, some, ungated)
    assert all(finds(spark, [t], catalogue.rules("github_token"))[0, "github_token"] == [t] for t in lone)


@pytest.mark.parametrize("pattern", [r"\b", "(?=a)", "a*", "(?:x|)", "(?<!a)", "^", "(a?)(b?)"])
def test_expressions_that_can_match_nothing_are_refused(pattern):
    with pytest.raises(ValueError):
        catalogue.custom("mine", pattern)
    assert catalogue.custom("mine", rf"(?:{pattern})z").pattern


def texts_of(spark):
    shapes = [s.replace("{k}", f"{1000 + i}") for i, s in enumerate(SHAPES)]
    rows = shapes + [None, "", "é👍 a@b.co", "a@b.co " * 700, " ".join(shapes), "mail a.b@mail.example.org, see http://a.b.example.com/x?t=1 é"]
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(rows)], "doc_id long, text string, rule string, t string")


@pytest.mark.parametrize("name", ["default", "secret", "sip-voip", "all"])
def test_detect_in_sql(spark, name):
    sql_functions.register(spark)
    rules = sql_functions.rule_sets()[name]
    if name not in ("default", "all"):  # the order of rules in SQL is the catalogue's
        assert {r.id for r in rules} - {r.id for r in catalogue.RULES} == {r.id for r in presets.PRESETS.get(name, presets.Preset()).extra}
    docs = texts_of(spark)
    want = spans.exploded(resolved_documents(docs.select("doc_id", "text"), rules)).select("doc_id", "rule", "start", "end", "value", "priority")
    got = spark.sql(f"select d.doc_id, x.* from {{d}} d, lateral detect(d.text, '{name}') x", d=docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns


def test_redact_in_sql(spark):
    sql_functions.register(spark)
    got = {r.doc_id: r.x for r in spark.sql("select doc_id, redact(text, 'default') as x from {d}", d=texts_of(spark)).collect()}
    n = len(SHAPES)
    assert got[n] is None and got[n + 1] == "" and got[n + 2] == "é👍 [EMAIL]" and got[n + 3] == "[EMAIL] " * 700
    assert got[0] == "write to [EMAIL] or <[EMAIL]>"
    chosen = spark.sql("select redact(t, s) as x from values ('a@b.co 1.2.3.4', 'contact'), ('a@b.co 1.2.3.4', 'network') as v(t, s)").collect()
    assert sorted(r.x for r in chosen) == ["[EMAIL] 1.2.3.4", "a@b.co [IPV4]"]
    for bad in ("'none'", "null"):
        with pytest.raises(Exception, match="no such rule set"):
            spark.sql(f"select redact(text, {bad}) as x from {{d}}", d=texts_of(spark)).collect()


def test_detect_in_sql_shuffles_nothing(spark):
    sql_functions.register(spark)
    docs = texts_of(spark)
    docs.createOrReplaceTempView("texts_for_detect")
    plan = spark.sql("select d.doc_id, x.value from texts_for_detect d, lateral detect(d.text, 'contact') x")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("regexp_extract_all") == len(catalogue.of_category("contact"))
