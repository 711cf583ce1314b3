"""What iterates or builds on itself keeps each plan small: the driver holds every plan with its metrics."""

import re

import pytest
from pyspark.sql import functions as F

from veilspark.llm import kneser_ney, mixing, near_dedup, simhash


@pytest.fixture
def shuffles(monkeypatch):
    """Shuffles in the plan of each table that a module writes or checkpoints."""
    seen = []

    def noting(keep):
        def noted(df):
            seen.append(len(re.findall(r"\bExchange \w+", df._jdf.queryExecution().executedPlan().toString())))
            return keep(df)

        return noted

    for module, name in ((kneser_ney, "stored"), (mixing, "checkpointed"), (near_dedup, "checkpointed")):
        monkeypatch.setattr(module, name, noting(getattr(module, name)))
    return seen


def test_no_order_of_the_model_plans_the_orders_below_again(spark, shuffles):
    df = spark.createDataFrame([("en", "the cat sat on the mat"), ("de", "der Hund bellt laut")], "lang string, text string")
    model = kneser_ney.estimate(kneser_ney.count(df, F.col("lang"), F.col("text")))
    assert model.where("kind = 0").count() > 0 and max(shuffles) <= 6


def test_no_mix_target_plans_the_joins_of_another(spark, shuffles):
    cells = spark.createDataFrame([(a, b, c, 1 + i) for i, (a, b, c) in enumerate(["xpu", "xqv", "ypv", "yqu"])], "a string, b string, c string, n long")
    done, _ = mixing.rake(cells, ["a", "b", "c"], alpha=1.0)
    assert abs(done.agg(F.sum("w")).first()[0] - 1) < 1e-6 and max(shuffles) <= 8


def test_a_turn_of_the_components_plans_one_step_at_a_time(spark, shuffles):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 30)], "a long, b long")
    got = {r.node: r.root for r in near_dedup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(10)}, 20: 20, 30: 20} and max(shuffles) <= 5


@pytest.mark.parametrize("module, run", [(simhash, simhash.similar_documents), (near_dedup, near_dedup.near_duplicates)])
def test_exploded_keys_are_not_broadcast(spark, monkeypatch, module, run):
    """Spark takes an explode for as many rows as its input: all keys of up to 10 MB of classes went to the driver."""
    plans, stored = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(i, text + f" tail{i}") for i in range(6)] + [(9, "else"), (10, None)], "doc_id long, text string")
    assert run(df).count() == 8
    exploded = [p for p in plans if "Generate" in p and "explode(" in p]
    assert exploded and all(re.search(r"\w+Join\b", p)[0] == "SortMergeJoin" for p in exploded)
