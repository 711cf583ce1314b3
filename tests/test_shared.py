"""Tables written on the way to a result."""

from pathlib import Path

from pyspark.sql import functions as F

from veilspark.sources.shared import SHUFFLE_CLEANUP, settled, shared_dir, written


def folders(spark):
    return {p.name for p in Path(shared_dir(spark).removeprefix("file:")).glob("veilspark-*")}


def test_settled_keeps_the_result_alone(spark):
    before, setting = folders(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    seen = []

    def inner():
        t = written(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
        seen.append(folders(spark) - before)
        return t.join(written(t.where("k < 5")), "k", "left_semi")

    def outer():
        return settled(inner).where("k > 0")

    done = settled(outer)
    assert sorted(r.k for r in done.collect()) == [1, 2, 3, 4]
    assert len(seen[0]) == 1 and len(folders(spark) - before) == 1
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting


def test_settled_failure_keeps_the_tables(spark):
    before = folders(spark)

    def make():
        written(spark.range(3))
        raise ValueError("stop")

    try:
        settled(make)
    except ValueError:
        pass
    assert len(folders(spark) - before) == 1
    after = folders(spark)
    written(spark.range(1))
    assert len(folders(spark) - after) == 1
