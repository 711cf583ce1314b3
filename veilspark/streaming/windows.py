"""Counts over time windows, alike for batch tables and streams, and streaming redaction.

A stream gets its watermark from with_watermark(); batch tables need none. Redaction is a column
expression without state, so a stream of lines takes the same plan as a table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.catalogue import Rule
from veilspark.operators import replace, spans
from veilspark.operators.report import ranked


def with_watermark(stream: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(rows: DataFrame, size: str, ts: str = "ts") -> DataFrame:
    return rows.groupBy(F.window(ts, size).alias("w"), "rule").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "rule", "n")


def sliding(rows: DataFrame, size: str, step: str, ts: str = "ts") -> DataFrame:
    return rows.groupBy(F.window(ts, size, step).alias("w"), "rule").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "rule", "n")


def sessions(rows: DataFrame, gap: str, ts: str = "ts", user: str = "user_id") -> DataFrame:
    return rows.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("session_start"), "n")


def redacted_lines(lines: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """Lines with every find replaced by a bare label; a table or a stream."""
    found = spans.detect(lines, rules, text_col)
    found = found.withColumn("spans", spans.resolved(F.col("spans")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return found.withColumn(text_col, spans.applied(text, F.col("spans"), F.transform("spans", lambda s: replace.bare(s["rule"])))).drop("spans")


def hit_rows(lines: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """One row for each find, for counts by window: (all columns, rule, value_hash)."""
    found = spans.detect(lines, rules, text_col)
    return found.withColumn("s", F.explode_outer("spans")).where("s IS NOT NULL").withColumn("rule", F.col("s.rule")).withColumn("value_hash", F.sha2("s.value", 256)).drop("spans", "s")


def new_values(hits: DataFrame) -> DataFrame:
    """The first time that a value is seen, late rows within the watermark included; for streams."""
    return hits.dropDuplicatesWithinWatermark(["rule", "value_hash"])


def numbered_batches(stream: DataFrame, dictionary: str):
    """A stream writer that numbers values as they first appear: each batch adds its new values to a dictionary table.

    A batch that is run again finds its values in the table and adds none, so numbers stay stable.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.schema("rule string, value string, number long, batch long").parquet(dictionary)
        except AnalysisException as e:  # the first batch finds no dictionary yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            old = spark.createDataFrame([], "rule string, value string, number long, batch long")
        old = old.where(F.col("batch") != batch_id)
        fresh = batch.select("rule", "value").distinct().join(old, ["rule", "value"], "left_anti")
        top = old.groupBy("rule").agg(F.max("number").alias("top"))
        out = ranked(fresh, "rule", ["value"], "k").join(top, "rule", "left").select("rule", "value", (F.col("k") + F.coalesce("top", F.lit(0))).cast("long").alias("number"))
        out.write.mode("overwrite").parquet(f"{dictionary}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add)
