"""Reports over a span table (doc_id, span_no, rule, value, start, end, ..)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilspark.functions.catalogue import Rule
from veilspark.sources.shared import written


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    """The rules as a table: (rule, label, category, priority, enabled, strategy)."""
    return spark.createDataFrame([(r.id, r.label, r.category, r.priority, r.enabled, r.strategy) for r in rules], "rule string, label string, category string, priority int, enabled boolean, strategy string")


def per_document(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def statistics(spans: DataFrame) -> DataFrame:
    """(rule, n_hits, n_distinct, first_value, n_documents). Hits are summed by value and by document first, so that no rule's finds meet in one task.

    The hits of a value in a document are written as one row, so that the texts are scanned once for both sums.
    """
    held = written(spans.groupBy("rule", "value", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start")))
    values = held.groupBy("rule", "value").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "start")).alias("f"))
    values = values.groupBy("rule").agg(F.sum("n").alias("n_hits"), F.count(F.lit(1)).alias("n_distinct"), F.min_by("value", "f").alias("first_value"))
    documents = held.select("rule", "doc_id").distinct().groupBy("rule").agg(F.count(F.lit(1)).alias("n_documents"))
    return values.join(documents, "rule")


def values_in_order(spans: DataFrame) -> DataFrame:
    """The values of each rule in a document, in order of position."""
    held = F.array_sort(F.collect_list(F.struct("start", "value")))
    return spans.groupBy("doc_id", "rule").agg(F.array_join(F.transform(held, lambda x: x["value"]), "|").alias("found"))


def totals(spans: DataFrame) -> DataFrame:
    """Counts by rule, by document and over all: grouping sets in one pass."""
    return spans.groupingSets([["doc_id"], ["rule"], []], "doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def by_category(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """Counts of rules with their category's total and the category's place by total."""
    n = spans.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).join(rules.select("rule", "category"), "rule")
    n = n.withColumn("category_total", F.sum("n").over(W.partitionBy("category")))
    return n.withColumn("category_rank", F.dense_rank().over(W.orderBy(F.col("category_total").desc(), "category")).cast("long"))


def mapping(replaced: DataFrame) -> DataFrame:
    """Per document and replacement: the original, its rule, count and distinct lines. replaced: (doc_id, start, rule, value, replacement, line).

    Numbers are given anew in each document, so [EMAIL-1] of two documents are two rows, and the lines of one row are one document's.
    """
    lines = F.array_join(F.transform(F.sort_array(F.collect_set("line")), lambda x: x.cast("string")), ",")
    return replaced.groupBy("doc_id", "replacement").agg(F.min_by("value", "start").alias("original"), F.min_by("rule", "start").alias("rule"), F.count(F.lit(1)).alias("n"), lines.alias("lines"))


def revealed(texts: DataFrame, known: DataFrame, pattern: str, text_col: str = "redacted") -> DataFrame:
    """(doc_id, token, original, rule, n, lines): tokens of redacted texts with what they stand for. known: a mapping(), keyed by document and token.

    Tokens that the mapping does not have are left out: they were in the text before.
    """
    rows = texts.select("doc_id", F.posexplode(F.split(text_col, "\n", -1)).alias("k", "line"))
    tokens = rows.select("doc_id", (F.col("k") + 1).alias("line"), F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("token"))
    found = tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_set("line")), lambda x: x.cast("string")), ",").alias("lines"))
    mine = known.select("doc_id", F.col("replacement").alias("token"), "original", "rule")
    return found.join(mine, ["doc_id", "token"]).select("doc_id", "token", "original", "rule", "n", "lines")


def audit(spans: DataFrame, most: int = 100) -> DataFrame:
    """Per rule: hits, distinct values, and the first distinct values in order (ranked, so that no group is gathered whole)."""
    counts = written(spans.groupBy("rule", "value").agg(F.count(F.lit(1)).alias("n")))
    ranked = counts.withColumn("k", F.row_number().over(W.partitionBy("rule").orderBy("value"))).where(F.col("k") <= most)
    listed = ranked.groupBy("rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]), "|").alias("sample"))
    return counts.groupBy("rule").agg(F.sum("n").alias("n_hits"), F.count(F.lit(1)).alias("n_distinct")).join(listed, "rule")


def samples(spans: DataFrame, most: int = 3) -> DataFrame:
    """The first hits of each rule by document and position."""
    k = F.row_number().over(W.partitionBy("rule").orderBy("doc_id", "start"))
    return spans.withColumn("k", k).where(F.col("k") <= most)


def suggestions(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with hits, and whether they are on: those that are off are suggested."""
    return spans.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).join(rules, "rule").select("rule", "label", "category", "n", F.when(F.col("enabled"), "active").otherwise("suggested").alias("kind"))


def without_hits(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """Enabled rules that found nothing."""
    return rules.where("enabled").join(spans.select("rule").distinct(), "rule", "left_anti").select("rule", "label")


def ranked(rows: DataFrame, group: str, order: list[str], out: str = "number") -> DataFrame:
    """rows with their number in their group, from 1, in the order given.

    Two passes, so that no task sees a whole group: rows are range-partitioned by (group, order) and written with
    their part's number; the parts' counts, one row for each part and group, are summed before each part and added to
    the place within the part. Written, because rows that are dealt anew, or read in other parts, would get other numbers.
    """
    dealt = written(rows.repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(group).alias("__group"), F.col("__part").alias("__p"), before.alias("__before"))
    within = dealt.withColumn("__k", F.row_number().over(W.partitionBy("__part", group).orderBy(*order)))
    joined = within.join(offsets, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn(out, F.col("__k") + F.col("__before")).drop("__part", "__k", "__group", "__p", "__before")


def corpus_numbers(spans: DataFrame) -> DataFrame:
    """(value, rule, number): numbers by first appearance over the whole corpus, per rule of the first hit."""
    first = spans.groupBy("value").agg(F.min(F.struct("doc_id", "start", "rule")).alias("f")).select("value", "f.rule", "f.doc_id", "f.start")
    return ranked(first, "rule", ["doc_id", "start"]).select("value", "rule", "number")


def dictionary_continued(values: DataFrame, old: DataFrame) -> DataFrame:
    """(kind, original, number): an imported dictionary kept as it is, and new originals numbered after its largest number."""
    new = values.select("kind", "original").distinct().join(old, ["kind", "original"], "left_anti")
    top = old.groupBy("kind").agg(F.max("number").alias("top"))
    fresh = ranked(new, "kind", ["original"], "k").join(top, "kind", "left").select("kind", "original", (F.col("k") + F.coalesce("top", F.lit(0))).alias("number"))
    return old.select("kind", "original", "number").unionByName(fresh)
