"""Quality rules: fixed counts, and perplexity bands under a model of each language.

A Kneser-Ney model of each language is counted over all whole texts (kneser_ney.py), every text is
scored, and the median and quartiles of the log perplexity of each language set a lower and an upper
bound, `below` and `above` interquartile ranges from the median. Texts outside their language's band, and texts
that fail a fixed rule, are rejected.

With labels (id, quality 1 or 0), below and above are fitted: of all labelled texts that pass the fixed
rules, the pair is taken that rejects most of quality 0 and at most `loss` of quality 1. With fewer than LEAST_GOOD of quality 1 the given below and above hold.

Languages of fewer than `least` texts share one model and one band. If they are fewer even together,
their upper bound is that of all texts pooled; they have no lower one, as a model of few texts knows
each of them.

Nulls: a null text counts as empty (and fails the word count), a null language is the language ''.
Rows with the same id and text have the same verdict. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import kneser_ney
from .common import free_name, released, small_slices, stored, text_of

SYMBOLS = "#*$%&|<>"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Labelled texts of quality 1 that pass the fixed rules, at least, for fitted bounds.
LEAST_GOOD = 200
#: The share of quality 1 that the fitted bounds may reject.
LOSS = 0.01


def n_repeat_words(words: list[bytes], numbers: dict[bytes, int]) -> int:
    """Words inside three-word windows that the text has twice or more. numbers: of words seen so far."""
    if len(words) < 4:
        return 0
    own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) < 1 << 21:
        window = (own[:-2] << 42) | (own[1:-1] << 21) | own[2:]
        _, at, n = np.unique(window, return_inverse=True, return_counts=True)
    else:
        _, at, n = np.unique(np.stack([own[:-2], own[1:-1], own[2:]], axis=1), axis=0, return_inverse=True, return_counts=True)
    again = np.flatnonzero(n[at.ravel()] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[again + k] = True
    return int(covered.sum())


def measured(rows: DataFrame) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of rows (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        for b in batches:
            for part in small_slices(b, 1):
                out, numbers = [], {}
                for t in part.column(1).to_pylist():
                    words = t.encode().split()
                    lines = [x for x in t.split("\n") if x.strip(SPACE)]
                    if len(numbers) > 200_000:
                        numbers = {}
                    out.append((len(words), len(t) - sum(map(t.count, SPACE)), sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), n_repeat_words(words, numbers)))
                yield pa.record_batch({"key": part.column(0)} | {n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*out))})

    kinds = ", ".join(f"{c} bigint" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return rows.select(F.col("key").cast("string"), text_of("text")).mapInArrow(released(run), f"key string, {kinds}")


def grouped(docs: DataFrame, lang: Column, least: int) -> DataFrame:
    """(lang, group): '=' and the language, of all languages of `least` texts or more."""
    return docs.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= least).select("lang", F.concat(F.lit("="), F.col("lang")).alias("group"))


def centres(scored: DataFrame, least: int) -> DataFrame:
    """(group, own, middle, spread) of the log perplexity, of all texts where own is false; quartiles are from Spark's mergeable sketch."""
    q = F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000)
    found = scored.groupBy("group").agg(q.alias("q"), F.count(F.lit(1)).alias("texts"))
    found = found.crossJoin(F.broadcast(scored.agg(q.alias("pooled")))).withColumn("own", F.col("texts") >= least)
    found = found.withColumn("q", F.when(F.col("own"), F.col("q")).otherwise(F.col("pooled")))
    return found.select("group", "own", F.col("q")[1].alias("middle"), F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(0.02)).alias("spread"))


def fitted(place: np.ndarray, good: np.ndarray, loss: float) -> tuple[float, float] | None:
    """(below, above) that keep all but `loss` of the good and reject most others; None for too few good ones.

    place: distances from the median in interquartile ranges.
    """
    clean, junk = np.sort(place[good]), np.sort(place[~good])
    if len(clean) < LEAST_GOOD:
        return None
    spare = int(loss * len(clean))
    under = np.arange(spare + 1)
    low, high = clean[under], clean[len(clean) - 1 - (spare - under)]
    gone = np.searchsorted(junk, low, "left") + len(junk) - np.searchsorted(junk, high, "right")
    k = int(np.argmax(gone))
    return float(-low[k]), float(high[k])


def labelled(out: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """(place, good) of all labelled texts that pass the fixed rules and have a band of their own."""
    some = labels.where("quality in (0, 1)").select(F.col(id_col).alias("_id"), (F.col("quality") == 1).alias("good"))
    held = out.where(F.col("own") & ~F.col("base_failed")).join(some, F.col(id_col) == F.col("_id"))
    return held.select(((F.col("log_perplexity") - F.col("middle")) / F.col("spread")).alias("place"), "good")


def fitted_on(table: DataFrame, loss: float) -> tuple[float, float] | None:
    """As fitted(), of a table (place, good) of any size: one row reaches the driver.

    Each place has the good and the others before it; the counts of earlier parts are added, so no task orders all of them.
    """
    good, junk = F.col("good").cast("long"), (~F.col("good")).cast("long")
    places = table.groupBy("place").agg(F.sum(good).alias("g"), F.sum(junk).alias("j"))
    dealt = stored(places.repartitionByRange("place").withColumn("part", F.spark_partition_id()))
    totals = dealt.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("g"), F.coalesce(F.sum("j"), F.lit(0)).alias("j")).first()
    if totals.g < LEAST_GOOD:
        return None
    spare = int(loss * totals.g)
    parts = dealt.groupBy("part").agg(F.sum("g").alias("pg"), F.sum("j").alias("pj"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a part
    parts = parts.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("pg", "pj")])
    inside = W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    told = dealt.select("part", "place", "g", "j", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for c, n in (("g", "bg"), ("j", "bj"))])
    told = stored(told.join(F.broadcast(parts), "part").select("place", "g", "j", (F.col("bg") + F.col("pg")).alias("bg"), (F.col("bj") + F.col("pj")).alias("bj")).where("g > 0"))
    # The k-th good one from below goes with the (spare - k)-th from above.
    first = totals.g - 1 - spare
    low = told.where(F.col("bg") <= spare).select(F.explode(F.sequence(F.col("bg"), F.least(F.col("bg") + F.col("g") - 1, F.lit(spare)))).alias("k"), F.col("place").alias("low"), F.col("bj").alias("under"))
    high = told.where(F.col("bg") + F.col("g") > first).select(F.explode(F.sequence(F.greatest(F.col("bg") - first, F.lit(0)), F.col("bg") + F.col("g") - 1 - first)).alias("k"), F.col("place").alias("high"), (F.lit(totals.j) - F.col("bj") - F.col("j")).alias("over"))
    best = low.join(high, "k").agg(F.max(F.struct((F.col("under") + F.col("over")).alias("gone"), (-F.col("k")).alias("k"), "low", "high")).alias("b")).first().b
    return -best.low, best.high


def row_key(id_col: Column, text: Column) -> Column:
    """One key for rows of the same id and text."""
    return F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")), F.xxhash64(text_of(text)).cast("string"))


def judged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = 6.0, above: float = 3.5, least: int = 50, bound: int = kneser_ney.ENTRY_BOUND, labels: DataFrame | None = None, loss: float = LOSS
) -> DataFrame:
    """A row for each document: id, key, the counts, log_perplexity, lower, upper, base_failed, kept."""
    lang, text = F.coalesce(F.col(lang_col).cast("string"), F.lit("")), F.col(text_col)
    # Written, so that Spark knows its size and broadcasts it where it is small.
    groups = stored(grouped(docs, lang, least))
    rows = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), text).alias("key"), lang.alias("lang"), text_of(text).alias("text"))
    rows = rows.join(groups, "lang", "left").withColumn("group", F.coalesce("group", F.lit("few")))
    model = kneser_ney.estimate(kneser_ney.count(rows, F.col("group"), F.col("text")))
    scored = kneser_ney.score(rows.select("key", F.col("group").alias("lang"), "text"), model, bound).dropDuplicates(["key"])
    told = stored(measured(rows.select("key", "text")).dropDuplicates(["key"]).join(scored, "key").withColumn("log_perplexity", F.col("loss") / F.col("n")))
    out = rows.select(F.col("id").alias(id_col), "lang", "group", "key").join(told, "key")
    out = stored(out.drop("loss", "n"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.join(stored(centres(out, least)), "group").withColumn("base_failed", failed)
    if labels is not None:
        below, above = fitted_on(labelled(out, labels, id_col), loss) or (below, above)
    lower = F.when(F.col("own"), F.col("middle") - below * F.col("spread"))
    out = out.withColumn("lower", lower).withColumn("upper", F.col("middle") + above * F.col("spread"))
    inside = (F.col("lower").isNull() | (F.col("log_perplexity") >= F.col("lower"))) & (F.col("log_perplexity") <= F.col("upper"))
    return out.drop("group", "own", "middle", "spread").withColumn("kept", ~F.col("base_failed") & inside)


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with all their columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    name = free_name(docs, "gone_key")
    gone = judged(docs, **options).where(~F.col("kept")).select(F.col("key").alias(name)).distinct()
    return docs.join(gone, row_key(F.col(id_col), F.col(text_col)) == F.col(name), "left_anti")
