"""Removal of repeated passages: overlapping windows of three lines, found by hash.

Each run of three consecutive lines is one window, named by two 64-bit hashes with different seeds.
Of all places of a window, the first by (id, position) stays; the lines that any later place covers
go. Covered positions are merged to intervals in each document, and the lines between them stay.
A window of blank lines only is not a passage. Texts of fewer than three lines stay as they are.

dedup_passages() does the same with clauses for lines, so that a passage that is pasted into the
middle of a line is found too: texts are cut after line breaks and after the marks . ! ? ; : , and a
space, and runs of repeated clauses go from the later places. A run of fewer than LEAST_WORDS words
stays: three short clauses meet by chance. The parts of a passage before its first cut and after its
last one stay, as they are one clause with the text around them.

The windows are grouped with map-side combining, so that a passage in a third of all documents is a
few rows to each reducer; repeated windows then meet their places in a join that Spark splits where
one window is very frequent. The texts themselves are shuffled once, by document.

Nulls: a null text counts as empty; null ids sort last. Rows with the same id and text are the same
document, and all are treated alike. Extra columns pass through. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored, text_of

WINDOW = 3
#: Words of a run of repeated clauses, at least.
LEAST_WORDS = 20
#: The places between clauses; each clause keeps what ends it.
CLAUSE_END = r"(?<=[.!?;:,][ \t\r\n])|(?<=\n)"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(lines: Column) -> Column:
    def window(i: Column) -> Column:
        at = [F.get(lines, i + k) for k in range(WINDOW)]
        return F.struct(
            i.alias("pos"),
            F.xxhash64(*at).alias("w1"),
            F.xxhash64(F.lit(1), *at).alias("w2"),
            F.concat(*at).rlike("[^\\x20\\x09-\\x0D]").alias("said"),
        )

    found = F.transform(F.sequence(F.lit(0), F.size(lines) - WINDOW), window)
    return F.when(F.size(lines) >= WINDOW, F.filter(found, lambda x: x["said"]))


def _runs(starts: Column) -> Column:
    """The windows that begin at starts (sorted), merged: from a to before b."""
    opens = F.filter(starts, lambda x, i: (i == 0) | (x - F.get(starts, i - 1) > WINDOW))
    shuts = F.filter(starts, lambda x, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) - x > WINDOW))
    return F.zip_with(opens, shuts, lambda a, b: F.struct(a.alias("a"), (b + WINDOW).alias("b")))


def _outside(lines: Column, runs: Column) -> Column:
    """The lines outside all runs."""
    gap_from = F.concat(F.array(F.lit(0)), F.transform(runs, lambda x: x["b"]))
    gap_to = F.concat(F.transform(runs, lambda x: x["a"]), F.array(F.size(lines)))
    return F.flatten(F.zip_with(gap_from, gap_to, lambda a, b: F.slice(lines, a + 1, b - a)))


#: Repeated hashes that are broadcast to sift windows; more are joined by shuffle.
SIFT_BOUND = 1_000_000


def _sifted(places: DataFrame) -> DataFrame:
    """The places whose first hash occurs twice or more: counting one hash moves far less than all places do."""
    twice = stored(places.groupBy("w1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1"))
    few = twice.count() <= SIFT_BOUND
    return stored(places.join(F.broadcast(twice) if few else twice, "w1", "left_semi"))


def _later_starts(rows: DataFrame, sift: bool = False) -> DataFrame:
    """(_id, _key, _starts): where later places of repeated windows begin, for rows (id, key, lines). sift: most windows occur once."""
    places = rows.select("id", "key", F.explode(_windows(F.col("lines"))).alias("w")).select("w.w1", "w.w2", F.struct(F.col("id").isNull().alias("last"), "id", "key", "w.pos").alias("place"))
    if sift:
        places = _sifted(places)
    # Written, so that the join below is between plain shuffles, of which Spark splits a hot window's.
    repeated = stored(places.groupBy("w1", "w2").agg(F.min("place").alias("first"), F.max("place").alias("other")).where("first <> other").drop("other"))
    later = places.join(repeated, ["w1", "w2"]).where("place <> first").select(F.col("place.id").alias("_id"), F.col("place.key").alias("_key"), F.col("place.pos").alias("pos"))
    return later.groupBy("_id", "_key").agg(F.sort_array(F.collect_set("pos")).alias("_starts"))


def _with_starts(docs: DataFrame, starts: DataFrame, key: Column, id_col: str, held: str) -> DataFrame:
    """(held, _starts): each row of docs as one column, with its starts or null."""
    rows = docs.select(F.struct(*docs.columns).alias(held), F.col(id_col).alias("_a"), key.alias("_b"))
    return rows.join(starts, F.col("_a").eqNullSafe(F.col("_id")) & (F.col("_b") == F.col("_key")), "left")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with shortened texts, and the columns n_lines and n_removed (with _ before a name that is taken)."""
    n_lines, n_removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    key = F.xxhash64(text_of(text_col))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), _lines(text_of(text_col)).alias("lines"))
    held = free_name(docs, "held_row")
    joined = _with_starts(docs, _later_starts(rows), key, id_col, held)
    text = F.col(held)[text_col]
    done = joined.select(held, "_starts", _lines(F.coalesce(text, F.lit(""))).alias("_lines"))
    kept = _outside(F.col("_lines"), _runs(F.col("_starts")))
    done = done.select(held, "_starts", F.when(F.col("_starts").isNotNull(), kept).alias("_kept"), F.size("_lines").alias("_n"))
    out = {c: F.col(held)[c] for c in docs.columns} | {text_col: F.when(F.col("_starts").isNull(), text).otherwise(F.array_join("_kept", "\n"))}
    gone = F.when(F.col("_starts").isNull(), 0).otherwise(F.col("_n") - F.size("_kept"))
    return done.select(*[c.alias(n) for n, c in out.items()], F.col("_n").cast("long").alias(n_lines), gone.cast("long").alias(n_removed))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """docs with shortened texts, and the column n_cut, the characters removed (with _ before a name that is taken)."""
    n_cut = free_name(docs, "n_cut")
    key = F.xxhash64(text_of(text_col))
    bare = F.transform(F.split(text_of(text_col), CLAUSE_END, -1), lambda x: F.btrim(x, F.lit(" \t\r\n")))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), bare.alias("lines"))
    held = free_name(docs, "held_row")
    joined = _with_starts(docs, _later_starts(rows, sift=True), key, id_col, held)
    text = F.col(held)[text_col]
    cut = joined.select(held, F.when(F.col("_starts").isNotNull(), F.split(text, CLAUSE_END, -1)).alias("_units"), _runs(F.col("_starts")).alias("_runs"))
    said = F.filter("_runs", lambda x: F.regexp_count(F.array_join(F.slice("_units", x["a"] + 1, x["b"] - x["a"]), ""), F.lit(r"\S+")) >= least)
    cut = cut.select(held, "_units", said.alias("_runs"))
    done = cut.select(held, F.when(F.size("_runs") > 0, F.array_join(_outside(F.col("_units"), F.col("_runs")), "")).otherwise(text).alias("_kept"))
    out = {c: F.col(held)[c] for c in docs.columns} | {text_col: F.col("_kept")}
    return done.select(*[c.alias(n) for n, c in out.items()], F.coalesce(F.length(text) - F.length("_kept"), F.lit(0)).cast("long").alias(n_cut))
