"""A character n-gram model with modified Kneser-Ney smoothing, counted and estimated by Spark.

Texts are lowered, white space becomes one space and digits become 0. Each character is hashed to 12
bits, so that the hash of an n-gram of up to five characters is a 60-bit integer, its context is that
integer shifted and its suffix that integer masked. Tasks count the five-grams of their texts; Spark
sums them by (language, hash). Lower orders are continuation counts of the next higher order. All
joins and sums of the estimate are over n-grams, partitioned by hash; counts cover every text whole.

To score, the table is sorted by (language, kind, order, hash) into hash arrays that tasks search by
bisection. The table's rows are counted first: up to ENTRY_BOUND (12 bytes each) it is broadcast;
beyond it, texts' n-grams are joined to it by hash. Both give the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, small_slices, stored, text_of, trim

ORDER, BITS = 5, 12
ENTRY_BOUND = 6_000_000
BEGIN, END, CONTROL = "\x02", "\x03", 1
#: Distinct n-grams that a task holds before it sends them on.
HELD = 2_000_000


def mask(n: int) -> int:
    return (1 << BITS * n) - 1


def symbols(texts: list[str]) -> np.ndarray:
    """The hashed characters of the texts, with marks around each."""
    clean = (" ".join(t.lower().split()).replace(BEGIN, "\x01").replace(END, "\x01") for t in texts)
    points = np.frombuffer("".join(BEGIN * (ORDER - 1) + t + END for t in clean).encode("utf-32-le"), np.uint32)
    out = np.where(points < 2048, points, 2048 + (points * np.uint32(2654435761) >> np.uint32(21))).astype(np.int64)
    out[(out >= 48) & (out <= 57)] = 48
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The five-grams' hashes, text after text, and how many each text has."""
    sym = symbols(texts)
    code = sym[: 1 - ORDER]
    for j in range(1, ORDER):
        code = (code << BITS) | sym[j : len(sym) - ORDER + 1 + j]
    last = sym[ORDER - 1 :]
    ends = np.cumsum((last != ord(BEGIN)).astype(np.int64))[last == ord(END)]
    return code[last != ord(BEGIN)], np.diff(ends, prepend=0)


def count(docs: DataFrame, lang: Column, text: Column) -> DataFrame:
    """(lang, code, n): how often each language has each five-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return code, np.bincount(at, np.concatenate([n for _, n in parts]), len(code)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                code, n = summed(parts)
                yield pa.record_batch({"lang": pa.array([lang]).take(pa.array(np.zeros(len(code), np.int64))), "code": code, "n": n})
            held.clear()

        for b in batches:
            for part in small_slices(b, 1):
                by_lang: dict[str, list[str]] = {}
                for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by_lang.setdefault(lang, []).append(t)
                for lang, texts in by_lang.items():
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(grams(texts)[0], return_counts=True))
                    if len(parts) >= 8:
                        held[lang] = [summed(parts)]
                if sum(len(c) for parts in held.values() for c, _ in parts) > HELD:
                    yield from out()
        yield from out()

    rows = docs.select(F.coalesce(lang.cast("string"), F.lit("")), text_of(text))
    return rows.mapInArrow(released(run), "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _discounted(level: DataFrame) -> DataFrame:
    """level (lang, code, n) with the discount d that its counts of counts give."""
    of = {k: F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)}
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(k: int) -> Column:
        usual = k - (k + 1) * F.try_divide(y * F.col(f"n{k + 1}"), F.col(f"n{k}"))
        return F.when((usual > 0) & (usual <= k), usual).otherwise(k * 0.5)

    rates = stored(level.groupBy("lang").agg(*of.values()).select("lang", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)]))
    return level.join(rates, "lang").select("lang", "code", "n", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))


def estimate(counts: DataFrame) -> DataFrame:
    """(lang, kind, size, code, value): kind 0, log probabilities of n-grams; kind 1, log weights of contexts for what is below.

    Each order's counts, discounts and contexts are written: a plan that held the chain of all orders below it several times costs the driver memory.
    """
    levels = {ORDER: stored(counts)}
    for size in range(ORDER - 1, 0, -1):
        levels[size] = stored(levels[size + 1].groupBy("lang", F.col("code").bitwiseAND(mask(size)).alias("code")).agg(F.count(F.lit(1)).alias("n")))
    model, below = None, None
    for size in range(1, ORDER + 1):
        level = _discounted(levels[size]).withColumn("context", F.shiftright("code", BITS))
        contexts = stored(level.groupBy("lang", "context").agg(F.sum("n").alias("all"), (F.sum("d") / F.sum("n")).alias("weight")))
        found = level.join(contexts, ["lang", "context"])
        if below is None:
            found = found.withColumn("lower", F.lit(2.0**-BITS))
        else:
            found = found.withColumn("code_below", F.col("code").bitwiseAND(mask(size - 1))).join(below, ["lang", "code_below"])
        found = found.select("lang", "code", ((F.col("n") - F.col("d")) / F.col("all") + F.col("weight") * F.col("lower")).alias("p"))
        found = stored(found)
        parts = found.select("lang", F.lit(0).alias("kind"), F.lit(size).alias("size"), "code", F.log("p").cast("float").alias("value"))
        parts = parts.unionByName(contexts.select("lang", F.lit(1).alias("kind"), F.lit(size).alias("size"), F.col("context").alias("code"), F.log("weight").cast("float").alias("value")))
        model = parts if model is None else model.unionByName(parts)
        below = found.select("lang", F.col("code").alias("code_below"), F.col("p").alias("lower"))
    return stored(model)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as runs of one (lang, kind, size), 12 bytes an entry."""
    for b in batches:
        lang, kind, size = b.column(0).dictionary_encode(), b.column(1).to_numpy(), b.column(2).to_numpy()
        key = (lang.indices.to_numpy().astype(np.int64) * 2 + kind) * (ORDER + 1) + size
        code, value = b.column(3).to_numpy(), b.column(4).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for x, y in zip(cuts, cuts[1:]):
            if x < y:
                one = {"lang": [b.column(0)[x].as_py()], "kind": pa.array([kind[x]], pa.int32()), "size": pa.array([size[x]], pa.int32())}
                yield pa.record_batch(one | {"code": pa.array([code[x:y].tobytes()], pa.binary()), "value": pa.array([value[x:y].tobytes()], pa.binary())})


def hash_arrays(model: DataFrame) -> dict:
    """The model as sorted hash arrays by language, kind and order; only for a model that has been counted. Tasks pack it first."""
    packed = model.select("lang", "kind", "size", "code", "value").orderBy("lang", "kind", "size", "code").mapInArrow(released(_packed), "lang string, kind int, size int, code binary, value binary")
    runs: dict = {}
    for b in packed.toArrow().to_batches():
        for lang, kind, size, code, value in zip(*(c.to_pylist() for c in b.columns)):
            both = runs.setdefault((lang, kind, size), ([], []))
            both[0].append(code)
            both[1].append(value)
    return {k: (np.frombuffer(b"".join(c), np.int64), np.frombuffer(b"".join(v), np.float32)) for k, (c, v) in runs.items()}


def _look_up(arrays: dict, key: tuple, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    have, value = arrays.get(key, (np.zeros(0, np.int64), np.zeros(0, np.float32)))
    if not len(have):
        return np.zeros(len(code), bool), np.zeros(len(code))
    at = np.minimum(np.searchsorted(have, code), len(have) - 1)
    return have[at] == code, value[at].astype(np.float64)


def log_probabilities(arrays: dict, lang: str, codes: np.ndarray) -> np.ndarray:
    """For five-gram hashes; unseen ones fall back order by order, to an even chance at the end."""
    out, rest, extra = np.zeros(len(codes)), np.arange(len(codes)), np.zeros(len(codes))
    for size in range(ORDER, 0, -1):
        code = codes[rest] & mask(size)
        seen, value = _look_up(arrays, (lang, 0, size), code)
        out[rest[seen]] = value[seen] + extra[rest[seen]]
        rest, code = rest[~seen], code[~seen]
        seen, value = _look_up(arrays, (lang, 1, size), code >> BITS)
        extra[rest[seen]] += value[seen]
    out[rest] = extra[rest] - BITS * np.log(2)
    return out


def _score_by_broadcast(rows: DataFrame, model: DataFrame) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(hash_arrays(model))
    trim()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = shared.value
        for b in batches:
            for part in small_slices(b, 2):
                langs, texts = part.column(1).to_pylist(), part.column(2).to_pylist()
                loss, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                for lang in set(langs):
                    own = [i for i, x in enumerate(langs) if x == lang]
                    code, sizes = grams([texts[i] for i in own])
                    some, at = np.unique(code, return_inverse=True)
                    loss[own] = -np.add.reduceat(log_probabilities(arrays, lang, some)[at], np.cumsum(sizes) - sizes)
                    n[own] = sizes
                yield pa.record_batch({"key": part.column(0), "loss": loss, "n": n})

    return rows.mapInArrow(released(run), "key string, loss double, n bigint")


def _score_by_join(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Each text's distinct n-grams meet the model by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in small_slices(b, 2):
                for key, lang, t in zip(*(c.to_pylist() for c in part.columns)):
                    code, n = np.unique(grams([t])[0], return_counts=True)
                    yield pa.record_batch({"key": [key] * len(code), "lang": [lang] * len(code), "code": code, "n": n})

    parts = stored(rows.mapInArrow(released(run), "key string, lang string, code bigint, n bigint"))
    asked = parts.select("lang", "code").distinct()
    found = asked.withColumn("p", F.lit(None).cast("double")).withColumn("extra", F.lit(0.0))
    for size in range(ORDER, 0, -1):
        p, w = (model.where((F.col("kind") == k) & (F.col("size") == size)).select("lang", F.col("code").alias("at"), F.col("value").cast("double").alias("v")) for k in (0, 1))
        found = found.withColumn("at", F.col("code").bitwiseAND(mask(size))).join(p, ["lang", "at"], "left")
        found = found.withColumn("p", F.coalesce("p", F.col("v") + F.col("extra"))).withColumn("at", F.shiftright("at", BITS)).drop("v")
        found = found.join(w, ["lang", "at"], "left").withColumn("extra", F.col("extra") + F.coalesce("v", F.lit(0.0))).drop("v", "at")
    found = found.select("lang", "code", F.coalesce("p", F.col("extra") - BITS * float(np.log(2))).alias("p"))
    return parts.join(found, ["lang", "code"]).groupBy("key").agg((-F.sum(F.col("n") * F.col("p"))).alias("loss"), F.sum("n").alias("n"))


def score(rows: DataFrame, model: DataFrame, bound: int = ENTRY_BOUND) -> DataFrame:
    """(key, loss, n) of rows (key, lang, text): the negative log-likelihood and number of predicted characters."""
    rows = rows.select(F.col("key").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text_of("text").alias("text"))
    return (_score_by_broadcast if model.count() <= bound else _score_by_join)(rows, model)
