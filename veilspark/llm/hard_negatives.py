"""Hard negatives: rotated one-bit codes bound every score, and only what the bounds leave open is scored.

Components are integers. A vector is rotated (three rounds of fixed sign flips and a Hadamard transform) and coded by the signs
of its components; beside the code stands its alignment, the vector's inner product with the unit vector of the code. What the code
leaves is coded again, LEVELS times: v = a1 c1 + .. + aL cL + r, where r is orthogonal to cL and its length is stored.
An anchor is rotated too and cut into bit planes, so that its product with a code is a weighted sum of
popcounts, up to what cutting may lose, which is known. By Cauchy-Schwarz the rest is at most |r| times the length of
the anchor's part that is orthogonal to cL. So a score lies in an interval for certain, level by level in a narrower one.
A pair is dropped only where its interval cannot reach the best scores so far or lies outside the band asked for; the others' scores are
computed in integers. No probability decides: the result is the one that scoring all pairs gives.

Anchors come in batches of at most about ANCHORS vectors, the only thing that is broadcast; each batch meets the coded rows where they
are stored, in a stream: a task holds one batch of anchors, their best scores so far, BLOCK rows, and of the pairs of both
at most TILE at a time, which are scored before the next ones are looked at. A task returns its best for each
anchor; those are ranked again by Spark. Two passes: positives, then negatives within the positives' bands.

Rows with a null label, a null vector, or a null or non-finite component take no part. Shorter vectors count as filled up by
zeros. A null id is no anchor and comes last among ties; rows with the same id are rows of their own, told apart by row number.
A component beyond 2^53 after scaling, or a score beyond 64 bits, is an error. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import released, stored

LEVELS = 4
PLANES = 8
#: Anchors of a batch, and rows that a task compares at a time.
ANCHORS, BLOCK = 16_384, 2048
#: Pairs whose bounds a task holds at a time, components of either side that it copies to score them, and rows that it returns at a time.
TILE, HELD, TOLD = 1 << 18, 1 << 21, 100_000
ROUNDS, SEED = 3, 11
#: What rounding may add to a bound, as a part of the product of the lengths.
SLACK = 1e-7

CODED = "rid bigint, id bigint, label bigint, v binary, codes binary, facts binary"
FOUND = "anchor bigint, positive bigint, rid bigint, id bigint, score bigint"


def rotated(v: np.ndarray) -> np.ndarray:
    """(rows, size) with the same inner products; size is a power of two, 64 at least, and v is filled up by zeros."""
    size = max(64, 1 << max(0, v.shape[1] - 1).bit_length())
    x = np.zeros((len(v), size))
    x[:, : v.shape[1]] = v
    rng = np.random.Generator(np.random.PCG64(SEED))
    for _ in range(ROUNDS):
        x *= rng.integers(0, 2, size) * 2.0 - 1.0
        half = 1
        while half < size:
            y = x.reshape(len(x), -1, 2, half)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), size)
            half *= 2
        x /= math.sqrt(size)
    return x


def coded(v: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(rows, levels, words) code bits, and (rows, 2 * levels) alignments and lengths of what is left after each level."""
    rest = rotated(v)
    size = rest.shape[1]
    codes, facts = np.zeros((len(v), levels, size // 64), np.uint64), np.zeros((len(v), 2 * levels))
    for k in range(levels):
        up = rest >= 0
        codes[:, k] = np.packbits(up, axis=1).view(np.uint64)
        facts[:, k] = np.abs(rest).sum(1) / math.sqrt(size)
        rest = rest - facts[:, k : k + 1] * np.where(up, 1.0, -1.0) / math.sqrt(size)
        facts[:, levels + k] = np.sqrt((rest * rest).sum(1))
    return codes, facts


class Anchors:
    """A batch of anchors as bit planes: w = low + step * u + what is lost, u in whole numbers of PLANES bits."""

    def __init__(self, rid: np.ndarray, label: np.ndarray, v: np.ndarray):
        self.rid, self.label, self.v = rid, label, v
        w = rotated(v)
        self.length, self.size = np.sqrt((w * w).sum(1)), w.shape[1]
        self.low = w.min(1, initial=0.0)
        self.step = np.maximum((w.max(1, initial=0.0) - self.low) / (2**PLANES - 1), 1e-300)
        u = np.clip(np.rint((w - self.low[:, None]) / self.step[:, None]), 0, 2**PLANES - 1)
        self.lost = np.abs(w - self.low[:, None] - self.step[:, None] * u).sum(1) / math.sqrt(self.size)
        self.total = self.low * self.size + self.step * u.sum(1)
        u = u.astype(np.uint8)
        self.planes = np.stack([np.packbits((u >> p) & 1, axis=1).view(np.uint64) for p in range(PLANES)], 1)

    def along(self, a: np.ndarray | slice, codes: np.ndarray) -> np.ndarray:
        """About <w, c> for anchors a and codes (broadcast against each other): twice the sum over set bits less the sum over all."""
        planes, ones, weighted = self.planes[a], 0, 0.0
        for x in range(codes.shape[-1]):
            ones = ones + np.bitwise_count(codes[..., x]).astype(np.int32)
            for p in range(PLANES):
                weighted = weighted + np.bitwise_count(planes[..., p, x] & codes[..., x]) * float(1 << p)
        return (2 * (self.low[a] * ones + self.step[a] * weighted) - self.total[a]) / math.sqrt(self.size)

    def margin(self, a: np.ndarray | slice, along: np.ndarray, left: np.ndarray, whole: np.ndarray, before: np.ndarray | float) -> np.ndarray:
        """How far the score may be from the estimate. before: what cutting may have lost at all levels so far."""
        sure = np.maximum(np.abs(along) - self.lost[a], 0.0)
        across = np.sqrt(np.maximum(self.length[a] ** 2 - sure**2, 0.0))
        return before + left * across + SLACK * (1.0 + self.length[a] * whole)


def open_pairs(anchors: Anchors, codes: np.ndarray, facts: np.ndarray, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (anchor, row) that no interval closes, for a few anchors at a time: at most TILE pairs, or one anchor's. wanted(a, rows, low, high): which pairs may still count, for arrays that broadcast."""
    levels = codes.shape[1]
    whole = np.sqrt((facts[:, :levels] ** 2).sum(1) + facts[:, -1] ** 2)
    high = max(1, TILE // max(1, len(codes)))
    for at in range(0, len(anchors.rid), high):
        rows, a, some = np.arange(len(codes))[None, :], np.arange(at, min(at + high, len(anchors.rid)))[:, None], None
        estimate, lost = 0.0, 0.0
        for k in range(levels):
            along = anchors.along(a, codes[rows, k])
            estimate, lost = estimate + facts[rows, k] * along, lost + facts[rows, k] * anchors.lost[a]
            off = anchors.margin(a, along, facts[rows, levels + k], whole[rows], lost)
            some = np.broadcast_to(wanted(a, rows, estimate - off, estimate + off), np.broadcast_shapes(a.shape, rows.shape))
            where = np.nonzero(some)
            a, rows = np.broadcast_to(a, some.shape)[where], np.broadcast_to(rows, some.shape)[where]
            estimate, lost = estimate[where], lost[where]
            if not len(a):
                break
        if len(a):
            yield a, rows


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows, exactly; beyond 64 bits an error."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if most < 2.0**62:
        return np.einsum("ij,ij->i", x, y)
    return np.array([sum(int(p) * int(q) for p, q in zip(a, b, strict=True)) for a, b in zip(x, y, strict=True)], dtype=object).astype(np.int64)


def scored(pairs: Iterator[tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, r, scores) of pairs (a, r) of rows of x and y; at most HELD components of either are copied at a time."""
    most = max(1, HELD // x.shape[1])
    for a, r in pairs:
        for at in range(0, len(a), most):
            some = slice(at, at + most)
            yield a[some], r[some], scores(x[a[some]], y[r[some]])


class Best:
    """The first k rows of each group so far: by score, then by id (null last), then by row number."""

    def __init__(self, groups: int, k: int):
        self.k, self.sizes = k, np.zeros(groups, np.int64)
        self.held = np.zeros((4, groups, k), np.int64)
        self.least = np.full(groups, -np.inf)

    def add(self, group: np.ndarray, *row: np.ndarray) -> None:
        """row: score, no id, id, row number. Only the groups that are added to are ranked again."""
        some = row[0] >= self.least[group]
        if not some.any():
            return
        groups, within = np.unique(group[some], return_inverse=True)
        there = np.arange(self.k)[None, :] < self.sizes[groups][:, None]
        within = np.concatenate([np.nonzero(there)[0], within])
        score, no_id, ids, rid = (np.concatenate([held[groups][there], new[some]]) for held, new in zip(self.held, row, strict=True))
        order = np.lexsort((rid, ids, no_id, ~score, within))
        within = within[order]
        starts = np.searchsorted(within, np.arange(len(groups)))
        place = np.arange(len(order)) - starts[within]
        first = place < self.k
        for held, new in zip(self.held, (score, no_id, ids, rid), strict=True):
            held[groups[within[first]], place[first]] = new[order[first]]
        self.sizes[groups] = np.minimum(np.diff(np.r_[starts, len(order)]), self.k)
        full = groups[self.sizes[groups] == self.k]
        self.least[full] = self.held[0, full, self.k - 1]

    def rows(self) -> tuple[np.ndarray, ...]:
        """(group, score, no id, id, row number) of all that is held."""
        there = np.arange(self.k)[None, :] < self.sizes[:, None]
        return (np.nonzero(there)[0], *(held[there] for held in self.held))


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, levels: int) -> Iterator[tuple]:
    """(rid, id, no id, label, v, codes, facts) of BLOCK rows at a time; the first blocks are smaller, so that bounds soon have something to beat."""
    most = 64
    for b in batches:
        at = 0
        while at < b.num_rows:
            c = dict(zip(b.schema.names, b.slice(at, most).columns, strict=True))
            at, most = at + len(c["rid"]), min(2 * most, BLOCK)
            n, raw = len(c["rid"]), {k: b"".join(c[k].to_pylist()) for k in ("v", "codes", "facts")}
            no_id = c["id"].is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            yield (
                c["rid"].to_numpy(), c["id"].fill_null(0).to_numpy(), no_id, c["label"].to_numpy(), np.frombuffer(raw["v"], np.int64).reshape(n, dims),
                np.frombuffer(raw["codes"], np.uint64).reshape(n, levels, -1), np.frombuffer(raw["facts"], np.float64).reshape(n, -1),
            )


def _told(best: Best, anchors: np.ndarray, positives: np.ndarray) -> Iterator[pa.RecordBatch]:
    found = best.rows()
    for at in range(0, max(1, len(found[0])), TOLD):
        group, score, no_id, ids, rid = (c[at : at + TOLD] for c in found)
        yield pa.record_batch({"anchor": anchors[group], "positive": positives[group], "rid": rid, "id": pa.array(ids, mask=no_id.astype(bool)), "score": score})


def best_positives(rows: DataFrame, anchors, k: int, dims: int, levels: int) -> DataFrame:
    """FOUND: of each task's rows, the first k of the anchor's label, but for the anchor itself. anchors: (rid, label, v), broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Anchors(*anchors.value)
        best = Best(len(own.rid), k)
        for rid, ids, no_id, label, v, codes, facts in _blocks(batches, dims, levels):

            def wanted(a, r, low, high, rid=rid, label=label):
                return (label[r] == own.label[a]) & (rid[r] != own.rid[a]) & (high >= best.least[a])

            for a, r, score in scored(open_pairs(own, codes, facts, wanted), own.v, v):
                best.add(a, score, no_id[r], ids[r], rid[r])
        yield from _told(best, own.rid, np.full(len(own.rid), -1))

    return rows.mapInArrow(released(run), FOUND)


def best_negatives(rows: DataFrame, anchors, k: int, dims: int, levels: int, percent: tuple[int, int]) -> DataFrame:
    """FOUND: of each task's rows, the first k of another label within each positive's band. anchors: (rid, label, v, ranks, positives' rids and scores)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid_, label_, v_, positive, known, counts = anchors.value
        own, most = Anchors(rid_, label_, v_), known.shape[1]
        # The band in whole numbers: percent[0] * p <= 100 * n <= percent[1] * p.
        wide = known.astype(object)
        floor, top = (-(-percent[0] * wide // 100)).astype(np.int64), (percent[1] * wide // 100).astype(np.int64)
        there = np.arange(most)[None, :] < counts[:, None]
        best = Best(len(rid_) * most, k)
        for rid, ids, no_id, label, v, codes, facts in _blocks(batches, dims, levels):

            def wanted(a, r, low, high, label=label):
                some = False
                for p in range(most):
                    least = np.maximum(floor[a, p], best.least[a * most + p])
                    some = some | (there[a, p] & (high >= least) & (low <= top[a, p]))
                return some & (label[r] != own.label[a])

            for a, r, score in scored(open_pairs(own, codes, facts, wanted), own.v, v):
                for p in range(most):
                    inside = there[a, p] & (score >= floor[a, p]) & (score <= top[a, p])
                    x, y = a[inside], r[inside]
                    best.add(x * most + p, score[inside], no_id[y], ids[y], rid[y])
        yield from _told(best, np.repeat(rid_, most), positive.ravel())

    return rows.mapInArrow(released(run), FOUND)


def described(table: DataFrame, id_col: str, vector_col: str, label_col: Column, scale: int, levels: int) -> tuple[DataFrame, int]:
    """The CODED rows that take part, stored, and the length of their vectors."""
    v = F.col(vector_col).cast("array<double>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), label_col.cast("bigint").alias("label"), v.alias("v")).where("label IS NOT NULL AND v IS NOT NULL").where(fit.alias("fit"))
    # Row numbers are given once, before the rows are read again.
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "id", "label", "v"))
    dims = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, BLOCK):
                b = big.slice(at, BLOCK)
                given = b.column(3)
                sizes = given.value_lengths().to_numpy()
                x = np.zeros((b.num_rows, dims))
                x[np.arange(dims)[None, :] < sizes[:, None]] = np.floor(scale * given.flatten().to_numpy())
                if (np.abs(x) > 2.0**53).any():
                    raise OverflowError("a component beyond 2^53")
                codes, facts = coded(x, levels)
                v = x.astype(np.int64)
                held = {"v": [r.tobytes() for r in v], "codes": [r.tobytes() for r in codes], "facts": [r.tobytes() for r in facts]}
                yield pa.record_batch({"rid": b.column(0), "id": b.column(1), "label": b.column(2), **{k: pa.array(x, pa.binary()) for k, x in held.items()}})

    return stored(rows.mapInArrow(released(run), CODED)), dims


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each group with their rank: a task's best are few, and Spark limits each side of the shuffle to k."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("rid")]
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def mined(
    table: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90), scale: int = 256, levels: int = LEVELS, batch: int = ANCHORS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors and positives that have negatives.

    anchor: a condition on the column id. percent: the band of the negatives' scores, in hundredths of the positive's score.
    """
    spark = table.sparkSession
    rows, dims = described(table, id_col, vector_col, F.col(label) if isinstance(label, str) else label, scale, levels)
    chosen = rows.where(anchor).select("rid", "label", "v")
    parts, out = -(-chosen.count() // batch), []
    for part in range(parts):
        held = sorted(chosen.where(F.pmod(F.xxhash64("rid"), F.lit(parts)) == part).collect(), key=lambda r: r.rid)
        if not held:
            continue
        rid, own = np.array([r.rid for r in held], np.int64), np.array([r.label for r in held], np.int64)
        v = np.frombuffer(b"".join(bytes(r.v) for r in held), np.int64).reshape(len(held), dims)
        sent = spark.sparkContext.broadcast((rid, own, v))
        near = stored(_first(best_positives(rows, sent, positives, dims, levels), ["anchor"], positives))
        sent.unpersist()
        # At most `positives` rows for each anchor of the batch.
        place, known = {r: i for i, r in enumerate(rid.tolist())}, np.zeros((len(rid), positives), np.int64)
        which, counts = np.full((len(rid), positives), -1, np.int64), np.zeros(len(rid), np.int64)
        for r in near.select("anchor", "rank", "rid", "score").collect():
            i = place[r.anchor]
            which[i, r.rank - 1], known[i, r.rank - 1], counts[i] = r.rid, r.score, max(counts[i], r.rank)
        sent = spark.sparkContext.broadcast((rid, own, v, which, known, counts))
        far = stored(_first(best_negatives(rows, sent, negatives, dims, levels, percent), ["anchor", "positive"], negatives))
        sent.unpersist()
        named = rows.where(anchor).select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
        met = near.select("anchor", F.col("rid").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        done = far.select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(met, ["anchor", "positive"]).join(named, "anchor")
        out.append(done.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
    if not out:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    done = out[0]
    for more in out[1:]:
        done = done.unionByName(more)
    return done
