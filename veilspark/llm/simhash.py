"""Near duplicates: SimHash fingerprints, linked by pigeonring filtering.

A document's fingerprint has 64 bits; a bit is set where it is set in over half of the XXH64 hashes of the
document's word shingles (repeats included). ASCII letters are lowered and ASCII white space parts words.

Two fingerprints link at `most` or fewer differing bits. Their bits lie on a ring of SEGMENTS segments. If the
segments' differences sum to `most`, then some segment starts a chain whose first l segments differ in at most
l * most / SEGMENTS bits together, for every l: the running sums around a ring cannot begin above their
average everywhere. So a pair is a candidate only where a chain keeps all of its budgets: nothing in
its first segments, then one bit, and so on. The segments up to the second step are the index: the first of them
whole, and one of the next ones left out. What meets in a key is held against the later budgets and only then
against all 64 bits. No pair is lost, and no pair that does not link passes.

Equal fingerprints are one class, and only classes are joined. No key's members are all paired: turn by
turn each member meets one leader of its key, outside the key's largest component, as long as leaders link many; what then
still lies in several components of one key is compared across components only. Links are between components, so each turn's are fewer.

Long texts are hashed in parts of PART_BYTES, whole. Nulls: null and empty texts and texts without words have fingerprint
zero, and are linked like any other; null ids are passed on, and component_id is the least id that is not null.
Repeated rows are rows of one class. Empty tables give empty results; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, released, small_slices, stored, text_of
from .near_dedup import components, open_keys

SEGMENTS = 10
SEED = 42
#: A long text's words are split off in parts of so many bytes.
PART_BYTES = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: For each byte value its bits, the highest first.
BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def word_lists(text: bytes, most: int = PART_BYTES) -> Iterator[list[bytes]]:
    """The text's lowered words, part by part."""
    at = 0
    while at < len(text):
        end = at + most
        if end < len(text):
            gap = SPACE.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def hashes(text: bytes, size: int) -> Iterator[bytes]:
    """The hashes of the text's shingles, part by part, eight bytes each; a text of fewer words is one shingle."""
    digest, carried, any_yet = partial(xxhash.xxh64_digest, seed=SEED), [], False
    for words in word_lists(text):
        words = carried + words
        if len(words) >= size:
            any_yet = True
            yield b"".join(map(digest, map(b" ".join, zip(*(islice(words, k, None) for k in range(size)), strict=False))))
        carried = words[-(size - 1) :] if size > 1 else []
        if size == 1:
            any_yet = any_yet or bool(words)
    if not any_yet and carried:
        yield digest(b" ".join(carried))


def fingerprint(text: bytes, size: int = 3) -> int:
    """64 bits as a signed number."""
    counts, n = np.zeros(64, np.int64), 0
    for part in hashes(text, size):
        each = np.frombuffer(part, np.uint8).reshape(-1, 8).astype(np.int64) + 256 * np.arange(8)
        counts += (np.bincount(each.ravel(), minlength=2048).reshape(8, 256) @ BITS_OF).ravel()
        n += len(part) // 8
    return int(np.packbits(2 * counts > n).view(">i8")[0]) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp) for each row."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in small_slices(b, 1):
                found = [fingerprint(t, size) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.record_batch({"id": part.column(0), "fp": pa.array(found, pa.int64())})

    return rows.mapInArrow(released(run), f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def chain(start: int, length: int) -> int:
    """The bits of `length` segments from segment `start` on, around the ring, as a signed mask."""
    edges, mask = [64 * k // SEGMENTS for k in range(SEGMENTS + 1)], 0
    for k in range(start, start + length):
        low, high = edges[k % SEGMENTS], edges[k % SEGMENTS + 1]
        mask |= (1 << high) - (1 << low)
    return mask - (1 << 64) if mask >> 63 else mask


def steps(most: int) -> list[int]:
    """For each budget b, 0 to most, the longest chain that may differ in no more than b bits."""
    return [max(n for n in range(SEGMENTS + 1) if n * most // SEGMENTS <= b) for b in range(most + 1)]


def index_masks(most: int) -> list[tuple[int, int]]:
    """(start, mask): the bits of each key. All of the chain that may differ in one bit, but for one segment after its first step."""
    if not 1 <= most < SEGMENTS:
        raise ValueError(f"most must be from 1 to {SEGMENTS - 1}")
    none, one = steps(most)[:2]
    return [(i, chain(i, one) & ~chain(j, 1)) for i in range(SEGMENTS) for j in range(i + none, i + one)]


def keyed(classes: DataFrame, most: int) -> DataFrame:
    """(rid, t, key): the keys of each fingerprint rid. A key is a hash of the index's number t and its bits."""
    keys = [F.xxhash64(F.lit(t), F.col("rid").bitwiseAND(F.lit(mask).cast("bigint"))) for t, (_, mask) in enumerate(index_masks(most))]
    return classes.select("rid", F.posexplode(F.array(*keys)).alias("t", "key"))


def _viable(x: str, y: str, most: int) -> Column:
    """Whether the pair keeps the chain's budgets from its key's start on, and then the full distance."""
    apart, index = F.col(f"{x}.rid").bitwiseXOR(F.col(f"{y}.rid")), index_masks(most)
    kept = F.lit(True)
    for budget, length in list(enumerate(steps(most)))[:-1]:
        masks = F.array(*[F.lit(chain(i, length)).cast("bigint") for i, _ in index])
        kept = kept & (F.bit_count(apart.bitwiseAND(F.get(masks, F.col(f"{x}.t")))) <= budget)
    return kept & (F.bit_count(apart) <= most)


def _met_leaders(now: DataFrame, most: int) -> DataFrame:
    """(a, b): components that a member and its keys' leaders link. A key's leader lies outside the key's largest component.

    Of a member's leaders (one a key) the first is linked with the member and with the others: what is joined stays the same, with fewer links.
    """
    held = now.where(F.coalesce(F.col("comp") != F.col("main"), F.lit(True)))
    leaders = held.groupBy("key").agg(F.max_by(F.struct("rid", "comp"), F.struct("score", "rid")).alias("l")).select("key", "l.*")
    met = now.alias("x").join(leaders.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & _viable("x", "y", most))
    held = met.groupBy(F.col("x.rid").alias("rid"), F.col("x.comp").alias("a")).agg(F.sort_array(F.collect_set("y.comp")).alias("s"))
    told = F.transform(F.concat(F.array("a"), F.slice("s", 2, len(index_masks(most)))), lambda x: F.struct(x.alias("a"), F.get("s", F.lit(0)).alias("b")))
    return checkpointed(held.select(F.explode(told).alias("l")).select("l.*").distinct())


def _merged(roots: DataFrame | None, more: DataFrame) -> DataFrame:
    """(node, root) after the components of roots have been joined to those of more, whose nodes are components."""
    if roots is None:
        return more
    fresh = more.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    tops = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return checkpointed(roots.unionByName(fresh).join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


#: Turns go on while they link one in so many of the members that are left; what they leave is compared across components.
WORTH = 20


def linked(classes: DataFrame, most: int = 3) -> DataFrame | None:
    """(node, root) for every fingerprint that links with another; the root is its component's least. classes: distinct (rid); None: no links."""
    keys = keyed(classes, most)
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    # Written, so that joins are between plain shuffles, of which Spark splits a hot key's. Never broadcast: Spark takes the exploded keys for as few as the classes.
    held = stored(keys.join(several.hint("merge"), "key"))
    shared = stored(held.drop("members").join(held.groupBy("rid").agg(F.sum("members").alias("score")), "rid"))
    now, roots, worth = shared.withColumn("comp", F.col("rid")).withColumn("main", F.lit(None).cast("bigint")), None, True
    while worth:
        found = _met_leaders(now, most)
        worth = WORTH * found.count() >= now.select("rid").distinct().count() > 0
        if not found.isEmpty():
            roots = _merged(roots, components(found))
            now = stored(open_keys(now.drop("comp"), roots))
    # Two that agree in all of a chain share all of its keys: the first is enough.
    x, y, index = now.where("comp <> main").alias("x"), now.alias("y"), index_masks(most)
    wild = F.array(*[F.lit(chain(i, steps(most)[1]) & ~mask).cast("bigint") for i, mask in index])
    firsts = [t for t, (i, _) in enumerate(index) if t == 0 or index[t - 1][0] != i]
    once = F.col("x.t").isin(firsts) | (F.col("x.rid").bitwiseXOR(F.col("y.rid")).bitwiseAND(F.get(wild, F.col("x.t"))) != 0)
    across = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.rid") < F.col("y.rid")))
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & across & once & _viable("x", "y", most))
    more = checkpointed(rest.select(F.greatest("x.comp", "y.comp").alias("a"), F.least("x.comp", "y.comp").alias("b")).distinct())
    return roots if more.isEmpty() else _merged(roots, components(more))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, most: int = 3) -> DataFrame:
    """A row for each document: id, fingerprint (16 hexadecimal digits), component_id (the least id reachable)."""
    told = stored(fingerprints(docs, id_col, text_col, size))
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"))
    classes = stored(told.groupBy(F.col("fp").alias("rid")).agg(F.min(order).alias("first")))
    roots = linked(classes.select("rid"), most)
    if roots is not None:
        placed = stored(classes.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid")))
        firsts = placed.groupBy("root").agg(F.min("first").alias("first"))
        classes = stored(placed.drop("first").join(firsts, "root").select("rid", "first"))
    done = told.join(classes.hint("merge"), F.col("fp") == F.col("rid"))  # neither is of a fixed size
    return done.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))
