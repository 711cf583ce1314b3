"""Near duplicates: MinHash signatures and a multi-index Hamming join.

A document's set is its distinct shingles of `size` words; ASCII letters are lowered and ASCII white
space parts words. Its signature is CHUNKS x PER_CHUNK minima of B_BITS bits each, cut into chunks by
pigeonhole: if two signatures differ in at most 2 * CHUNKS - 1 places, some chunk differs in at most
one. So each chunk is indexed once for each place that may be wrong, by its other values: no pair
within that distance is missed. (A pair of similarity 0.8 shares no key with probability 1e-7.)

Documents with equal sets (128-bit digest of the full set) are one class, and only classes are joined.
No key's members are all paired. In a few turns each member meets the most alike leader of its keys: first the
member that shares most keys with others (in a group of copies, the one that all were made from). The links that
the full sets confirm are contracted to components. Then, for keys whose members still lie in several components,
the members outside the key's largest component meet the others; a pair inside one component can add nothing.

Three tests inside the join drop pairs: the sizes of the sets; the distance of the signatures (a pair of
similarity 0.8 differs in more than DISTANCE_MOST places with probability 2e-9); and parity maps. A
parity map has BITS bits, each telling whether an odd number of the set's hashes fall on it. Two maps differ in at
most as many bits as the sets have elements that only one holds, so that test loses no pair whatever. What is
left is confirmed on full sets of shingles from the texts. Components come from alternating large-star and
small-star joins.

Very long texts are hashed whole, one at a time; their sets are larger than a parity map, and rely on the signatures.
Nulls: null and empty texts have empty sets, and are linked with nothing; null ids are passed on, and
component_id is the least id that is not null. Of rows with one component's least id, one is kept.
Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, released, small_slices, stored, text_of

CHUNKS, PER_CHUNK, B_BITS = 12, 5, 14
PLACES = CHUNKS * PER_CHUNK
DISTANCE_MOST = 32
#: Bits of a parity map, kept as columns of 64.
BITS = 1024
#: A signature is kept as columns of so many places each.
PLACES_HELD = 4
SIGNED, MAPPED = [f"s{i}" for i in range(PLACES // PLACES_HELD)], [f"m{i}" for i in range(BITS // 64)]
#: Rows of (id, text hash) that are broadcast to fetch candidates' texts; more are joined by shuffle.
FETCH_BOUND = 200_000
#: Turns in which members meet their keys' leaders before the rest is compared.
STAR_TURNS = 2
#: Links for which components() has a task.
PART_LINKS = 500_000
#: Distinct words whose hashes a task keeps.
WORDS_HELD = 300_000

_RNG = np.random.Generator(np.random.PCG64(20))
FLIPS = _RNG.integers(0, 2**64, PLACES, np.uint64)
FACTORS = _RNG.integers(0, 2**64, PLACES, np.uint64) | np.uint64(1)
POWERS = np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, 65, dtype=np.uint64)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingles(text: bytes, size: int) -> set[bytes]:
    words = words_of(text)
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes of a document's shingles, sorted; words: its words' hashes."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < size:
        return _mixed(np.array([(words * POWERS[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    total = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        total += words[j : n - size + 1 + j] * POWERS[j]
    return np.unique(_mixed(total))


def signatures(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(documents, PLACES) minima of B_BITS bits."""
    out = np.zeros((len(starts), PLACES), np.int64)
    for f in range(PLACES):
        low = np.minimum.reduceat((sets ^ FLIPS[f]) * FACTORS[f], starts)
        out[:, f] = _mixed(low) >> np.uint64(64 - B_BITS)
    return out


def index_keys(signature: np.ndarray) -> np.ndarray:
    """(documents, PLACES) keys: for each chunk and each place that may be wrong, the chunk's other values."""
    out = np.zeros(signature.shape, np.int64)
    for c in range(CHUNKS):
        for wrong in range(PER_CHUNK):
            key = np.full(len(signature), c * PER_CHUNK + wrong, np.int64)
            for j in range(PER_CHUNK):
                if j != wrong:
                    key = (key << B_BITS) | signature[:, c * PER_CHUNK + j]
            out[:, c * PER_CHUNK + wrong] = key
    return out


def packed(signature: np.ndarray) -> np.ndarray:
    """(documents, len(SIGNED)) numbers, PLACES_HELD places in each."""
    out = np.zeros((len(signature), len(SIGNED)), np.int64)
    for j in range(PLACES_HELD):
        out = (out << B_BITS) | signature[:, j::PLACES_HELD]
    return out


def parity_map(hashes: np.ndarray) -> np.ndarray:
    """BITS bits in 64-bit numbers."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def described(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, th, n, digest, SIGNED.., MAPPED.., keys, left): th is a hash of the text, n the size of the set, left the value that each key leaves out."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            for part in small_slices(b, 2):
                if len(known) > WORDS_HELD:
                    known.clear()
                sets = []
                for t in part.column(2).cast(pa.binary()).to_pylist():
                    words = words_of(t)
                    for w in set(words):
                        if w not in known:
                            known[w] = xxhash.xxh64_intdigest(w)
                    sets.append(shingle_hashes(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), size))
                n = np.array([len(s) for s in sets], np.int64)
                keys, left = np.zeros((len(sets), PLACES), np.int64), np.zeros((len(sets), PLACES), np.int16)
                signed, mapped = np.zeros((len(sets), len(SIGNED)), np.int64), np.array([parity_map(s) for s in sets])
                if len(full := np.flatnonzero(n)):
                    signature = signatures(np.concatenate(sets), (np.cumsum(n) - n)[full])
                    keys[full], left[full], signed[full] = index_keys(signature), signature, packed(signature)
                offsets = np.cumsum([0, *np.where(n > 0, PLACES, 0)]).astype(np.int32)
                yield pa.record_batch(
                    {
                        "id": part.column(0),
                        "th": part.column(1),
                        "n": n,
                        "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        **{c: np.ascontiguousarray(signed[:, i]) for i, c in enumerate(SIGNED)},
                        **{c: np.ascontiguousarray(mapped[:, i]) for i, c in enumerate(MAPPED)},
                        "keys": pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[n > 0].ravel())),
                        "left": pa.ListArray.from_arrays(pa.array(offsets), pa.array(left[n > 0].ravel())),
                    }
                )

    kind = docs.schema[id_col].dataType.simpleString()
    numbers = ", ".join(f"{c} bigint" for c in [*SIGNED, *MAPPED])
    return rows.mapInArrow(released(run), f"id {kind}, th bigint, n bigint, digest binary, {numbers}, keys array<bigint>, left array<smallint>")


def fetched(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, t): the texts of rows (rid, id, th), read again."""
    wanted = checkpointed(rows.select("rid", F.col("id").alias("_id"), F.col("th").alias("_th")))
    if wanted.count() <= FETCH_BOUND:
        wanted = F.broadcast(wanted)
    text = text_of(text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("t")).join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    return stored(texts.dropDuplicates(["rid"]).select("rid", "t"))


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of row numbers whose full sets are similar."""
    both = pairs.join(texts.select(F.col("rid").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("rid").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for b in batches:
            for part in small_slices(b, 2):
                alike = []
                for x, y, tx, ty in zip(*(c.to_pylist() for c in part.columns)):
                    if y != last:
                        last, held = y, shingles(ty.encode(), size)
                    own = shingles(tx.encode(), size)
                    common = len(own & held)
                    alike.append(100 * common >= percent * (len(own) + len(held) - common))
                yield part.select([0, 1]).filter(pa.array(alike, pa.bool_()))

    return checkpointed(both.mapInArrow(released(run), "a bigint, b bigint"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the least node of its component.

    Links are few against documents, so that they are dealt to a task for every PART_LINKS, not to all shuffle partitions.
    """
    parts = 1 + edges.count() // PART_LINKS

    def few(df: DataFrame) -> DataFrame:
        return df.coalesce(parts)

    edges = checkpointed(few(few(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")).distinct()))
    before = None
    while True:
        both = few(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Kept, as it is used three times: a plan of both steps, turn after turn, costs the driver memory.
        large = checkpointed(few(few(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")).distinct()))
        least = few(large.groupBy("a").agg(F.min("b").alias("m")))
        small = few(large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).unionByName(least.select("a", F.col("m").alias("b")))
        edges = checkpointed(few(few(small.where("a <> b")).distinct()))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(few(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
        before = now


#: In each place of a packed signature, all bits but the highest, and the highest.
_LOW = sum(((1 << (B_BITS - 1)) - 1) << (B_BITS * j) for j in range(PLACES_HELD))
_HIGH = sum(1 << (B_BITS * j + B_BITS - 1) for j in range(PLACES_HELD))


def _distance(x: str, y: str):
    """In how many places the signatures differ: a place that differs carries into, or has, its highest bit."""
    total = F.lit(0)
    for c in SIGNED:
        z = F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))
        total = total + F.bit_count((z.bitwiseAND(_LOW) + _LOW).bitwiseOR(z).bitwiseAND(_HIGH))
    return total


def _maps_apart(x: str, y: str):
    total = F.lit(0)
    for c in MAPPED:
        total = total + F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")))
    return total


def _near(x: str, y: str, percent: int):
    """What a pair's sizes, parity maps and signatures must meet."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    sizes = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
    return sizes & ((100 + percent) * _maps_apart(x, y) <= (100 - percent) * (nx + ny)) & (_distance(x, y) <= DISTANCE_MOST)


def _star(now: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member with the most alike of its keys' leaders that lies in another component.

    A key's leader is the member whose keys have most members, outside the key's largest component after the first
    turn; a member has one pair a turn, so a group's pairs grow as its members.
    """
    rank = F.struct("score", (-F.col("rid")).alias("r"))
    held = now.where(F.coalesce(F.col("comp") != F.col("main"), F.lit(True)))
    leaders = held.groupBy("key").agg(F.max_by(F.struct(F.col("rid").alias("b"), F.col("comp").alias("b_comp")), rank).alias("l")).select("key", "l.*")
    met = now.join(leaders, "key").where("comp <> b_comp").select(F.col("rid").alias("a"), "b").distinct()
    y = met.alias("m").join(facts.alias("y"), F.col("m.b") == F.col("y.rid")).join(facts.alias("x"), F.col("m.a") == F.col("x.rid"))
    best = y.where(_near("x", "y", percent)).groupBy("m.a").agg(F.min(F.struct(_distance("x", "y").alias("d"), F.col("m.b").alias("b"))).alias("best"))
    return checkpointed(best.select("a", "best.b"))


def open_keys(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of keys that still have several components, with their own and the key's largest component."""
    now = shared.drop("main").join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("root", "rid")).drop("root")
    sums = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("members"))
    main = sums.groupBy("key").agg(F.max(F.struct("members", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("key", F.col("m.comp").alias("main"))
    return now.join(stored(main), "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """A row for each document: id, n_shingles, component_id, kept, text_hash."""
    if percent < 80:
        raise ValueError("the index is laid out for similarities of 80 per cent or more")
    told = stored(described(docs, id_col, text_col, size).withColumn("rid", F.monotonically_increasing_id()))
    # Tables of groups are written before they are joined, so that the join is between plain shuffles, of which Spark splits a hot group's.
    classes = stored(told.where("n > 0").groupBy("digest").agg(F.min("rid").alias("class")))
    member = stored(told.select("rid", "digest").join(classes, "digest", "left").select("rid", F.coalesce("class", "rid").alias("class")))
    chosen = member.where("rid = class").select("rid")
    classed = told.where("n > 0").join(chosen, "rid", "left_semi")
    keys = classed.select("rid", F.explode(F.arrays_zip("keys", "left")).alias("k")).select("rid", F.col("k.keys").alias("key"), F.col("k.left").alias("left"))
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    held = stored(keys.join(several.hint("merge"), "key"))  # never broadcast: Spark takes the exploded keys for as few as the classes
    scores = held.groupBy("rid").agg(F.sum("members").alias("score"))
    shared = stored(held.drop("members").join(scores, "rid"))
    facts = stored(told.select("rid", "n", *SIGNED, *MAPPED).join(scores.select("rid"), "rid", "left_semi"))

    texts = fetched(facts.select("rid").join(told.select("rid", "id", "th"), "rid"), docs, id_col, text_col)
    now, links, roots = shared.withColumn("comp", F.col("rid")).withColumn("main", F.lit(None).cast("bigint")), None, None
    for _ in range(STAR_TURNS):
        found = confirmed(_star(now, facts, percent), texts, size, percent)
        links = found if links is None else checkpointed(links.unionByName(found))
        roots = components(links)
        now = stored(open_keys(now.drop("comp"), roots))

    now = now.drop("score").join(facts, "rid")
    x, y = now.where("comp <> main").alias("x"), now.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.rid") < F.col("y.rid")))
    # Two that agree in a whole chunk share all of its keys: one of them is enough.
    once = (F.shiftright("x.key", B_BITS * (PER_CHUNK - 1)) % PER_CHUNK == 0) | (F.col("x.left") != F.col("y.left"))
    rest = x.join(y, apart & once & _near("x", "y", percent)).select(F.greatest("x.rid", "y.rid").alias("a"), F.least("x.rid", "y.rid").alias("b")).distinct()
    more = confirmed(rest, texts, size, percent)
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    placed = member.join(roots.withColumnRenamed("node", "class"), "class", "left").select("rid", F.coalesce("root", "class").alias("comp"))
    placed = told.select("rid", "id", "th", "n").join(placed, "rid")
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    groups = stored(placed.groupBy("comp").agg(F.min(order).alias("first")))
    return placed.join(groups, "comp").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("first.id").alias("component_id"),
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        F.col("th").alias("text_hash"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, with all its columns; repeated rows of a kept one stay."""
    judged = near_duplicates(docs, id_col, text_col, **options)
    i, h = free_name(docs, "gone_id"), free_name(docs, "gone_hash")
    gone = judged.groupBy(id_col, "text_hash").agg(F.max("kept").alias("any")).where("NOT any").select(F.col(id_col).alias(i), F.col("text_hash").alias(h))
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_of(text_col)) == F.col(h)), "left_anti")
