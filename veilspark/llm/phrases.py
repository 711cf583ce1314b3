"""Phrase collocations: phrases counted in HAT-tries, merged by ranges of prefixes, scored by their weakest cut.

A text is cut into pieces at the marks . , ; : ! ? and line breaks, and pieces into words at spaces and tabs; ASCII letters are lowered.
Phrases are runs of words inside a piece. Everything is counted for each language by itself.

Counting goes by length, one and two words first. A task numbers its words, packs a phrase's numbers to one key, and counts keys in a burst trie: hash containers
below a shallow trie over the digits of the word numbers, where a container of more than BURST keys becomes a node with containers of its
own. When a task holds more than HELD keys it spills the largest subtrees, whole, as sorted runs of (language, phrase, count), which
are written to the shared folder. Spark deals all runs by ranges of (language, phrase), that is by prefix, and adds them up there.

A phrase occurs `least` times only if the two phrases that are one word shorter do. So from three words on each length is counted where the
length before it is frequent: frequent phrases are marked in a bitmap of fixed size, 2^FILTER_BITS bits, which is all that is broadcast. It lets
too many through where hashes meet, never too few; what it lets through is counted exactly.

Scores are exact: integers in decimals of 38 digits. Ranks are counted by ranges, not by one task for each language.

Nulls: a null text counts as empty, a null language as `und`; repeated rows count as often as they occur; the ids are not read. Texts beyond
PART_BYTES are counted part by part, with the words between. Empty tables give empty results; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.report import ranked

from .common import released, small_slices, stored, text_of

#: Keys of a container before it bursts, keys of a task before it spills, words that a task numbers.
BURST, HELD, WORDS_HELD = 16_384, 600_000, 1 << 19
#: Bits of a word's number in a key, of a trie's digit, and of the bitmap of frequent phrases.
WORD_BITS, DIGIT_BITS, FILTER_BITS = 21, 7, 26
PART_BYTES = 1 << 20

#: Letters are lowered; each mark becomes a full stop, each blank a space.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")
CUT = re.compile(rb"[ .]")
_FACTORS = np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, 9, dtype=np.uint64)
RUN = "part bigint, lang string, size int, total bigint, phrases binary, lengths binary, counts binary"
MERGED = "lang string, size int, phrase string, f bigint"


def pieces(text: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """The text with marks as full stops, in parts. A part begins with up to size - 1 words of the part before it: how many, is told."""
    text, at, before = text.translate(TABLE), 0, []
    while at < len(text):
        end = at + PART_BYTES
        if end < len(text):
            gap = CUT.search(text, end)
            end = gap.start() if gap else len(text)
        part = b" ".join([*before, text[at:end]])
        yield part, len(before) - before.count(b".")
        before = part.replace(b".", b" . ").split()[1 - size :] if size > 1 and end < len(text) else []
        at = end


def phrase_hashes(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from their words' hashes, place by place."""
    x = sum((w * _FACTORS[j] for j, w in enumerate(words)), np.zeros(len(words[0]), np.uint64))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\0" + word)


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    at = hashes >> np.uint64(64 - FILTER_BITS)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class Words(dict):
    """Word numbers by word, from 1."""

    def __init__(self, lang: bytes):
        super().__init__()
        self.lang, self.listed, self.hashes = lang, [b""], np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.listed)
        self.listed.append(word)
        return n

    def numbers(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the text's words, and of the piece that each is in. The words are cut out in whole arrays; only distinct ones are looked up."""
        signs = np.frombuffer(text, np.uint8)
        stop = signs == ord(".")
        inside = ~(stop | (signs == ord(" ")))
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        tokens = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(signs[inside])]).dictionary_encode()
        known = np.fromiter(map(self.__getitem__, tokens.dictionary.to_pylist()), np.int64, len(tokens.dictionary))
        return known[tokens.indices.to_numpy()], np.cumsum(stop)[starts]

    def hashed(self) -> np.ndarray:
        """The hashes of all words, by number."""
        fresh = self.listed[len(self.hashes) :]
        self.hashes = np.concatenate([self.hashes, np.fromiter((word_hash(self.lang, w) for w in fresh), np.uint64, len(fresh))])
        return self.hashes


class HatTrie:
    """Counts of packed keys: nodes are lists of 2^DIGIT_BITS children, containers are dicts from key to count."""

    def __init__(self, size: int):
        # A key's digits, its first word's lowest first: they part the words most evenly.
        self.shifts = [WORD_BITS * (size - 1 - w) + d for w in range(size) for d in range(0, WORD_BITS, DIGIT_BITS)]
        self.root: list = [None] * (1 << DIGIT_BITS)
        self.sizes = [0] * (1 << DIGIT_BITS)

    def __len__(self) -> int:
        return sum(self.sizes)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds the counts of distinct keys."""
        for digit, k, n in self._split(keys, counts, 0):
            self.root[digit], grown = self._added(self.root[digit], 1, k, n)
            self.sizes[digit] += grown

    def _split(self, keys: np.ndarray, counts: np.ndarray, depth: int) -> Iterator[tuple]:
        digits = (keys >> self.shifts[depth]) & ((1 << DIGIT_BITS) - 1)
        order = np.argsort(digits, kind="stable")
        keys, counts, digits = keys[order], counts[order], digits[order]
        starts = np.flatnonzero(np.diff(digits, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(digits)], strict=True):
            yield int(digits[a]), keys[a:b], counts[a:b]

    def _added(self, node, depth: int, keys: np.ndarray, counts: np.ndarray) -> tuple:
        """The node with the counts, a new one where it burst, and how many keys are new."""
        if isinstance(node, list):
            new = 0
            for digit, k, n in self._split(keys, counts, depth):
                node[digit], grown = self._added(node[digit], depth + 1, k, n)
                new += grown
            return node, new
        held = {} if node is None else node
        before, get = len(held), held.get
        for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
            held[k] = get(k, 0) + n
        new = len(held) - before
        if len(held) > BURST and depth < len(self.shifts):
            burst = [None] * (1 << DIGIT_BITS)
            for digit, k, n in self._split(np.fromiter(held.keys(), np.int64, len(held)), np.fromiter(held.values(), np.int64, len(held)), depth):
                burst[digit] = self._added(None, depth + 1, k, n)[0]
            return burst, new
        return held, new

    def taken(self, digit: int) -> tuple[np.ndarray, np.ndarray]:
        """A subtree's keys and counts; the subtree is gone."""
        found, todo = [], [self.root[digit]]
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += [x for x in node if x is not None]
            elif node:
                found.append((np.fromiter(node.keys(), np.int64, len(node)), np.fromiter(node.values(), np.int64, len(node))))
        self.root[digit], self.sizes[digit] = None, 0
        return np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])


def _blocks(cuts: np.ndarray, data: pa.Buffer) -> pa.Array:
    """The buffer cut to binary values, without a copy."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), data])


def run_of(lang: bytes, words: Words, size: int, bits: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A run: a row for each partition, of which there are 2^bits."""
    ids = [(keys >> (WORD_BITS * (size - 1 - j))) & ((1 << WORD_BITS) - 1) for j in range(size)]
    known = words.hashed()
    part = (phrase_hashes([known[i] for i in ids]) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    listed, part, counts = pa.array(words.listed, pa.binary()), part[order], counts[order]
    each = [listed.take(pa.array(i[order])) for i in ids]
    phrase = pc.binary_join_element_wise(*each, b" ") if size > 1 else each[0]
    ends = np.frombuffer(phrase.buffers()[1], np.int32, len(keys) + 1)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    same = np.zeros(len(cuts) - 1, np.int64)
    return pa.record_batch(
        {
            "part": part[cuts[:-1]], "lang": pa.array([lang.decode()], pa.string()).take(pa.array(same)), "size": pa.array(same + size, pa.int32()), "total": np.add.reduceat(counts, cuts[:-1]),
            "phrases": _blocks(ends[cuts], phrase.buffers()[2]), "lengths": _blocks(cuts * 4, pa.py_buffer(np.diff(ends).astype(np.int32))), "counts": _blocks(cuts * 8, pa.py_buffer(counts.astype(np.int64))),
        }
    )


def merged(blocks: DataFrame, least: int) -> DataFrame:
    """MERGED: the phrases of RUN rows that occur `least` times or more. Rows come sorted by partition, of which one is held at a time."""

    def added(lang: str, size: int, held: list) -> pa.RecordBatch:
        lengths = np.frombuffer(b"".join(x[1] for x in held), np.int32)
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        phrases = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(x[0] for x in held))])
        counts = pa.array(np.frombuffer(b"".join(x[2] for x in held), np.int64))
        sums = pa.table({"phrase": phrases, "n": counts}).group_by("phrase", use_threads=False).aggregate([("n", "sum")])
        sums = sums.filter(pc.greater_equal(sums["n_sum"], least))
        same = pa.array(np.zeros(sums.num_rows, np.int64))
        columns = [pa.array([lang]).take(same), pa.array([size], pa.int32()).take(same), sums["phrase"].combine_chunks().cast(pa.large_string()).cast(pa.string()), sums["n_sum"].combine_chunks()]
        return pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            for part, lang, size, *block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (part, lang, size) != key:
                    if held:
                        yield added(*key[1:], held)
                    key, held = (part, lang, size), []
                held.append(block)
        if held:
            yield added(*key[1:], held)

    dealt = blocks.select("part", "lang", "size", "phrases", "lengths", "counts").repartition("part").sortWithinPartitions("part", "lang", "size")
    return dealt.mapInArrow(released(run), MERGED)


class Counter:
    """A task's tries, one for each language and length, and their words. shorter: the bitmap of frequent phrases that are one word shorter."""

    def __init__(self, sizes: tuple[int, ...], bits: int, shorter: np.ndarray | None = None):
        self.sizes, self.bits, self.shorter = sizes, bits, shorter
        self.tries: dict[tuple[bytes, int], HatTrie] = {}
        self.words: dict[bytes, Words] = {}

    def phrases(self, words: Words, found: np.ndarray, piece: np.ndarray, size: int, before: int) -> np.ndarray:
        """The keys of all phrases of `size` words whose shorter phrases are marked, but for those among the first `before` words."""
        n = len(found) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        fit, keys = piece[:n] == piece[size - 1 :], np.zeros(n, np.int64)
        fit[: max(0, before - size + 1)] = False
        for j in range(size):
            keys = (keys << WORD_BITS) | found[j : n + j]
        if self.shorter is not None:
            hashes = words.hashed()[found]
            good = marked(self.shorter, phrase_hashes([hashes[j : n + 1 + j] for j in range(size - 1)]))
            fit &= good[:n] & good[1:]
        return keys[fit]

    def add(self, lang: bytes, text: bytes, before: int = 0) -> None:
        words = self.words.setdefault(lang, Words(lang))
        found, piece = words.numbers(text)
        for size in self.sizes:
            keys = self.phrases(words, found, piece, size, before)
            if len(keys):
                self.tries.setdefault((lang, size), HatTrie(size)).add(*np.unique(keys, return_counts=True))

    def spilled(self, everything: bool = False) -> Iterator[pa.RecordBatch]:
        """Runs, once too much is held: the largest subtrees, down to half of HELD; all where the words are too many."""
        full = everything or sum(map(len, self.words.values())) > WORDS_HELD
        held = sum(map(len, self.tries.values()))
        if not full and held <= HELD:
            return
        subtrees = sorted(((n, *key, digit) for key, t in self.tries.items() for digit, n in enumerate(t.sizes) if n), reverse=True)
        chosen: dict[tuple[bytes, int], list] = {}
        for n, lang, size, digit in subtrees:
            if not full and held <= HELD // 2:
                break
            chosen.setdefault((lang, size), []).append(self.tries[lang, size].taken(digit))
            held -= n
        for (lang, size), parts in chosen.items():
            yield run_of(lang, self.words[lang], size, self.bits, *map(np.concatenate, zip(*parts, strict=True)))
        if full:
            self.tries.clear()
            self.words.clear()


#: Partitions are 2^PART_BITS at least, and 2^5 times as many as the table has parts: so what one holds does not grow with the table.
PART_BITS = 10


def runs(docs: DataFrame, lang_col: str, text_col: str, sizes: tuple[int, ...], shorter=None) -> DataFrame:
    """RUN: runs of counted phrases of so many words. shorter: a broadcast bitmap."""
    bits = max(PART_BITS, docs.rdd.getNumPartitions().bit_length() + 5)
    rows, longest = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("t")), max(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sizes, bits, shorter.value if shorter else None)
        for b in batches:
            for part in small_slices(b, 1):
                by_lang: dict[bytes, list[bytes]] = {}
                for lang, text in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    if len(text) <= PART_BYTES:
                        by_lang.setdefault(lang, []).append(text)
                        continue
                    for piece, before in pieces(text, longest):
                        counter.add(lang, piece, before)
                        yield from counter.spilled()
                for lang, texts in by_lang.items():
                    counter.add(lang, b".".join(texts).translate(TABLE))
                    yield from counter.spilled()
        yield from counter.spilled(everything=True)

    return rows.mapInArrow(released(run), RUN)


def bitmap_of(frequent: DataFrame, size: int) -> np.ndarray:
    """The bitmap of a table (lang, phrase). At most 2^FILTER_BITS / 64 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, phrases = (c.cast(pa.binary()).to_pylist() for c in b.columns)
            words = [[word_hash(lang, w) for w in p.split(b" ")] for lang, p in zip(langs, phrases, strict=True)]
            hashes = phrase_hashes([np.array([w[j] for w in words], np.uint64) for j in range(size)])
            at = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            yield pa.record_batch({"word": at >> 6, "bit": (at & 63).astype(np.int32)})

    bits = frequent.select("lang", "phrase").mapInArrow(run, "word bigint, bit int")
    found = bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bitmap.view(np.uint64)


def frequencies(docs: DataFrame, longest: int, least: int, lang_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases that occur `least` times or more, and (lang, n): all words."""
    if not 2 <= longest <= 63 // WORD_BITS:
        raise ValueError(f"phrases may have 2 to {63 // WORD_BITS} words")
    context, tables, totals, shorter = docs.sparkSession.sparkContext, [], None, None
    for sizes in [(1, 2), *[(n,) for n in range(3, longest + 1)]]:
        found = stored(runs(docs, lang_col, text_col, sizes, shorter))
        if shorter:
            shorter.unpersist()
        if totals is None:
            totals = stored(found.where("size = 1").groupBy("lang").agg(F.sum("total").alias("n")))
        tables.append(stored(merged(found, least)))
        if sizes[-1] < longest:
            shorter = context.broadcast(bitmap_of(tables[-1].where(F.col("size") == sizes[-1]), sizes[-1]))
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out, totals


def _words(phrase: Column) -> Column:
    return F.split(phrase, " ")


def _part(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def score_of() -> Column:
    """A cut's score from a, l and r, in decimals of 37 digits. l and r are at least a, so it is a million at most."""
    wide = {c: f"cast({c} as decimal(14,0))" for c in "alr"}
    return F.expr(f"(cast(1000000 as decimal(7,0)) * ({wide['a']} * {wide['a']})) div ({wide['l']} * {wide['r']})")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, covered: int = 50, most: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first `most` phrases: lang, rank, phrase, size, a, cut, l, r, n, score.

    covered: a phrase goes where a longer candidate that holds it has this many hundredths of its count.
    """
    known, totals = frequencies(docs, longest, least, lang_col, text_col)
    candidates = known.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    words = _words(F.col("phrase"))
    cuts = candidates.select("lang", "size", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("*", _part(words, F.lit(1), F.col("cut")).alias("left"), _part(words, F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])

    scored = cuts.withColumn("score", score_of()).groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w")).select("lang", "size", "phrase", "a", "w.*")
    if longest > 2:
        inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: _part(words, i, k))))
        held = candidates.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("b")).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
        scored = scored.join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("b") < covered * F.col("a"), F.lit(True))).drop("b")
    order = {"by_score": -F.col("score"), "by_count": -F.col("a")}
    done = ranked(stored(scored.withColumns(order)), "lang", [*order, "phrase"], "rank").where(F.col("rank") <= most)
    return done.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "size", "a", "cut", "l", "r", "n", "score")
