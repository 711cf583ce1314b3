"""Byte-level BPE by a pair occurrence index, and decoding.

A task takes about ROUND_CHARS bytes of texts at a time, cuts them to pieces that no merge crosses,
and keeps each distinct piece once. All symbols of the distinct pieces lie in one array with links to
their neighbours. An index maps every pair that some merge joins to its places; the active ranks are
applied in ascending order, each to all its places at once, and only the lists of pairs next to a
changed place are touched. Texts are then put together from their pieces' ids.

The vocabulary is read from a tokenizer file's JSON text on the driver and travels to the tasks.

Nulls: a null text counts as empty and has no ids. Ids are passed on as they are. Empty tables stay empty.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_slices, text_of

ROUND_CHARS = 8_000_000
#: Tokens put together at a time.
OUT_TOKENS = 400_000
NEVER = np.iinfo(np.int32).max

#: Unicode white space, as a class.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The byte-level pre-tokenizer's expression (a fixed format of the vocabulary).
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Texts with none of these can be cut before every blank and around every line feed: runs of white space, other white space, the mark.
MARK = "\x01"
UNEVEN = r"[ \n][ \n]|[\x{0}\x{1}\t\r\x{b}\x{c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts without it can also be cut before a full stop or comma that ends a word.
AFTER_MARK = r"[^\pL\pN][.,][ \n]"


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    at = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [at[b] for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary with its merges as arrays sorted by pair."""

    def __init__(self, text: str):
        spec = json.loads(text)
        ids = dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ids |= self.special
        chars = byte_characters()
        back = {c: b for b, c in enumerate(chars)}
        self.byte_ids = np.array([ids[c] for c in chars], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = np.array([(ids[a] << 20) | ids[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        self.twin = np.array([a == b for a, b in merges])
        size = max(ids.values()) + 1
        told = [b""] * size
        for token, i in ids.items():
            told[i] = token.encode() if i in self.special.values() else bytes(back[c] for c in token)
        self.lengths = np.array([len(t) for t in told], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(told), np.uint8)
        self.piece = regex.compile(PIECE)
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at], NEVER)

    def pieces(self, text: str) -> list[bytes | int]:
        """The pieces of a text in bytes; special tokens as ids."""
        out: list = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                out += [p.encode() for p in self.piece.findall(part)]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.bytes[at].tobytes()


def merged(vocabulary: Vocabulary, pieces: list[bytes | int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces, one after another, and the number of each piece's ids."""
    sizes = np.array([1 if isinstance(p, int) else len(p) for p in pieces], np.int64)
    symbols = vocabulary.byte_ids[np.frombuffer(b"".join(b"\0" if isinstance(p, int) else p for p in pieces), np.uint8)]
    firsts = np.cumsum(sizes) - sizes
    for i, p in enumerate(pieces):
        if isinstance(p, int):
            symbols[firsts[i]] = p
    n = len(symbols)
    if not n:
        return symbols, sizes
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[firsts + sizes - 1], before[firsts] = -1, -1
    rank = np.full(n, NEVER, np.int32)
    inner = np.flatnonzero(after >= 0)
    rank[inner] = vocabulary.rank(symbols[inner], symbols[after[inner]])

    places: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(at: np.ndarray) -> None:
        at = at[rank[at] != NEVER]
        if not len(at):
            return
        at = at[np.argsort(rank[at], kind="stable")]
        own = rank[at]
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
        for r, part in zip(own[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
            if r in places:
                places[r].append(part)
            else:
                places[r] = [part]
                heapq.heappush(active, r)

    add(inner)
    while active:
        r = heapq.heappop(active)
        lists = places.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[rank[at] == r]
        if vocabulary.twin[r] and len(at) > 1:  # of three or more alike, the first two join
            at = np.sort(at)
            new_run = np.concatenate([[True], after[at[:-1]] != at[1:]])
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        gone = after[at]
        beyond = after[gone]
        symbols[at], symbols[gone], rank[gone], after[at] = vocabulary.made[r], -1, NEVER, beyond
        has = beyond >= 0
        before[beyond[has]] = at[has]
        rank[at] = NEVER
        ahead = before[at]
        changed = np.unique(np.concatenate([at[has], ahead[ahead >= 0]]))
        rank[changed] = vocabulary.rank(symbols[changed], symbols[after[changed]])
        add(changed)
    alive = symbols >= 0
    return symbols[alive], np.add.reduceat(alive.astype(np.int64), firsts)


def parted(texts: pa.StringArray) -> tuple[pa.Array, np.ndarray]:
    """All texts' parts, one after another, and how many each text has; no piece crosses from part to part.

    Texts of even white space are cut in Arrow; the others are one part each.
    """
    uneven = pc.match_substring_regex(texts, UNEVEN)
    cut = texts.filter(pc.invert(uneven))
    stops = pc.replace_substring_regex(cut, r"([.,][ \n])", MARK + r"\1")
    cut = pc.if_else(pc.match_substring_regex(cut, AFTER_MARK), cut, stops)
    cut = pc.replace_substring(pc.replace_substring(cut, " ", MARK + " "), "\n", f"{MARK}\n{MARK}")
    lists = pc.split_pattern(cut, MARK)
    whole = texts.filter(uneven)
    if not len(whole):
        return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    # Put the two kinds back in the texts' order.
    parts = pa.concat_arrays([lists.flatten(), whole])
    odd = uneven.to_numpy(zero_copy_only=False)
    n = np.ones(len(texts), np.int64)
    n[~odd] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    start = np.empty(len(texts), np.int64)
    start[~odd] = np.cumsum(n[~odd]) - n[~odd]
    start[odd] = n[~odd].sum() + np.arange(odd.sum())
    order = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return parts.take(pa.array(order)), n


class Round:
    """Texts of one round: each as the numbers of its distinct parts."""

    def __init__(self, texts: pa.StringArray):
        parts, n = parted(texts)
        coded = parts.dictionary_encode()
        self.distinct: list[str] = coded.dictionary.to_pylist()
        self.texts = np.split(coded.indices.to_numpy(), np.cumsum(n)[:-1])

    def ids(self, encode) -> Iterator[list[np.ndarray]]:
        """The ids of each text, a list of texts at a time. encode: distinct parts to ids and their numbers."""
        flat, sizes = encode(self.distinct)
        starts = np.cumsum(sizes) - sizes
        at = 0
        while at < len(self.texts):
            to, tokens = at, 0
            while to < len(self.texts) and (to == at or tokens < OUT_TOKENS):
                tokens += int(sizes[self.texts[to]].sum())
                to += 1
            parts = np.concatenate(self.texts[at:to])
            n = sizes[parts]
            places = np.repeat((starts[parts] - (np.cumsum(n) - n)).astype(np.int32), n)
            places += np.arange(len(places), dtype=np.int32)
            ids = flat[places]
            ends = np.cumsum([sizes[t].sum() for t in self.texts[at:to]])
            yield np.split(ids, ends[:-1])
            at = to


def by_index(vocabulary: Vocabulary):
    """Encodes distinct parts with merged()."""

    def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, n = [], []
        for p in parts:
            own = vocabulary.pieces(p)
            pieces += own
            n.append(len(own))
        flat, sizes = merged(vocabulary, pieces)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n)])]
        return flat, np.diff(ends)

    return encode


def rounds(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[Round, pa.RecordBatch]]:
    """Rounds of texts, with the other columns of their rows."""
    for b in batches:
        for part in small_slices(b, text, ROUND_CHARS):
            yield Round(part.column(text)), part.select([i for i in range(part.num_columns) if i != text])


def encode_documents(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns to keep, ids, decoded) for each document; decoded is read back from the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for now, rows in rounds(batches, 0):
            columns, at = rows.columns, 0
            for texts in now.ids(by_index(vocabulary)):
                ends = np.cumsum([0, *map(len, texts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(texts).astype(np.int32)))
                decoded = [vocabulary.decode(t).decode("utf-8", "replace") for t in texts]
                yield pa.RecordBatch.from_arrays([*[c.slice(at, len(texts)) for c in columns], ids, pa.array(decoded, pa.string())], [*names, "ids", "decoded"])
                at += len(texts)

    rows = docs.select(text_of(text_col).alias("t"), *[F.col(c) for c in names])
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(released(run), f"{kinds}, ids array<int>, decoded string")
