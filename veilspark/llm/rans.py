"""Token ids in files of static range asymmetric numeral systems.

A file is a list of sections. A section codes the ids of whole documents with one frequency table,
shared by its blocks. Blocks have BLOCK_TOKENS ids each, are independent, interleave LANES states, and
carry a checksum. Every CHECKPOINT steps, a block's states and its place among the words are kept,
so that a reader can start there; all blocks of a section are coded side by side in arrays.

A section in bytes (little-endian): MAGIC, then counts of ids, symbols, blocks and words (8 bytes
each), the table (4-byte symbols, 4-byte frequencies that sum to 2^PRECISION), and for each block:
its ids, words and crc32 (4 bytes each), its checkpoints' states (8 bytes for each lane) and words
before them (4 bytes), the first checkpoint being the block's start; then all blocks' 4-byte words.

Rows are dealt by ranges of id, with a hash of the text behind it so that a repeated id can be split,
and sorted; part k of the files holds the k-th range. Nulls: a null text counts as empty; null ids
come first. Empty documents have their end id only. Empty tables give no file. Repeated rows are coded one by
one. Other columns are not read, whatever their names. A very long text makes one longer section.

Beside each section stand its documents' ids and lengths with a checksum of their own.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import bpe
from .common import released, text_of

MAGIC = b"rans-1\0\0"
PRECISION, LOW = 20, 1 << 31
BLOCK_TOKENS, LANES, CHECKPOINT = 65_536, 128, 256
SECTION_TOKENS = 1_200_000


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that occur and their shares of 2^PRECISION, at least 1 each."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    n = counts[symbols]
    share = np.maximum(1, (n * ((1 << PRECISION) / max(1, n.sum()))).astype(np.int64))
    over = int(share.sum()) - (1 << PRECISION)
    while over > 0:  # the small ones were raised to 1; the large ones give way
        cut = np.minimum(share - 1, np.ceil(share * (over / (1 << PRECISION))).astype(np.int64))
        cut = np.where(np.cumsum(cut) <= over, cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
        share, over = share - cut, over - int(cut.sum())
    if len(share):
        share[np.argmax(share)] -= over
    return symbols.astype(np.uint32), share.astype(np.uint32)


def _grid(n: int) -> tuple[int, int, int]:
    """Blocks, steps and width of n ids laid out so that id i of a block is at step i // LANES, lane i % LANES."""
    blocks = -(-n // BLOCK_TOKENS)
    return blocks, BLOCK_TOKENS // LANES if blocks > 1 else -(-n // LANES), blocks * LANES


def _checkpoints(steps: int) -> int:
    return max(1, -(-steps // CHECKPOINT))


def encode_section(ids: np.ndarray) -> bytes:
    n = len(ids)
    symbols, share = frequencies(ids)
    blocks, steps, width = _grid(n)
    start = np.cumsum(share, dtype=np.uint64) - share
    padded = np.full(blocks * steps * LANES, -1, np.int32)
    place = np.zeros(int(symbols[-1]) + 1 if n else 1, np.int32)
    place[symbols] = np.arange(len(symbols))
    padded[:n] = place[ids]
    grid = padded.reshape(blocks, steps, LANES).transpose(1, 0, 2).reshape(steps, width) if n else padded.reshape(0, 0)
    freq64, top = share.astype(np.uint64), share.astype(np.uint64) << np.uint64(63 - PRECISION)
    state = np.full(width, LOW, np.uint64)
    out, words = np.zeros((steps, width), bool), np.zeros((steps, width), np.uint32)
    marks = np.zeros((_checkpoints(steps), width), np.uint64)
    for s in range(steps - 1, -1, -1):
        at = grid[s]
        live = None
        if at.min() < 0:
            live, at = at >= 0, np.maximum(at, 0)
        f = freq64[at]
        spill = state >= top[at]
        if live is not None:
            spill &= live
        words[s], out[s] = state.astype(np.uint32), spill
        x = np.where(spill, state >> np.uint64(32), state)
        q = x // f
        x = (q << np.uint64(PRECISION)) + (x - q * f) + start[at]
        state = x if live is None else np.where(live, x, state)
        if s % CHECKPOINT == 0:
            marks[s // CHECKPOINT] = state
    parts = [MAGIC, b"", symbols.tobytes(), share.tobytes()]
    body, total = [], 0
    for b in range(blocks):
        lanes = slice(b * LANES, (b + 1) * LANES)
        own = words[:, lanes][out[:, lanes]]
        before = np.concatenate([[0], np.cumsum(out[:, lanes].sum(axis=1))])[np.arange(_checkpoints(steps)) * CHECKPOINT]
        raw = ids[b * BLOCK_TOKENS : (b + 1) * BLOCK_TOKENS].astype("<u4").tobytes()
        parts += [struct.pack("<III", len(raw) // 4, len(own), zlib.crc32(raw)), marks[:, lanes].tobytes(), before.astype("<u4").tobytes()]
        body.append(own.tobytes())
        total += len(own)
    parts[1] = struct.pack("<QQQQ", n, len(symbols), blocks, total)
    return b"".join(parts + body)


class Section:
    """A section that has been read: its table, and its blocks' places."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a section of token ids")
        self.n, n_symbols, self.blocks, n_words = struct.unpack_from("<QQQQ", data, len(MAGIC))
        at = len(MAGIC) + 32
        self.symbols = np.frombuffer(data, "<u4", n_symbols, at)
        self.share = np.frombuffer(data, "<u4", n_symbols, at + 4 * n_symbols).astype(np.uint64)
        at += 8 * n_symbols
        self.start = np.cumsum(self.share, dtype=np.uint64) - self.share
        self.slots = np.repeat(np.arange(n_symbols, dtype=np.int32), self.share.astype(np.int64))
        _, self.steps, _ = _grid(self.n)
        k = _checkpoints(self.steps)
        self.sizes, self.words, self.crc, self.marks, self.before = [], [], [], [], []
        for _ in range(self.blocks):
            size, words, crc = struct.unpack_from("<III", data, at)
            self.marks.append(np.frombuffer(data, "<u8", k * LANES, at + 12).reshape(k, LANES))
            self.before.append(np.frombuffer(data, "<u4", k, at + 12 + 8 * k * LANES))
            at += 12 + 8 * k * LANES + 4 * k
            self.sizes.append(size), self.words.append(words), self.crc.append(crc)
        self.body = np.frombuffer(data, "<u4", n_words, at)
        self.first = np.cumsum([0, *self.words])[:-1]

    def decode(self, blocks: list[int], checkpoint: int = 0) -> list[np.ndarray]:
        """The ids of some blocks, from a checkpoint on; whole blocks are held against their checksums.

        What lies between two checkpoints is decoded side by side with all the rest.
        """
        if not blocks:
            return []
        marks = range(checkpoint, _checkpoints(self.steps))
        runs = [(b, k) for b in blocks for k in marks]
        state = np.concatenate([self.marks[b][k] for b, k in runs])
        read = np.array([self.first[b] + self.before[b][k] for b, k in runs], np.int64)
        steps = min(CHECKPOINT, self.steps)
        out = np.zeros((steps, len(runs) * LANES), np.int32)
        left = np.array([self.sizes[b] - k * CHECKPOINT * LANES for b, k in runs])[:, None] - np.arange(LANES)[None, :]
        left = left.ravel()
        low, body = np.uint64((1 << PRECISION) - 1), np.append(self.body, np.uint32(0))
        for s in range(steps):
            slot = state & low
            at = self.slots[slot.astype(np.int64)]
            x = self.share[at] * (state >> np.uint64(PRECISION)) + slot - self.start[at]
            live = left > s * LANES
            if not live.all():
                x = np.where(live, x, state)
            take = (x < LOW) & live
            by_run = take.reshape(-1, LANES)
            place = (read[:, None] + np.cumsum(by_run, axis=1) - 1).ravel()
            state = np.where(take, (x << np.uint64(32)) | body[np.where(take, place, -1)], x)
            read += by_run.sum(axis=1)
            out[s] = at
        found = []
        by_lanes = out.reshape(steps, len(runs), LANES).transpose(1, 0, 2).reshape(len(blocks), -1)
        for own, b in zip(by_lanes, blocks):
            ids = self.symbols[own[: max(0, self.sizes[b] - checkpoint * CHECKPOINT * LANES)]]
            if not checkpoint and zlib.crc32(ids.astype("<u4").tobytes()) != self.crc[b]:
                raise ValueError(f"block {b} does not match its checksum")
            found.append(ids)
        return found


def decode_section(data: bytes) -> np.ndarray:
    section = Section(data)
    return np.concatenate([np.zeros(0, np.uint32), *section.decode(list(range(section.blocks)))])


def _by_library(tokenizer_json: str):
    """Encodes distinct parts with the tokenizers library: words by its model, all else by the whole tokenizer."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core; more threads cost memory only
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.no_truncation(), tokenizer.no_padding()
    chars = bpe.byte_characters()
    blank = chars[ord(" ")]

    def ids_of(parts: list[str]) -> Iterator[list[int]]:
        mixed = [p for p in parts if not (p[1:] if p[:1] == " " else p).isalpha()]
        whole = dict(zip(mixed, tokenizer.encode_batch_fast(mixed, add_special_tokens=False)))
        tokenize = tokenizer.model.tokenize
        for p in parts:
            if p in whole:
                yield whole[p].ids
            elif p.isascii():
                yield [t.id for t in tokenize(blank + p[1:] if p[0] == " " else p)]
            else:
                yield [t.id for t in tokenize("".join(map(chars.__getitem__, p.encode())))]

    def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [np.zeros(0, np.int32)], []
        for at in range(0, len(parts), 10_000):
            ids = list(ids_of(parts[at : at + 10_000]))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32))
            sizes += map(len, ids)
        return np.concatenate(flat), np.array(sizes, np.int64)

    return encode


def _head_crc(docs: pa.Array, lengths: list[int]) -> int:
    """The checksum of a section's document ids and lengths."""
    return zlib.crc32(repr((docs.to_pylist(), lengths)).encode())


def write_files(docs: DataFrame, tokenizer_json: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Writes rows (part, section, start, docs, lengths, head_crc, data); start counts the ids of the part's earlier sections."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _by_library(shared.value), TaskContext.get().partitionId()
        section, start, held, keys = 0, 0, [], []

        def out() -> pa.RecordBatch:
            data = encode_section(np.concatenate(held))
            row = {"part": pa.array([part], pa.int32()), "section": pa.array([section], pa.int32()), "start": pa.array([start], pa.int64())}
            own, lengths = pa.concat_arrays(keys), [len(x) for x in held]
            row |= {"docs": pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), own)}
            row |= {"lengths": pa.array([lengths], pa.list_(pa.int64())), "head_crc": pa.array([_head_crc(own, lengths)], pa.int64()), "data": pa.array([data], pa.binary())}
            return pa.record_batch(row)

        for now, rows in bpe.rounds(batches, 1):
            column = rows.column(0)
            at, tokens = 0, 0
            for texts in now.ids(encode):
                for t in texts:
                    held.append(np.append(t, np.int32(end_id)))
                    tokens += len(t) + 1
                keys.append(column.slice(at, len(texts)))
                at += len(texts)
                if tokens >= SECTION_TOKENS or at == len(column):
                    yield out()
                    section, start, tokens, held, keys = section + 1, start + tokens, 0, [], []

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"), F.xxhash64(text_of(text_col)).alias("h"))
    sorted_rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "t")
    sorted_rows.mapInArrow(released(run), f"part int, section int, start bigint, docs array<{kind}>, lengths array<bigint>, head_crc bigint, data binary").write.option("compression", "none").parquet(path)


def _read(files: DataFrame, id_col: str, columns: str, told) -> DataFrame:
    """(id, part, start_in_part, columns..) of every document; told: a document's ids in bytes to the columns' values."""
    kind = files.schema["docs"].dataType.elementType.simpleString()
    schema = f"`{id_col}` {kind}, part int, start_in_part bigint, {columns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part, start, docs, lengths, crc, data = (b.column(k)[i] for k in range(6))
                docs, lengths = docs.values, lengths.as_py()
                if _head_crc(docs, lengths) != crc.as_py():
                    raise ValueError("a section's documents do not match their checksum")
                ids, ends = decode_section(data.as_py()).astype("<u4"), np.cumsum(lengths)
                found = list(zip(*[told(x.tobytes()) for x in np.split(ids, ends[:-1])]))
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(np.full(len(docs), part.as_py()), pa.int32()), pa.array(start.as_py() + ends - lengths, pa.int64()), *map(pa.array, found)],
                    [id_col, "part", "start_in_part", *[c.split()[0] for c in columns.split(", ")]],
                )

    return files.select("part", "start", "docs", "lengths", "head_crc", "data").mapInArrow(released(run), schema)


def read_documents(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, part, start_in_part, ids) of every document, decoded from the files' sections; ids are 4 bytes each."""
    return _read(files, id_col, "ids binary", lambda ids: (ids,))


def read_digests(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, part, start_in_part, n_tokens, ids_crc32) of every document: as read_documents(), but the ids stay where they are decoded."""
    return _read(files, id_col, "n_tokens bigint, ids_crc32 bigint", lambda ids: (len(ids) // 4, zlib.crc32(ids)))


def part_starts(files: DataFrame) -> DataFrame:
    """(part, part_start): the ids of all earlier parts. One row for each part, so the running sum is over few rows."""
    sums = files.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return sums.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
