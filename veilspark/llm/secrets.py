"""Secret scan: fixed rules, and character Markov models for random strings that no rule names.

Two first-order Markov models over the characters of tokens are trained from labelled samples: random
strings (label 1) and ordinary identifiers (label 0). Every task counts the character pairs of its
samples and Spark sums the counts, so training covers all rows and what reaches the driver has at
most 2 x 68 x 68 counts. A token whose log-likelihood ratio of the two models is over a threshold,
in total and for each character, is a find of kind "markov", unless a find of a rule overlaps it and is as long.

count_texts() takes labels from the text itself: values that the rules find are random strings, other
long tokens are identifiers, but for those of CANDIDATE's length with letters and digits, which may be secrets
and are learned as neither. Any other labelled table (value, label) will do, by count_labelled().

A very long text is scanned whole. Other columns are not read, whatever their names. Null texts count as empty; null values or labels are not learned from; ids are passed on as they are,
null or repeated. Empty tables give empty results and, in training, two uniform models.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_slices, text_of

#: Fixed rules: kind, expression, the group whose length counts, the least length.
RULES = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
MARKOV = "markov"
SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: One more state for the ends of a token and one for all other characters.
END, OTHER, STATES = len(ALPHABET), len(ALPHABET) + 1, len(ALPHABET) + 2
CODES = np.full(256, OTHER, np.int64)
CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
CODES[ord("\n")] = END

#: The score decides, not the length: twelve characters of an even mix are well above the threshold.
LEAST_CHARS = 12
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}"
SAMPLE = r"[A-Za-z][A-Za-z0-9_.-]{7,}"
DIGIT = re.compile("[0-9]")


def rule_spans(text: str, compiled: list) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed rules, in order."""
    found = []
    for kind, (pattern, group, least) in enumerate(compiled):
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def compiled_rules() -> list:
    return [(re.compile(p), g, n) for _, p, g, n in RULES]


def pair_counts(values: list[str]) -> np.ndarray:
    """How often each character follows each other one, ends included."""
    raw = np.frombuffer(("\n" + "\n".join(values) + "\n").encode("latin-1", "replace"), np.uint8)
    code = CODES[raw]
    return np.bincount(code[:-1] * STATES + code[1:], minlength=STATES * STATES)


def _count_rows(totals: np.ndarray) -> pa.RecordBatch:
    label, pair = np.nonzero(totals)
    return pa.record_batch({"label": pa.array(label, pa.int32()), "pair": pa.array(pair, pa.int32()), "n": pa.array(totals[label, pair], pa.int64())})


COUNTED = "label int, pair int, n bigint"


def count_labelled(samples: DataFrame, value: str = "value", label: str = "label") -> DataFrame:
    """The pair counts of a labelled table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, STATES * STATES), np.int64)
        for b in batches:
            values, labels = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in (0, 1):
                if own := [v for v, x in zip(values, labels) if x == k]:
                    totals[k] += pair_counts(own)
        yield _count_rows(totals)

    rows = samples.select(F.col(value).cast("string"), F.col(label).cast("int")).dropna()
    return rows.mapInArrow(released(run), COUNTED).groupBy("label", "pair").agg(F.sum("n").alias("n"))


def ordinary(token: str) -> bool:
    """Whether an unlabelled token is learned as an identifier."""
    return len(token) < LEAST_CHARS or token.isalpha() or not DIGIT.search(token)


def count_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The pair counts of a table of texts, labelled by the fixed rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, sample = compiled_rules(), re.compile(SAMPLE)
        totals = np.zeros((2, STATES * STATES), np.int64)
        for b in batches:
            for part in small_slices(b, 0):
                random, plain = [], []
                for t in part.column(0).to_pylist():
                    spans, at = rule_spans(t, compiled), 0
                    for start, kind, end in spans:
                        pattern, group, _ = compiled[kind]
                        random.append(pattern.match(t, start, end)[group])
                        plain += filter(ordinary, sample.findall(t, at, max(at, start)))
                        at = max(at, end)
                    plain += filter(ordinary, sample.findall(t, at))
                for k, own in enumerate((plain, random)):
                    if own:
                        totals[k] += pair_counts(own)
        yield _count_rows(totals)

    return docs.select(text_of(text_col)).mapInArrow(released(run), COUNTED).groupBy("label", "pair").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame, prior: float = 1.0, strength: float = 200.0) -> np.ndarray:
    """The log ratio of the two models for each pair of characters; at most 2 x STATES^2 counts are gathered.

    A character's followers are smoothed towards the label's own characters: where identifiers have no
    digit after a capital, their rarity of digits tells, not an even chance.
    """
    totals = np.zeros((2, STATES, STATES))
    for r in counts.collect():
        totals[r["label"], r["pair"] // STATES, r["pair"] % STATES] += r["n"]
    single = totals.sum(axis=1, keepdims=True) + prior
    single /= single.sum(axis=2, keepdims=True)
    share = np.log((totals + strength * single) / (totals.sum(axis=2, keepdims=True) + strength))
    return share[1] - share[0]


def log_ratio(value: str, ratios: np.ndarray) -> float:
    code = CODES[np.frombuffer(f"\n{value}\n".encode("latin-1", "replace"), np.uint8)]
    return float(ratios[code[:-1], code[1:]].sum())


def as_long(base: list[tuple[int, int, int]], tokens: list[tuple[int, int]], kinds: int) -> list[bool]:
    """For each token (start, end), whether a base span (start, kind, end) that overlaps it is as long.

    Tokens are disjoint and in order, and so are the base spans of one kind: one sweep a kind, linear in both.
    """
    out = [False] * len(tokens)
    for kind in range(kinds):
        own = [(x, y) for x, k, y in base if k == kind]
        at = 0
        for i, (s, e) in enumerate(tokens):
            while at < len(own) and own[at][1] <= s:
                at += 1
            j = at
            while j < len(own) and own[j][0] < e:
                out[i] |= own[j][1] - own[j][0] >= e - s
                j += 1
    return out


def find_secrets(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", least: float = 14.0, least_each: float = 0.5) -> DataFrame:
    """(id, spans) for each document: all finds in order of start, then kind; ends are exclusive, in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, candidate, model = compiled_rules(), re.compile(CANDIDATE), shared.value
        kinds = [r[0] for r in RULES]
        for b in batches:
            for part in small_slices(b, 1):
                rows = []
                for t in part.column(1).to_pylist():
                    base = rule_spans(t, compiled)
                    found = [(s, k, e, math.inf) for s, k, e in base]
                    tokens = [m.span() for m in candidate.finditer(t)]
                    for (s, e), covered in zip(tokens, as_long(base, tokens, len(kinds))):
                        if covered:
                            continue
                        score = log_ratio(t[s:e], model)
                        if score >= least and score >= least_each * (e - s):
                            found.append((s, len(kinds), e, score))
                    rows.append([{"kind": (*kinds, MARKOV)[k], "start": s, "end": e, "score": None if x == math.inf else x} for s, k, e, x in sorted(found)])
                spans = pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
                yield pa.RecordBatch.from_arrays([part.column(0), spans], [id_col, "spans"])

    rows = docs.select(F.col(id_col), text_of(text_col).alias("t"))
    return rows.mapInArrow(released(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, spans {SPANS}")
