"""The look-alikes of lookalikes.py for whole columns: the same permutations, worked on as matrices of characters.

Values of one rule and one length are a matrix of code points. A Feistel round takes one md5 sum a row, as before, and moves the characters
of all rows at once; a walk goes on only with the rows that have not ended. `look_alike` of lookalikes.py, made of Spark's own functions, gives the same
values, row by row, where no Python may run.

Null values and values of a null rule are null. Characters beyond ASCII stay. Values of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lookalikes import CAPITAL, DIGITS, HEX_CAPITAL, HEX_RULES, HEX_SMALL, ROUNDS, SMALL, WALK

PLAIN = (DIGITS, SMALL, CAPITAL)
#: Code points that a matrix has at most.
HELD = 1 << 20


def _texts(x: np.ndarray) -> list[str]:
    n, size = x.shape
    whole = np.ascontiguousarray(x).astype("<u4").tobytes().decode("utf-32-le")
    return [whole[i : i + size] for i in range(0, n * size, size)] if size else [""] * n


def _matrix(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").reshape(len(texts), -1) if texts and texts[0] else np.zeros((len(texts), 0), np.uint32)


def _bytes(x: np.ndarray) -> list[bytes]:
    n, size = x.shape
    if not size or x.max(initial=0) >= 128:
        return [t.encode() for t in _texts(x)]
    whole = x.astype(np.uint8).tobytes()
    return [whole[i : i + size] for i in range(0, n * size, size)]


def _joined(*parts: np.ndarray) -> np.ndarray:
    return np.concatenate(parts, axis=1)


def _keys(key: bytes, x: np.ndarray) -> list[bytes]:
    return [key + b for b in _bytes(x)]


@lru_cache
def _tables(alphabets: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each ASCII character its alphabet (from 1; 0: none) and its place there; of each alphabet its size and its letters."""
    of, place = np.zeros(129, np.intp), np.zeros(129, np.int64)
    sizes, letters = np.ones(len(alphabets) + 1, np.int64), np.zeros((len(alphabets) + 1, max(map(len, alphabets))), np.uint32)
    for k, a in reversed(list(enumerate(alphabets, 1))):
        codes = np.frombuffer(a.encode(), np.uint8)
        of[codes], place[codes], sizes[k], letters[k, : len(a)] = k, np.arange(len(a)), len(a), codes
    return of, place, sizes, letters


def permuted(x: np.ndarray, keys: bytes | list[bytes], alphabets: tuple[str, ...] = PLAIN) -> np.ndarray:
    """Each row's place in the permutation that its key names."""
    n, size = x.shape
    of, place, sizes, letters = _tables(alphabets)
    x, m, keys = x.astype(np.uint32), size // 2, [keys] * n if isinstance(keys, bytes) else keys
    for k in range(ROUNDS):
        half, other = (x[:, :m], x[:, m:]) if k % 2 == 0 else (x[:, m:], x[:, :m])
        if not half.shape[1]:
            continue
        told = _bytes(other)
        sums = [np.frombuffer(b"".join([md5(p + mark + t).digest() for p, t in zip(keys, told, strict=True)]), np.uint8).reshape(n, 16) for mark in (b":%d:%d:" % (k, b) for b in range((half.shape[1] - 1) // 16 + 1))]
        ascii_ = np.minimum(half, 128)
        own = of[ascii_]
        moved = letters[own, (place[ascii_] + _joined(*sums)[:, : half.shape[1]]) % sizes[own]]
        half[:] = np.where(own > 0, moved, half)
    return x


def _walked(x: np.ndarray, step: Callable[[np.ndarray], np.ndarray], holds: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """step() again and again until holds(): at least once."""
    x, left = x.copy(), np.arange(len(x))
    for _ in range(WALK):
        if not len(left):
            return x
        x[left] = step(x[left])
        left = left[~holds(x[left])]
    if len(left):
        raise ValueError("no look-alike found on the walk")
    return x


def luhn_sum(x: np.ndarray) -> np.ndarray:
    back = x[:, ::-1].astype(np.int64) - 48
    digit = (back >= 0) & (back <= 9)
    twice = np.cumsum(digit, axis=1) % 2 == 0
    return (np.where(twice, 2 * back - np.where(back > 4, 9, 0), back) * digit).sum(1)


def _mod97(x: np.ndarray) -> np.ndarray:
    if x.max(initial=0) >= 128:  # signs that in capitals are letters
        return np.array([_mod97(_matrix([t.upper().encode("ascii", "ignore").decode()]))[0] for t in _texts(x)])
    out = np.zeros(len(x), np.int64)
    for c in x.T.astype(np.int64):
        digit, letter = (c >= 48) & (c <= 57), ((c >= 65) & (c <= 90)) | ((c >= 97) & (c <= 122))
        out = np.where(digit, (out * 10 + c - 48) % 97, np.where(letter, (out * 100 + c % 32 + 9) % 97, out))
    return out


def iban_holds(x: np.ndarray) -> np.ndarray:
    check = (x[:, 2].astype(np.int64) << 32) + x[:, 3]
    return (_mod97(_joined(x[:, 4:], x[:, :4])) == 1) & (check >= (ord("0") << 32) + ord("2")) & (check <= (ord("9") << 32) + ord("8"))


def _parted(x: np.ndarray, kinds: np.ndarray, ways: dict[int, Callable[[np.ndarray], np.ndarray]]) -> np.ndarray:
    """Each row by the way of its kind."""
    out = x.copy()
    for kind, way in ways.items():
        if len(at := np.flatnonzero(kinds == kind)):
            out[at] = way(x[at])
    return out


def _card(x: np.ndarray, key: bytes, keep: int = 1) -> np.ndarray:
    digit = (x >= 48) & (x <= 57)
    size = x.shape[1]

    def passing(v: np.ndarray) -> np.ndarray:
        ends = size - np.argmax(((v >= 48) & (v <= 57))[:, ::-1], axis=1) - 1

        def of(end: int) -> Callable[[np.ndarray], np.ndarray]:
            def one(w: np.ndarray) -> np.ndarray:
                body = _joined(w[:, :keep], permuted(w[:, keep:end], _keys(key + b":", w[:, :keep]), (DIGITS,)))
                check = (10 - luhn_sum(_joined(body, np.full((len(w), 1), 48, np.uint32))) % 10) % 10
                return _joined(body, (check[:, None] + 48).astype(np.uint32), w[:, end + 1 :])

            return one

        return _parted(v, ends, {int(e): of(int(e)) for e in np.unique(ends)})

    def failing(v: np.ndarray) -> np.ndarray:
        return _walked(v, lambda w: _joined(w[:, :keep], permuted(w[:, keep:], _keys(key + b":x:", w[:, :keep]), (DIGITS,))), lambda w: luhn_sum(w) % 10 != 0)

    kinds = np.where(digit.sum(1) < keep + 2, 0, np.where(luhn_sum(x) % 10 == 0, 1, 2))
    return _parted(x, kinds, {0: lambda v: permuted(v, key, (DIGITS,)), 1: passing, 2: failing})


def _iban(x: np.ndarray, key: bytes) -> np.ndarray:
    if x.shape[1] < 5:
        return permuted(x, key)

    def right(v: np.ndarray) -> np.ndarray:
        new, country = permuted(v[:, 4:], _keys(key + b":", v[:, :2])), v[:, :2]
        check = 98 - _mod97(_joined(new, country, np.full((len(v), 2), 48, np.uint32)))
        return _joined(country, (np.stack([check // 10, check % 10], 1) + 48).astype(np.uint32), new)

    def wrong(v: np.ndarray) -> np.ndarray:
        return _walked(v, lambda w: _joined(w[:, :2], permuted(w[:, 2:], _keys(key + b":x:", w[:, :2]))), lambda w: ~iban_holds(w))

    return _parted(x, iban_holds(x).astype(int), {0: wrong, 1: right})


def _hexadecimal(x: np.ndarray, key: bytes) -> np.ndarray:
    capital, small = ((x >= 65) & (x <= 70)).any(1), ((x >= 97) & (x <= 102)).any(1)
    upper = lambda v: _walked(v, lambda w: permuted(w, key + b":A", (HEX_CAPITAL,)), lambda w: ((w >= 65) & (w <= 70)).any(1))
    mixed = lambda v: permuted(v, key + b":aA", (DIGITS, "abcdef", "ABCDEF"))
    return _parted(x, capital.astype(int) + 2 * small, {0: lambda v: permuted(v, key + b":a", (HEX_SMALL,)), 1: upper, 2: lambda v: permuted(v, key + b":a", (HEX_SMALL,)), 3: mixed})


def _of_rule(x: np.ndarray, rule: str, key: str) -> np.ndarray:
    named = f"{key}:{rule}".encode()
    if rule == "credit_card":
        return _card(x, named)
    if rule == "iban":
        return _iban(x, named)
    if rule not in HEX_RULES:
        return permuted(x, named)
    prefixed = (x[:, 0] == ord("0")) & (x[:, 1] == ord("x")) if rule == "eth_address" and x.shape[1] > 1 else np.zeros(len(x), bool)
    return _parted(x, prefixed.astype(int), {0: lambda v: _hexadecimal(v, named), 1: lambda v: _joined(v[:, :2], _hexadecimal(v[:, 2:], named))})


def look_alikes_of(rules: pa.Array, values: pa.Array, key: str = "") -> pa.Array:
    """The look-alike of each value by its rule."""
    sizes = pc.utf8_length(values).fill_null(0).to_numpy(zero_copy_only=False)
    coded = rules.dictionary_encode()
    kinds = np.where(pc.is_null(values).to_numpy(zero_copy_only=False), -1, coded.indices.fill_null(-1).to_numpy(zero_copy_only=False))
    out, given = [None] * len(values), values.to_pylist()
    order = np.lexsort((sizes, kinds))
    edges = np.flatnonzero(np.r_[True, (np.diff(kinds[order]) != 0) | (np.diff(sizes[order]) != 0)]) if len(order) else []
    for group in np.split(order, edges[1:]) if len(order) else []:
        if kinds[group[0]] < 0:
            continue
        rule, most = coded.dictionary[int(kinds[group[0]])].as_py(), max(1, HELD // max(1, int(sizes[group[0]])))
        for at in range(0, len(group), most):
            some = group[at : at + most].tolist()
            for i, t in zip(some, _texts(_of_rule(_matrix([given[i] for i in some]), rule, key)), strict=True):
                out[i] = t
    return pa.array(out, pa.string())


def look_alike(rule: Column, value: Column, key: str = "") -> Column:
    """As lookalikes.look_alike(), for columns of many values."""

    @F.arrow_udf("string")
    def made(rules: pa.Array, values: pa.Array) -> pa.Array:
        return look_alikes_of(rules, values, key)

    return made(rule, value)
