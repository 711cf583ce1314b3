"""SimHash links, hard negatives and phrases against brute force on small tables."""

import itertools
import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspark.llm import hard_negatives, phrases, simhash

DOCS = "doc_id long, text string, lang string"


def fingerprint(text, size=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("most", [1, 2, 3, 6, 9])
def test_every_close_pair_has_a_viable_chain(most):
    rng, index = random.Random(most), simhash.index_masks(most)
    for _ in range(3000):
        apart = sum(1 << b for b in rng.sample(range(64), rng.randint(0, most)))
        budgets = list(enumerate(simhash.steps(most)))
        assert any(not apart & mask and all((apart & simhash.chain(i, n) & (2**64 - 1)).bit_count() <= b for b, n in budgets) for i, mask in index)


@pytest.mark.parametrize("size", [1, 3])
@pytest.mark.parametrize("part", [7, 1 << 20])
def test_fingerprint_by_definition(monkeypatch, size, part):
    rng = random.Random(part)
    texts = ["", " \t\n", "One", "a B", "a b c", "é x É y", "one two three " * 40] + [" ".join(rng.choice("abcdé") * rng.randint(1, 30) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    monkeypatch.setattr(simhash.word_lists, "__defaults__", (part,))
    for t in texts:
        assert simhash.fingerprint(t.encode(), size) == signed(fingerprint(t, size))


def brute_roots(points, most):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(points), 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= most and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in points}


@pytest.mark.parametrize("most", [1, 3])
def test_links_against_brute_force(spark, most):
    rng, points = random.Random(7), {0, -1}
    for group in range(8):
        centre = rng.getrandbits(64)
        for _ in range(80):  # many share keys without being close, some only through others
            points.add(signed(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2 + group)))))
    at = rng.getrandbits(64)
    for _ in range(30):  # a chain whose ends are far apart
        at ^= sum(1 << b for b in rng.sample(range(64), most))
        points.add(signed(at))
    classes = spark.createDataFrame([(p,) for p in points], "rid long")
    got = {r.node: r.root for r in simhash.linked(classes, most).collect()}
    want = brute_roots(points, most)
    assert {p: got.get(p, p) for p in points} == want and any(p != r for p, r in want.items())
    assert simhash.linked(classes.where("rid = 0"), most) is None


def test_similar_documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 5, 300]))), "en") for i in range(30)]
    for i in range(40, 60):  # near copies of long texts
        w = rows[rng.randrange(30)][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "en"))
    rows += [(70, None, None), (71, "", "en"), (72, " \n", "en"), (None, rows[3][1].upper(), "de"), (73, rows[4][1], "en"), (73, rows[4][1], "en")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("id", "fp", "rid", "root", "first", "key")})
    got = simhash.similar_documents(df).collect()
    assert len(got) == len(rows)
    print_of = {i: fingerprint(t) for i, t, _ in rows}
    roots = brute_roots({signed(x) for x in print_of.values()}, 3)
    least = {}
    for i, x in print_of.items():
        if i is not None:
            least[roots[signed(x)]] = min(i, least.get(roots[signed(x)], i))
    for r in got:
        assert r.fingerprint == f"{print_of[r.doc_id]:016x}" and r.component_id == least[roots[signed(print_of[r.doc_id])]]
    assert least[roots[0]] == 70 and simhash.similar_documents(df.limit(0)).count() == 0


def brute_negatives(rows, positives=5, negatives=10, low=30, high=90):
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda s, r: (-s, r[0] is None, r[0] or 0)
    out = []
    for a, anchor in enumerate(kept):
        if anchor[0] is None or anchor[0] % 4:
            continue
        scored = sorted(((sum(x * y for x, y in zip(anchor[1], r[1])), r) for b, r in enumerate(kept) if a != b), key=lambda x: order(*x))
        for p, pos in [x for x in scored if x[1][2] == anchor[2]][:positives]:
            fit = [(s, r) for s, r in scored if r[2] != anchor[2] and low * p <= 100 * s <= high * p]
            out += [(anchor[0], pos[0], k + 1, r[0], p, s) for k, (s, r) in enumerate(fit[:negatives])]
    return out


def vectors(rng, n, dims):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [float(np.float32(x + rng.gauss(0, 0.4))) for x in c], rng.randint(0, 2)))
    return rows


@pytest.mark.parametrize("dims, batch", [(8, 1000), (70, 7)])
def test_hard_negatives_against_brute_force(spark, dims, batch):
    rng = random.Random(dims)
    rows = vectors(rng, 160, dims)
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(20)]  # ties
    rows += [(300, None, 1), (304, [1.0] * dims, None), (308, [math.nan] + [1.0] * (dims - 1), 1), (312, [math.inf] * dims, 1), (316, [None] + [1.0] * (dims - 1), 1)]
    rows += [(None, rows[5][1], 1), (320, rows[9][1][:3], 0), (324, [], 1), (328, [0.0] * dims, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("id", "rid", "v", "codes", "anchor", "score")}).repartition(5)
    got = hard_negatives.mined(df, F.col("id") % 4 == 0, batch=batch)
    want = brute_negatives(rows)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 300
    assert hard_negatives.mined(df.limit(0), F.col("id") % 4 == 0).count() == 0


def test_rows_with_one_id_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.5, 0.0], 2)]
    got = hard_negatives.mined(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("id") % 4 == 0).collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 1, 1, 65536, 32768)] * 2


def test_open_pairs_are_scored_a_few_at_a_time(monkeypatch):
    """All open pairs of a batch of anchors and a block of rows were held, and copied with their vectors, at once."""
    rng = np.random.default_rng(2)
    x, label = rng.integers(-300, 300, (400, 8)), rng.integers(0, 3, 400)
    codes, facts = hard_negatives.coded(x.astype(float))
    held = {k: pa.array([r.tobytes() for r in c], pa.binary()) for k, c in (("v", x), ("codes", codes), ("facts", facts))}
    batch = pa.record_batch({"rid": np.arange(400), "id": np.arange(400), "label": label, **held})
    rows = SimpleNamespace(mapInArrow=lambda run, _: list(run(iter([batch]))))

    def best():
        anchors = SimpleNamespace(value=(np.arange(150), label[:150], x[:150]))
        near = hard_negatives.best_positives(rows, anchors, 2, 8, hard_negatives.LEVELS)
        found = pa.Table.from_batches(near).to_pydict()
        which, known = np.array(found["rid"]).reshape(150, 2), np.array(found["score"]).reshape(150, 2)
        anchors.value += (which, known, np.full(150, 2))
        far = hard_negatives.best_negatives(rows, anchors, 3, 8, hard_negatives.LEVELS, (30, 90))
        return [pa.Table.from_batches(t).to_pylist() for t in (near, far)]

    want, seen, scores = best(), [], hard_negatives.scores
    for k, v in (("TILE", 2_000), ("HELD", 800), ("TOLD", 70)):
        monkeypatch.setattr(hard_negatives, k, v, raising=False)
    monkeypatch.setattr(hard_negatives, "scores", lambda a, b: seen.append(len(a)) or scores(a, b))
    assert best() == want and len(want[1]) > 300
    assert max(seen) <= 100


def test_bounds_hold_and_narrow(spark):
    rng = np.random.default_rng(1)
    for dims in (1, 3, 64, 100):
        v = np.floor(256 * rng.normal(size=(200, dims)) * rng.choice([0, 0.01, 1, 50], (200, 1)))
        codes, facts = hard_negatives.coded(v)
        anchors, rows, a = hard_negatives.Anchors(np.arange(20), np.zeros(20), v[:20]), np.arange(200)[None, :], np.arange(20)[:, None]
        estimate, lost, widths, true = 0.0, 0.0, [], v[:20] @ v.T
        for k in range(hard_negatives.LEVELS):
            along = anchors.along(a, codes[rows, k])
            estimate, lost = estimate + facts[rows, k] * along, lost + facts[rows, k] * anchors.lost[a]
            off = anchors.margin(a, along, facts[rows, hard_negatives.LEVELS + k], np.linalg.norm(v, axis=1)[rows], lost)
            assert (np.abs(true - estimate) <= off).all()
            widths.append(off.mean())
        assert widths[-1] < widths[0]


def test_scores_are_exact_or_an_error(spark):
    big = np.array([[2**52, 3]])
    assert hard_negatives.scores(np.array([[5, -7]]), np.array([[2, 3]])).tolist() == [-11]
    assert hard_negatives.scores(np.array([[2**40, 1]]), np.array([[2**22, 1]])).tolist() == [2**62 + 1]
    with pytest.raises(OverflowError):
        hard_negatives.scores(big, big)


def brute_phrases(rows, longest, least, covered, most):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    candidates, out = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}, {}
    for (lang, p), a in candidates.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
        if any(x == lang and len(q) > len(p) and 100 * b >= covered * a and inside(q) for (x, q), b in candidates.items()):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:most]))


@pytest.mark.parametrize("burst, held, words, part", [(16_384, 600_000, 1 << 19, 1 << 20), (4, 60, 30, 50)])
def test_phrases_against_brute_force(spark, monkeypatch, burst, held, words, part):
    for k, v in (("BURST", burst), ("HELD", held), ("WORDS_HELD", words), ("PART_BYTES", part)):
        monkeypatch.setattr(phrases, k, v)
    rng = random.Random(5)
    known = ["New", "york", "city", "the", "of", "ÉCOLE", "école", "x y", "a-b", "'", "\x1c", "news"]
    say = lambda n: "".join(rng.choices(known, [9, 8, 7, 6, 6, 2, 2, 2, 1, 1, 1, 1])[0] + rng.choices([" ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"], [30, 2, 2, 1, 1, 1, 1, 1])[0] for _ in range(n))
    rows = [(i, say(rng.choice([0, 1, 2, 30, 60])), rng.choice(["en", "en", "de", None, "und", ""])) for i in range(70)]
    rows += [(90, None, "en"), (91, "", None), (None, "null id " * 12, "en"), (92, "New york city " * 15, "fr"), (92, "New york city " * 15, "fr"), (93, say(3000), "en")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("n", "phrase", "size", "f", "a", "rank")})
    got = phrases.collocations(df, least=4, most=25).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    want = brute_phrases(rows, 3, 4, 50, 25)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 60
    assert phrases.collocations(df.limit(0)).count() == 0


def test_scores_of_phrases_beyond_64_bits(spark):
    a, left, right = 10**13 - 1, 3 * 10**13, 10**13 + 7
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(phrases.score_of().alias("s")).first().s == 1_000_000 * a * a // (left * right)


def test_a_trie_counts_as_a_counter_does(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 3)
    rng, want, trie = random.Random(1), Counter(), phrases.HatTrie(3)
    for _ in range(30):
        keys = np.array([sum(rng.choice([1, 2, 3, 130, 2**20]) << (phrases.WORD_BITS * j) for j in range(3)) for _ in range(40)])
        want.update(keys.tolist())
        trie.add(*np.unique(keys, return_counts=True))
    assert len(trie) == len(want)
    got = {}
    for digit, n in enumerate(trie.sizes):
        if n:
            got |= dict(zip(*(x.tolist() for x in trie.taken(digit))))
    assert got == dict(want) and len(trie) == 0
