"""Secrets, licenses, quality rules, line dedup and mixing against brute force on small tables."""

import hashlib
import math
import random
import re
import string
import time
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from veilspark.llm import kneser_ney as kn
from veilspark.llm import license_signatures, licenses, line_dedup, mixing, quality, queries, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from".split()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def save(df, tmp_path):
    path = tmp_path / "sf"
    df.write.mode("overwrite").parquet(str(path / "documents.parquet"))
    return str(path)


def test_secret_rules_and_model(spark, tmp_path):
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = []
    for i in range(90):
        key, access, digest = ("".join(rng.choice(a) for _ in range(n)) for a, n in ((alphabet, 40), (alphabet[:26], 14), ("0123456789abcdef", 20)))
        names = " ".join(f"{rng.choice(WORDS)}_{rng.choice(WORDS)}_identifier_of_function" for _ in range(12))
        rows.append((i, f"{prose(rng, 40)} API_KEY = '{key}' AKIA{access} {digest} {names} é {prose(rng, 5)}"))
    rows[0] = (0, "AKIA" + "X" * 14 + " and AKIA" + "X" * 13 + " deadbeefdeadbeef0 " + rows[0][1])
    held_out = "".join(rng.choice(alphabet) for _ in range(40))
    rows += [(100, f"x {held_out} y"), (101, "this_is_an_ordinary_identifier_of_some_length"), (102, None), (103, ""), (103, ""), (None, "token:" + "a" * 12), (104, "ſecret=aaaaaaaaaaaaaa password = short")]
    sf = save(docs(spark, rows), tmp_path)
    got = {(r.doc_id, r.spans): r for r in queries.op1_secrets(spark, sf).collect()}
    compiled = [(k, re.compile(p), g, n) for k, p, g, n in secrets.RULES]
    for doc_id, text in rows:
        base = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, g, n) in enumerate(compiled) for m in p.finditer(text or "") if len(m[g]) >= n)
        want = hashlib.sha256(",".join(b[2] for b in base).encode()).hexdigest()
        assert any(r.base_sha256 == want for (d, _), r in got.items() if d == doc_id)
    found = {d: s for d, s in got}
    assert found[100] == "markov:2:42"
    assert found[101] == "" and found[102] == "" and found[103] == ""
    assert "assign:0:18" in found[None]
    assert "assign" not in found[104]


def test_secret_training_is_the_same_for_labelled_tables(spark):
    rows = [("abc", 0), ("Zx9", 1), (None, 1), ("q", None)]
    counts = secrets.count_labelled(spark.createDataFrame(rows, "value string, label int"))
    assert counts.agg(F.sum("n")).first()[0] == 8
    assert np.allclose(secrets.fit(counts.where("n < 0")), 0)


def _labelled(rng, n: int) -> list[tuple[str, int]]:
    """Random strings of several alphabets, and identifiers that people make of words."""
    alphabets = ["0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits]
    syllables = [a + b for a in "bcdfghlmnprstvw" for b in "aeiou"] + ["tion", "ing", "er", "ment", "get", "set", "user", "file", "index"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(400)]
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(12, 44))), 1) for _ in range(n)]
    for _ in range(n):
        parts = rng.choices(words, k=rng.randint(2, 5))
        joined = rng.choice(["_", "-", ""]).join(p.title() if rng.random() < 0.4 else p for p in parts)
        out.append((joined + (str(rng.randint(0, 99)) if rng.random() < 0.2 else ""), 0))
    return out


def test_markov_precision_and_recall_on_held_out_samples(spark):
    rng = random.Random(8)
    learned, held = _labelled(rng, 3000), [x for x in _labelled(rng, 2000) if len(x[0]) >= secrets.LEAST_CHARS]
    ratios = secrets.fit(secrets.count_labelled(spark.createDataFrame(learned, "value string, label int")))
    rows = spark.createDataFrame([(i, f"a {v} b") for i, (v, _) in enumerate(held)], "doc_id long, text string")
    told = {r.doc_id: [s for s in r.spans if s.kind == secrets.MARKOV or s.kind == "hex"] for r in secrets.find_secrets(rows, ratios).collect()}
    hits = sum(1 for i, (_, y) in enumerate(held) if y and told[i])
    wrong = sum(1 for i, (_, y) in enumerate(held) if not y and told[i])
    recall, precision = hits / sum(y for _, y in held), hits / max(1, hits + wrong)
    print(f"precision {precision:.3f}, recall {recall:.3f}")
    assert precision >= 0.98 and recall >= 0.85


def test_markov_spans_against_brute_force(spark):
    rng = random.Random(9)
    counted: dict = {0: Counter(), 1: Counter()}
    samples = _labelled(rng, 300)
    for value, label in samples:
        counted[label].update(zip("\n" + value, value + "\n"))
    states = [*secrets.ALPHABET, "\n", "other"]

    pairs, single, before = {}, {}, {}
    for label in (0, 1):
        pairs[label] = Counter()
        for (x, y), n in counted[label].items():
            pairs[label][x if x in states else "other", y if y in states else "other"] += n
        single[label] = {c: 1.0 + sum(n for (_, y), n in pairs[label].items() if y == c) for c in states}
        before[label] = {c: sum(n for (x, _), n in pairs[label].items() if x == c) for c in states}

    def share(label: int, a: str, b: str) -> float:
        return math.log((pairs[label][a, b] + 200.0 * single[label][b] / sum(single[label].values())) / (before[label][a] + 200.0))

    table = {(a, b): share(1, a, b) - share(0, a, b) for a in states for b in states if (a, b) != ("other", "other")}
    ratios = secrets.fit(secrets.count_labelled(spark.createDataFrame(samples, "value string, label int")))
    texts = ["", "word " * 10, *[" ".join(rng.choice(samples)[0] for _ in range(8)) for _ in range(40)], "token = " + "aZ9k" * 6 + " 0123456789abcdef0123Zq"]
    got = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ratios).collect()
    for r in got:
        text = texts[r.doc_id]
        base = [(s.start, s.end) for s in r.spans if s.kind != secrets.MARKOV]
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{12,}", text):
            score = sum(table[a, b] for a, b in zip("\n" + m[0], m[0] + "\n"))
            beside = all(e <= m.start() or m.end() <= s or e - s < m.end() - m.start() for s, e in base)
            if beside and score >= 14.0 and score >= 0.5 * len(m[0]):
                want.append((m.start(), m.end(), round(score, 6)))
        assert [(s.start, s.end, round(s.score, 6)) for s in r.spans if s.kind == secrets.MARKOV] == want, text


def test_tokens_under_base_spans_against_brute_force():
    rng = random.Random(12)

    def disjoint():
        cuts = sorted(rng.sample(range(120), 2 * rng.randint(0, 12)))
        return list(zip(cuts[::2], cuts[1::2]))

    for _ in range(300):
        tokens, base = disjoint(), sorted((s, k, e) for k in range(3) for s, e in disjoint())
        assert secrets.as_long(base, tokens, 3) == [any(x < e and s < y and y - x >= e - s for x, _, y in base) for s, e in tokens]
    many = [(10 * i, 10 * i + 8) for i in range(100_000)]
    assert secrets.as_long([(s, i % 3, e - i % 2) for i, (s, e) in enumerate(many)], many, 3) == [i % 2 == 0 for i in range(100_000)]


def test_licenses_against_word_positions(spark, tmp_path):
    rows = [
        (1, "Under THE MIT-License. under the mit license; under the mit license"),
        (2, "Apache License, Version 2.0 and GPL version 3; cc by nc 4.0 license"),
        (3, "SPDX-License-Identifier: BSD-3-Clause"),
        (4, None), (5, ""), (6, "mit dem Hund, ohne Lizenz"), (7, "é under the mit licensé"),
        (8, "licensed under the terms of the GNU General Public License version 2"),
    ]
    got = {r.doc_id: r for r in queries.op5_licenses(spark, save(docs(spark, rows), tmp_path)).collect()}
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = got[doc_id]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
    assert got[3].labels == "bsd-3-clause" and got[3].score == 1.0
    assert got[8].labels == "gpl-2" or "gpl" in got[8].labels
    assert got[6].labels == "" and got[6].score == 0.0
    assert len(licenses.signatures()) >= 200


def test_license_keywords_are_in_all_that_a_signature_matches():
    rules = licenses.signatures()
    gated = licenses.by_keyword(rules)
    around = ("spdx license identifier {} {}", "{} licence version {}", "{} v {}", "{} license v {}", "released under the {} license", "governed by the {} license", "the {} licence")
    for label, names, *_, versions in licenses.FAMILIES:
        for name in names.split("|"):
            for form in around:
                if versions or "{} {}" not in form and " v" not in form:
                    words = licenses.words_of(form.format(name, versions.split("|")[0]).encode())
                    text = b" ".join(words)
                    want = licenses.suppressed([(m.start(), m.end(), p, la, f) for la, f, p, pattern, _, _ in rules for m in pattern.finditer(text)])
                    got = [(x["label"], x["rule"]) for x in licenses.scan(words, gated) if x["rule"] != "base"]
                    assert got == [(x[3], x[4]) for x in want], text
                    assert any(la.startswith(label) for la, _ in got), text


def _example(rng, expression: str) -> str:
    """A string that the expression matches."""
    from re import _constants as k, _parser

    def made(parsed) -> str:
        out = []
        for op, arg in parsed:
            if op is k.LITERAL:
                out.append(chr(arg))
            elif op is k.IN:
                kind, x = rng.choice(arg)
                out.append("w" if kind is k.CATEGORY else chr(rng.randint(*x) if kind is k.RANGE else x))
            elif op is k.MAX_REPEAT:
                low, high, inner = arg
                out += [made(inner) for _ in range(rng.randint(low, min(int(high), low + 2)))]
            elif op is k.BRANCH:
                out.append(made(rng.choice(arg[1])))
            elif op is k.SUBPATTERN:
                out.append(made(arg[3]))
            else:
                raise AssertionError(op)
        return "".join(out)

    return made(_parser.parse(expression))


def _plainly_suppressed(found):
    kept = []
    for x in sorted(found, key=lambda m: (-m[2], m[0] - m[1], m[0], m[3], m[4])):
        if not any(y[0] <= x[0] and x[1] <= y[1] for y in kept):
            kept.append(x)
    return sorted(kept)


def test_license_signatures_against_ungated_matching():
    rng, rules = random.Random(3), licenses.signatures()
    gated, lines = licenses.by_keyword(rules), license_signatures.lines()
    assert len(lines) >= 200 and len({x for _, _, x in lines}) == len(lines)
    for label, _, expression in lines:
        for _ in range(4):
            own = _example(rng, expression)
            assert re.fullmatch(expression, own), expression
            have = {*own.split(), *(["license"] if "licence" in own.split() else [])}
            assert {*licenses.keywords(expression)} <= have, (expression, own)
    for _ in range(60):
        pieces = [_example(rng, rng.choice(lines)[2]) if rng.random() < 0.7 else "some words between under the mit license" for _ in range(rng.randrange(1, 6))]
        words = licenses.words_of(" ".join(pieces).encode())
        text = b" ".join(words)
        want = _plainly_suppressed([(m.start(), m.end(), p, la, f) for la, f, p, pattern, _, _ in rules for m in pattern.finditer(text)])
        got = [x for x in licenses.scan(words, gated) if x["rule"] != "base"]
        assert [(x["label"], x["rule"], x["first"], x["last"]) for x in got] == [(x[3], x[4], text.count(b" ", 0, x[0]), text.count(b" ", 0, x[1])) for x in want]


def test_a_long_text_of_repeated_notices():
    words = licenses.words_of(b"permission is hereby granted free of charge to any person obtaining a copy of this software under the mit license " * 8_000)
    began = time.time()
    found = licenses.scan(words, licenses.by_keyword(licenses.signatures()))
    assert len([x for x in found if x["rule"] == "base"]) == 8_000 and time.time() - began < 60


def test_suppression_keeps_the_higher_of_nested_finds():
    found = [(0, 10, 50, "a", "mention"), (2, 8, 90, "b", "title"), (0, 30, 80, "c", "grant"), (40, 50, 50, "d", "mention"), (45, 60, 50, "e", "mention")]
    assert [x[3] for x in licenses.suppressed(found)] == ["c", "b", "d", "e"]


def test_quality_counts_against_plain_python(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 120)) + rng.choice(["", "\n\nend", " # $ <x>"])) for i in range(80)]
    rows += [(200, "a b c " * 40), (201, None), (202, ""), (203, "x\ny\nx\n\n \nx"), (204, "\x1c a\x85b"), (205, rows[0][1]), (205, rows[0][1])]
    got = {}
    for r in queries.op2_quality(spark, save(docs(spark, rows), tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        r = got[doc_id][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and r.kept)


def brute_kneser_ney(texts):
    """Modified Kneser-Ney over tuples of symbols, straight from the definition."""
    grams = Counter()
    for t in texts:
        s = kn.symbols([t]).tolist()
        for i in range(len(s) - kn.ORDER + 1):
            grams[tuple(s[i : i + kn.ORDER])] += 1
    levels = {kn.ORDER: grams}
    for n in range(kn.ORDER - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    p = {(): 2.0**-kn.BITS}
    for n in range(1, kn.ORDER + 1):
        c = levels[n]
        of = Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else 0

        def d(k):
            k = min(k, 3)
            usual = k - (k + 1) * y * of[k + 1] / of[k] if of[1] and of[k] else 0
            return usual if 0 < usual <= k else 0.5 * k

        total, back = defaultdict(int), defaultdict(float)
        for g, k in c.items():
            total[g[:-1]] += k
            back[g[:-1]] += d(k)
        for g, k in c.items():
            p[g] = (k - d(k)) / total[g[:-1]] + back[g[:-1]] / total[g[:-1]] * p[g[1:]]
    return p


def test_kneser_ney_against_the_definition_and_both_ways_to_score(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(0, 30)) for _ in range(25)] + ["", "é漢字 1 22"]
    df = docs(spark, enumerate(texts))
    model = kn.estimate(kn.count(df, F.lit("en"), F.col("text")))
    p = brute_kneser_ney(texts)
    rows = docs(spark, [*enumerate(texts), (900, "zq zq unseen words ñ"), (901, None)]).select(F.col("doc_id").alias("key"), "lang", "text")
    fast = {r.key: r for r in kn.score(rows, model).collect()}
    slow = {r.key: r for r in kn.score(rows, model, bound=0).collect()}
    for i, t in enumerate(texts):
        s = kn.symbols([t]).tolist()
        want = -sum(math.log(p[tuple(s[k : k + kn.ORDER])]) for k in range(len(s) - kn.ORDER + 1))
        assert abs(fast[str(i)].loss - want) < 1e-3 and fast[str(i)].n == len(s) - kn.ORDER + 1
    for key, r in fast.items():
        assert abs(r.loss - slow[key].loss) < 1e-3 and r.n == slow[key].n


def test_perplexity_bands_reject_strangers(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 80)) for i in range(200)] + [(900, " ".join("".join(rng.choice("zxqjkvwpñß#") for _ in range(7)) for _ in range(80)))]
    kept = {r.doc_id: r.kept for r in quality.judged(docs(spark, rows)).collect()}
    assert not kept[900] and sum(kept.values()) >= 195
    assert quality.kept_documents(docs(spark, rows)).count() == sum(kept.values())
    assert quality.judged(docs(spark, [])).count() == 0


def test_quality_bounds_are_fitted_on_labels(spark):
    rng = random.Random(14)
    rows, labels = [], []
    for i in range(500):
        text = prose(rng, 120)
        if i >= 400:
            text = " ".join(w + rng.choice(["", "", "#", "*"]) for w in text.split())
        rows.append((i, text))
        labels.append((i, int(i < 400)))
    told = spark.createDataFrame(labels, "doc_id long, quality int")
    df = docs(spark, rows)
    kept = {r.doc_id for r in quality.judged(df, labels=told).where("kept").collect()}
    assert 400 * (1 - quality.LOSS) <= len([i for i in kept if i < 400])
    assert len([i for i in kept if i >= 400]) < 20
    plain = {r.doc_id for r in quality.judged(df, labels=told.limit(50)).where("kept").collect()}
    assert len(plain) >= len(kept)  # too few labels: the given bounds
    assert quality.fitted(np.zeros(10), np.ones(10, bool), 0.01) is None


def test_rare_languages_share_a_band(spark):
    rng = random.Random(15)
    odd = " ".join("".join(rng.choice("zxqjkvwpñß#") for _ in range(7)) for _ in range(80))
    rows = [(i, prose(rng, 80), "en") for i in range(100)] + [(200 + i, prose(rng, 80), f"x{i % 4}") for i in range(120)] + [(900, odd, "x1")]
    df = spark.createDataFrame([(i, t, la, "s", len(t)) for i, t, la in rows], DOCS)
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    assert not got[900].kept and sum(r.kept for r in got.values()) >= 215
    few = quality.judged(df.where("lang = 'en' OR doc_id IN (200, 201)")).where("doc_id >= 200").collect()
    assert all(r.kept and r.lower is None and r.upper is not None for r in few)


def brute_lines(rows):
    seen, gone = {}, defaultdict(set)
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines = (text or "").split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not re.search(r"[^\x20\x09-\x0D]", "".join(w)):
                continue
            if w in seen:
                gone[doc_id] |= {i, i + 1, i + 2}
            else:
                seen[w] = (doc_id, i)
    return {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[d]) for d, t in rows}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, "\n".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 14)))) for i in range(60)]
    rows += [(70, "a\na\na\na\na"), (71, None), (72, ""), (73, "\n\n\n\n"), (None, "a\nb\nc\nd")]
    df = docs(spark, rows).withColumn("n_lines", F.lit(-1)).withColumn("w1", F.lit("clash"))
    done = line_dedup.dedup_lines(df)
    assert done.columns == [*df.columns, "_n_lines", "n_removed"]
    got = {r.doc_id: r for r in done.collect()}
    for doc_id, text in brute_lines(rows).items():
        assert (got[doc_id].text or "") == text
        assert got[doc_id]._n_lines - got[doc_id].n_removed == (len(text.split("\n")) if text or got[doc_id]._n_lines != got[doc_id].n_removed else 0)
    assert got[71].text is None and got[70].w1 == "clash"
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_repeated_rows_are_one_document_to_line_dedup(spark):
    done = line_dedup.dedup_lines(docs(spark, [(1, "a\nb\nc"), (1, "a\nb\nc")])).collect()
    assert [r.text for r in done] == ["a\nb\nc"] * 2


def clauses(rng, n):
    return " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 99)}" + ("," if k % 7 == 6 else "." if k % 17 == 16 else "") for k in range(n))


def test_passages_inside_lines_go_from_later_places(spark):
    rng = random.Random(12)
    passage = clauses(rng, 50)
    inner = passage[passage.index(",") + 2 : passage.rindex(",") + 2]
    own = [clauses(rng, 60) for _ in range(4)]
    rows = [(1, f"{own[0]} {passage} {own[1]}"), (2, f"{own[2]} {passage} {own[3]}"), (3, None), (4, "")]
    rows += [(i, f"{clauses(rng, 70)} yes, no, well, {clauses(rng, 30)}\n\nend.\t x") for i in range(10, 60)]
    df = docs(spark, rows).withColumn("n_cut", F.lit("clash"))
    done = line_dedup.dedup_passages(df)
    assert done.columns == [*df.columns, "_n_cut"]
    got = {r.doc_id: r for r in done.collect()}
    assert got[2].text == rows[1][1].replace(inner, "") and got[2]._n_cut == len(inner) and len(inner.split()) > 30
    assert all(got[i].text == t and got[i]._n_cut == 0 for i, t in rows if i != 2)
    lines = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert inner in lines[2]  # three whole lines do not see it
    kept = {r.doc_id: r for r in corpus_pipeline.near_duplicates(spark, docs(spark, rows), "").collect()}
    assert inner in kept[1].text and inner not in kept[2].text and kept[2].n_chars == len(kept[2].text)


def brute_mix(rows, alpha, seed, sweeps=400):
    cells = defaultdict(float)
    for _, dims, n in rows:
        cells[dims] += n
    cells = {c: n for c, n in cells.items() if n}
    k = len(next(iter(cells)))
    targets = []
    for d in range(k):
        sums = defaultdict(float)
        for c, n in cells.items():
            sums[c[d]] += n
        total = sum(v**alpha for v in sums.values())
        targets.append({v: x**alpha / total for v, x in sums.items()})
    w = dict(cells)
    for _ in range(sweeps):
        for d in range(k):
            sums = defaultdict(float)
            for c, x in w.items():
                sums[c[d]] += x
            w = {c: x * targets[d][c[d]] / sums[c[d]] for c, x in w.items()}
    ratio = {c: w[c] / cells[c] for c in cells}
    most = max(ratio.values())
    out = {}
    for doc_id, dims, n in rows:
        p = ratio[dims] / most if n else 0.0
        u = int(hashlib.md5(f"{seed}:{doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        out[doc_id] = (p, u < p)
    return out


def test_mixing_against_brute_force_one_partition_and_many(spark):
    rng = random.Random(13)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c"]), rng.choice(["en", "de", None]), rng.choice(["x", "y"]), rng.randint(0, 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n long").withColumn("mix_kept", F.lit("clash"))
    want = brute_mix([(i, (s, la or "", t), n) for i, s, la, t, n in rows], 0.7, 3)
    for bound in (mixing.CELL_BOUND, 0):
        done = mixing.mix(df, {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("topic")}, F.col("n"), alpha=0.7, seed=3, bound=bound)
        for r in done.collect():
            assert abs(r.mix_probability - want[r.doc_id][0]) < 1e-6 and r._mix_kept == want[r.doc_id][1] and r.mix_kept == "clash"
    assert mixing.mix_documents(docs(spark, [])).count() == 0


def test_mixing_meets_given_targets(spark):
    rows = [(i, "a" if i % 4 else "b", 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    done = mixing.mix(df, {"source": F.col("source")}, F.col("n"), targets={"source": {"a": 0.5, "b": 0.5, "absent": 9.0}})
    p = {r.source: r.p for r in done.groupBy("source").agg(F.max("mix_probability").alias("p")).collect()}
    assert abs(p["b"] - 1) < 1e-9 and abs(p["a"] - 1 / 3) < 1e-9


def test_a_whole_mix_keeps_every_document_and_meets_the_targets(spark):
    """The rarest source decided how many documents of all others went."""
    import corpus_pipeline

    said = "the cat sat on the mat and saw the dog run by the house of old"
    rows = [(i, said, "en", "web" if i % 3 else "books", len(said)) for i in range(3000)] + [(5000, said, "en", "rare", len(said)), (5001, None, "en", "web", 0), (None, said, None, None, len(said))]
    given = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.source_mix(spark, given, "/nowhere")
    assert got.columns == given.columns
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert {r[0] for r in rows} == set(ids) and len(ids) > len(rows)

    df = spark.createDataFrame([(i, "a" if i % 4 else "b", 1) for i in range(8000)] + [(9000, "b", 0), (9001, "none", 5)], "doc_id long, source string, n long").withColumn("mix_copies", F.lit("clash"))
    done = mixing.mix(df, {"source": F.col("source")}, F.col("n"), targets={"source": {"a": 0.5, "b": 0.5}}, whole=True)
    facts = {r.source: r for r in done.groupBy("source").agg(F.sum("_mix_copies").alias("c"), F.min("_mix_copies").alias("least"), F.max("mix_probability").alias("p")).collect()}
    assert facts["a"].least == 1 and facts["a"].c == 6000 and facts["none"].c == 0
    assert abs(facts["b"].p - 3) < 1e-9 and facts["b"].c == 2000 * 3 + 1 and facts["b"].least == 1
