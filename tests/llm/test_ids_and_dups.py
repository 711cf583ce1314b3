"""Exact and near dedup, BPE, rANS files and the pipeline against brute force on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilspark.llm import bpe, exact_dedup, mixing, near_dedup, queries, rans
from veilspark.llm.common import stored

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)


def save(df, tmp_path):
    df.write.mode("overwrite").parquet(str(tmp_path / "sf/documents.parquet"))
    return str(tmp_path / "sf")


@pytest.mark.parametrize("block_chars, hash_bits", [(4096, 64), (3, 64), (3, 2)])
def test_block_naming(spark, block_chars, hash_bits):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \t\n") for _ in range(rng.choice([0, 1, 3, 4, 7, 20, 21]))) for _ in range(70)]
    rows = [*enumerate(texts), (500, None), (501, ""), (502, "x" * 50), (503, "x" * 50), (503, "x" * 50), (None, "x" * 50)]
    df = docs(spark, rows).withColumn("rid", F.lit("clash")).withColumn("name", F.lit(1))
    groups = {}
    norm = [" ".join(p for p in __import__("re").split(r"[\x20\x09-\x0D]+", t or "")) for _, t in rows]
    for (i, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(i)
    got = exact_dedup.exact_duplicates(df, block_chars=block_chars, hash_bits=hash_bits).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.keep_id == min(i for i in ids if i is not None) and r.group_size == len(ids)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def brute_components(rows, size):
    sets = {i: near_dedup.shingles((t or "").encode(), size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for g in range(12):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 9)):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 999)}"
            rows.append((len(rows), " ".join(w)))
    chain = [f"c{i}" for i in range(100)]  # links whose ends are not similar to each other
    for step in range(12):
        rows.append((len(rows), " ".join([f"s{step}_{i}" if i < 2 * step else c for i, c in enumerate(chain)])))
    rows += [(900, None), (901, ""), (902, " "), (903, "A b"), (904, "a B"), (905, rows[0][1].upper().replace(" ", "\n"))]
    want = brute_components(rows, 4)
    got = near_dedup.near_duplicates(docs(spark, rows), size=4).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    kept = near_dedup.kept_documents(docs(spark, rows), size=4)
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_index_finds_all_within_the_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**near_dedup.B_BITS, (200, near_dedup.PLACES))
    b = a.copy()
    for row in b:
        at = rng.choice(near_dedup.PLACES, 2 * near_dedup.CHUNKS - 1, replace=False)
        row[at] ^= 1
    same = (near_dedup.index_keys(a) == near_dedup.index_keys(b)).any(axis=1)
    assert same.all()


TEXTS = [
    "Hello, world. It's 12.5% off — naïve café!", "", None, "a  b   c\n\n d\t e ", "x<|endoftext|> y <|endoftext|>", "aaaaaaaaaaaaaaaaa bbbb aaaa", "日本語 テキスト。", "\x00\x1c\x85\xa0 odd", "don't, we'll. I've!. (ok), 'tis.", "é. é, x", "emoji 👍🏽. end", "..., ,. . ,", " lead. trail \n", "٣٤. ²³, Ⅷ.",
]


def reference():
    return tokenizers.Tokenizer.from_str(queries.tokenizer_json())


def test_bpe_equals_the_library(spark, tmp_path):
    rng = random.Random(6)
    rows = list(enumerate(TEXTS)) + [(100 + i, "".join(rng.choice(" \nab.,'éß1　_x") for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(7, TEXTS[7])]
    tok = reference()
    for r in queries.op6_bpe(spark, save(docs(spark, rows), tmp_path)).collect():
        ids = tok.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(docs(spark, []), queries.tokenizer_json()).count() == 0


def test_rans_files_round_trip(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50 + i, " ".join(rng.choice(["foo", "bar.", "Baz,"]) for _ in range(rng.randint(0, 400)))) for i in range(80)]
    rng.shuffle(rows)
    tok, at = reference(), 0
    got = {r.doc_id: r for r in queries.op9_rans_files(spark, save(docs(spark, rows), tmp_path)).collect()}
    for doc_id, text in sorted(rows):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("n, symbols", [(0, 1), (1, 1), (5, 3), (1000, 1), (200_000, 50_000), (65_536 * 2 + 17, 200)])
def test_sections(n, symbols):
    ids = (np.random.default_rng(n).zipf(1.3, n) % symbols).astype(np.int64)
    data = rans.encode_section(ids)
    assert np.array_equal(rans.decode_section(data), ids)
    section = rans.Section(data)
    assert n == 0 or int(section.share.sum()) == 1 << rans.PRECISION
    for b in range(section.blocks):
        for k in range(len(section.marks[b])):
            part = section.decode([b], k)[0]
            own = ids[b * rans.BLOCK_TOKENS : (b + 1) * rans.BLOCK_TOKENS]
            assert np.array_equal(part, own[k * rans.CHECKPOINT * rans.LANES :])
    if n > 1000:
        broken = bytearray(data)
        broken[-9] ^= 255
        with pytest.raises(ValueError):
            rans.decode_section(bytes(broken))


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(10)
    words = "the of and to in a is that for it as was with be by on not".split()

    def said():
        return "\n".join(" ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(15)) for _ in range(6))

    rows = [(i, said()) for i in range(40)]
    passage = "\n".join(rows[0][1].split("\n")[:4])
    rows += [(100, rows[3][1]), (101, rows[5][1].replace("the1", "the2", 1)), (102, passage + "\n" + said()), (103, "too short"), (104, None)]
    sf = save(docs(spark, rows), tmp_path)
    state, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = columns or state.columns
        state = stored(stage(spark, state, sf))
        out[name] = {r.doc_id: r for r in state.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert state.columns == columns
    assert {103, 104} & set(out["quality_rules"]) == set() and {*range(40), 102} <= set(out["quality_rules"])
    assert 100 not in out["line_dedup"]  # an exact copy: all its passages are later ones
    assert passage.split("\n")[1] not in out["line_dedup"][102].text
    want = brute_components([(i, r.text) for i, r in out["line_dedup"].items()], 5)
    assert set(out["near_dedup"]) == {i for i, (_, c) in want.items() if i == c}
    assert all(r.n_chars == len(r.text) for r in out["line_dedup"].values())
    draws = mixing.mix_documents(stored(spark.createDataFrame(list(out["near_dedup"].values()), DOCS)), alpha=corpus_pipeline.MIX_ALPHA).where("mix_kept")
    assert {r.doc_id for r in draws.collect()} == set(out["source_mix"])
    tok = reference()
    for i, r in out["token_ids"].items():
        assert r.ids == tok.encode(out["source_mix"][i].text, add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(out["source_mix"][i].text.encode()).hexdigest()
    assert set(out["token_ids"]) == set(out["source_mix"])
    assert corpus_pipeline.run(spark, sf).count() == len(out["token_ids"])
