"""Every operator and stage on awkward tables: empty; nulls, repeated rows, a very long text, and columns whose names clash."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilspark.llm import bpe, chat_trees, exact_dedup, licenses, line_dedup, mixing, near_dedup, phrases, quality, queries, rans, secrets, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("id", "key", "rid", "th", "t", "n", "h", "part", "ids", "spans", "found", "kept", "digest", "group", "group_size", "mix_tokens", "n_words", "n_lines", "lines", "words", "comp", "class", "_id", "_th", "_gone", "_key", "_starts", "gone_id", "gone_hash", "gone_key", "_a", "_b", "held_row", "dim_0", "fp", "rid", "root", "node", "v", "codes", "phrase", "f", "size")


def awkward(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghiklmnoprstuw", k=rng.randint(2, 9))) for _ in range(300)]
    long = "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(25_000))
    rows = [(1, "one two three. " * 30, "en", "a"), (1, "one two three. " * 30, "en", "a"), (2, None, None, None), (None, "null id " * 20, "en", "b"), (None, None, "de", "b"), (3, "", "", ""), (4, " \n\t ", "en", "a"), (5, long, "en", "hot"), (6, "é👍 " * 50, "fr", "b"), (7, "x", "en", "a")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    return df.withColumns({c: F.lit(f"extra {c}") for c in dict.fromkeys(CLASHES)})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def as_rows(spark, docs):
    """Documents as one-message conversations."""
    return docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), "text", *[c for c in docs.columns if c in ("node", "tree")])


def files(spark, docs, path):
    rans.write_files(docs, queries.tokenizer_json(), path)
    return rans.read_documents(spark.read.parquet(path)) if docs.count() else docs.select("doc_id")


OPERATORS = {
    "secrets": lambda s, d, p: secrets.find_secrets(d, secrets.fit(secrets.count_texts(d))),
    "quality": lambda s, d, p: quality.judged(d),
    "exact_dedup": lambda s, d, p: exact_dedup.exact_duplicates(d),
    "licenses": lambda s, d, p: licenses.find_licenses(d),
    "bpe": lambda s, d, p: bpe.encode_documents(d, queries.tokenizer_json()),
    "line_dedup": lambda s, d, p: line_dedup.dedup_lines(d),
    "mixing": lambda s, d, p: mixing.mix_documents(d),
    "rans": files,
    "near_dedup": lambda s, d, p: near_dedup.near_duplicates(d),
    "simhash": lambda s, d, p: simhash.similar_documents(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_an_empty_table(spark, tmp_path, name):
    assert OPERATORS[name](spark, empty(spark), str(tmp_path / "f")).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_awkward_rows(spark, tmp_path, name):
    given = awkward(spark)
    got = OPERATORS[name](spark, given, str(tmp_path / "f")).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in given.select("doc_id").collect())


def test_chat_trees_on_awkward_rows(spark):
    assert chat_trees.format_trees(chat_trees.threads(as_rows(spark, empty(spark)))).count() == 0
    rows = as_rows(spark, awkward(spark)).withColumn("score", F.lit("extra"))
    got = {str(r.tree): r.n_turns for r in chat_trees.format_trees(chat_trees.threads(rows)).collect()}
    assert got == {"1": 2, "2": 1, "None": 2, "3": 1, "4": 1, "5": 1, "6": 1, "7": 1}


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stage_on_empty_and_awkward_tables(spark, stage):
    run, last = dict(corpus_pipeline.STAGES)[stage], corpus_pipeline.STAGES[-1][0]
    assert run(spark, empty(spark), "/nowhere").count() == 0
    given = awkward(spark)
    got = run(spark, given, "/nowhere")
    ids = {str(r.doc_id) for r in got.select("doc_id").collect()}
    assert ids <= {str(r.doc_id) for r in given.select("doc_id").collect()}
    assert "5" in ids or stage == "source_mix"  # which draws
    if stage != last:
        assert got.columns == given.columns
        assert all(r[c] == f"extra {c}" for r in got.collect() for c in CLASHES)
