"""Chunks and the places of entities against plain Python."""

import random

from pyspark.sql import functions as F

from veilspark.operators import places


def brute_chunks(text, most):
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > most:
            feed = text.rfind("\n", at, at + most)
            end = feed + 1 if feed >= 0 else at + most
        out.append((at, end, text[at:end]))
        at = end
    return out


def test_chunks_against_plain_python(spark):
    rng = random.Random(3)
    texts = ["", "\n", "\n" * 25, "x" * 47, "ab\n" * 9 + "y" * 31 + "\nz", "é👍\n" * 12, "x" * 10 + "\n" + "y" * 9 + "\n"] + ["".join(rng.choice("ab\n") if rng.random() < 0.3 else "c" for _ in range(rng.randint(1, 200))) for _ in range(60)]
    rows = [*enumerate(texts), (900, None), (1, "\n"), (None, "null id\n" * 5), (901, "one line of a long text\n" * 3000 + "w" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("t", "e", "start", "chunk_no")})
    for most in (10, 4000):
        got = sorted(map(repr, map(tuple, places.chunks(df, most=most).collect())))
        assert got == sorted(repr((i, k, *c)) for i, t in rows for k, c in enumerate(brute_chunks(t or "", most)))
        assert all(r.end - r.start <= most for r in places.chunks(df, most=most).collect())
    assert places.chunks(df.limit(0)).count() == 0


def test_places_against_plain_python(spark):
    docs = [(1, "Ann met ann Lee. ANN saw Lee, aaa"), (2, None), (3, ""), (4, "İstanbul and ÉCOLE école"), (5, "new big york and new york")]
    asked = [(1, 0, "ann"), (1, 1, "ANN"), (1, 2, "Ann Lee"), (1, 3, "Ann"), (1, 4, "ann"), (1, 5, "saw Ann"), (1, 6, "met aaa"), (1, 7, "aa"), (1, 8, "aa"), (1, 9, "aa"), (1, 10, None), (1, 11, ""), (2, 0, "x"), (3, 0, "x"), (4, 0, "istanbul"), (4, 1, "école"), (4, 2, "AND"), (5, 0, "new  york"), (5, 1, "york"), (5, 2, "new york"), (5, 3, "new york"), (9, 0, "x")]
    df = spark.createDataFrame(asked, "doc_id long, entity_no int, word string").withColumn("places", F.lit("clash"))
    got = {(r.doc_id, r.entity_no): (r.start, r.end, r.how) for r in places.placed(df.drop("places"), spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    none, n = (None, None, None), len(asked)
    assert len(got) == n and got[1, 0] == (0, 3, "place") and got[1, 1] == (8, 11, "place") and got[1, 3] == (17, 20, "place") and got[1, 4] == none
    assert got[1, 2] == (8, 15, "place") and got[1, 5] == none and got[1, 6] == (4, 33, "ends")
    assert got[1, 7] == (30, 32, "place") and got[1, 8] == (31, 33, "place") and got[1, 9] == none
    assert all(got[k] == none for k in [(1, 10), (1, 11), (2, 0), (3, 0), (4, 0), (9, 0)]) and got[4, 2] == (9, 12, "place")
    assert got[5, 0] == (0, 12, "ends") and got[5, 1] == (8, 12, "place") and got[5, 2] == (17, 25, "place") and got[5, 3] == (0, 12, "ends")


def test_entities_are_made_once_and_searched_forward(spark):
    docs = spark.createDataFrame([(1, "ab " * 20_000)], "doc_id long, text string")
    asked = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("entity_no"), F.lit("AB").alias("word"))
    tagged = asked.unionByName(spark.createDataFrame([(None, 0, "ab"), (None, 1, "ab")], "doc_id long, entity_no int, word string")).mapInPandas(lambda parts: parts, "doc_id long, entity_no int, word string")
    done = places.placed(tagged, docs)
    assert done._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    got = {(r.doc_id, r.entity_no): (r.start, r.end, r.how) for r in done.collect()}
    assert len(got) == 20_002 and all(got[1, k] == (3 * k, 3 * k + 2, "place") for k in range(20_000))
    assert got[None, 0] == got[None, 1] == (None, None, None)
