"""Literals of a list looked up in texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veilspark.sources.shared import written

from .spans import let

WHITE = r"[\x20\x09-\x0D]+"
#: Words of a window, and characters of a run, that are joined by: the largest that a literal has.
WORDS, CHARS = (4, 3, 2, 1), (6, 3, 2, 1)

#: Literals, and characters of all of them, with which a text is searched one by one; longer lists are joined by keys.
FEW, FEW_CHARS = 4_000, 400_000
#: Hits that a task holds at a time.
HITS_HELD = 100_000


def _searched(docs: DataFrame, literals: DataFrame) -> DataFrame:
    """The hits of a short list: each text is searched for each literal where it stands; nothing is made of the texts but hits."""
    items: dict[str, list] = {}
    for item, literal in literals.collect():
        items.setdefault(literal, []).append(item)
    of = to_arrow_type(literals.schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                mine = [x for literal, some in items.items() if literal in text for x in some]
                rows += [i] * len(mine)
                found += mine
                if rows and (len(rows) > HITS_HELD or i == b.num_rows - 1):
                    yield pa.record_batch({"doc_id": b.column(0).take(pa.array(rows)), "item_id": pa.array(found, of)})
                    rows, found = [], []

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {literals.schema['item_id'].dataType.simpleString()}"
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(run, kinds)


def _windows(text: Column, k: int) -> Column:
    def of(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, k), " "))

    return F.array_distinct(let(F.split(text, WHITE), of))


def _runs(text: Column, k: int) -> Column:
    """All runs of k characters: those that begin at 0, k, 2k.., then at 1, k + 1.. and so on."""
    by_phase = [F.regexp_extract_all(F.substring(text, p + 1, 2**31 - 1), F.lit(f"(?s).{{{k}}}"), F.lit(0)) for p in range(k)]
    return F.array_distinct(F.concat(*by_phase))


def literal_hits(docs: DataFrame, literals: DataFrame) -> DataFrame:
    """(doc_id, item_id): each literal (item_id, literal) with the documents (doc_id, text) that hold it, from one character on.

    The words inside a literal of three words or more stand whole in a text that holds it: its key is a window
    of them. A shorter literal may begin and end within words: its key is its first characters. The distinct
    windows, or runs of characters, of a text are joined with the keys, and a pair is then held against the whole
    literal. So no length is left out, and no product of documents and literals is made. Runs of characters are
    many; they are made only where the list has such short literals.

    A list of few literals is not joined at all: to search a text for each of them costs less than to cut it into runs.
    """
    some = written(literals.where("length(literal) > 0").select("item_id", "literal"))
    n, chars = some.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("literal")), F.lit(0))).first()
    if n <= FEW and chars <= FEW_CHARS:
        return _searched(docs, some).distinct()
    words = F.split("literal", WHITE)
    inner = F.size(words) - 2
    by_words = F.coalesce(*[F.when(inner >= k, F.struct(F.lit("words").alias("kind"), F.lit(k).alias("k"), F.array_join(F.slice(words, 2, k), " ").alias("key"))) for k in WORDS])
    by_chars = F.coalesce(*[F.when(F.length("literal") >= k, F.struct(F.lit("chars").alias("kind"), F.lit(k).alias("k"), F.substring("literal", 1, k).alias("key"))) for k in CHARS])
    keyed = written(some.select("item_id", "literal", F.coalesce(by_words, by_chars).alias("x")).select("item_id", "literal", "x.*"))
    hits = None
    for kind, k in [tuple(r) for r in keyed.select("kind", "k").distinct().collect()]:  # eight at most
        keys = (_windows if kind == "words" else _runs)(F.col("text"), k)
        rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.explode(keys).alias("key"))
        mine = keyed.where((F.col("kind") == kind) & (F.col("k") == k)).select("key", "item_id", "literal")
        found = rows.join(mine, "key").select("doc_id", "item_id", "literal")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return docs.join(keyed.select("item_id"), F.lit(False)).select("doc_id", "item_id")
    return hits.join(docs, "doc_id").where(F.contains("text", F.col("literal"))).select("doc_id", "item_id").distinct()
