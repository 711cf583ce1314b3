"""Chunks of texts for a model, and the places of entities that come back without offsets.

Chunks are expressions over one text. Entities are brought together by document; each text meets its own once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import BLOCK_BITS, folded, let, rows_of

CHUNK_CHARS = 4000


def chunk_ends(text: Column, most: int = CHUNK_CHARS) -> Column:
    """Where the chunks of a text end. A chunk has as many whole lines as fit `most` characters; a line that is longer is cut.

    A fold over the lines: `start` of the open chunk, `fits` the last line end that fits it, `at` the end of the lines read. Linear in lines and cuts.
    """

    def step(acc: Column, line: Column) -> Column:
        end = F.least(acc["at"] + F.length(line) + 1, F.length(text))
        # The chunk is shut at the last line end that fits, if there is one, and then wherever a long line needs it.
        shut = F.when((end - acc["start"] > most) & (acc["fits"] > acc["start"]), F.array(acc["fits"])).otherwise(F.array().cast("array<int>"))
        begun = F.when(F.size(shut) > 0, acc["fits"]).otherwise(acc["start"])
        n = F.greatest(F.floor((end - begun - 1) / most).cast("int"), F.lit(0))
        inside = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: begun + k * most)).otherwise(F.array().cast("array<int>"))
        return F.struct(end.alias("at"), (begun + n * most).alias("start"), end.alias("fits"), F.concat(acc["out"], shut, inside).alias("out"))

    def over_lines(lines: Column) -> Column:
        return F.concat(folded(lines, {"at": F.lit(0), "start": F.lit(0), "fits": F.lit(0)}, step, "int"), F.array(F.length(text)))

    return F.when(F.length(text) <= most, F.array(F.length(text))).otherwise(let(F.split(text, "\n", -1), over_lines))


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = CHUNK_CHARS) -> DataFrame:
    """(id, chunk_no, start, end, text): the chunks of every text, from 0; they put together are the text. Null and empty texts have none."""
    ends = df.where(F.length(text_col) > 0).select(id_col, F.col(text_col).alias("t"), chunk_ends(F.col(text_col), most).alias("e"))
    blocks = F.regexp_extract_all("t", F.lit(f"(?s).{{1,{1 << BLOCK_BITS}}}"), F.lit(0))

    def cut(z: Column) -> Column:
        def one(end: Column, i: Column) -> Column:
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(z["e"], i - 1))
            first = F.shiftright(start, BLOCK_BITS)
            over = F.slice(z["b"], first + 1, F.shiftright(end - 1, BLOCK_BITS) - first + 1)
            text = F.substring(F.array_join(over, ""), start.bitwiseAND((1 << BLOCK_BITS) - 1) + 1, end - start)
            return F.struct(start.alias("start"), end.alias("end"), text.alias("text"))

        return F.transform(z["e"], one)

    parts = let(F.struct(F.col("e").alias("e"), blocks.alias("b")), cut)
    return rows_of(ends, parts, [id_col], "chunk_no").select(id_col, F.col("chunk_no").cast("long").alias("chunk_no"), "s.start", "s.end", "s.text")


def lowered(text: Column) -> Column:
    """The text in lower case, character for character: letters whose lower case is longer are left alone, with all others beyond ASCII."""
    low = F.lower(text)
    ascii_only = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(low) == F.length(text), low).otherwise(ascii_only)


def spots(text: str, words: list[str | None]) -> list[tuple[int | None, int | None, str | None]]:
    """(start, end, how) of each word, in order, as placed() says. A search for a word goes on where its last one ended, and not again when there is no place left."""
    out, after, ends = [], {}, {}
    for w in words:
        at = text.find(w, after.get(w, 0)) if w and after.get(w, 0) >= 0 else -1
        if w:
            after[w] = at + 1 if at >= 0 else -1
        if at >= 0:
            out.append((at, at + len(w), "place"))
            continue
        if w and " " in w and w not in ends:
            first, last = w[: w.index(" ")], w[w.rindex(" ") + 1 :]
            begin = text.find(first)
            end = text.find(last, begin + len(first)) if begin >= 0 else -1
            ends[w] = (begin, end + len(last), "ends") if end >= 0 else None
        out.append(ends.get(w) or (None, None, None))
    return out


SPOT = "struct<start:int,end:int,how:string>"


def _spots(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, words in parts:
        yield pd.Series([None if t is None else spots(t, list(w)) for t, w in zip(texts, words)], dtype=object)


def placed(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """entities (doc_id, entity_no, word) with start, end and how ("place", "ends" or null): where each is in its text (doc_id, text), in any case.

    The k-th entity of a word takes the k-th place of that word, so that no place is used twice. Where places run out, an entity of several
    words takes what reaches from the first place of its first word to the next place of its last word; else it has no place. Null words and
    entities of texts that are not there or null have none. Entities of one document are numbered; ids of documents are unique.
    """
    # Entities without a document are dealt by their number: they are no one's group.
    key = F.when(F.col("doc_id").isNull(), F.col("entity_no")).alias("__null")
    own = entities.groupBy("doc_id", key).agg(F.array_sort(F.collect_list(F.struct(F.col("entity_no").alias("__no"), F.struct(*entities.columns).alias("e")))).alias("__own"))
    placing = F.pandas_udf(_spots, f"array<{SPOT}>")
    told = own.join(docs.select(F.col("doc_id").alias("__d"), lowered(F.col("text")).alias("__t")), F.col("doc_id") == F.col("__d"), "left")
    found = told.select("__own", placing("__t", F.transform("__own", lambda x: lowered(x["e"]["word"]))).alias("__at"))
    rows = rows_of(found, F.arrays_zip("__own", F.coalesce("__at", F.transform("__own", lambda x: F.lit(None).cast(SPOT))).alias("__at")))
    return rows.select(*[F.col("s.__own.e")[c].alias(c) for c in entities.columns], "s.__at.start", "s.__at.end", "s.__at.how")
