"""A known mapping applied to other data: originals of any number of words, in every string column.

Originals and cells are read as words (runs of letters, digits and _, or one other sign; white space parts them and counts for nothing), in any case.
The originals are a trie kept as a table: a node for each run of first words. Places are extended one word a round: those whose
first word begins some original meet the nodes of two words, then of three, and so on, each time by an equal join, so that what does not go on
is gone at once. Of matches that overlap the leftmost stays, of those that begin together the longest. Of originals that are the same
words the one with the least number decides.

A trie of few nodes is broadcast instead, and each row is gone through where it stands: nothing is made of the cells, and nothing is shuffled.

Nulls: null cells stay null; a null or wordless original, or a null replacement, is no entry. Repeated rows are rows of their own.
An empty mapping changes nothing. Columns of other types pass through, whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.catalogue import Rule
from veilspark.sources.shared import written

from . import spans

#: A word or a single sign.
TOKEN = r"\w+|[^\w\x20\x09-\x0D]"
_TOKENS = Rule("token", "mapping", 0, TOKEN)
_PARTS = re.compile(f"({TOKEN})", re.ASCII)

#: Nodes, and characters of all of them and their replacements, up to which a trie is broadcast.
FEW_NODES, FEW_CHARS = 200_000, 10_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def trie(entries: DataFrame) -> DataFrame:
    """(depth, node, replacement, inner): a node's words, what its words are replaced by (null: they are no original), and whether some original goes on."""
    words = entries.where("replacement IS NOT NULL").select("no", "replacement", words_of(F.col("original")).alias("w")).where("size(w) > 0")
    first = words.groupBy("w").agg(F.min_by("replacement", F.struct("no", "replacement")).alias("replacement"))
    nodes = first.select(F.explode(F.sequence(F.lit(1), F.size("w"))).alias("depth"), "w", "replacement")
    last = F.col("depth") == F.size("w")
    nodes = nodes.select("depth", F.array_join(F.slice("w", F.lit(1), F.col("depth")), " ").alias("node"), F.when(last, F.col("replacement")).alias("replacement"), (~last).alias("inner"))
    return nodes.groupBy("depth", "node").agg(F.max("replacement").alias("replacement"), F.max("inner").alias("inner"))


def matches(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cell, start, end, replacement) of all matches in cells (cell, text), overlapping ones too.

    Every word that the trie has is a row of its own and is met by its place, so no row holds a text's words more than once.
    """
    longest = nodes.agg(F.max("depth")).first()[0] or 0
    known = nodes.select(F.substring_index("node", " ", -1).alias("w")).distinct()
    each = spans.rows_of(spans.detect(cells, [_TOKENS], out="tokens"), "tokens", ["cell"])
    each = each.select("cell", "at", F.lower("s.value").alias("w"), F.col("s.start").alias("a"), F.col("s.end").alias("b"))
    told = written(each.join(known, "w", "left_semi"))
    found = told.select("cell", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("replacement")).limit(0)
    alive = told.select("cell", "at", F.col("a").alias("start"), F.col("b").alias("end"), F.col("w").alias("node"))
    for depth in range(1, longest + 1):
        here = written(alive.join(nodes.where(F.col("depth") == depth).drop("depth"), "node"))
        found = found.unionByName(here.where("replacement IS NOT NULL").select("cell", "start", "end", "replacement"))
        alive = here.where("inner").select("cell", (F.col("at") + 1).alias("at"), "start", "node").join(told, ["cell", "at"])
        alive = alive.select("cell", "at", "start", F.col("b").alias("end"), F.concat_ws(" ", "node", "w").alias("node"))
    return found


def replaced(text: str, nodes: dict[str, tuple[str | None, bool]]) -> tuple[str, int]:
    """The text after all replacements, and their number. nodes: a node's replacement and whether some original goes on, by its words."""
    parts = _PARTS.split(text)  # what is between words, and words, in turn
    words = [w.lower() for w in parts[1::2]]
    out, done, n = [], 0, 0
    for i in [i for i, w in enumerate(words) if w in nodes]:
        if 2 * i + 1 < done:
            continue
        node, end, last, best = words[i], 0, i, None
        while found := nodes.get(node):
            if found[0] is not None:
                end, best = last, found[0]
            last += 1
            if not found[1] or last == len(words):
                break
            node = f"{node} {words[last]}"
        if best is not None:
            out += [*parts[done : 2 * i + 1], best]
            done, n = 2 * end + 2, n + 1
    return ("".join([*out, *parts[done:]]), n) if n else (text, 0)


def _gone_through(rows: DataFrame, named: list[str], nodes: DataFrame, count: str) -> DataFrame:
    """applied() for a trie of few nodes."""
    sent = rows.sparkSession.sparkContext.broadcast({r.node: (r.replacement, r.inner) for r in nodes.select("node", "replacement", "inner").collect()})
    fields = [f"t{i}" for i in range(len(named))]

    @F.arrow_udf(", ".join(f"{f} string" for f in fields) + ", n bigint")
    def made(*cells: pa.Array) -> pa.Array:
        total, new = [0] * len(cells[0]), []
        for cell in cells:
            texts = []
            for i, text in enumerate(cell):
                text, n = (None, 0) if (text := text.as_py()) is None else replaced(text, sent.value)
                texts.append(text)
                total[i] += n
            new.append(pa.array(texts, pa.string()))
        return pa.StructArray.from_arrays([*new, pa.array(total, pa.int64())], names=[*fields, "n"])

    held = rows.select(F.struct(*rows.columns).alias("row"))
    held = held.select("row", made(*[F.col("row")[c] for c in named]).alias("new"))
    kept = [F.col("new")[fields[named.index(c)]] if c in named else F.col("row")[c] for c in rows.columns]
    return held.select(*[v.alias(c) for v, c in zip(kept, rows.columns)], F.col("new")["n"].alias(count))


def applied(rows: DataFrame, entries: DataFrame, count: str = "n_replaced") -> DataFrame:
    """rows with every original of entries (no, original, replacement) replaced in all string columns, and how many were in the row."""
    if count in rows.columns:
        raise ValueError(f"the table has a column {count} already")
    named = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]
    nodes = written(trie(entries))
    n, chars = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("node") + F.coalesce(F.length("replacement"), F.lit(0))), F.lit(0))).first()
    if named and n <= FEW_NODES and chars <= FEW_CHARS:
        return _gone_through(rows, named, nodes, count)
    held = written(rows.select(F.monotonically_increasing_id().alias("rid"), F.struct(*rows.columns).alias("row")))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col("row")[c].alias("text")) for i, c in enumerate(named)] or [F.struct(F.lit(-1).alias("column"), F.lit(None).cast("string").alias("text"))]))
    cells = held.select("rid", cells.alias("x")).where("x.text IS NOT NULL").select(F.struct("rid", "x.column").alias("cell"), "x.text")
    found = matches(cells, nodes)
    span = F.struct(F.lit("").alias("rule"), F.col("replacement").alias("value"), "start", "end", F.lit(0).alias("priority"), F.lit(0).alias("no"))
    by_cell = found.groupBy("cell").agg(F.collect_list(span).alias("s"))
    chosen = cells.join(by_cell, "cell").withColumn("s", spans.resolved(F.col("s"), "first"))
    new = chosen.select("cell.*", F.size("s").alias("n"), spans.applied(F.col("text"), F.col("s"), F.transform("s", lambda x: x["value"])).alias("text"))
    new = new.groupBy(F.col("rid").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("new"), F.sum("n").alias("n"))
    out = held.join(new, F.col("rid") == F.col("of"), "left")
    kept = {c: F.coalesce(F.col("new")[named.index(c)], F.col("row")[c]) if c in named else F.col("row")[c] for c in rows.columns}
    return out.select(*[v.alias(c) for c, v in kept.items()], F.coalesce("n", F.lit(0)).cast("long").alias(count))
