"""Mixing of sources to target weights by iterative proportional fitting.

Token counts are summed to cells (source x language x topic). The cells' weights are raked to each
marginal in turn until all marginals hold; a document of a cell is then sampled with a probability in
proportion to the cell's weight by its tokens, so that the expected tokens of the sample have the
target shares. The largest probability is 1. The draw is a hash of seed and id: equal in every run.

So the cell that the data lack most decides how many documents stay. In the whole mode none goes: the least ratio of weight to tokens, not
the largest, counts as 1, each document stays once at least, and those of cells that need more tokens are repeated. The expected tokens
have the same target shares. Only cells whose target is 0 are left out.

Only cells are shuffled or raked, never documents. The number of cells is counted: up to CELL_BOUND
they are one partition, so that raking needs no shuffle, and are broadcast to the documents; beyond
it the same windows and the same join run partitioned. Lineage is cut every few sweeps.

Nulls: a null text has no tokens; a null source, language or topic is the value ''. Documents without
tokens have probability 0 and are not sampled (in the whole mode: stay once). A target for a value that the data lack is left out
and the others are scaled up. Where the marginals contradict one another, the last sweep's weights
hold. Rows with the same id are drawn alike. Extra columns pass through. Empty tables stay empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, free_name, text_of

CELL_BOUND = 100_000


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic for tables without one; the first rule that holds."""
    return (
        F.when(text.contains("icense") | text.contains("ICENSE"), "legal")
        .when(text.contains("@") | text.contains("://"), "web")
        .when(F.regexp_count(text, F.lit("[0-9]")) * 200 > F.length(text), "data")
        .otherwise("prose")
    )


def draw(seed: int, key: Column) -> Column:
    """A number from 0 to 1 (without 1) for the key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(16**13)


def _targets(cells: DataFrame, dim: str, shares: dict | None, alpha: float) -> DataFrame:
    """The target share of each value of a dimension: as given, or the value's own share to the power alpha."""
    sums = cells.groupBy(dim).agg(F.sum("n").alias("own"))
    if shares is None:
        sums = sums.select(dim, F.pow("own", F.lit(alpha)).alias("t"))
    else:
        given = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in shares.items()], f"{dim} string, t double")
        sums = sums.select(dim).join(given, dim, "left").fillna(0.0, ["t"])
    total = sums.agg(F.sum("t")).first()[0]
    return sums.select(dim, (F.col("t") / F.lit(total or 1.0)).alias(f"target_{dim}"))


def rake(cells: DataFrame, dims: list[str], targets: dict | None = None, alpha: float = 0.9, tolerance: float = 1e-9, rounds: int = 20, sweeps: int = 4, bound: int = CELL_BOUND) -> tuple[DataFrame, bool]:
    """cells (dims, n) with their weight w, and whether they are few. w sums to 1 where targets can be met."""
    cells = checkpointed(cells)
    few = cells.count() <= bound
    for t in [_targets(cells, d, (targets or {}).get(d), alpha) for d in dims]:  # all of the checkpoint: no plan holds another's joins
        cells = cells.join(t, t.columns[0])
    cells = cells.withColumn("w", F.lit(1.0) * F.col("n"))
    cells = checkpointed(cells.coalesce(1) if few else cells)
    if few:
        cells = cells.coalesce(1)
    for _ in range(rounds):
        for _ in range(sweeps):
            for d in dims:
                now = F.sum("w").over(W.partitionBy(d))
                cells = cells.withColumn("w", F.when(now > 0, F.col("w") * F.col(f"target_{d}") / now).otherwise(0.0))
        cells = checkpointed(cells)
        if few:
            cells = cells.coalesce(1)
        off = cells
        for d in dims:
            off = off.withColumn(f"off_{d}", F.abs(F.sum("w").over(W.partitionBy(d)) - F.col(f"target_{d}")))
        if (off.agg(F.max(reduce(F.greatest, [F.col(f"off_{d}") for d in dims], F.lit(0.0)))).first()[0] or 0) <= tolerance:
            break
    return cells.select(*dims, "n", "w"), few


def mix(docs: DataFrame, dims: dict[str, Column], tokens: Column, id_col: str = "doc_id", targets: dict | None = None, alpha: float = 0.9, seed: int = 1, bound: int = CELL_BOUND, whole: bool = False) -> DataFrame:
    """docs with the columns mix_tokens, mix_probability and mix_kept (with _ before a name that is taken).

    whole: mix_probability is the number of copies to expect, 1 at least, and a column mix_copies has the number drawn.
    """
    names = [f"dim_{i}" for i in range(len(dims))]
    keys = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, dims.values())]
    by_name = {n: (targets or {}).get(d) for n, d in zip(names, dims)}
    cells = docs.select(*keys, tokens.alias("n")).groupBy(*names).agg(F.sum("n").alias("n")).where("n > 0")
    raked, few = rake(cells, names, by_name, alpha, bound=bound)
    raked = raked.withColumn("ratio", F.col("w") / F.col("n"))
    one = raked.where("ratio > 0").agg(F.min("ratio") if whole else F.max("ratio")).first()[0] or 1.0
    raked = raked.select(*names, (F.col("ratio") / F.lit(one)).alias("p"))
    held, out = free_name(docs, "held_row"), [free_name(docs, c) for c in ("mix_tokens", "mix_probability", "mix_kept", "mix_copies")]
    rows = docs.select(F.struct(*docs.columns).alias(held), *keys, tokens.alias("n"))
    joined = rows.join(F.broadcast(raked) if few else raked, names, "left")
    p = F.when(F.col("n") > 0, F.coalesce("p", F.lit(0.0))).otherwise(1.0 if whole else 0.0)
    drawn = draw(seed, F.col(held)[id_col])
    told = [F.col(held)[c].alias(c) for c in docs.columns] + [F.col("n").alias(out[0]), p.alias(out[1])]
    if not whole:
        return joined.select(*told, (drawn < p).alias(out[2]))
    copies = (F.floor(p) + (drawn < p - F.floor(p)).cast("int")).cast("int")
    return joined.select(*told, (copies > 0).alias(out[2]), copies.alias(out[3]))


def mix_documents(docs: DataFrame, whole: bool = True, **options) -> DataFrame:
    """mix() for a table of documents: by source, lang and topic."""
    text = text_of("text")
    return mix(docs, {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(text)}, n_words(text), whole=whole, **options)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each document as often as the whole mix has it; their own columns only."""
    copies = F.col(free_name(docs, "mix_copies"))
    mixed = mix_documents(docs, **options)
    return mixed.withColumn(free_name(mixed, "copy"), F.explode(F.array_repeat(F.lit(True), copies))).select(*docs.columns)
