"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of characters. The distinct blocks are sorted and
numbered, so that equal blocks, and only they, share an integer name. Then adjacent names are paired
and the distinct pairs are sorted and numbered in turn, until each document has one name. Two
documents with equally many blocks and the same last name hold the same text: no hash decides.

Where the blocks' names are looked up, a 64-bit hash of the block stands for its text, because only
one text has it; blocks whose hash is shared by several texts are told apart by the texts themselves.
Each text is shuffled once (map sides drop repeated blocks first); all else moves integers.

Nulls: a null text counts as empty; a null id sorts after all others. Equal texts in rows with the
same id: one of the rows stays. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored, text_of

#: White space that counts as one space.
SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def blocks_of(text: Column, block_chars: int) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(found)


def _numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """An integer for each row of a table of distinct rows, by sorting each partition."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _names_by_hash(whole: DataFrame, hashed) -> DataFrame:
    """(h, names): the sorted names of all distinct blocks with that hash; one, but for chance."""
    distinct = whole.select(F.explode("blocks").alias("block")).distinct()
    names = _numbered(distinct, "block").select(hashed(F.col("block")).alias("h"), "name")
    return stored(names.groupBy("h").agg(F.array_sort(F.collect_list("name")).alias("names")))


def _block_names(whole: DataFrame, rows: DataFrame, by_hash: DataFrame, hashed, tied: bool) -> DataFrame:
    """rows (rid, n, pos, h) with the names of their blocks. tied: some hash has several texts, which whole (rid, blocks) has."""
    named = rows.join(by_hash.where("size(names) = 1"), "h").select("rid", "pos", "n", F.col("names")[0].alias("name"))
    if not tied:
        return named
    cut = whole.select("rid", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    several = cut.withColumn("h", hashed(F.col("block"))).join(by_hash.where("size(names) > 1"), "h")
    told = several.select("h", "names", "block").distinct().withColumn("tie", F.row_number().over(W.partitionBy("h").orderBy("block")))
    told = told.select("block", F.element_at("names", F.col("tie").cast("int")).alias("name"))
    return named.unionByName(several.join(told, "block").select("rid", "pos", "n", "name"))


def identities(level: DataFrame) -> DataFrame:
    """(rid, depth, name) from (rid, pos, n, name): one name for each document, unique among documents of that depth."""
    level, depth, done = stored(level), 0, []
    while True:
        done.append(level.where("n = 1").select("rid", F.lit(depth).alias("depth"), "name"))
        rest = level.where("n > 1")
        if rest.isEmpty():
            break
        left, right = (F.max(F.when(F.col("pos") % 2 == side, F.col("name"))) for side in (0, 1))
        pairs = rest.groupBy("rid", F.floor(F.col("pos") / 2).alias("half"), F.ceil(F.col("n") / 2).alias("n")).agg(left.alias("l"), F.coalesce(right, F.lit(-1)).alias("r"))
        names = _numbered(pairs.select("l", "r").distinct(), "l", "r")
        level = stored(pairs.join(names, ["l", "r"]).select("rid", F.col("half").alias("pos"), "n", "name"))
        depth += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096, hash_bits: int = 64) -> DataFrame:
    """A row for each document: id, keep_id, group_size, kept, text_sha256."""

    def hashed(block: Column) -> Column:
        return F.xxhash64(block) if hash_bits == 64 else F.xxhash64(block).bitwiseAND((1 << hash_bits) - 1)

    texts = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"), normalised(text_of(text_col)).alias("t"))
    whole = texts.select("id", "rid", F.sha2("t", 256).alias("sha"), blocks_of(F.col("t"), block_chars).alias("blocks"))
    by_hash = _names_by_hash(whole, hashed)
    tied = not by_hash.where("size(names) > 1").isEmpty()
    if tied:  # the texts are read again by row number, which must not change
        whole = stored(whole)
    facts = stored(whole.select("id", "rid", "sha", F.transform("blocks", hashed).alias("hashes")))
    rows = facts.select("rid", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h"))
    told = facts.select("id", "rid", "sha").join(identities(_block_names(whole, rows, by_hash, hashed, tied)), "rid")
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    # Written, so that the join below is between plain shuffles, of which Spark splits a hot group's.
    groups = stored(told.groupBy("depth", "name").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")))
    return told.join(groups, ["depth", "name"]).select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
