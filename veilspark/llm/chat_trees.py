"""Reply trees to conversations: the best root-to-leaf path of each tree, as one marked text.

A message has a tree, a number, its parent's number, a role, a text and a score. Self-joins that
double their reach each time find every message's distance and summed score from its root, so a
thread of a thousand replies takes ten joins. The leaves of a tree are ranked by mean score on their
path, then by number; the top_k paths are spelled out by the same tables of jumps, from long to short.

Turns are written as  <|im_start|>role LF text <|im_end|> LF.  Inside roles and texts, the pairs '<' '|'
are parted by a backslash (and those already parted get one more), so no text can hold a mark and the
change can be undone. Line feeds in roles are written %0A and per cents %25. The loss mask is a list
of spans (code points, end exclusive): the texts of assistant turns.

A path is one row of output by nature; all else is spread by (tree, number). Nulls: null texts, roles
and scores count as '' and 0; null trees are one tree. A parent that does not exist makes a root; rows
that repeat a number count once (the least row stays); messages on or below a cycle belong to no path.
Empty tables give empty results, and other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, stored

OPEN, SHUT = "<|im_start|>", "<|im_end|>\n"
FIELDS = ("tree", "node", "parent", "role", "text", "score")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _at(a: str, b: str, left: str, right: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & (F.col(f"{a}.{left}") == F.col(f"{b}.{right}"))


def best_paths(messages: DataFrame, top_k: int = 1) -> DataFrame:
    """(tree, leaf, branch, node, depth): the messages of the chosen paths; branch is the rank from 1."""
    own = messages.select("tree", "node", "parent", "score")
    first = own.alias("a").join(own.select("tree", "node").alias("b"), _at("a", "b", "parent", "node"), "left")
    first = checkpointed(first.select("a.tree", "a.node", F.col("b.node").alias("up"), F.col("a.score").cast("double").alias("sum"), F.lit(1).cast("long").alias("steps")))
    jumps, reached = [first.where("up IS NOT NULL")], first.where("up IS NULL").drop("up")
    most = first.count()
    while 2 ** len(jumps) <= 2 * most and not jumps[-1].isEmpty():
        far = jumps[-1]  # of exactly 2^k steps; those that reach a message without such a jump are done
        wider = far.alias("a").join(far.alias("b"), _at("a", "b", "up", "node"), "left")
        wider = checkpointed(wider.select("a.tree", "a.node", F.col("a.up").alias("by"), "b.up", "a.sum", "a.steps", F.col("b.sum").alias("more"), F.col("b.steps").alias("on")))
        jumps.append(wider.where("up IS NOT NULL").select("tree", "node", "up", (F.col("sum") + F.col("more")).alias("sum"), (F.col("steps") + F.col("on")).alias("steps")))
        last = wider.where("up IS NULL").alias("a").join(reached.alias("b"), _at("a", "b", "by", "node"))
        last = checkpointed(last.select("a.tree", "a.node", (F.col("a.sum") + F.col("b.sum")).alias("sum"), (F.col("a.steps") + F.col("b.steps")).alias("steps")))
        reached = reached.unionByName(last)
    reached = reached.withColumnRenamed("steps", "depth")
    parents = jumps[0].select("tree", "up").distinct()
    leaves = reached.alias("a").join(parents.alias("b"), _at("a", "b", "node", "up"), "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy((F.col("sum") / F.col("depth")).desc(), "node"))
    chosen = leaves.withColumn("branch", rank).where(F.col("branch") <= top_k)
    paths = checkpointed(chosen.select("tree", F.col("node").alias("leaf"), "branch", "node", "depth"))
    for k in range(len(jumps) - 1, -1, -1):
        more = paths.alias("a").join(jumps[k].alias("b"), _at("a", "b", "node", "node"))
        paths = checkpointed(paths.unionByName(more.select("a.tree", "a.leaf", "a.branch", F.col("b.up").alias("node"), (F.col("a.depth") - 2**k).alias("depth"))))
    return paths


def format_trees(messages: DataFrame, top_k: int = 1) -> DataFrame:
    """(tree, branch, n_turns, formatted, loss_spans) for the chosen paths of each tree."""
    clean = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    once = clean.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*")
    once = stored(once)
    paths = best_paths(once, top_k)
    turns = paths.alias("a").join(once.alias("b"), _at("a", "b", "node", "node"))
    head = F.concat(F.lit(OPEN), _role_out(F.col("b.role")), F.lit("\n"))
    turns = turns.select("a.tree", "a.leaf", "a.branch", "a.depth", (F.col("b.role") == "assistant").alias("loss"), F.length(head).alias("ahead"), F.length(escaped(F.col("b.text"))).alias("said"), F.concat(head, escaped(F.col("b.text")), F.lit(SHUT)).alias("turn"))
    before = F.sum(F.length("turn")).over(W.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(W.unboundedPreceding, -1))
    turns = turns.withColumn("start", F.coalesce(before, F.lit(0)).cast("long") + F.col("ahead"))
    whole = turns.groupBy("tree", "leaf", "branch").agg(F.array_sort(F.collect_list(F.struct("depth", "turn", "loss", "start", "said"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["said"]).alias("end")))
    return whole.select("tree", "branch", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substring(piece, len(OPEN) + 1, 2**31 - 1), "\n", 1)
        return F.struct(_role_in(role).alias("role"), unescaped(F.substring(piece, F.length(role) + len(OPEN) + 2, F.lit(2**31 - 1))).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def threads(rows: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of plain conversations: each row answers the one before it (ties by role, then text)."""
    w = W.partitionBy("tree").orderBy("at", "role", "text")
    plain = rows.select(F.col(tree).alias("tree"), F.col(order).alias("at"), F.col(role).alias("role"), F.col(text).alias("text"))
    numbered = plain.withColumn("node", F.row_number().over(w).cast("long"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
