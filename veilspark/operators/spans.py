"""Span algebra: detect, order, resolve overlaps, apply replacements, look up positions.

Everything is a column expression over one row's text, so a table of documents is scanned once and
nothing is shuffled. Offsets are 0-based and in characters, ends exclusive. A span is
struct<rule, value, start, end, priority>.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilspark.functions.catalogue import Rule
from veilspark.functions.validators import CHECKS

SPAN = "struct<rule:string,value:string,start:int,end:int,priority:int,no:int>"


def sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def gated(text: Column, rule: Rule) -> Column:
    """Whether the text holds one of the rule's literals, and its shape, at all (cheap tests before the expression)."""
    held = reduce(lambda a, b: a | b, [text.contains(g) for g in rule.gate]) if rule.gate else F.lit(True)
    return held & text.rlike(rule.shape) if rule.shape else held


def values(text: Column, rule: Rule) -> Column:
    """All matches of a rule, in order, before its validator."""
    return F.when(gated(text, rule), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def valid(rule: Rule, value: str) -> str | None:
    """The SQL of the rule's validator for a value."""
    return CHECKS[rule.validator](value) if rule.validator else None


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the value is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements that folded() takes at a time.
PART = 256


def folded(items: Column, state: dict[str, Column], step: Callable[[Column, Column], Column], kind: str = SPAN, part: int = PART) -> Column:
    """The list that a fold makes. step: (state and "out", item) to the next state and "out", of which it may read the last element only.

    Each step of aggregate() copies its state, so a list that grows with the items would make it quadratic.
    So the items are folded part by part, and only the end of a part's list goes on to the next part.
    """
    n = F.size(items)
    parts = let(items, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / part).cast("int")), lambda k: F.slice(x, k * part + 1, part)))

    def over_part(acc: Column, part: Column) -> Column:
        begun = F.struct(*[acc[c].alias(c) for c in state], acc["out"].alias("out"))

        def go_on(z: Column) -> Column:
            last = F.greatest(F.size(z["out"]), F.lit(1))
            return F.struct(*[z[c].alias(c) for c in state], F.slice(z["out"], last, 1).alias("out"), F.concat(acc["done"], F.array(F.slice(z["out"], 1, last - 1))).alias("done"))

        return let(F.aggregate(part, begun, step), go_on)

    begun = F.struct(*[v.alias(k) for k, v in state.items()], F.array().cast(f"array<{kind}>").alias("out"), F.array().cast(f"array<array<{kind}>>").alias("done"))
    return F.when(n > 0, F.aggregate(parts, begun, over_part, lambda acc: F.concat(F.flatten(acc["done"]), acc["out"]))).otherwise(F.array().cast(f"array<{kind}>"))


def _starts(found: Column, gaps: Column) -> Column:
    """Where the matches of a rule begin: they lie between the pieces that split() leaves.

    The fold holds numbers only: each of its steps copies what it holds, texts too.
    """

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x["gap"] + x["long"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["gap"])).alias("out"))

    both = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda v, g: F.struct(F.length(v).alias("long"), F.length(g).alias("gap")))
    one = F.array(F.length(F.get(gaps, F.lit(0))))
    return F.when(F.size(found) == 1, one).when(F.size(found) > 0, folded(both, {"at": F.lit(0)}, step, "int", 64)).otherwise(F.array().cast("array<int>"))


def detect(df: DataFrame, rules: Sequence[Rule], text_col: str = "text", out: str = "spans") -> DataFrame:
    """df with all spans of the rules, rule by rule. Null texts have none.

    Each rule's matches, and for texts that have some the gaps between them, are columns of their own,
    so that no expression runs again inside a lambda; the validators are SQL over the spans. Only the rules that
    found something go on from there: most texts are short beside the list of rules, and hold finds of few.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = range(len(rules))
    held = df.withColumns({f"__{out}_v{i}": values(text, r) for i, r in enumerate(rules)})
    held = held.withColumns({f"__{out}_g{i}": F.when(F.size(f"__{out}_v{i}") > 0, F.split(text, r.pattern, -1)) for i, r in enumerate(rules)})
    if not rules:
        return held.withColumn(out, F.array().cast(f"array<{SPAN}>"))
    each = [F.struct(F.lit(i).alias("no"), F.lit(r.id).alias("rule"), F.lit(r.priority).alias("priority"), F.col(f"__{out}_v{i}").alias("v"), F.col(f"__{out}_g{i}").alias("g")) for i, r in enumerate(rules)]

    def located(x: Column) -> Column:
        span = lambda v, a: F.struct(x["rule"].alias("rule"), v.alias("value"), a.alias("start"), (a + F.length(v)).alias("end"), x["priority"].alias("priority"), x["no"].alias("no"))
        return F.struct(x["no"].alias("no"), F.zip_with(x["v"], _starts(x["v"], x["g"]), span).alias("s"))

    held = held.withColumn(f"__{out}_s", F.transform(F.filter(F.array(*each), lambda x: F.size(x["v"]) > 0), located))
    checks = " ".join(f"when {i} then filter(f.s, x -> {valid(r, 'x.value')})" for i, r in enumerate(rules) if r.validator)
    whole = F.expr(f"flatten(transform(__{out}_s, f -> {f'case f.no {checks} else f.s end' if checks else 'f.s'}))")
    return held.withColumn(out, whole).drop(f"__{out}_s", *[f"__{out}_{k}{i}" for i in n for k in "vg"])


def ordered(spans: Column) -> Column:
    """By start, then longest, then highest priority, then rule order."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (s["start"] - s["end"]).alias("b"), (-s["priority"]).alias("c"), s["no"].alias("d"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def resolved(spans: Column, overlap: str = "greedy") -> Column:
    """Spans without overlaps.

    "greedy": in order, a span inside the last kept one goes; of two that partly overlap the longer
    stays, of equally long ones the one of higher priority (else the earlier). A longer later span so
    replaces an earlier one, whose own beginning then stays readable.
    "cover": touching spans are merged to one, named after its first; nothing of any find stays.
    "first": in order, a span that overlaps the last kept one goes.
    """

    def ends_with(acc: Column, m: Column, instead: bool = False) -> Column:
        return F.struct(F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1) if instead else acc["out"], F.array(m)).alias("out"))

    def greedy(acc: Column, m: Column) -> Column:
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        length, last_length = m["end"] - m["start"], last["end"] - last["start"]
        keep_last = (last_length > length) | ((last_length == length) & (last["priority"] >= m["priority"]))
        return (
            F.when(F.size(acc["out"]) == 0, ends_with(acc, m))
            .when(m["end"] <= last["end"], acc)
            .when((m["start"] < last["end"]) & keep_last, acc)
            .when(m["start"] < last["end"], ends_with(acc, m, True))
            .otherwise(ends_with(acc, m))
        )

    def cover(acc: Column, m: Column) -> Column:
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        wider = F.struct(
            last["rule"].alias("rule"),
            F.when(m["end"] > last["end"], F.concat(last["value"], F.substring(m["value"], (last["end"] - m["start"] + 1).cast("int"), F.length(m["value"])))).otherwise(last["value"]).alias("value"),
            last["start"].alias("start"),
            F.greatest(last["end"], m["end"]).alias("end"),
            F.greatest(last["priority"], m["priority"]).alias("priority"),
            last["no"].alias("no"),
        )
        return F.when((F.size(acc["out"]) > 0) & (m["start"] < last["end"]), ends_with(acc, wider, True)).otherwise(ends_with(acc, m))

    def first(items: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            free = x["start"] >= acc["until"]
            return F.struct(F.when(free, x["end"]).otherwise(acc["until"]).alias("until"), F.concat(acc["out"], F.array(free)).alias("out"))

        # The fold holds flags only, as each of its steps copies what it holds.
        ends = F.transform(items, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        kept = folded(ends, {"until": F.lit(0)}, step, "boolean", 64)
        return F.transform(F.filter(F.arrays_zip(items.alias("s"), kept.alias("kept")), lambda x: x["kept"]), lambda x: x["s"])

    if overlap == "first":
        return F.when(F.size(spans) > 1, let(ordered(spans), first)).otherwise(spans)
    step = {"greedy": greedy, "cover": cover}[overlap]
    return F.when(F.size(spans) > 1, folded(ordered(spans), {}, step)).otherwise(spans)


def without_clashes(spans: Column) -> Column:
    """Spans of which a clash keeps the one of the earlier rule (of one rule, the first), in order of position.

    Only spans of one cluster, a run of spans that overlap one another, are compared.
    """

    def clustered(acc: Column, m: Column) -> Column:
        held = F.get(acc["out"], F.size(acc["out"]) - 1)
        joins = (F.size(acc["out"]) > 0) & (m["start"] < acc["until"])
        grown = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.concat(held, F.array(m))))
        return F.when(joins, F.struct(F.greatest(acc["until"], m["end"]).alias("until"), grown.alias("out"))).otherwise(F.struct(m["end"].alias("until"), F.concat(acc["out"], F.array(F.array(m))).alias("out")))

    def free(acc: Column, m: Column) -> Column:
        clash = F.exists(acc, lambda k: (k["start"] < m["end"]) & (m["start"] < k["end"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(m)))

    def chosen(cluster: Column) -> Column:
        by_rule = F.transform(F.array_sort(F.transform(cluster, lambda s: F.struct(s["no"].alias("no"), s["start"].alias("a"), s.alias("s")))), lambda k: k["s"])
        return F.when(F.size(cluster) < 2, cluster).otherwise(ordered(F.aggregate(by_rule, F.array().cast(f"array<{SPAN}>"), free)))

    clusters = folded(ordered(spans), {"until": F.lit(-1)}, clustered, f"array<{SPAN}>")
    return F.when(F.size(spans) > 1, F.flatten(F.transform(clusters, chosen))).otherwise(spans)


#: Characters in a block of a text that applied() cuts, as a power of two.
BLOCK_BITS = 12


def applied(text: Column, spans: Column, replacements: Column) -> Column:
    """The text with each span (disjoint, in order) replaced: gaps and replacements joined in one pass.

    The text is cut into blocks first: to find a character by its number a string is read from its start.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << BLOCK_BITS}}}"), F.lit(0))

    def cut(z: Column, start: Column, end: Column) -> Column:
        first = F.shiftright(start, BLOCK_BITS)
        over = F.slice(z["blocks"], first + 1, F.greatest(F.shiftright(end - 1, BLOCK_BITS) - first + 1, F.lit(0)))
        return F.substring(F.array_join(over, ""), start.bitwiseAND((1 << BLOCK_BITS) - 1) + 1, end - start)

    def joined(z: Column) -> Column:
        pieces = F.transform(z["spans"], lambda s, i: F.concat(cut(z, F.when(i == 0, F.lit(0)).otherwise(F.get(z["spans"], i - 1)["end"]), s["start"]), F.get(z["new"], i)))
        return F.concat(F.array_join(pieces, ""), cut(z, F.get(z["spans"], F.size(z["spans"]) - 1)["end"], F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(blocks.alias("blocks"), spans.alias("spans"), replacements.alias("new")), joined))


def rows_of(df: DataFrame, array: Column | str, keep: Sequence[str] = (), at: str = "at", name: str = "s") -> DataFrame:
    """(keep.., at, name): a row for each element of a computed array.

    By posexplode_outer(): for posexplode() the optimiser adds a test of the array's size and pushes it
    down, where it copies whatever computes the array into the filter, once for each use.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(at, name)).where(F.col(at).isNotNull())


def exploded(df: DataFrame, id_col: str = "doc_id", spans: str = "spans") -> DataFrame:
    """The span table: (id, span_no, rule, value, start, end, priority)."""
    return rows_of(df, spans, [id_col], "span_no").select(id_col, "span_no", "s.rule", "s.value", "s.start", "s.end", "s.priority")


def line_of(text: Column, start: Column) -> Column:
    """The 1-based line of an offset; -1 where the offset is unknown."""
    return F.when(start < 0, -1).otherwise(F.regexp_count(F.substring(text, F.lit(1), start), F.lit("\n")) + 1)


def column_of(text: Column, start: Column) -> Column:
    """The 1-based column of an offset."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)) + 1


def context_of(text: Column, start: Column, end: Column, reach: int = 30, nudge: int = 10) -> Column:
    """(before, after, cut_before, cut_after): the neighbourhood in the same line, moved to a blank if one is near the cut."""
    line_before = F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)
    line_after = F.substring_index(F.substring(text, end + 1, F.length(text)), "\n", 1)
    before = F.substring(line_before, F.greatest(F.length(line_before) - reach + 1, F.lit(1)), F.lit(reach))
    after = F.substring(line_after, F.lit(1), F.lit(reach))
    cut_before, cut_after = F.length(line_before) > reach, F.length(line_after) > reach
    blank = F.instr(F.substring(before, 1, nudge), " ")
    back = F.instr(F.reverse(F.substring(after, reach - nudge + 1, nudge)), " ")
    before = F.when(cut_before & (blank > 0), F.substring(before, blank + 1, F.lit(reach))).otherwise(before)
    after = F.when(cut_after & (back > 0), F.substring(after, F.lit(1), F.length(after) - back)).otherwise(after)
    return F.struct(before.alias("before"), after.alias("after"), cut_before.alias("cut_before"), cut_after.alias("cut_after"))


def lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no from 1, start, line) of every line."""
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    rows = df.select(F.col(id_col), F.posexplode(parts).alias("n", "line"))
    before = F.sum(F.length("line") + 1).over(W.partitionBy(id_col).orderBy("n").rowsBetween(W.unboundedPreceding, -1))
    return rows.select(id_col, (F.col("n") + 1).alias("line_no"), F.coalesce(before, F.lit(0)).alias("start"), "line")
