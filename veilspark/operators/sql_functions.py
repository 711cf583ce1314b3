"""Detection and redaction for SQL users: functions over built-in expressions, so that a query stays one narrow stage.

    select d.id, x.* from documents d, lateral detect(d.text, 'default') x
    select id, redact(text, 'financial') from documents

`detect` is a table function (rule, start, end, value, priority) whose body is one generator over one expression: the
optimiser puts it in the place of the lateral join, and no text is shuffled. The second argument names a set of rules: `default`, `all`,
a category, or a preset. Where it is a literal, the tests of rules that are not in the set are folded away with their expressions.
The texts of the expressions follow spans.detect() and spans.resolved() step by step and are held against them by the tests.

A null text has no finds and stays null when redacted. A set that is not known is an error, also for null texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from veilspark.functions import catalogue, presets
from veilspark.functions.catalogue import Rule

from .spans import BLOCK_BITS, PART, SPAN, sql_string, valid

EMPTY = f"cast(array() as array<{SPAN}>)"


def rule_sets() -> dict[str, list[Rule]]:
    """The sets that SQL users can name."""
    sets = {"default": catalogue.enabled(), "all": list(catalogue.RULES)}
    sets |= {c: catalogue.of_category(c) for c in catalogue.CATEGORIES}
    return sets | {name: [r for r in presets.rules_of(name) if r.enabled] for name in presets.PRESETS}


def bound(value: str, name: str, body: str) -> str:
    """body with `name` for the value, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def folded(items: str, begin: dict[str, str], step: Callable[[str, str], dict[str, str]]) -> str:
    """SQL of spans.folded(): items is a name; step gives the next state, with `out`, from the names of state and item."""

    def struct(parts: dict[str, str]) -> str:
        return f"named_struct({', '.join(f"'{k}', {v}" for k, v in parts.items())})"

    parts = f"transform(sequence(0, cast(floor((size({items}) - 1) / {PART}) as int)), k_ -> slice({items}, k_ * {PART} + 1, {PART}))"
    part_begin = struct({c: f"acc_.{c}" for c in begin} | {"out": "acc_.out"})
    go_on = struct({c: f"z_.{c}" for c in begin} | {"out": "slice(z_.out, greatest(size(z_.out), 1), 1)", "done": "concat(acc_.done, array(slice(z_.out, 1, greatest(size(z_.out), 1) - 1)))"})
    over_part = bound(f"aggregate(part_, {part_begin}, (s_, x_) -> {struct(step('s_', 'x_'))})", "z_", go_on)
    whole = struct(begin | {"out": EMPTY, "done": f"cast(array() as array<array<{SPAN}>>)"})
    return f"aggregate({parts}, {whole}, (acc_, part_) -> {over_part}, acc_ -> concat(flatten(acc_.done), acc_.out))"


def located(text: str, rule: Rule, no: int) -> str:
    """SQL of one rule's valid spans."""

    def step(s: str, x: str) -> dict[str, str]:
        start = f"{s}.at + length({x}.gap)"
        span = f"named_struct('rule', '{rule.id}', 'value', {x}.value, 'start', {start}, 'end', {start} + length({x}.value), 'priority', {rule.priority}, 'no', {no})"
        return {"at": f"{start} + length({x}.value)", "out": f"concat({s}.out, array({span}))"}

    pattern = sql_string(rule.pattern)
    both = f"zip_with(v_, slice(split({text}, {pattern}, -1), 1, size(v_)), (a_, b_) -> named_struct('value', a_, 'gap', b_))"
    spans = bound(f"regexp_extract_all({text}, {pattern}, 0)", "v_", f"case when size(v_) > 0 then {bound(both, 'i_', folded('i_', {'at': '0'}, step))} else {EMPTY} end")
    if rule.validator:
        spans = f"filter({spans}, y_ -> {valid(rule, 'y_.value')})"
    gate = " or ".join(f"contains({text}, {sql_string(g)})" for g in rule.gate)
    tests = [f"({gate})"] * bool(gate) + [f"rlike({text}, {sql_string(rule.shape)})"] * bool(rule.shape)
    return f"case when {' and '.join(tests)} then {spans} else {EMPTY} end" if tests else spans


def resolved(spans: str) -> str:
    """SQL of spans.resolved(), greedy."""

    def step(s: str, m: str) -> dict[str, str]:
        last = f"element_at({s}.out, -1)"
        longer = f"({last}.end - {last}.start > {m}.end - {m}.start or ({last}.end - {last}.start = {m}.end - {m}.start and {last}.priority >= {m}.priority))"
        instead = f"concat(slice({s}.out, 1, size({s}.out) - 1), array({m}))"
        return {"out": f"case when size({s}.out) = 0 then array({m}) when {m}.end <= {last}.end then {s}.out when {m}.start < {last}.end and {longer} then {s}.out when {m}.start < {last}.end then {instead} else concat({s}.out, array({m})) end"}

    keyed = "transform(r_, q_ -> named_struct('a', q_.start, 'b', q_.start - q_.end, 'c', -q_.priority, 'd', q_.no, 's', q_))"
    ordered = f"transform(array_sort({keyed}), q_ -> q_.s)"
    return bound(spans, "r_", f"case when size(r_) > 1 then {bound(ordered, 'o_', folded('o_', {}, step))} else r_ end")


def found(text: str, chosen: str, sets: dict[str, Sequence[Rule]]) -> str:
    """SQL of the resolved spans of the rules of a set."""
    rules: dict[Rule, list[str]] = {}
    for name, some in sets.items():
        for r in some:
            rules.setdefault(Rule(r.id, r.category, r.priority, r.pattern, r.gate, r.validator, shape=r.shape), []).append(name)
    order = {r.id: i for i, r in enumerate(catalogue.RULES)}
    listed = sorted(rules, key=lambda r: order.get(r.id, len(order)))
    parts = [f"case when {chosen} in ({', '.join(map(sql_string, rules[r]))}) then {located(text, r, no)} else {EMPTY} end" for no, r in enumerate(listed)]
    known = f"{chosen} in ({', '.join(map(sql_string, sets))})"
    return f"case when not coalesce({known}, false) then raise_error(concat('no such rule set: ', coalesce({chosen}, 'null'))) when {text} is null then {EMPTY} else {resolved(f'concat({', '.join(parts)})')} end"


def applied(text: str, spans: str, replacement: Callable[[str], str]) -> str:
    """SQL of spans.applied(): spans and blocks are bound here."""

    def cut(start: str, end: str) -> str:
        over = f"slice(b_, shiftright({start}, {BLOCK_BITS}) + 1, greatest(shiftright({end} - 1, {BLOCK_BITS}) - shiftright({start}, {BLOCK_BITS}) + 1, 0))"
        return f"substring(array_join({over}, ''), ({start} & {(1 << BLOCK_BITS) - 1}) + 1, {end} - {start})"

    before = "(case when i_ = 0 then 0 else get(f_, i_ - 1).end end)"
    pieces = f"transform(f_, (m_, i_) -> concat({cut(before, 'm_.start')}, {replacement('m_')}))"
    whole = f"concat(array_join({pieces}, ''), {cut('element_at(f_, -1).end', f'length({text})')})"
    blocks = f"regexp_extract_all({text}, '(?s).{{1,{1 << BLOCK_BITS}}}', 0)"
    return bound(spans, "f_", f"case when size(f_) = 0 then {text} else {bound(blocks, 'b_', whole)} end")


def register(spark: SparkSession, sets: dict[str, Sequence[Rule]] | None = None) -> None:
    """detect(text, rules) and redact(text, rules) as temporary functions of the session. sets: other rule sets, by name."""
    sets = sets or rule_sets()
    columns = "rule string, start int, `end` int, value string, priority int"
    spans = found("t", "rules", sets)
    # A filter or another column must not copy the detection: inline() takes the spans as they are, once.
    spark.sql(f"create or replace temporary function detect(t string, rules string) returns table ({columns}) return select rule, start, `end`, value, priority from inline({spans})")
    labelled = applied("t", spans, lambda m: f"concat('[', upper({m}.rule), ']')")
    spark.sql(f"create or replace temporary function redact(t string, rules string) returns string return case when t is null then cast(null as string) else {labelled} end")
