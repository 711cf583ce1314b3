"""Presets, entities as rules, gates, finds turned into rules, track privacy and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import catalogue, presets
from veilspark.operators import context, entities, lookup, records, replace, spans, timeshift

from .detection import duck_values
from .logs import KINDS_CTE, _FORMS, kinds, log_lines
from .planted import TEXTS_CTE, texts
from .redaction import RESOLVED, SEVEN, duck_redacted, duck_spans, redacted, resolved_documents
from .registry import documents, query, sql, table
from .tables import _ENTITIES, tokens

EXTRAS = [r for p in presets.PRESETS.values() for r in p.extra]
#: Lines that the presets' own rules find, with an event's key in them.
PRESET_LINES = (
    "id 123456{k} arn:aws:s3:eu-west-1:123456789012:bucket/a{k} ok", '1.2.3.4 - - "GET /{k}" 200 "https://ref.example.org/{k}" "Mozilla/5.0 (X11) {k}"', "id 0123456789ab namespace=team-{k} image registry.example.org/a/b{k}:v1.{k}",
    "Server=db{k};Database=x;Password=p{k}; then INSERT INTO t VALUES (1, 'x{k}')", "pam_unix(sshd:session): session opened for bob{k} SHA256:abcdefghijklmnopqrstuvwxyz0123456789ABC{k} end", "no finds here {k}",
)
_LINES = f"lines as (select event_id as doc_id, replace(s, '{{k}}', lpad(cast(event_id % 10000 as varchar), 4, '0')) as text from events join (values {', '.join(f'({i}, {sql(s)})' for i, s in enumerate(PRESET_LINES))}) as v(i, s) on event_id % {len(PRESET_LINES)} = i)"


def preset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.lit(False), F.lit(""))
    for i, s in enumerate(PRESET_LINES):
        line = line.when(F.col("event_id") % len(PRESET_LINES) == i, F.lit(s))
    key = F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.replace(line, F.lit("{k}"), key).alias("text"))


@query(oracle=f"with {_LINES} " + " union all ".join(f"select doc_id, '{r.id}' as rule, len(v) as n, array_to_string(v, chr(10)) as found from (select doc_id, {duck_values(r)} as v from lines) where len(v) > 0" for r in EXTRAS))
def preset_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that presets bring along (D117)."""
    held = preset_lines(spark, sf_dir).select("doc_id", *[spans.values(F.col("text"), r).alias(f"v{i}") for i, r in enumerate(EXTRAS)])
    parts = F.array(*[F.struct(F.lit(r.id).alias("rule"), F.col(f"v{i}").alias("v")) for i, r in enumerate(EXTRAS)])
    rows = spans.rows_of(held, F.filter(parts, lambda p: F.size(p["v"]) > 0), ["doc_id"], name="p")
    return rows.select("doc_id", "p.rule", F.size("p.v").cast("long").alias("n"), F.array_join("p.v", "\n").alias("found"))


_SETTINGS = [(name, r.id, r.enabled) for name in presets.PRESETS for r in presets.rules_of(name)]


@query(oracle=f"""with recursive {TEXTS_CTE}, {duck_spans(SEVEN)}, {RESOLVED}, settings(preset, rule) as (values {', '.join(f"('{p}', '{r}')" for p, r, on in _SETTINGS if on)})
  select preset, rule, count(*) as n from res join settings using (rule) group by preset, rule""")
def preset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds of seven rules by the presets that turn them on (SRC-10, CLS-19)."""
    on = spark.createDataFrame([(p, r) for p, r, enabled in _SETTINGS if enabled], "preset string, rule string")
    found = spans.exploded(resolved_documents(texts(spark, sf_dir), SEVEN)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return found.join(on, "rule").select("preset", "rule", "n")


_GROUP_CASE = "case kind " + " ".join(f"when '{g}' then '{r}'" for g, r in entities.GROUP_RULE.items()) + " end"


@query(oracle=f"""with {_ENTITIES}, g as (select *, {_GROUP_CASE} as rule from e where score >= 0.5 and length(word) >= 2 and "end" - start between 1 and 100)
  select doc_id, rule, word as value, start, "end", round(score, 6) as score from g where rule is not null""")
def entity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged entities as finds of rules; groups without a rule are dropped (D108-D116)."""
    return entities.entity_spans(tokens(spark, sf_dir)).withColumn("score", F.round("score", 6))


def by_capitals(batch) -> list[list[tuple]]:
    """A tagger for tests and examples: capitalised ASCII words are names, their score is their length's."""
    import re

    return [[("B-PER", m[0], min(1.0, len(m[0]) / 8), m.start(), m.end()) for m in re.finditer(r"\b[A-Z][a-z]+\b", t, re.A)] for t in batch]


@query(oracle=r"""with w as (select doc_id, text, regexp_extract_all(coalesce(text, ''), '\b[A-Z][a-z]+\b') as v, string_split_regex(coalesce(text, ''), '\b[A-Z][a-z]+\b') as g from documents),
  r as (select doc_id, unnest(v) as word from w) select doc_id, 'ml_person_name' as rule, word as value, count(*) as n from r where length(word) between 4 and 100 group by all""")
def tagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's tagger over whole documents in Arrow batches, merged and mapped to rules (U-04)."""
    found = entities.entity_spans(entities.tagged(documents(spark, sf_dir), by_capitals))
    return found.groupBy("doc_id", "rule", "value").agg(F.count(F.lit(1)).alias("n"))


@query(oracle=f"with {TEXTS_CTE}, {duck_spans(catalogue.rules('email', 'postfix_from', 'sendmail_from', 'postfix_relay', 'sendmail_relay', 'phone_us', 'uk_nhs'))} select doc_id, s as \"start\", e as \"end\", arg_min(rule, no) as rule, arg_min(value, no) as value from spans group by doc_id, s, e")
def deduplicated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span a place, the earlier rule's (X-15)."""
    rules = catalogue.rules("email", "postfix_from", "sendmail_from", "postfix_relay", "sendmail_relay", "phone_us", "uk_nhs")
    order = spark.createDataFrame([(r.id, i) for i, r in enumerate(rules)], "rule string, no int")
    rows = spans.exploded(spans.detect(texts(spark, sf_dir), rules)).select("doc_id", "start", "end", "rule", "value").join(order, "rule")
    return entities.deduplicated(rows, ["no"]).drop("no")


_HEADERS = ", ".join(sql(h) for h in context.NAME_HEADERS)
_GATES = f"""regexp_matches(text, '[{{]\\s*"[^"\\n]*"\\s*:|^\\s*\\[\\s*["{{\\[0-9-]') as json, len(h) > 1 and len(list_filter(h, lambda c: lower(trim(replace(c, '"', ''))) in ({_HEADERS}))) > 0 as names"""


@query(oracle=f"""with {KINDS_CTE}, t as (select doc_id, text from kinds union all select -1 - c_custkey, 'id;First Name;note' || chr(10) || c_custkey || ';' || c_name || ';x' from customer union all select -10000000 - event_id, props from events),
  h as (select *, string_split_regex(split_part(replace(text, chr(13) || chr(10), chr(10)), chr(10), 1), '[,;\\t|]') as h from t) select doc_id, {_GATES} from h""")
def content_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text may hold JSON or a table with names, before those detectors are tried (CLS-17)."""
    people = table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).alias("doc_id"), F.concat(F.lit("id;First Name;note\n"), F.col("c_custkey").cast("string"), F.lit(";"), "c_name", F.lit(";x")).alias("text"))
    props = table(spark, sf_dir, "events").select((-10000000 - F.col("event_id")).alias("doc_id"), F.col("props").alias("text"))
    rows = kinds(spark, sf_dir).unionByName(people).unionByName(props)
    return rows.select("doc_id", entities.likely_json(F.col("text")).alias("json"), entities.likely_names(F.col("text")).alias("names"))


@query(oracle=duck_redacted("repeat('█', least(length(value), 16))", SEVEN, "documents"))
def one_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One strategy set on all rules, whatever their own (R-18)."""
    rules = presets.with_strategy(SEVEN, "redact")
    own = F.create_map(*[F.lit(x) for r in rules for x in (r.id, r.strategy)])
    return redacted(documents(spark, sf_dir), rules, lambda s: F.transform(s, lambda x: replace.replaced(F.try_element_at(own, x["rule"]), x["rule"], x["value"], F.lit(0))))


_NOTES = "select event_id as doc_id, lower('note: p' || (event_id % 37) || 'pw and K' || (event_id % 11) || 'zz ' || event_type) as text from events"


@query(oracle=f"""with finds as (select distinct lower('P' || s_suppkey || 'pw') as literal from supplier union select distinct 'k' || (s_suppkey % 7) || 'zz' from supplier), notes as ({_NOTES})
  select doc_id, literal from notes join finds on contains(text, literal)""")
def context_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values found under suspicious keys become literals that are looked up in other texts (R-19, J-07)."""
    made = F.concat(F.lit('log {"password": "P'), F.col("s_suppkey").cast("string"), F.lit('pw", "keys": [{"api_key": "k'), (F.col("s_suppkey") % 7).cast("string"), F.lit('zz"}]} end'))
    finds = context.json_secrets(table(spark, sf_dir, "supplier").select("s_suppkey", made.alias("text")), "s_suppkey")
    literals = entities.literals_of(finds)
    notes = table(spark, sf_dir, "events").selectExpr("event_id as doc_id", "lower(concat('note: p', event_id % 37, 'pw and K', event_id % 11, 'zz ', event_type)) as text")
    return lookup.literal_hits(notes, literals).join(literals, "item_id").select("doc_id", "literal")


_TRACK = ("user_id as track_id", "event_id as point_no", "case when event_id % 5 = 0 then 'lap' when event_id % 17 = 0 then 'session' else 'record' end as type", "case when event_id % 11 <> 0 then value end as lat", "value as lon", "cast(event_id % 300 as int) as hr", "cast(event_id % 5000 as int) as power", "cast(event_id % 150 - 70 as int) as temp", "cast(event_id % 70000 as int) as raw_alt", "ts")


@query(oracle=f"""with t as (select {', '.join(_TRACK)} from events) select track_id, type, count(*) as n, coalesce(bool_or(lat is not null and lon is not null), false) as has_place, bool_or(hr between 1 and 254) as has_hr, bool_or(power between 0 and 4000) as has_power from t group by track_id, type""")
def activity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of record types and what they hold, after the sensors' ranges (AGG-16, TRK-03)."""
    return records.activity_summary(records.in_range(table(spark, sf_dir, "events").selectExpr(*_TRACK)))


@query(oracle=f"""with t as (select {', '.join(_TRACK)} from events) select point_no, type, lat, lon, case when raw_alt < 65535 then round(raw_alt / 5.0 - 500.0, 3) end as altitude, cast(null as int) as power, case when temp between -60 and 80 then temp end as temp from t""")
def track_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heart rate and time dropped, power blanked, altitudes from device units (FLT-17, TRK-03)."""
    rows = records.in_range(table(spark, sf_dir, "events").selectExpr(*_TRACK))
    rows = records.without_columns(rows, drop=("hr", "ts"), blank=("power",))
    return rows.select("point_no", "type", "lat", "lon", F.round(records.altitude(F.col("raw_alt")), 3).cast("double").alias("altitude"), "power", "temp")


def _time(ts: str) -> str:
    cases = []
    for i, (before, form, duck, after) in enumerate(_FORMS):
        own = {0: "|| '.250+02:00'", 1: "|| ']'", 2: "|| ' +0100]'", 4: "|| ')'"}.get(i, "")
        opened = {1: "'[' || ", 2: "'[' || ", 4: "'(' || "}.get(i, "")
        when = f"date_trunc('day', ts) + ({ts})" if "HH" not in form else f"ts + ({ts})"
        cases.append(f"when {i} then {opened}strftime({when}, '{duck}') {own}")
    return f"case event_id % {len(_FORMS)} {' '.join(cases)} end"


@query(oracle=f"""select event_id as doc_id, 1 as n, {_time("interval 0 second")} as before, {_time("interval 5400 second")} as after from events
  union all select event_id, 2, '2024-02-03 04:05:06', '2024-02-03 05:35:06' from events where event_id % 9 = 8""")
def time_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three times of a document before and after a shift: the number is the feature (TOP-09)."""
    return timeshift.preview(log_lines(spark, sf_dir), 5400)
