"""Overlap resolution, numbering and replacement of whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import catalogue
from veilspark.operators import replace, spans

from .detection import duck_values
from .planted import TEXTS_CTE, texts
from .registry import documents, query, sql, table

FLAGSHIP = catalogue.rules("email", "ipv4", "credit_card", "phone_us")
SEVEN = catalogue.rules("email", "ipv4", "hostname", "credit_card", "phone_us", "generic_secret", "sha1_hash")


def duck_spans(rules: list[catalogue.Rule], source: str = "texts") -> str:
    """DuckDB's span table (doc_id, rule, value, s, e, prio, no), from matches and the gaps between them."""
    parts = []
    for no, r in enumerate(rules):
        keep = spans.valid(r, "value") or "true"
        parts.append(
            f"select * from (select doc_id, '{r.id}' as rule, v[i] as value, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0) as int) as s, {r.priority} as prio, {no} as no "
            f"from (select doc_id, v, g, unnest(range(1, len(v) + 1)) as i from (select doc_id, regexp_extract_all(coalesce(text, ''), {sql(r.pattern)}) as v, string_split_regex(coalesce(text, ''), {sql(r.pattern)}) as g from {source}))) where {keep}"
        )
    return f"spans as (select *, s + length(value) as e from ({' union all '.join(parts)}))"


#: DuckDB's greedy fold: the state is the last kept span and the numbers of all kept ones.
RESOLVED = """
 o as (select *, row_number() over (partition by doc_id order by s, e desc, prio desc, no) as rn from spans),
 fold as (
  select doc_id, rn, s, e, prio, [rn] as keep from o where rn = 1
  union all
  select o.doc_id, o.rn,
   case when skip then f.s else o.s end, case when skip then f.e else o.e end, case when skip then f.prio else o.prio end,
   case when skip then f.keep when o.s < f.e then list_append(f.keep[1:len(f.keep) - 1], o.rn) else list_append(f.keep, o.rn) end
  from fold f join (select * from o) o on o.doc_id = f.doc_id and o.rn = f.rn + 1,
   lateral (select o.e <= f.e or (o.s < f.e and (f.e - f.s > o.e - o.s or (f.e - f.s = o.e - o.s and f.prio >= o.prio))) as skip)),
 kept as (select doc_id, unnest(keep) as rn from (select doc_id, arg_max(keep, rn) as keep from fold group by doc_id)),
 res as (select o.* from o join kept using (doc_id, rn))"""


def duck_redacted(replacement: str, rules: list[catalogue.Rule], source: str = "texts", extra: str = "") -> str:
    """DuckDB's redacted documents; replacement: SQL of a resolved span's columns."""
    return (
        f"with recursive {TEXTS_CTE}, {duck_spans(rules, source)}, {RESOLVED}{extra}, "
        f"rep as (select doc_id, s, e, {replacement} as r, lag(e, 1, 0) over (partition by doc_id order by s) as p from res), "
        f"parts as (select r0.doc_id, string_agg(substr(t.text, r0.p + 1, r0.s - r0.p) || r0.r, '' order by r0.s) as head, max(r0.e) as last, count(*) as n from rep r0 join {source} t using (doc_id) group by r0.doc_id) "
        f"select t.doc_id, case when n is null then coalesce(t.text, '') else head || substr(t.text, last + 1) end as redacted, coalesce(n, 0) as n_spans from {source} t left join parts using (doc_id)"
    )


def resolved_documents(df: DataFrame, rules: list[catalogue.Rule], overlap: str = "greedy") -> DataFrame:
    found = spans.detect(df.withColumn("text", F.coalesce("text", F.lit(""))), rules)
    return found.withColumn("spans", spans.resolved(F.col("spans"), overlap))


def redacted(df: DataFrame, rules: list[catalogue.Rule], each, overlap: str = "greedy") -> DataFrame:
    """(doc_id, redacted, n_spans); each: the resolved spans to the array of their replacements."""
    done = resolved_documents(df, rules, overlap)
    done = done.withColumn("replacements", each(F.col("spans")))
    return done.select("doc_id", spans.applied(F.col("text"), F.col("spans"), F.col("replacements")).alias("redacted"), F.size("spans").cast("long").alias("n_spans"))


def numbered_labels(s):
    n = replace.position_numbers(s)
    return F.zip_with(s, n, lambda x, k: replace.label(x["rule"], k))


def each_value(make):
    return lambda s: F.transform(s, lambda x: make(x["rule"], x["value"]))


@query(oracle=duck_redacted("'[' || upper(rule) || '-' || row_number() over (partition by doc_id, rule order by s) || ']'", FLAGSHIP, "documents"))
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: four rules, overlaps resolved, labels numbered by position (X-01 to X-04, R-01, WIN-01)."""
    return redacted(documents(spark, sf_dir), FLAGSHIP, numbered_labels)


_FIRSTS = """, firsts as (select doc_id, value, arg_min(rule, s) as first_rule, min(s) as first_s from res group by doc_id, value),
 numbers as (select doc_id, value, first_rule, dense_rank() over (partition by doc_id, first_rule order by first_s) as k from firsts)"""


@query(oracle=duck_redacted("(select '[' || upper(first_rule) || '-' || k || ']' from numbers z where z.doc_id = res.doc_id and z.value = res.value)", SEVEN, "texts", _FIRSTS))
def redact_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same value gets the same label within a document (R-14, WIN-02)."""
    done = replace.with_value_numbers(resolved_documents(texts(spark, sf_dir), SEVEN))
    done = done.withColumn("labels", F.transform("numbers", lambda k: replace.label(k["rule"], k["n"])))
    return done.select("doc_id", spans.applied(F.col("text"), F.col("spans"), F.col("labels")).alias("redacted"), F.size("spans").cast("long").alias("n_spans"))


@query(oracle=duck_redacted("repeat('█', least(length(value), 16))", SEVEN))
def redact_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the value's length, 16 at most (R-03)."""
    return redacted(texts(spark, sf_dir), SEVEN, each_value(lambda rule, value: replace.redact(value)))


@query(oracle=duck_redacted("'[' || upper(rule) || ']'", SEVEN))
def redact_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare labels (R-04)."""
    return redacted(texts(spark, sf_dir), SEVEN, each_value(lambda rule, value: replace.bare(rule)))


@query(oracle=duck_redacted("'<' || rule || '/' || upper(rule) || '#' || row_number() over (partition by doc_id, rule order by s) || ':' || length(value) || '>'", SEVEN))
def redact_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template with number, type and length (R-02)."""

    def each(s):
        pattern = F.lit("<{type}/{TYPE}#{n}:{len}>")
        return F.zip_with(s, replace.position_numbers(s), lambda x, k: replace.template(pattern, x["rule"], x["value"], k))

    return redacted(texts(spark, sf_dir), SEVEN, each)


_N = "row_number() over (partition by doc_id, rule order by s)"


def _wide(width: int) -> str:
    return f"lpad(cast({_N} as varchar), greatest({width}, length(cast({_N} as varchar)))::int, '0')"


@query(
    oracle=duck_redacted(
        f"case rule when 'email' then 'user' || {_N} || '@example.com' when 'ipv4' then '192.0.2.' || {_wide(3)} when 'hostname' then 'host' || {_N} || '.example.com' "
        f"when 'credit_card' then '4000-0000-0000-' || {_wide(4)} when 'phone_us' then '555-010-' || {_wide(4)} when 'generic_secret' then 'secret-' || {_wide(4)} else {_wide(40)} end",
        SEVEN,
    )
)
def redact_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed shapes with the number (R-05)."""

    def each(s):
        return F.zip_with(s, replace.position_numbers(s), lambda x, k: replace.fake(x["rule"], k))

    return redacted(texts(spark, sf_dir), SEVEN, each)


def _duck_layout(skip: int = 0) -> str:
    """DuckDB's digit layout of value under the md5 of rule and value."""
    at = "(instr('0123456789abcdef', substr(h, (i - 1) % 32 + 1, 1)) - 1)"
    return f"array_to_string(list_transform(string_split(value, ''), lambda c, i: case when i - 1 >= {skip} and regexp_matches(c, '^[0-9]$') then substr('0123456789', cast(({at} * 7 + i - 1) % 10 as int) + 1, 1) else c end), '')"


_SEEDED = ", seeded as (select *, md5(rule || ':' || value) as h from res)"
_LUHN = "(10 - list_sum(list_transform(string_split(reverse(substr(c, 1, length(c) - 1)), ''), lambda d, i: case when (i - 1) % 2 = 0 then 2 * cast(d as int) - case when cast(d as int) > 4 then 9 else 0 end else cast(d as int) end)) % 10) % 10"


def _duck_realistic(keep: int) -> str:
    first = "substr(laid, 1)" if keep else "'4' || substr(laid, 2)"
    return f"""with recursive {TEXTS_CTE}, {duck_spans(catalogue.rules('credit_card', 'phone_us', 'ssn'))}, {RESOLVED}{_SEEDED},
      laid as (select *, case when rule = 'credit_card' then {_duck_layout(max(keep, 1))} else {_duck_layout()} end as laid from seeded),
      cards as (select *, case when rule = 'credit_card' then {first} end as c from laid)
      select doc_id, s as "start", rule, case when rule = 'credit_card' then substr(c, 1, length(c) - 1) || cast({_LUHN} as varchar) else laid end as replacement from cards"""


def _look_alikes(spark: SparkSession, sf_dir: str, keep: bool) -> DataFrame:
    done = resolved_documents(texts(spark, sf_dir), catalogue.rules("credit_card", "phone_us", "ssn"))
    rows = spans.exploded(done)
    return rows.select("doc_id", "start", "rule", replace.realistic(F.col("rule"), F.col("value"), keep).alias("replacement"))


@query(oracle=_duck_realistic(0))
def realistic_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded look-alikes that keep the digit layout; cards pass Luhn's test (R-06, R-09, R-12)."""
    return _look_alikes(spark, sf_dir, False)


@query(oracle=_duck_realistic(6))
def realistic_country_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As before, with the card's first six digits kept (R-07, R-13)."""
    return _look_alikes(spark, sf_dir, True)


@query(oracle=f"with recursive {TEXTS_CTE}, {duck_spans(SEVEN)}, {RESOLVED} select doc_id, rule, s as \"start\", e as \"end\", value from res")
def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolved spans of seven rules (X-01, X-02, X-03)."""
    return spans.exploded(resolved_documents(texts(spark, sf_dir), SEVEN)).select("doc_id", "rule", "start", "end", "value")


@query(oracle=f"""with recursive {TEXTS_CTE}, {duck_spans(SEVEN)},
  o as (select *, max(e) over (partition by doc_id order by s, e desc, prio desc, no rows between unbounded preceding and 1 preceding) as before from spans),
  g as (select *, sum(case when before is null or s >= before then 1 else 0 end) over (partition by doc_id order by s, e desc, prio desc, no rows unbounded preceding) as grp from o)
  select doc_id, min(s) as "start", max(e) as "end" from g group by doc_id, grp""")
def cover_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping spans merged, so that no part of a find stays readable (the safe alternative to the greedy fold)."""
    return spans.exploded(resolved_documents(texts(spark, sf_dir), SEVEN, "cover")).select("doc_id", "start", "end")


_PAGE_PARAM = r"[?&]([A-Za-z0-9_.-]+)=([^&#\s]+)"


@query(oracle=f"select page_id, regexp_replace(u, '([?&][A-Za-z0-9_.-]+=)[^&#\\s]+', '\\1[PARAM]', 'g') as redacted, len(regexp_extract_all(u, '{_PAGE_PARAM}')) as n from (select page_id, url || '?user=u' || page_id || '&t=' || (page_id * 7) as u from pages)")
def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of URL parameters replaced, keys kept (D103, R-15)."""
    u = F.concat("url", F.lit("?user=u"), F.col("page_id").cast("string"), F.lit("&t="), (F.col("page_id") * 7).cast("string"))
    rows = table(spark, sf_dir, "pages").select("page_id", u.alias("u"))
    return rows.select("page_id", F.regexp_replace("u", r"([?&][A-Za-z0-9_.-]+=)[^&#\s]+", "$1[PARAM]").alias("redacted"), F.regexp_count("u", F.lit(_PAGE_PARAM)).cast("long").alias("n"))


@query(oracle="select doc_id, len(regexp_extract_all(text, '(?i)[a-z]+tion[ .,]')) as n_custom, len(regexp_extract_all(text, '(?i)MIT License')) as n_literal from documents where regexp_matches(text, '(?i)[a-z]+tion[ .,]') or regexp_matches(text, '(?i)MIT License')")
def user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's expression and a user's literal, in any case (D104, D105, U-01, U-02)."""
    mine = [catalogue.custom("tion", r"[a-z]+tion[ .,]"), catalogue.literal("mit", "MIT License")]
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", *[F.size(spans.values(text, r)).cast("long").alias(n) for r, n in zip(mine, ("n_custom", "n_literal"))])
    return rows.where("n_custom > 0 OR n_literal > 0")
