"""Reports, lookups and joins over the span table of twelve rules on documents and made texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilspark.functions import catalogue
from veilspark.operators import lookup, replace, report, spans
from veilspark.sources.shared import written

from .planted import TEXTS_CTE, texts
from .redaction import RESOLVED, SEVEN, duck_redacted, duck_spans, redacted, resolved_documents
from .registry import documents, query, sql, table

TWELVE = SEVEN + catalogue.rules("mac_address", "uuid", "date_iso", "time", "ssn")
_BASE = f"with recursive {TEXTS_CTE}, {duck_spans(TWELVE)}, {RESOLVED}"
_LINES = "(length(substr(coalesce(t.text, ''), 1, s)) - length(replace(substr(coalesce(t.text, ''), 1, s), chr(10), '')) + 1)"
_RULES = "rules(rule, label, category, priority, enabled) as (values " + ", ".join(f"('{r.id}', '{r.label}', '{r.category}', {r.priority}, {str(r.enabled).lower()})" for r in catalogue.RULES) + ")"


def span_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.exploded(resolved_documents(texts(spark, sf_dir), TWELVE))


@query(oracle=f"{_BASE} select doc_id, rule, count(*) as n from res group by doc_id, rule")
def counts_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-05, AGG-01, AGG-08."""
    return report.per_document(span_table(spark, sf_dir))


@query(oracle=f"{_BASE} select doc_id, rule, string_agg(value, '|' order by s) as found from res group by doc_id, rule")
def values_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02."""
    return report.values_in_order(span_table(spark, sf_dir))


@query(oracle=f"{_BASE} select doc_id, rule, count(*) as n from res group by grouping sets ((doc_id), (rule), ())")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03."""
    return report.totals(span_table(spark, sf_dir))


@query(oracle=f"""{_BASE}, {_RULES}, n as (select rule, category, count(*) as n from res join rules using (rule) group by rule, category),
  c as (select *, cast(sum(n) over (partition by category) as bigint) as category_total from n)
  select rule, category, n, category_total, dense_rank() over (order by category_total desc, category) as category_rank from c""")
def counts_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04, J-08, TOP-03."""
    return report.by_category(span_table(spark, sf_dir), report.rule_table(spark, catalogue.RULES))


def replaced_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resolved_documents(texts(spark, sf_dir), TWELVE)
    done = replace.with_value_numbers(done)
    rows = spans.rows_of(done, F.arrays_zip("spans", "numbers"), ["doc_id", "text"], name="z")
    return rows.select("doc_id", F.col("z.spans.start").alias("start"), F.col("z.spans.end").alias("end"), F.col("z.spans.rule").alias("rule"), F.col("z.spans.value").alias("value"), replace.label(F.col("z.numbers.rule"), F.col("z.numbers.n")).alias("replacement"), spans.line_of(F.col("text"), F.col("z.spans.start")).alias("line"))


_REPLACED = f"""{_BASE}, firsts as (select doc_id, value, arg_min(rule, s) as fr, min(s) as fs from res group by doc_id, value),
  numbers as (select doc_id, value, '[' || upper(fr) || '-' || dense_rank() over (partition by doc_id, fr order by fs) || ']' as replacement from firsts),
  replaced as (select res.*, replacement, {_LINES} as line from res join numbers using (doc_id, value) join texts t using (doc_id))"""


@query(oracle=f"""{_REPLACED} select doc_id, replacement, arg_min(value, s) as original, arg_min(rule, s) as rule, count(*) as n,
  array_to_string(list_sort(list(distinct line)), ',') as lines from replaced group by doc_id, replacement""")
def mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05, X-08, TOP-08, SNK-03's rows."""
    return report.mapping(replaced_spans(spark, sf_dir))


@query(oracle=f"{_REPLACED} select replacement, count(*) as n from replaced where contains(lower(replacement), 'mail') or contains(lower(value), 'mail') or contains(lower(rule), 'mail') group by replacement")
def mapping_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-09."""
    hit = F.lit(False)
    for c in ("replacement", "value", "rule"):
        hit = hit | F.contains(F.lower(c), F.lit("mail"))
    return replaced_spans(spark, sf_dir).where(hit).groupBy("replacement").agg(F.count(F.lit(1)).alias("n"))


@query(oracle=f"""{_BASE}, v as (select rule, value, count(*) as n, row_number() over (partition by rule order by value) as k from res group by rule, value)
  select rule, cast(sum(n) as bigint) as n_hits, count(*) as n_distinct, string_agg(value, '|' order by k) filter (k <= 100) as sample from v group by rule""")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06, AGG-09, SET-02, SNK-04's rows; hits and distinct values both."""
    return report.audit(span_table(spark, sf_dir))


@query(oracle=f"{_BASE}, {_RULES} select rule, label, category, count(*) as n, case when enabled then 'active' else 'suggested' end as kind from res join rules using (rule) group by all")
def rule_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07, J-08."""
    return report.suggestions(span_table(spark, sf_dir), report.rule_table(spark, catalogue.RULES))


@query(oracle=f"{_BASE}, {_RULES} select rule, label from rules where enabled and rule not in (select rule from res)")
def rules_without_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-10, SET-03."""
    return report.without_hits(span_table(spark, sf_dir), report.rule_table(spark, catalogue.RULES))


@query(oracle=f"{_BASE}, {_RULES} select doc_id, rule, s as \"start\" from res where rule in (select rule from rules where enabled)")
def refilter_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished spans filtered by the rules that are on, without a new scan (FLT-02, FLT-08)."""
    on = report.rule_table(spark, catalogue.RULES).where("enabled").select("rule")
    return span_table(spark, sf_dir).join(on, "rule", "left_semi").select("doc_id", "rule", "start")


_CONTEXT = """
  case when length(lb) > 30 then right(lb, 30) else lb end as b0, substr(la, 1, 30) as a0, length(lb) > 30 as cut_before, length(la) > 30 as cut_after"""


@query(oracle=f"""{_BASE}, k as (select res.*, row_number() over (partition by rule order by doc_id, s) as k from res),
  l as (select k.*, string_split(substr(t.text, 1, s), chr(10))[-1] as lb, string_split(substr(t.text, e + 1), chr(10))[1] as la from k join texts t using (doc_id) where k <= 3),
  c as (select *, {_CONTEXT} from l)
  select rule, k, value, cut_before, cut_after,
   case when cut_before and instr(substr(b0, 1, 10), ' ') > 0 then substr(b0, instr(substr(b0, 1, 10), ' ') + 1) else b0 end as before,
   case when cut_after and instr(reverse(substr(a0, 21, 10)), ' ') > 0 then substr(a0, 1, 30 - instr(reverse(substr(a0, 21, 10)), ' ')) else a0 end as after from c""")
def samples_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-07, TOP-02."""
    first = report.samples(span_table(spark, sf_dir))
    joined = first.join(texts(spark, sf_dir), "doc_id").withColumn("c", spans.context_of(F.col("text"), F.col("start"), F.col("end")))
    return joined.select("rule", F.col("k").cast("long").alias("k"), "value", "c.cut_before", "c.cut_after", "c.before", "c.after")


@query(oracle=f"""{_BASE}, f as (select value, min((doc_id, s, rule)) as f from res group by value),
  g as (select value, f[3] as rule, f[1] as doc_id, f[2] as s from f) select value, rule, row_number() over (partition by rule order by doc_id, s) as number from g""".replace("min((doc_id, s, rule)) as f", "arg_min(rule, (doc_id, s)) as rule, min(doc_id) as doc_id, arg_min(s, (doc_id, s)) as s").replace("g as (select value, f[3] as rule, f[1] as doc_id, f[2] as s from f)", "g as (select * from f)"))
def corpus_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by first appearance over all documents, in two passes (WIN-03)."""
    return report.corpus_numbers(span_table(spark, sf_dir))


@query(oracle=f"""{_BASE}, old as (select rule as kind, value as original, row_number() over (partition by rule order by value) as number from (select distinct rule, value from res where doc_id >= 0)),
  new as (select distinct rule as kind, value as original from res where (rule, value) not in (select kind, original from old)),
  top as (select kind, max(number) as top from old group by kind)
  select kind, original, number from old union all
  select kind, original, row_number() over (partition by kind order by original) + coalesce(top, 0) from new left join top using (kind)""")
def dictionary_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An imported dictionary is kept and its numbers go on (SRC-11, J-12)."""
    rows = written(span_table(spark, sf_dir).select("doc_id", F.col("rule").alias("kind"), F.col("value").alias("original")))
    old = report.ranked(rows.where("doc_id >= 0").select("kind", "original").distinct(), "kind", ["original"])
    return report.dictionary_continued(rows, written(old))


@query(oracle=f"""{_REPLACED} select doc_id, s as "start", cast(s + coalesce(sum(length(replacement) - length(value)) over (partition by doc_id order by s rows between unbounded preceding and 1 preceding), 0) as bigint) as out_start from replaced""")
def output_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original offsets to offsets in the redacted text (X-06, WIN-10)."""
    w = W.partitionBy("doc_id").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.length("replacement") - F.length("value")).over(w), F.lit(0))
    return replaced_spans(spark, sf_dir).select("doc_id", "start", (F.col("start") + moved).cast("long").alias("out_start"))


@query(oracle=f"""{_REPLACED}, ask as (select doc_id, unnest(range(0, length(text), 500)) as o from texts where length(text) > 0)
  select ask.doc_id, cast(ask.o as int) as o, r.replacement from ask asof left join replaced r on ask.doc_id = r.doc_id and ask.o >= r.e""")
def last_replacement_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every 500th offset, the last replacement that ends at or before it: union and window, no pairs (J-04)."""
    ask = texts(spark, sf_dir).where("length(text) > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(500))).alias("o"))
    ends = replaced_spans(spark, sf_dir).select("doc_id", F.col("end").alias("o"), "replacement", F.lit(0).alias("kind"))
    both = ask.select("doc_id", "o", F.lit(None).cast("string").alias("replacement"), F.lit(1).alias("kind")).unionByName(ends)
    last = F.last("replacement", ignorenulls=True).over(W.partitionBy("doc_id").orderBy("o", "kind"))
    return both.withColumn("replacement", F.when(F.col("kind") == 1, last)).where("kind = 1").select("doc_id", "o", "replacement")


@query(oracle=f"""{_BASE}, l as (select doc_id, unnest(range(1, len(x) + 1)) as line_no, unnest(x) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from texts)),
  p as (select *, cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as bigint) as ls from l)
  select doc_id, line_no, ls as "start", exists (select 1 from res where res.doc_id = p.doc_id and res.s < ls + length(line) and res.e > ls) as changed from p""")
def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with numbers and offsets, and whether a span touches them (SRC-03, FLT-07, J-09, WIN-05). Spans that begin in a line are found by line number; a span may run on to later lines."""
    t = texts(spark, sf_dir)
    rows = spans.lines(t)
    found = spans.rows_of(resolved_documents(t, TWELVE), "spans", ["doc_id", "text"])
    first, last = spans.line_of(F.col("text"), F.col("s.start")), spans.line_of(F.col("text"), F.col("s.end") - 1)
    touched = found.select("doc_id", F.explode(F.sequence(first, last)).alias("line_no")).distinct().withColumn("changed", F.lit(True))
    joined = rows.join(touched, ["doc_id", "line_no"], "left")
    return joined.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("start").cast("long").alias("start"), (F.coalesce("changed", F.lit(False)) & (F.length("line") > 0)).alias("changed"))


def _redacted_lines(df: DataFrame) -> DataFrame:
    return spans.lines(df.select("doc_id", F.col("redacted").alias("text"))).select("doc_id", "line_no", F.col("line").alias("line_out"))


_OUT = duck_redacted("'[' || upper(rule) || ']'", SEVEN)
_OUT_CTE = _OUT[: _OUT.rindex("select t.doc_id")].rstrip(" ,") + ", out as (" + _OUT[_OUT.rindex("select t.doc_id") :] + ")"


@query(oracle=f"""{_OUT_CTE}, li as (select doc_id, unnest(range(1, len(x) + 1)) as line_no, unnest(x) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from texts)),
  lo as (select doc_id, unnest(range(1, len(x) + 1)) as line_no, unnest(x) as line from (select doc_id, string_split(redacted, chr(10)) as x from out))
  select doc_id, line_no, li.line as line_in, lo.line as line_out from li join lo using (doc_id, line_no) where li.line <> lo.line""")
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of changed lines before and after (X-16, J-11)."""
    t = texts(spark, sf_dir)
    done = redacted(t, SEVEN, lambda s: F.transform(s, lambda x: replace.bare(x["rule"])))
    both = spans.lines(t).join(_redacted_lines(done), ["doc_id", "line_no"]).where("line <> line_out")
    return both.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("line").alias("line_in"), "line_out")


@query(oracle=f"""{_OUT_CTE} select out.doc_id, length(text) - length(replace(text, chr(10), '')) - (length(redacted) - length(replace(redacted, chr(10), ''))) as lines_lost from out join texts using (doc_id)""")
def line_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-11."""
    done = redacted(texts(spark, sf_dir), SEVEN, lambda s: F.transform(s, lambda x: replace.bare(x["rule"])))
    both = done.join(texts(spark, sf_dir), "doc_id")
    return both.select("doc_id", (F.regexp_count("text", F.lit("\n")) - F.regexp_count("redacted", F.lit("\n"))).cast("long").alias("lines_lost"))


@query(oracle=f"""{_OUT_CTE}, tok as (select doc_id, unnest(regexp_extract_all(redacted, '\\[[A-Z0-9_]+\\]')) as token from out)
  select token, count(*) as n, count(distinct doc_id) as docs from tok where lower(token[2:-2]) in ({', '.join(repr(r.id) for r in SEVEN)}) group by token""")
def reveal_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in redacted texts looked up in the mapping (X-18)."""
    done = redacted(texts(spark, sf_dir), SEVEN, lambda s: F.transform(s, lambda x: replace.bare(x["rule"])))
    tokens = spans.rows_of(done, F.regexp_extract_all("redacted", F.lit(r"\[[A-Z0-9_]+\]"), F.lit(0)), ["doc_id"], name="token")
    known = spark.createDataFrame([(f"[{r.label}]",) for r in SEVEN], "token string")
    return tokens.join(F.broadcast(known), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(oracle="""with w as (select item_id, lower(trim(text)) as t from benchmark union all
   select -1 - item_id, split_part(lower(trim(text)), ' ', 1 + cast(item_id % 3 as int)) from benchmark union all
   select -1000000 - item_id, array_to_string(string_split(lower(trim(text)), ' ')[2:1 + 2 + cast(item_id % 4 as int)], ' ') from benchmark),
   d as (select doc_id, lower(text) as t from documents)
  select doc_id, item_id from d join w on contains(d.t, w.t) where length(w.t) > 0""")
def literal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a literal of a list (J-07): the benchmark's items, and words and phrases of one to five words from them."""
    text = F.lower(F.trim("text"))
    items = table(spark, sf_dir, "benchmark")
    words = F.split(text, " ")
    one = items.select((-1 - F.col("item_id")).alias("item_id"), F.get(words, (F.col("item_id") % 3).cast("int")).alias("literal"))
    few = items.select((-1000000 - F.col("item_id")).alias("item_id"), F.array_join(F.slice(words, F.lit(2), (F.col("item_id") % 4).cast("int") + 2), " ").alias("literal"))
    literals = items.select("item_id", text.alias("literal")).unionByName(one).unionByName(few).where("length(literal) > 0")
    docs = documents(spark, sf_dir).select("doc_id", F.lower("text").alias("text"))
    return lookup.literal_hits(docs, literals)
