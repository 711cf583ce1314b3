"""All default rules, and all rules of the catalogue, in one plan; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import catalogue
from veilspark.operators import report, spans, sql_functions

from .planted import TEXTS_CTE, texts
from .redaction import RESOLVED, duck_redacted, duck_spans, numbered_labels, redacted, resolved_documents
from .registry import query

DEFAULT, ALL = catalogue.enabled(), list(catalogue.RULES)
FINANCIAL = catalogue.of_category("financial")


@query(oracle=duck_redacted("'[' || upper(rule) || '-' || row_number() over (partition by doc_id, rule order by s) || ']'", DEFAULT))
def redact_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that is on by default, overlaps resolved, labels numbered by position: the first use of the library."""
    return redacted(texts(spark, sf_dir), DEFAULT, numbered_labels)


@query(oracle=f"with recursive {TEXTS_CTE}, {duck_spans(DEFAULT)}, {RESOLVED} select doc_id, rule, s as \"start\", e as \"end\", value from res")
def resolve_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolved spans of all default rules (X-01 to X-03 with the rules that overlap in earnest)."""
    return spans.exploded(resolved_documents(texts(spark, sf_dir), DEFAULT)).select("doc_id", "rule", "start", "end", "value")


@query(oracle=f"""with {TEXTS_CTE}, {duck_spans(ALL)}, v as (select rule, value, count(*) as n, min({{'doc_id': doc_id, 's': s}}) as f from spans group by rule, value)
  select rule, cast(sum(n) as bigint) as n_hits, count(*) as n_distinct, arg_min(value, f) as first_value, d.n_documents from v join (select rule, count(distinct doc_id) as n_documents from spans group by rule) d using (rule) group by rule, d.n_documents""")
def stats_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules of the catalogue in one scan: hits, documents, distinct values and the first value of each rule, before overlaps are resolved."""
    return report.statistics(spans.exploded(spans.detect(texts(spark, sf_dir), ALL)))


@query(oracle=f"with recursive {TEXTS_CTE}, {duck_spans(DEFAULT)}, {RESOLVED} select doc_id, rule, s as \"start\", e as \"end\", value, prio as priority from res")
def detect_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detect() as a table function (U-06)."""
    sql_functions.register(spark)
    return spark.sql("select d.doc_id, x.* from {d} d, lateral detect(d.text, 'default') x", d=texts(spark, sf_dir))


@query(oracle="with recursive a as (" + duck_redacted("'[' || upper(rule) || ']'", DEFAULT) + "), b as (" + duck_redacted("'[' || upper(rule) || ']'", FINANCIAL) + ") select doc_id, a.redacted as by_default, b.redacted as financial from a join b using (doc_id)")
def redact_sets_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """redact() as a scalar function, by default rules and by a category's (U-07)."""
    sql_functions.register(spark)
    return spark.sql("select doc_id, redact(coalesce(text, ''), 'default') as by_default, redact(coalesce(text, ''), 'financial') as financial from {d}", d=texts(spark, sf_dir))
