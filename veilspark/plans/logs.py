"""Time shift, classification and lines, on log lines made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import classify, spans, timeshift

from .registry import query, sql, table

# For each shape: what stands before, the time for Spark and for DuckDB, and what stands after.
_FORMS = (
    ("", "yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", ".250+02:00"), ("[", "EEE MMM dd HH:mm:ss yyyy", "%a %b %d %H:%M:%S %Y", "]"), ("[", "dd/MMM/yyyy:HH:mm:ss", "%d/%b/%Y:%H:%M:%S", " +0100]"),
    ("at ", "dd/MMM/yyyy:HH:mm:ss", "%d/%b/%Y:%H:%M:%S", " end"), ("(", "EEE, dd MMM yyyy HH:mm:ss", "%a, %d %b %Y %H:%M:%S", ")"), ("", "MMM dd HH:mm:ss", "%b %d %H:%M:%S", " host"),
    ("on ", "yyyy-MM-dd", "%Y-%m-%d", "!"), ("", "MM/dd/yyyy HH:mm:ss", "%m/%d/%Y %H:%M:%S", ";"), ("", "MM/dd/yyyy", "%m/%d/%Y", "\nsecond line 2024-02-03 04:05:06"),
)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % len(_FORMS)
    line = F.when(F.lit(False), F.lit(""))
    for i, (a, form, _, b) in enumerate(_FORMS):
        line = line.when(kind == i, F.concat(F.lit(a), F.date_format("ts", form), F.lit(b)))
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("doc_id"), "ts", "user_id", F.concat(line, F.lit(" user="), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type")).alias("text"))


def _duck_line(at: str, second: str) -> str:
    """The line with another time in it; times without a clock move from midnight."""
    cases = []
    for i, (a, form, duck, b) in enumerate(_FORMS):
        when = f"date_trunc('day', ts) + ({at})" if "HH" not in form else f"ts + ({at})"
        cases.append(f"when {i} then {sql(a)} || strftime({when}, '{duck}') || {sql(b.replace('2024-02-03 04:05:06', second))}")
    return f"case event_id % {len(_FORMS)} {' '.join(cases)} end || ' user=' || user_id || ' ' || event_type"


@query(oracle=f"select event_id as doc_id, {_duck_line('interval 5400 second', '2024-02-03 05:35:06')} as text, cast(case when event_id % 9 = 8 then 2 else 1 end as bigint) as n_times from events")
def time_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine shapes found, moved by 90 minutes and printed in their own shape (TIM-01, 02, 03, 05; wall time moves, zones stay)."""
    return timeshift.shifted(log_lines(spark, sf_dir), 5400, assume_year=2024).select("doc_id", "text", "n_times")


@query(oracle="""with f as (select event_id, case when event_id % 9 in (6, 8) then date_trunc('day', ts) else date_trunc('second', ts) end as t0, ts from events)
  select event_id as doc_id, case event_id % 9 when 0 then '2030-01-01T00:00:00.250+02:00' when 1 then '[Tue Jan 01 00:00:00 2030]' when 2 then '[01/Jan/2030:00:00:00 +0100]' when 3 then 'at 01/Jan/2030:00:00:00 end'
   when 4 then '(Tue, 01 Jan 2030 00:00:00)' when 5 then 'Jan 01 00:00:00 host' when 6 then 'on 2030-01-01!' when 7 then '01/01/2030 00:00:00;'
   else '01/01/2030' || chr(10) || 'second line ' || strftime(timestamp '2024-02-03 04:05:06' + (timestamp '2030-01-01' - t0), '%Y-%m-%d %H:%M:%S') end as head from f""")
def time_shift_to_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document moved so that its first time becomes a given start (TIM-04, WIN-08); the shape without a year takes 2024."""
    return timeshift.shifted(log_lines(spark, sf_dir), first_at="2030-01-01 00:00:00", assume_year=2024).select("doc_id", F.regexp_replace("text", r" user=.*$", "").alias("head"))


@query(oracle="select cast(count(*) + count(*) filter (event_id % 9 = 8) as bigint) as n_all, count(*) filter (event_id % 9 in (0, 1, 2, 4, 5, 7, 8)) as n_line_start from events")
def time_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All times, and those at line starts (AGG-20, FLT-16, TIM-06)."""
    found = spans.rows_of(timeshift.found(log_lines(spark, sf_dir)), "times", ["text"])
    return found.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(timeshift.at_line_start(F.col("text"), F.col("s.start"))).alias("n_line_start"))


@query(oracle="select event_id as doc_id, case when event_id % 9 in (6, 8) then date_trunc('day', ts) when event_id % 9 = 5 then strptime('2024-' || strftime(ts, '%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') else date_trunc('second', ts) end as at from events")
def first_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first time of a line (TIM-07)."""
    found = timeshift.found(log_lines(spark, sf_dir)).withColumn("s", F.get("times", 0))
    return found.select("doc_id", timeshift.read(F.col("s.value"), F.col("s.rule"), assume_year=2024).alias("at"))


# Texts of every kind, with the key of an order in them.
KIND_SHAPES = (
    "diff --git a b\n--- a\n+++ b\n@@ {k}", '{"a": {k}}', "[1, {k}]", "<html><body>{k}</body></html>", "---\nname: x{k}", "key:\n  - a{k}", "[section]\nname = {k}", "GET /x{k} HTTP/1.1\nHost: a", "HTTP/1.1 200 OK {k}", "  ServerName a{k}.b\nErrorLog /x",
    "upstream x{k} {\n a;\n}", "select a from t{k}", "def f{k}(x):\n  return x", "#!/usr/bin/env python\n{k}", "public static void main{k}()", "namespace A{k} { }", "using System;\n// {k}", "func main{k}() { }", "$ ls {k}", "#!/bin/sh\necho {k}", "const a = {k};", "a,b,c\n1,2,{k}\n", "2024-01-02 03:04:05 INFO started {k}", "plain words {k}",
    "[  12.345678] usb {k}\n[  13.345678] next", "INVITE sip:bob{k}@a.b SIP/2.0", "Received: from a by b; {k}\nReceived: from c by d\nSubject: x", '1.2.3.4 - - [15/Jan/2024:10:30:45 +0000] "GET /{k} HTTP/1.1" 200 12', '{"eventSource": "s3.amazonaws.com", "id": {k}}', "arn:aws:s3:eu:123456789012:x{k} in aws",
    "sshd[12]: Failed password for root{k}", "sudo: bob : x\nauthentication failure {k}", "X-Spam-Status: No, score={k}", "<gpx version='1'>{k}</gpx>", "", " \n\t", "a,b,c\n1,2\n3,4,{k}", '{"broken": {k}', "key = \"\"\"x{k}\"\"\"", "Accepted publickey for bob{k}",
)
_N = len(KIND_SHAPES)
KINDS_CTE = f"kinds as (select o_orderkey as doc_id, replace(shape, '{{k}}', cast(o_orderkey % 10000 as varchar)) as text from orders join (values {', '.join(f'({n}, {sql(s)})' for n, s in enumerate(KIND_SHAPES))}) as shapes(n, shape) on o_orderkey % {_N} = n)"


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = spark.createDataFrame(list(enumerate(KIND_SHAPES)), "n long, shape string")
    rows = table(spark, sf_dir, "orders").join(F.broadcast(shapes), F.col("o_orderkey") % _N == F.col("n"))
    return rows.select(F.col("o_orderkey").alias("doc_id"), F.replace("shape", F.lit("{k}"), (F.col("o_orderkey") % 10000).cast("string")).alias("text"))


_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(oracle=f"with {KINDS_CTE} select kind, count(*) as n from (select {classify.duck_first_kind(_TRIM, classify.LANGUAGES)} as kind from kinds union all select {classify.duck_first_kind(_TRIM.replace('text', 'html'), classify.LANGUAGES)} from pages) group by kind")
def content_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighteen kinds of content, first rule wins (CLS-18)."""
    rows = kinds(spark, sf_dir).select("text").unionByName(table(spark, sf_dir, "pages").select(F.col("html").alias("text")))
    return rows.select(classify.language(F.col("text")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(oracle=f"""with {KINDS_CTE}, g as (select doc_id, {classify.duck_first_kind('text', classify.LOG_KINDS, 'none')} as kind, regexp_matches(text, {sql(classify.TIMES)}) as has_times from kinds)
  select doc_id, kind, has_times, case kind {' '.join(f"when '{k}' then '{v}'" for k, v in classify.PRESETS.items())} end as preset from g""")
def log_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log kinds, presence of times and the preset for each kind (CLS-08 to CLS-16, CLS-19)."""
    kind = classify.log_kind(F.col("text"))
    presets = F.create_map(*[F.lit(x) for kv in classify.PRESETS.items() for x in kv])
    rows = kinds(spark, sf_dir).select("doc_id", kind.alias("kind"), classify.has_times(F.col("text")).alias("has_times"))
    return rows.withColumn("preset", F.try_element_at(presets, F.col("kind")))


@query(oracle=f"""with {KINDS_CTE}, e as (select *, case doc_id % 7 when 0 then 'JSON' when 1 then 'yml' when 2 then 'csv' when 3 then 'toml' when 4 then 'xml' else '' end as ext, substr({_TRIM}, 1, 1) as c from kinds)
  select doc_id, case lower(ext) when 'json' then 'json' when 'xml' then 'xml' when 'csv' then 'csv' when 'yml' then 'yaml' when 'toml' then 'toml' else case when c in ('{{', '[') then 'json' when c = '<' then 'xml' else 'unknown' end end as format from e""")
def format_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-01, CLS-06's dispatch."""
    ext = F.when(F.lit(False), F.lit(""))
    for i, e in enumerate(("JSON", "yml", "csv", "toml", "xml")):
        ext = ext.when(F.col("doc_id") % 7 == i, e)
    rows = kinds(spark, sf_dir).withColumn("ext", ext.otherwise(""))
    return rows.select("doc_id", classify.format_of(F.col("ext"), F.col("text")).alias("format"))


@query(oracle="with j as (select event_id, case when event_id % 5 = 0 then substr(props, 1, length(props) - 1) else props end as t from events) select event_id, t as text, json_valid(t) as valid from j")
def json_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-02."""
    t = F.when(F.col("event_id") % 5 == 0, F.substring("props", F.lit(1), F.length("props") - 1)).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", t.alias("text"), classify.json_valid(t).alias("valid"))


@query(oracle="""with c as (select o_orderkey as doc_id, 'a,b,c' || chr(10) || '1,"x,y",3' || chr(10) || case when o_orderkey % 3 = 0 then '1,2' else '1,2,3' end || chr(10) || case when o_orderkey % 4 = 0 then '9' else '7,8,9' end as t from orders)
  select doc_id, case when doc_id % 3 = 0 then 3 when doc_id % 4 = 0 then 4 end as bad_row from c""")
def csv_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-04: the first record that has not as many fields as the header; quoted commas do not count."""
    k = F.col("o_orderkey")
    t = F.concat(F.lit('a,b,c\n1,"x,y",3\n'), F.when(k % 3 == 0, "1,2").otherwise("1,2,3"), F.lit("\n"), F.when(k % 4 == 0, "9").otherwise("7,8,9"))
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), t.alias("t")).select("doc_id", classify.csv_first_bad_row(F.col("t")).alias("bad_row"))


@query(oracle="""with o as (select doc_id, text, unnest(range(0, length(text), 997)) as o from documents where length(text) > 0)
  select doc_id, cast(o as int) as o, cast(length(substr(text, 1, o)) - length(replace(substr(text, 1, o), chr(10), '')) + 1 as bigint) as line, cast(length(string_split(substr(text, 1, o), chr(10))[-1]) + 1 as bigint) as col from o""")
def offset_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets to line and column (CLS-07, X-08)."""
    rows = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(997))).alias("o"))
    return rows.select("doc_id", "o", spans.line_of(F.col("text"), F.col("o")).cast("long").alias("line"), spans.column_of(F.col("text"), F.col("o")).cast("long").alias("col"))
