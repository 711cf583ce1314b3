"""Layouts, chunks, occurrences, mappings applied to other data, lookups, syntax verdicts and SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.functions import catalogue, syntax
from veilspark.functions.validators import E164, country_code_length, phone_no_plus
from veilspark.operators import records, replace, spans
from veilspark.sources.shared import dealt

from .planted import TEXTS_CTE, texts
from .redaction import RESOLVED, SEVEN, duck_spans, resolved_documents
from .registry import query, sql, table
from .tables import _ENTITIES, tokens

_TWO = "|".join(t.replace(".", "\\.") for t in replace.TWO_PART_TOPS)


@query(oracle=rf"""with h as (select page_id, lower(regexp_extract(url, '://([^/:]+)', 1)) || case page_id % 4 when 0 then '.co.uk' when 1 then '.org.au' else '' end as host from pages)
  select page_id, host, coalesce(nullif(regexp_extract(host, '(\.(?:{_TWO}))$', 1), ''), regexp_extract(host, '(\.[^.]+)$', 1)) as top from h""")
def top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-08."""
    tail = F.when(F.col("page_id") % 4 == 0, ".co.uk").when(F.col("page_id") % 4 == 1, ".org.au").otherwise("")
    host = F.lower(F.concat(F.regexp_extract("url", "://([^/:]+)", 1), tail))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host")).withColumn("top", replace.top_domain(F.col("host")))


def _duck_layout(value: str, classes: list[tuple[str, str]]) -> str:
    at = "(instr('0123456789abcdef', substr(h, (i - 1) % 32 + 1, 1)) - 1)"
    cases = " ".join(f"when regexp_matches(c, '^[{p}]$') then substr('{among}', cast(({at} * 7 + i - 1) % {len(among)} as int) + 1, 1)" for p, among in classes)
    return f"array_to_string(list_transform(string_split({value}, ''), lambda c, i: case {cases} else c end), '')"


_HEX = [("0-9", replace.DIGITS), ("a-f", "abcdef"), ("A-F", "ABCDEF")]
_ALNUM = [("0-9", replace.DIGITS), ("a-z", replace.LOWER), ("A-Z", replace.UPPER)]


@query(oracle=f"with v as (select o_orderkey as id, 'Ab-' || md5(cast(o_orderkey as varchar)) || '/Z9' as value, md5('x:Ab-' || md5(cast(o_orderkey as varchar)) || '/Z9') as h from orders) select id, {_duck_layout('value', _HEX)} as hex, {_duck_layout('value', _ALNUM)} as alnum from v")
def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-10, R-11: hexadecimal and alphanumeric layouts."""
    value = F.concat(F.lit("Ab-"), F.md5(F.col("o_orderkey").cast("string")), F.lit("/Z9"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), value.alias("value")).withColumn("h", replace.seed(F.lit("x"), F.col("value")))
    return rows.select("id", replace.hex_layout(F.col("value"), F.col("h")).alias("hex"), replace.alnum_layout(F.col("value"), F.col("h")).alias("alnum"))


@query(oracle="""with l as (select doc_id, unnest(range(1, len(x) + 1)) as line_no, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents)),
  r as (select *, sum(length(line) + 1) over (partition by doc_id order by line_no) as e from l), c as (select *, (e - 1) // 4000 as chunk from r)
  select doc_id, cast(chunk as bigint) as chunk, count(*) as n_lines, cast(min(e - length(line) - 1) as bigint) as start, md5(string_agg(line, chr(10) order by line_no)) as text_md5 from c group by doc_id, chunk""")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at line ends to pieces of about 4,000 characters, with offsets, as batches for a model (X-14)."""
    rows = spans.lines(table(spark, sf_dir, "documents")).withColumn("chunk", F.floor((F.col("start") + F.length("line")) / 4000))
    held = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    out = rows.groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("n_lines"), F.min("start").cast("long").alias("start"), held.alias("l"))
    return out.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "n_lines", "start", F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text_md5"))


@query(oracle="""with w as (select doc_id, unnest(range(1, len(x) + 1)) as word_no, unnest(x) as word from (select doc_id, string_split(text, ' ') as x from documents)),
  p as (select *, cast(sum(length(word) + 1) over (partition by doc_id order by word_no) - length(word) - 1 as bigint) as start from w),
  e as (select doc_id, word, word_no, row_number() over (partition by doc_id, word order by word_no) as k from p where length(word) > 12)
  select e.doc_id, e.word, e.k, p.start from e join (select *, row_number() over (partition by doc_id, word order by start) as k from p where length(word) > 12) p on e.doc_id = p.doc_id and e.word = p.word and e.k = p.k""")
def entity_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities without offsets take the next unused place of their word: the k-th entity the k-th place (X-13, WIN-11)."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("word_no", "word"))
    before = F.sum(F.length("word") + 1).over(W.partitionBy("doc_id").orderBy("word_no")) - F.length("word") - 1
    placed = words.withColumn("start", before).where("length(word) > 12")
    entities = placed.select("doc_id", "word", F.row_number().over(W.partitionBy("doc_id", "word").orderBy("word_no")).alias("k"))
    places = placed.select("doc_id", "word", "start", F.row_number().over(W.partitionBy("doc_id", "word").orderBy("start")).alias("k"))
    return entities.join(places, ["doc_id", "word", "k"]).select("doc_id", "word", F.col("k").cast("long").alias("k"), F.col("start").cast("long").alias("start"))


@query(oracle="""with m as (select c_name as original, 'PERSON-' || c_custkey as replacement, c_custkey % 5 = 0 as known from customer), t as (select o_orderkey as id, unnest(string_split('paid by ' || c_name || ' today', ' ')) as word, generate_subscripts(string_split('paid by ' || c_name || ' today', ' '), 1) as i from orders join customer on o_custkey = c_custkey)
  select id, string_agg(coalesce(replacement, word), ' ' order by i) as text, count(replacement) as n from t left join (select * from m where known) m on word = original group by id""")
def apply_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known mapping applied to other texts by an equal join of tokens, the first replacement of an original winning (X-17, J-07)."""
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    known = people.where("c_custkey % 5 = 0").select(F.col("c_name").alias("word"), F.concat(F.lit("PERSON-"), F.col("c_custkey").cast("string")).alias("replacement"))
    known = known.groupBy("word").agg(F.min("replacement").alias("replacement"))
    text = F.concat(F.lit("paid by "), F.col("c_name"), F.lit(" today"))
    orders = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.posexplode(F.split(text, " ")).alias("i", "word"))
    done = orders.join(known, "word", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("replacement", "word").alias("w")))).alias("l"), F.count("replacement").alias("n"))
    return done.select("id", F.array_join(F.transform("l", lambda x: x["w"]), " ").alias("text"), "n")


@query(oracle=f"with {TEXTS_CTE} select doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '[0-9]{{3}}')[1:10], ',') as hits from texts where regexp_matches(coalesce(text, ''), '[0-9]{{3}}')")
def rule_tester(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten hits of an expression that is being tried out (TOP-07: the ten are the feature)."""
    rule = catalogue.custom("three", "[0-9]{3}")
    rows = texts(spark, sf_dir).select("doc_id", F.array_join(F.slice(spans.values(F.coalesce("text", F.lit("")), rule), 1, 10), ",").alias("hits"))
    return rows.where("hits <> ''")


@query(oracle=f"with k as (select o_orderkey as id, cast(o_orderkey * 7919 % 1000000000000 as varchar) as d from orders), n as (select id, d, {country_code_length('d')} as n from k), c as (values {', '.join(f'({c!r}, {a}, {b})' for c, (a, b) in ((str(c), x) for c, x in E164.items()))}) select id, substr(d, 1, n) as code, col1 as least, col2 as most, {phone_no_plus('d')} as valid from n join c on substr(d, 1, n) = col0")
def phone_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest country code of a number and its row in the table of codes (J-05, VAL-17, VAL-18)."""
    codes = spark.createDataFrame([(str(c), a, b) for c, (a, b) in E164.items()], "code string, least int, most int")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7919 % 1000000000000).cast("string").alias("d"))
    rows = rows.withColumn("code", F.expr(f"substr(d, 1, {country_code_length('d')})")).withColumn("valid", F.expr(phone_no_plus("d")))
    return rows.join(F.broadcast(codes), "code").select("id", "code", "least", "most", "valid")


@query(oracle=f"with {_ENTITIES}, g as (select * from e where length(word) >= 2) select kind, count(*) filter (score >= 0.85) as scrub, count(*) filter (score >= 0.7) as analyse, count(distinct word) filter (score >= 0.7) as n_distinct from g where score >= 0.5 and \"end\" - start between 1 and 100 group by kind")
def entity_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by mode, and distinct values (FLT-14, FLT-15, AGG-09)."""
    e = records.entities(tokens(spark, sf_dir))
    good = F.col("score") >= 0.7
    return e.groupBy("kind").agg(F.count_if(F.col("score") >= 0.85).alias("scrub"), F.count_if(good).alias("analyse"), F.count_distinct(F.when(good, F.col("word"))).alias("n_distinct"))


@query(oracle="""with f as (select c_nationkey as doc_id, c_name as value, min(c_custkey) as first from customer group by 1, 2) select doc_id, value, 'PERSON_NAME-' || row_number() over (partition by doc_id order by first) as label, repeat('█', length(value)) as block from f""")
def name_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-16, R-17: numbers by first appearance; blocks of the full length."""
    first = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("doc_id"), F.col("c_name").alias("value")).agg(F.min("c_custkey").alias("first"))
    k = F.row_number().over(W.partitionBy("doc_id").orderBy("first"))
    return first.select("doc_id", "value", F.concat(F.lit("PERSON_NAME-"), k.cast("string")).alias("label"), replace.redact(F.col("value"), 2**30).alias("block"))


@query(oracle="select source, lang, count(*) as files, cast(sum(length(text)) as bigint) as chars, count(*) filter (length(text) = 0) as empty from documents group by rollup (source, lang)")
def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a batch of files (AGG-21)."""
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("text")).cast("long").alias("chars"), F.count_if(F.length("text") == 0).alias("empty"))


@query(oracle=f"with recursive {TEXTS_CTE}, {duck_spans(SEVEN)}, {RESOLVED}, n as (select rule, count(*) as n from res group by rule), later as (select 'email' as rule, -1 as n union all select 'other', 7) select coalesce(later.rule, n.rule) as rule, coalesce(later.n, n.n) as n from n full join later on n.rule = later.rule")
def merged_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of counts, the later one winning (SET-06)."""
    n = spans.exploded(resolved_documents(texts(spark, sf_dir), SEVEN)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("at"))
    later = spark.createDataFrame([("email", -1, 1), ("other", 7, 1)], "rule string, n long, at int")
    return n.unionByName(later).groupBy("rule").agg(F.max_by("n", "at").alias("n"))


@query(oracle="""with d as (select o_orderkey as id from orders) select id, id % 3 <> 0 as toml_valid, case when id % 3 = 0 then 2 end as toml_line, id % 4 <> 0 as xml_valid, case when id % 4 = 0 then 2 end as xml_line, id % 5 <> 0 as yaml_valid from d""")
def syntax_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOML, XML and YAML, with the line of the first error (CLS-03, CLS-05)."""
    k = F.col("o_orderkey")
    rows = dealt(table(spark, sf_dir, "orders").select("o_orderkey")).select(
        k.alias("id"),
        F.concat(F.lit("a = 1\n"), F.when(k % 3 == 0, "b = = 2\n").otherwise("b = 2\n")).alias("t"),
        F.concat(F.lit("<a>\n"), F.when(k % 4 == 0, "<b></c>").otherwise("<b/>"), F.lit("</a>")).alias("x"),
        F.when(k % 5 == 0, "a: [1, 2\nb: }").otherwise("a: [1, 2]\nb: 3").alias("y"),
    )
    held = rows.select("id", syntax.toml_verdict("t").alias("t"), syntax.xml_verdict("x").alias("x"), syntax.yaml_verdict("y").alias("y"))
    return held.select("id", F.col("t.valid").alias("toml_valid"), F.col("t.line").alias("toml_line"), F.col("x.valid").alias("xml_valid"), F.col("x.line").alias("xml_line"), F.col("y.valid").alias("yaml_valid"))


def register_sql(spark: SparkSession) -> None:
    """redact_bare(text) and mask_value(value) for SQL users, as SQL functions over built-in expressions."""
    spark.sql(f"create or replace temporary function mask_value(v string) returns string return repeat('{replace.BLOCK}', least(length(v), 16))")
    body = "t"
    for r in catalogue.rules("email", "ipv4"):
        body = f"regexp_replace({body}, {spans.sql_string(r.pattern)}, '[{r.label}]')"
    spark.sql(f"create or replace temporary function redact_bare(t string) returns string return {body}")


@query(oracle=f"select doc_id, regexp_replace(regexp_replace(text, {sql(catalogue.BY_ID['email'].pattern)}, '[EMAIL]', 'g'), {sql(catalogue.BY_ID['ipv4'].pattern)}, '[IPV4]', 'g') as redacted, repeat('█', least(length(lang), 16)) as masked from documents")
def redact_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redaction as SQL functions (U-05, U-07)."""
    register_sql(spark)
    return spark.sql("select doc_id, redact_bare(text) as redacted, mask_value(lang) as masked from {d}", d=table(spark, sf_dir, "documents"))
