"""Detectors and validators: one query for each category of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import catalogue
from veilspark.functions.validators import CHECKS
from veilspark.operators import spans

from .planted import PLANTED_CTE, TEXTS_CTE, planted, texts
from .registry import ORACLES, QUERIES, query, sql


def found(df: DataFrame, rules: list[catalogue.Rule]) -> DataFrame:
    """(doc_id, rule, n, found): the valid matches of each rule, one to a line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = df.select("doc_id", *[spans.values(text, r).alias(f"v{i}") for i, r in enumerate(rules)])
    parts = [F.struct(F.lit(r.id).alias("rule"), (F.expr(f"filter(v{i}, x -> {spans.valid(r, 'x')})") if r.validator else F.col(f"v{i}")).alias("v")) for i, r in enumerate(rules)]
    rows = held.select("doc_id", F.explode(F.array(*parts)).alias("p")).where("size(p.v) > 0")
    return rows.select("doc_id", "p.rule", F.size("p.v").cast("long").alias("n"), F.array_join("p.v", "\n").alias("found"))


def duck_values(rule: catalogue.Rule, text: str = "text") -> str:
    out = f"regexp_extract_all(coalesce({text}, ''), {sql(rule.pattern)})"
    return f"list_filter({out}, lambda x: {spans.valid(rule, 'x')})" if rule.validator else out


def duck_found(rules: list[catalogue.Rule]) -> str:
    parts = [f"select doc_id, '{r.id}' as rule, {duck_values(r)} as v from texts" for r in rules]
    return f"with {TEXTS_CTE} select doc_id, rule, len(v) as n, array_to_string(v, chr(10)) as found from ({' union all '.join(parts)}) where len(v) > 0"


def _category(category: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return found(texts(spark, sf_dir), catalogue.of_category(category))

    return run


for _c in catalogue.CATEGORIES:
    QUERIES[f"detect_{_c}"] = _category(_c)
    ORACLES[f"detect_{_c}"] = duck_found(catalogue.of_category(_c))

#: A value for every validator, with the key's digits; tested whatever expression would find it.
SAMPLES = {
    "luhn_card": "lpad(cast(k * 7919 as varchar(20)), 16, '4')", "sin": "lpad(cast(k * 31 % 1000000000 as varchar(20)), 9, '0')", "iccid": "concat('89', lpad(cast(k * 7919 as varchar(20)), 17, '1'))",
    "iban": "concat('GB82WEST', lpad(cast(k * 13 as varchar(20)), 14, '3'))", "btc": "concat('bc1q', lpad(cast(k as varchar(20)), cast(36 + k % 9 as int), 'a'))", "eth": "concat('0x', lpad(cast(k as varchar(20)), cast(39 + k % 3 as int), 'f'))",
    "ssn": "concat(lpad(cast(k % 1000 as varchar(20)), 3, '0'), '-', lpad(cast(k % 7 as varchar(20)), 2, '0'), '-', lpad(cast(k % 11 as varchar(20)), 4, '0'))", "nhs": "lpad(cast(k * 97 as varchar(20)), 10, '9')", "tfn": "lpad(cast(k * 89 % 1000000000 as varchar(20)), 9, '1')",
    "nino": "concat(substr('ABDGBZZTNQ', cast(k % 9 as int) + 1, 2), lpad(cast(k % 1000000 as varchar(20)), 6, '0'), 'A')", "nric": "concat(substr('STFGM', cast(k % 5 as int) + 1, 1), lpad(cast(k % 10000000 as varchar(20)), 7, '0'), substr('ABCDEFGHIZJKLMNPQRTUWX', cast(k % 22 as int) + 1, 1))",
    "vin": "concat('1HGCM826', substr('0123456789X', cast(k % 11 as int) + 1, 1), '3A', lpad(cast(k % 1000000 as varchar(20)), 6, '0'))", "nif": "concat(lpad(cast(k % 100000000 as varchar(20)), 8, '0'), substr('TRWAGMYFPDXBNJZSQVHLCKE', cast(k % 23 as int) + 1, 1))",
    "nie": "concat('X', lpad(cast(k % 10000000 as varchar(20)), 7, '0'), substr('TRWAGMYFPDXBNJZSQVHLCKE', cast(k % 29 % 23 as int) + 1, 1))", "phone_no_plus": "concat(cast(k % 999 as varchar(20)), lpad(cast(k as varchar(20)), cast(7 + k % 5 as int), '5'))", "high_entropy": "concat('''', 'aB', cast(k * 7919 as varchar(20)), substr('abcdefghijklmnop', 1, cast(k % 9 as int)), '''')",
}
_SAMPLE_SQL = {k: v.replace("''''", '"\'"') for k, v in SAMPLES.items()}


def _checks_sql(samples: dict) -> str:
    return " union all ".join(f"select k, '{name}' as check_name, v, {CHECKS[name]('v')} as ok from (select k, {value} as v from keys)" for name, value in samples.items())


@query(oracle=f"with keys as (select o_orderkey as k from orders) select check_name, count(*) as n, cast(sum(cast(ok as int)) as bigint) as n_valid from ({_checks_sql(SAMPLES)}) group by check_name")
def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many made values each validator passes (VAL-01 to VAL-19)."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as k").createOrReplaceTempView("veilspark_keys")
    rows = spark.sql(_checks_sql(_SAMPLE_SQL).replace("from keys", "from veilspark_keys"))
    return rows.groupBy("check_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("int")).alias("n_valid"))
