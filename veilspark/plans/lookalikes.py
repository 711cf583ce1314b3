"""Look-alikes that no two values share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import lookalikes, permutations, report
from veilspark.sources.shared import dealt

from .registry import query, table


def _duck_moved(half: str, amounts: str) -> str:
    cases = " ".join(f"when contains('{a}', c) then substr('{a}', (instr('{a}', c) - 1 + cast('0x' || substr({amounts}, 2 * i - 1, 2) as int)) % {len(a)} + 1, 1)" for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return f"array_to_string(list_transform(string_split({half}, ''), lambda c, i: case {cases} else c end), '')"


def _duck_rounds() -> str:
    """DuckDB's rounds, one table each, for values of 32 characters at most: (id, kind, v) from t0."""
    out = []
    for k in range(8):
        left, right = "substr(v, 1, length(v) // 2)", "substr(v, length(v) // 2 + 1)"
        half, other = (left, right) if k % 2 == 0 else (right, left)
        moved = _duck_moved("half", "a")
        out.append(f"t{k + 1} as (select id, kind, {f'{moved} || other' if k % 2 == 0 else f'other || {moved}'} as v from (select id, kind, {half} as half, {other} as other, md5('k:' || kind || ':{k}:0:' || {other}) as a from t{k}))")
    return ", ".join(out)


_PHONE = "concat('+', cast({0} % 90 + 10 as varchar(20)), '-', lpad(cast({0} * 7919 as varchar(20)), 10, '0'), ' x', cast({0} % 7 as varchar(20)))"


@query(oracle=f"""with t0 as (select c_custkey as id, 'phone_us' as kind, {_PHONE.format('c_custkey')} as v from customer union all select c_custkey, 'passport', replace(c_name, '#', '-Ab ') from customer union all select s_suppkey, 'phone_uk', {_PHONE.format('s_suppkey')} from supplier), {_duck_rounds()}
  select id, kind, v as new from t8""")
def permuted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones and names of customers and suppliers under a keyed permutation of their layouts (R-06, R-09)."""
    people = table(spark, sf_dir, "customer").withColumn("c_phone", F.expr(_PHONE.format("c_custkey")))
    sellers = table(spark, sf_dir, "supplier").withColumn("s_phone", F.expr(_PHONE.format("s_suppkey")))
    rows = people.select(F.col("c_custkey").alias("id"), F.lit("phone_us").alias("kind"), F.col("c_phone").alias("v"))
    rows = rows.unionByName(people.select(F.col("c_custkey").alias("id"), F.lit("passport").alias("kind"), F.replace("c_name", F.lit("#"), F.lit("-Ab ")).alias("v")))
    rows = rows.unionByName(sellers.select(F.col("s_suppkey").alias("id"), F.lit("phone_uk").alias("kind"), F.col("s_phone").alias("v")))
    return rows.select("id", "kind", lookalikes.look_alike(F.col("kind"), F.col("v"), "k").alias("new"))


# A value of each kind for every order, each with what only right ones have.
VALUES = {
    "credit_card": "concat('4', lpad(cast(o_orderkey * 7 as varchar(20)), 15, '0'))",
    "iban": "concat('DE', lpad(cast(o_orderkey % 97 + 2 as varchar(20)), 2, '0'), lpad(cast(o_orderkey * 31 as varchar(20)), 18, '0'))",
    "mac_address": "concat('00:1', substr('aAbBcC', cast(o_orderkey % 6 as int) + 1, 1), ':', cast(o_orderkey % 90 + 10 as varchar(20)), ':', lpad(cast(o_orderkey as varchar(20)), 9, '0'))",
    "email": "concat('Ann.', cast(o_orderkey as varchar(20)), '@mail.example.org')",
}
_DIGITS_BACK = "list_transform(string_split(reverse(v), ''), lambda c, i: case when i % 2 = 1 then cast(c as int) else 2 * cast(c as int) - case when cast(c as int) > 4 then 9 else 0 end end)"
_MOD97 = "cast(substr(v, 5) || '1314' || substr(v, 3, 2) as hugeint) % 97 = 1 and substr(v, 3, 2) between '02' and '98'"


@query(oracle="with v as (" + " union all ".join(f"select '{k}' as kind, {x} as v from orders" for k, x in VALUES.items()) + f""")
  select kind, count(distinct v) as n_values, count(distinct v) as n_new, count(*) as n_same_layout, count(*) filter (kind = 'credit_card' and list_sum(case when kind = 'credit_card' then {_DIGITS_BACK} end) % 10 = 0) as n_luhn, count(*) filter (case when kind = 'iban' then {_MOD97} end) as n_iban from v group by kind""")
def distinct_look_alikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values have distinct look-alikes; cards pass Luhn's test, and account numbers have right check digits, as often as the originals do (R-06, R-12)."""
    rows, keys = None, dealt(table(spark, sf_dir, "orders").select("o_orderkey"))
    for kind, value in VALUES.items():
        some = keys.selectExpr(f"'{kind}' as kind", f"{value} as v")
        rows = some if rows is None else rows.unionByName(some)
    done = report.written(rows.select("kind", "v", permutations.look_alike(F.col("kind"), F.col("v")).alias("new")))

    def layout(c: str) -> F.Column:
        plain, hexadecimal = (lookalikes.DIGITS + lookalikes.SMALL + lookalikes.CAPITAL), "a" * 10 + "a" * 26 + "a" * 6 + "A" * 20
        return F.when(F.col("kind") == "mac_address", F.translate(c, plain, hexadecimal)).otherwise(F.translate(c, plain, "0" * 10 + "a" * 26 + "A" * 26))

    card, account = F.when(F.col("kind") == "credit_card", lookalikes.luhn_holds(F.col("new"))), F.when(F.col("kind") == "iban", lookalikes.iban_holds(F.col("new")))
    facts = done.groupBy("kind").agg(F.count_if(layout("v") == layout("new")).alias("n_same_layout"), F.count_if(F.coalesce(card, F.lit(False))).alias("n_luhn"), F.count_if(F.coalesce(account, F.lit(False))).alias("n_iban"))
    # Counted by distinct rows first, so that no kind's values meet in one task.
    counted = [done.select("kind", c).distinct().groupBy("kind").agg(F.count(F.lit(1)).alias(n)) for c, n in (("v", "n_values"), ("new", "n_new"))]
    return facts.join(counted[0], "kind").join(counted[1], "kind")
