"""Known mappings applied to other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import mapping

from .registry import documents, query, sql, table

_TOKEN = sql(mapping.TOKEN)

#: A fold over matches by start, then longest: the state is where the last kept one ends.
_FIRST = """o as (select *, row_number() over (partition by doc_id, col order by s, e desc) as rn from hit),
  fold as (select doc_id, col, rn, e as last, true as keep from o where rn = 1
    union all select o.doc_id, o.col, o.rn, case when o.s >= f.last then o.e else f.last end, o.s >= f.last from fold f join o on o.doc_id = f.doc_id and o.col = f.col and o.rn = f.rn + 1),
  res as (select o.* from o join fold using (doc_id, col, rn) where keep)"""


def _windows(k: int) -> str:
    """DuckDB's runs of k words: (doc_id, col, s, e, key)."""
    lead = [f"lead(w, {j}) over (partition by doc_id, col order by i)" for j in range(1, k)]
    end = f"lead(e, {k - 1}) over (partition by doc_id, col order by i)" if k > 1 else "e"
    return f"select doc_id, col, e - n as s, {end} as e, {" || ' ' || ".join(['w', *lead])} as key from p"


@query(oracle=f"""with recursive b as (select item_id, regexp_extract_all(lower(text), {_TOKEN}) as w, 1 + item_id % 5 as k from benchmark),
  x as (select item_id as no, w[1:k] as w, '<ITEM-' || item_id || '>' as r from b where len(w) >= k
    union all select 1000 + item_id, w[2:2], '<WORD-' || item_id || '>' from b where len(w) >= 2
    union all select distinct 5000, [lang], '<LANGUAGE>' from documents where lang is not null),
  m as (select array_to_string(w, ' ') as key, arg_min(r, {{'no': no, 'r': r}}) as r from x group by w),
  cells as (select doc_id, 'text' as col, text from documents union all select doc_id, 'lang', lang from documents union all select doc_id, 'source', source from documents),
  z as (select doc_id, col, regexp_extract_all(text, {_TOKEN}) as v, string_split_regex(text, {_TOKEN}) as g from cells where text is not null),
  t as (select doc_id, col, unnest(v) as v, unnest(g[1:len(v)]) as g, unnest(range(len(v))) as i from z),
  p as (select doc_id, col, i, lower(v) as w, length(v) as n, sum(length(v) + length(g)) over (partition by doc_id, col order by i) as e from t),
  hit as (select doc_id, col, s, e, r from ({" union all ".join(map(_windows, range(1, 6)))}) join m using (key)),
  {_FIRST},
  rep as (select *, lag(e, 1, 0) over (partition by doc_id, col order by s) as q from res),
  parts as (select r.doc_id, r.col, string_agg(substr(c.text, cast(r.q + 1 as bigint), cast(r.s - r.q as bigint)) || r.r, '' order by r.s) || substr(any_value(c.text), cast(max(r.e) + 1 as bigint)) as text, count(*) as n from rep r join cells c using (doc_id, col) group by r.doc_id, r.col)
  select d.doc_id, coalesce(a.text, d.text) as text, coalesce(b.text, d.lang) as lang, coalesce(c.text, d.source) as source, coalesce(a.n, 0) + coalesce(b.n, 0) + coalesce(c.n, 0) as n_replaced
  from documents d left join parts a on a.doc_id = d.doc_id and a.col = 'text' left join parts b on b.doc_id = d.doc_id and b.col = 'lang' left join parts c on c.doc_id = d.doc_id and c.col = 'source'""")
def mapping_of_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals of one to five words, upper-cased, replaced in all string columns; the first of equal originals decides (X-17, J-07)."""
    words = table(spark, sf_dir, "benchmark").select("item_id", mapping.words_of(F.col("text")).alias("w"))
    k = (F.col("item_id") % 5 + 1).cast("int")

    def entry(no, some, name: str) -> DataFrame:
        original = F.upper(F.array_join(some, "  "))
        return words.where(F.size("w") >= 2).select(no.cast("long").alias("no"), original.alias("original"), F.concat(F.lit(f"<{name}-"), F.col("item_id").cast("string"), F.lit(">")).alias("replacement"))

    entries = entry(F.col("item_id"), F.slice("w", F.lit(1), k), "ITEM").unionByName(entry(F.col("item_id") + 1000, F.slice("w", 2, 1), "WORD"))
    langs = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(F.lit(5000).cast("long").alias("no"), F.col("lang").alias("original"), F.lit("<LANGUAGE>").alias("replacement")).distinct()
    return mapping.applied(documents(spark, sf_dir).drop("n_chars"), entries.unionByName(langs))
