"""Chunks for a model, and entities that a tagger returns without offsets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import entities, places

from .registry import documents, query


#: Where the chunk that begins at `start` ends: after the last line feed that fits, or where it is full.
_END = "case when length(text) - start <= 4000 then length(text) when instr(substr(text, start + 1, 4000), chr(10)) > 0 then start + 4001 - instr(reverse(substr(text, start + 1, 4000)), chr(10)) else start + 4000 end"


@query(oracle=f"""with recursive c as (
    select doc_id, text, cast(0 as bigint) as chunk_no, cast(0 as bigint) as start, cast({_END} as bigint) as stop from (select doc_id, text, 0 as start from documents where length(text) > 0)
    union all select doc_id, text, chunk_no, start, cast({_END} as bigint) from (select doc_id, text, chunk_no + 1 as chunk_no, stop as start from c where stop < length(text)))
  select doc_id, chunk_no, cast(start as int) as start, cast(stop as int) as "end", md5(substr(text, start + 1, stop - start)) as text_md5 from c""")
def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole lines, 4,000 characters at most, with exact offsets (X-14)."""
    return places.chunks(documents(spark, sf_dir)).select("doc_id", "chunk_no", "start", "end", F.md5("text").alias("text_md5"))


def _tag(texts: pd.Series) -> list[list[tuple]]:
    """A tagger that tells no offsets: long words in capitals, now and then two words that do not stand together, and words that are nowhere."""
    out = []
    for t in texts:
        w = re.findall("[A-Za-z]{7,}", t)
        found = []
        for i in range(0, len(w), 5):
            name = f"zzqx{i}" if i % 35 == 0 else f"{w[i].upper()} {w[i + 3]}" if i % 25 == 0 and i + 3 < len(w) else w[i].upper()
            found.append(("B-PER", name, 0.9, -1, -1))
        out.append(found)
    return out


@query(oracle="""with recursive w as (select doc_id, lower(text) as t, regexp_extract_all(text, '[A-Za-z]{7,}') as w from documents where text is not null),
  i as (select doc_id, t, w, unnest(range(0, len(w), 5)) as i from w),
  e as (select doc_id, t, i // 5 as entity_no, case when i % 35 = 0 then 'zzqx' || i when i % 25 = 0 and i + 3 < len(w) then upper(w[i + 1]) || ' ' || w[i + 4] else upper(w[i + 1]) end as word from i),
  k as (select *, lower(word) as x, row_number() over (partition by doc_id, lower(word) order by entity_no) as k from e),
  d as (select doc_id, any_value(t) as t, x, max(k) as n from k group by doc_id, x),
  p as (select doc_id, x, t, n, 1 as k, instr(t, x) - 1 as pos from d where instr(t, x) > 0
    union all select doc_id, x, t, n, k + 1, pos + instr(substr(t, pos + 2), x) from p where k < n and instr(substr(t, pos + 2), x) > 0),
  f as (select doc_id, x, instr(t, split_part(x, ' ', 1)) as a, length(split_part(x, ' ', 1)) as n, split_part(x, ' ', -1) as last, t from d where contains(x, ' ')),
  g as (select doc_id, x, a - 1 as s, instr(substr(t, a + n), last) as b, a - 1 + n + instr(substr(t, a + n), last) - 1 + length(last) as e from f where a > 0)
  select k.doc_id, cast(k.entity_no as int) as entity_no, k.word, cast(coalesce(p.pos, case when g.b > 0 then g.s end) as int) as start, cast(coalesce(p.pos + length(k.word), case when g.b > 0 then g.e end) as int) as "end",
    case when p.pos is not null then 'place' when g.b > 0 then 'ends' end as how
  from k left join p on p.doc_id = k.doc_id and p.x = k.x and p.k = k.k left join g on g.doc_id = k.doc_id and g.x = k.x""")
def placed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a tagger at their next unused place in any case, else from first to last word, else nowhere (X-13, WIN-11)."""
    docs = documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text")
    found = entities.tagged(docs, _tag).select("doc_id", F.col("token_no").alias("entity_no"), "word")
    return places.placed(found, docs)
