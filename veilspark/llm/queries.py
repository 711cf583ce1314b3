"""The registered queries of this subpackage and, where SQL can express one, its DuckDB twin."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_trees, exact_dedup, hard_negatives, licenses, line_dedup, mixing, near_dedup, phrases, quality, rans, secrets, simhash
from .common import documents, quality_labels, shared_dir, spread, text_of


def tokenizer_json(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.find_secrets(docs, secrets.fit(secrets.count_texts(docs)))
    named = [r[0] for r in secrets.RULES]

    def listed(spans) -> F.Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def counted(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(named))
    return found.select("doc_id", *[counted(k) for k in (*named, secrets.MARKOV)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.judged(documents(spark, sf_dir), labels=quality_labels(spark, sf_dir))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("log_perplexity", 4).alias("log_perplexity"))


def op3_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    done = chat_trees.format_trees(chat_trees.threads(rows.unionByName(extra)))
    read = done.select("tree", "formatted", chat_trees.read_turns(F.col("formatted")).alias("turns"), F.array_join(chat_trees.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("found", lambda x: x["rule"] == "base")

    def labels(found) -> F.Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")

    starts = F.transform(base, lambda x: x["first"])
    return licenses.find_licenses(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        (F.coalesce(F.array_max(F.transform("found", lambda x: x["priority"])), F.lit(0)) / 100.0).alias("score"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_documents(documents(spark, sf_dir), tokenizer_json())
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(text_of("text"), 256).alias("text_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mixing.mix_documents(documents(spark, sf_dir), whole=False)
    return done.select("doc_id", F.col("mix_tokens").alias("n_tokens"), F.round("mix_probability", 6).alias("probability"), F.col("mix_kept").alias("kept"))


def op9_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/veilspark-{uuid.uuid4().hex}"
    rans.write_files(documents(spark, sf_dir), tokenizer_json(), path)
    files = spark.read.parquet(path)
    read = rans.read_digests(files).join(rans.part_starts(files), "part")
    return read.select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), size=4).drop("text_hash")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("id") % 100 == 0, label=label)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir)).drop("size", "cut")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.similar_documents(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_quality, op3_chat_trees, op4_exact_dedup, op5_licenses, op6_bpe, op7_line_dedup, op8_mixing, op9_rans_files, op10_near_dedup, op11_hard_negatives, op12_phrases, op13_simhash)}

ORACLES = {
    "op3_chat_trees": r"""
        with t as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
          union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
        select conv_id, count(*) as n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
          cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
          sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
          cast(sum(24 + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\1\\|', 'g'))
            + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) as bigint) as formatted_chars
        from t group by conv_id""",
    "op4_exact_dedup": r"""
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as n from documents)
        select doc_id, min(doc_id) over (partition by n) as keep_id, count(*) over (partition by n) as group_size,
          doc_id = min(doc_id) over (partition by n) as kept, sha256(n) as text_sha256 from t""",
    "op7_line_dedup": r"""
        with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        p as (select doc_id, lines, unnest(range(1, len(lines) - 1)) as pos from d),
        w as (select doc_id, pos, lines[pos:pos + 2] as w from p
          where regexp_matches(concat(lines[pos], lines[pos + 1], lines[pos + 2]), '[^\x20\x09-\x0D]')),
        later as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by w order by doc_id, pos) as k from w) where k > 1),
        gone as (select distinct doc_id, pos + k as pos from later, (values (0), (1), (2)) as v(k)),
        l as (select doc_id, unnest(range(1, len(lines) + 1)) as pos, unnest(lines) as line from d)
        select l.doc_id, count(*) as n_lines, count(gone.pos) as n_removed,
          sha256(coalesce(string_agg(line, chr(10) order by l.pos) filter (gone.pos is null), '')) as text_sha256
        from l left join gone on l.doc_id = gone.doc_id and l.pos = gone.pos group by l.doc_id""",
    "op8_mixing": r"""
        with recursive d as (
          select doc_id, coalesce(source, '') as s, coalesce(lang, '') as l, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n,
            case when contains(text, 'icense') or contains(text, 'ICENSE') then 'legal' when contains(text, '@') or contains(text, '://') then 'web'
              when len(regexp_extract_all(text, '[0-9]')) * 200 > length(text) then 'data' else 'prose' end as t from documents),
        c as (select s, l, t, sum(n)::double as n from d group by all having sum(n) > 0),
        ts as (select s, pow(sum(n), 0.9) / sum(pow(sum(n), 0.9)) over () as a from c group by s),
        tl as (select l, pow(sum(n), 0.9) / sum(pow(sum(n), 0.9)) over () as b from c group by l),
        tt as (select t, pow(sum(n), 0.9) / sum(pow(sum(n), 0.9)) over () as g from c group by t),
        r as (
          select s, l, t, n, a, b, g, n as w, 0 as it from c join ts using (s) join tl using (l) join tt using (t)
          union all
          select s, l, t, n, a, b, g, w2 * g / sum(w2) over (partition by t), it + 1 from (
            select *, w1 * b / sum(w1) over (partition by l) as w2 from (select *, w * a / sum(w) over (partition by s) as w1 from r)) where it < 80),
        p as (select s, l, t, w / n / max(w / n) over () as p from r where it = 80)
        select doc_id, n as n_tokens, round(case when n > 0 then coalesce(p, 0) else 0 end, 6) as probability,
          cast('0x' || substr(md5('1:' || doc_id), 1, 13) as bigint)::double / 4503599627370496 < case when n > 0 then coalesce(p, 0) else 0 end as kept
        from d left join p using (s, l, t)""",
    "op10_near_dedup": r"""
        with recursive w as (
          select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as x from documents),
        s as (select distinct doc_id, sh from (select doc_id, unnest(case when len(x) = 0 then [] when len(x) < 4 then [array_to_string(x, ' ')]
          else list_transform(range(1, len(x) - 2), lambda i: array_to_string(x[i:i + 3], ' ')) end) as sh from w)),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
        e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
        both_ways as (select a, b from e union all select b, a from e),
        reach as (select a as x, b as y from both_ways union select r.x, z.b from reach r join both_ways z on r.y = z.a),
        m as (select x as doc_id, min(y) as y from reach group by x)
        select doc_id, coalesce(n.n, 0) as n_shingles, least(doc_id, coalesce(m.y, doc_id)) as component_id, doc_id <= coalesce(m.y, doc_id) as kept
        from documents left join n using (doc_id) left join m using (doc_id)""",
    "op11_hard_negatives": r"""
        with e as (
          select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
          where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as anchor_id, e.vec_id as id, a.label = e.label as same, cast(list_inner_product(a.v, e.v) as bigint) as score
          from e as a join e on a.vec_id % 100 = 0 and a.vec_id <> e.vec_id),
        p as (select anchor_id, id, score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
        n as (select anchor_id, p.id as positive_id, row_number() over (partition by anchor_id, p.id order by s.score desc, s.id) as rank,
            s.id as negative_id, p.score as positive_score, s.score as negative_score
          from p join s using (anchor_id) where not same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
        select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10""",
    "op12_phrases": r"""
        with d as (select coalesce(lang, 'und') as lang,
            unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
        w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from d),
        f as (select lang, size, phrase, count(*) as f from (
            select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase
            from w, (values (1), (2), (3)) as v(size) where len(w) >= size) group by all),
        c as (select lang, size, phrase, f as a from f where size > 1 and f >= 10),
        cuts as (select c.*, k, array_to_string(string_split(phrase, ' ')[:k], ' ') as x, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') as y
          from c, (values (1), (2)) as v(k) where k < size),
        s as (select cuts.*, l.f as l, r.f as r, cast((1000000::hugeint * a * a) // (l.f::hugeint * r.f) as bigint) as score
          from cuts join f as l on l.lang = cuts.lang and l.phrase = x join f as r on r.lang = cuts.lang and r.phrase = y),
        b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
        longer as (select lang, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') as phrase, max(a) as m from c, (values (1), (2)) as v(i) where size = 3 group by all),
        kept as (select b.* from b left join longer using (lang, phrase) where coalesce(100 * m < 50 * a, true)),
        n as (select lang, sum(f)::bigint as n from f where size = 1 group by lang)
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept join n using (lang)
        qualify rank <= 2000""",
}
