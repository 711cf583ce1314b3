"""Entities of a tagger as finds of rules, gates before costly detectors, and finds turned into rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import context, records

#: Rule ids and the groups and labels of the usual models that belong to each, in any case; labels that are named nowhere (MISC) are dropped.
RULE_GROUPS = {
    "ml_person_name": ("PER", "PERSON", "GIVENNAME1", "GIVENNAME2", "LASTNAME1", "LASTNAME2", "LASTNAME3", "TITLE", "SEX", "BOD", "FIRST_NAME", "LAST_NAME", "NAME", "DOB", "HIPAA_DOB", "FIRSTNAME", "LASTNAME", "MIDDLENAME", "PREFIX"),
    "ml_location": ("LOC", "LOCATION", "GPE", "STREET", "CITY", "STATE", "COUNTRY", "POSTCODE", "BUILDING", "SECADDRESS", "GEOCOORD", "ZIPCODE", "COUNTY", "BUILDINGNUMBER"),
    "ml_organization": ("ORG", "ORGANIZATION", "COMPANYNAME"),
    "ml_identifier": ("ID", "PASSPORT", "IDCARD", "DRIVERLICENSE", "SOCIALNUMBER", "SSN", "DRIVER_LICENSE", "GDPR_NIN", "GDPR_PASSPORT", "HIPAA_MRN", "VEHICLEVIN"),
    "ml_contact": ("CONTACT", "EMAIL", "TEL", "PHONE", "PHONENUMBER"),
    "ml_financial": ("FINANCIAL", "CREDIT_CARD", "GDPR_IBAN", "HIPAA_ACCOUNT", "PCI_EXPIRY", "PCI_PAN", "PCI_TRACK", "CREDITCARDNUMBER", "ACCOUNTNUMBER", "IBAN", "BIC", "CURRENCY", "AMOUNT"),
    "ml_credential": ("CREDENTIAL", "USERNAME", "PASS", "API_KEY", "AWS_KEY", "PASSWORD", "PRIVATE_KEY", "PIN", "SECRET"),
    "ml_temporal": ("TEMPORAL", "DATE", "TIME", "AGE"),
    "ml_network": ("NETWORK", "IP", "IP_ADDRESS", "IPV4", "IPV6", "MAC", "URL", "USERAGENT"),
}
GROUP_RULE = {g: rule for rule, groups in RULE_GROUPS.items() for g in groups}


def rule_of(group: Column) -> Column:
    """The rule of an entity's group; null for groups that have none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in GROUP_RULE.items() for x in kv]), F.upper(group))


#: Characters of texts that a tagger gets at a time, beside what is over of the last text.
BATCH_CHARS = 500_000
TOKEN = "token_no int, label string, word string, score double, start int, end int"


def tagged(df: DataFrame, tagger: Callable[[pd.Series], list[list[tuple]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_no, label, word, score, start, end) from a user's tagger.

    It gets a batch of texts and returns for each its tokens (label, word, score, start, end), as a model that is
    loaded once a worker does. Batches are Arrow's, cut to BATCH_CHARS characters or one longer text, so that few tokens are held as Python objects.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [id_col, "token_no", "label", "word", "score", "start", "end"]
        for whole in batches:
            part = (whole.iloc[:, 1].str.len().cumsum() - 1).clip(lower=0) // BATCH_CHARS
            for _, b in whole.groupby(part, sort=False):
                b = b.reset_index(drop=True)
                rows = [(i, k, *token) for i, tokens in zip(b.iloc[:, 0], tagger(b.iloc[:, 1])) for k, token in enumerate(tokens)]
                yield pd.DataFrame(rows, columns=names)

    return df.select(id_col, F.coalesce(F.col(text_col), F.lit(""))).mapInPandas(run, f"`{id_col}` {kind}, {TOKEN}")


def entity_spans(tokens: DataFrame, least: float = 0.5) -> DataFrame:
    """Tokens (doc_id, ..) merged to entities, as finds: (doc_id, rule, value, start, end, score)."""
    merged = records.entities(tokens, least).withColumn("rule", rule_of(F.col("kind")))
    return merged.where("rule IS NOT NULL").select("doc_id", "rule", F.col("word").alias("value"), "start", "end", "score")


def deduplicated(spans: DataFrame, rank: list[str], id_col: str = "doc_id") -> DataFrame:
    """One of the spans with the same place in a document: the first by the columns of rank."""
    rest = [c for c in spans.columns if c not in (id_col, "start", "end")]
    best = F.min_by(F.struct(*rest), F.struct(*rank)).alias("s")
    return spans.groupBy(id_col, "start", "end").agg(best).select(id_col, "start", "end", *[f"s.{c}" for c in rest])


def likely_json(text: Column) -> Column:
    """Whether a text may hold JSON at all: a brace or bracket and a quoted name before a colon, or an array."""
    return text.rlike(r'[{]\s*"[^"\n]*"\s*:|^\s*\[\s*["{\[0-9-]')


def likely_names(text: Column) -> Column:
    """Whether the first line is a header with a delimiter and a field that names people."""
    head = F.split_part(F.regexp_replace(text, "\r\n", "\n"), F.lit("\n"), F.lit(1))
    fields = F.transform(F.split(head, r"[,;\t|]"), lambda c: F.lower(F.trim(F.regexp_replace(c, '"', ""))))
    return (F.size(fields) > 1) & F.exists(fields, lambda c: c.isin(*context.NAME_HEADERS))


def literals_of(finds: DataFrame, value: str = "value") -> DataFrame:
    """Finds by context as a list of literals to redact elsewhere: (item_id, literal), one for each distinct value."""
    return finds.select(F.lower(value).alias("literal")).where("length(literal) > 0").distinct().withColumn("item_id", F.xxhash64("literal"))
