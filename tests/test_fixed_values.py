"""Presets, key names, label groups and suggestions, spelt out; mappings by document; quoted commas."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions import presets
from veilspark.operators import classify, context, entities, report


def test_presets_turn_on_what_they_name():
    on = {name: {r.id for r in presets.rules_of(name) if r.enabled} for name in presets.PRESETS}
    assert {"gps_coordinates", "jwt"} <= on["api-json"] and "url" not in on["api-json"]
    assert {"email", "credit_card", "ssn", "private_key"} <= on["minimal"] and not {"ipv4", "generic_secret", "jwt"} & on["minimal"]
    assert {"sip_via", "email", "hostname"} <= on["sip-voip"] and not {"uuid", "url"} & on["sip-voip"]
    assert {r.id for r in presets.rules_of("minimal") if r.strategy == "redact" and r.enabled} >= {"credit_card", "ssn", "aws_access_key", "aws_secret_key", "private_key"}
    assert set(classify.PRESETS.values()) <= set(presets.PRESETS)


@pytest.mark.parametrize(
    "key, confidence",
    [("auth", "high"), ("JWT", "high"), ("sshKey", "high"), ("signing_key", "high"), ("masterKey", "high"), ("encryptionkey", "high"), ("my_key", "medium"), ("db_PASSWORD", "medium"), ("authority", "medium"), ("xCreds", "medium"), ("bypass", "medium"), ("tokens", None), ("card_number", None), ("author", "medium"), ("keys", None)],
)
def test_key_names(spark, key, confidence):
    df = spark.createDataFrame([(1, f'{{"{key}": "some value"}}')], "doc_id long, text string")
    assert [r.confidence for r in context.json_secrets(df, "doc_id").collect()] == ([confidence] if confidence else [])


def test_label_groups(spark):
    want = {
        "tel": "ml_contact", "pass": "ml_credential", "country": "ml_location", "postcode": "ml_location", "first_name": "ml_person_name", "last_name": "ml_person_name", "api_key": "ml_credential", "credit_card": "ml_financial", "ip_address": "ml_network", "CONTACT": "ml_contact", "CREDENTIAL": "ml_credential",
        "FINANCIAL": "ml_financial", "TEMPORAL": "ml_temporal", "NETWORK": "ml_network", "USERNAME": "ml_credential", "dob": "ml_person_name", "socialnumber": "ml_identifier", "pci_track": "ml_financial", "MISC": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "g string")
    assert {r.g: r.rule for r in df.select("g", entities.rule_of(F.col("g")).alias("rule")).collect()} == want


def test_one_label_in_two_documents_is_two_entries(spark):
    rows = [(1, 0, "email", "a@b.co", "[EMAIL-1]", 1), (1, 9, "email", "a@b.co", "[EMAIL-1]", 2), (2, 4, "email", "c@d.eu", "[EMAIL-1]", 1)]
    known = report.mapping(spark.createDataFrame(rows, "doc_id long, start int, rule string, value string, replacement string, line int"))
    assert {(r.doc_id, r.original, r.n, r.lines) for r in known.collect()} == {(1, "a@b.co", 2, "1,2"), (2, "c@d.eu", 1, "1")}
    texts = spark.createDataFrame([(1, "to [EMAIL-1]\nand [EMAIL-1] [X-1]"), (2, "[EMAIL-1]"), (3, "[EMAIL-1]"), (4, None)], "doc_id long, redacted string")
    got = {(r.doc_id, r.original, r.n, r.lines) for r in report.revealed(texts, known, r"\[[A-Z]+-[0-9]+\]").collect()}
    assert got == {(1, "a@b.co", 2, "1,2"), (2, "c@d.eu", 1, "1")}


def test_quoted_commas_in_a_header(spark):
    rows = [('"a,b",c\n1,2', None), ('"a,b",c\n1,2\n1,2,3', 3), ('a,b\n"1,2",3\n"x""y",4', None), ("a,b\n1", 2), ("", None)]
    df = spark.createDataFrame(rows, "t string, want int")
    assert all(r.got == r.want for r in df.select("want", classify.csv_first_bad_row(F.col("t")).alias("got")).collect())
