"""Finds by context: values under suspicious JSON keys, names under name-like headers, sheets in a text."""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Exact names (high confidence), name patterns (medium), placeholders, header names.
SECRET_KEYS = (
    "password", "passwd", "pwd", "secret", "token", "auth", "credential", "credentials", "api_key", "apikey", "access_key", "accesskey", "private_key", "privatekey", "client_secret", "clientsecret", "auth_token", "authtoken", "access_token", "accesstoken",
    "refresh_token", "refreshtoken", "bearer", "jwt", "ssh_key", "sshkey", "passphrase", "session_token", "sessiontoken", "secret_key", "secretkey", "encryption_key", "encryptionkey", "signing_key", "signingkey", "master_key", "masterkey",
)
SECRET_PATTERN = "_key$|_token$|_secret$|_password$|^auth|cred|pass$"
PLACEHOLDERS = ("null", "none", "undefined", "n/a", "na", "true", "false", "xxx", "unknown", "test", "example", "redacted", "todo", "changeme")
NAME_HEADERS = (
    "name", "first name", "firstname", "first_name", "last name", "lastname", "last_name", "surname", "full name", "fullname", "full_name", "given name", "given_name", "family name", "family_name", "middle name", "middle_name", "customer", "customer name", "customer_name",
    "client", "client name", "client_name", "contact", "contact name", "contact_name", "employee", "employee name", "employee_name", "patient", "patient name", "patient_name", "user name", "student", "student name", "author", "owner", "manager", "recipient", "sender", "nom", "prenom", "vorname", "nachname", "nombre", "apellido",
)


def significant(value: Column) -> Column:
    """A string of at least 3 characters that is no placeholder and not one character over and over."""
    return (F.length(value) >= 3) & ~F.lower(value).isin(*PLACEHOLDERS) & ~value.rlike(r"^(.)\1+$")


def plausible_name(value: Column) -> Column:
    v = F.trim(value)
    not_name = F.lower(v).isin(*PLACEHOLDERS) | v.rlike(r"^[\d\s.,+-]+$") | v.contains("@") | v.contains("://") | v.rlike("^[0-9a-fA-F]{16,}$") | v.rlike(r"^(.)\1+$")
    return F.length(v).between(2, 100) & v.rlike(r"\p{L}") & ~not_name


class _Pairs(list):
    """The members of a JSON object, repeated names too."""


_DECODER = json.JSONDecoder(object_pairs_hook=_Pairs, strict=False)
_JSON_START = re.compile(r'\{(?=\s*["}])|\[(?=\s*["{\[\]\-0-9tfn])')
_BRACKETS = re.compile(r'[{}\[\]]|"(?:[^"\\]|\\.)*"', re.S)


def _closed(text: str, start: int) -> bool:
    """Whether the bracket at start is closed by its like, outside strings."""
    open_ = []
    for m in _BRACKETS.finditer(text, start):
        c = m[0]
        if c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if open_.pop() != c:
                return False
            if not open_:
                return True
    return False


def json_fragments(text: str) -> Iterator[tuple[int, int, object]]:
    """(start, end, value) of the outermost JSON objects and arrays of a text: a document, lines, parts of log lines."""
    at = 0
    while m := _JSON_START.search(text, at):
        at = m.end()
        if _closed(text, m.start()):
            with contextlib.suppress(ValueError, RecursionError):
                value, at = _DECODER.raw_decode(text, m.start())
                yield m.start(), at, value


def _json_strings(path: str, value: object) -> Iterator[tuple[str, str, str]]:
    """(path, key, string) of all strings under a key, at any depth. The key of an array's elements is the array's."""
    todo = [(path, None, value)]
    while todo:
        path, key, value = todo.pop()
        if isinstance(value, str):
            if key is not None:
                yield path, key, value
        elif isinstance(value, _Pairs):
            todo += [(f"{path}.{k}", k, v) for k, v in value]
        elif isinstance(value, list):
            todo += [(f"{path}[{i}]", key, v) for i, v in enumerate(value)]


def json_secrets(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, path, key, value, confidence) of strings under suspicious keys, at any depth, in all JSON of a text.

    Paths start with $ where the text is one JSON document, and with $@ and the fragment's place in
    characters where JSON lies in lines or among other text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "path", "key", "text"]

        def batch(ids: pa.Array, rows: list, at: list) -> pa.RecordBatch:
            found = [pa.array([clean(r[k]) for r in rows], pa.string()) for k in range(3)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *found], names)

        def clean(x: str) -> str:
            return x.encode("utf-8", "replace").decode()

        for b in batches:
            rows, at = [], []
            for i, t in enumerate(b.column(1)):
                text = t.as_py() or ""
                for start, end, value in json_fragments(text):
                    whole = not text[:start].strip() and not text[end:].strip()
                    for row in _json_strings("$" if whole else f"$@{start}", value):
                        rows.append(row)
                        at.append(i)
                if len(rows) >= 10_000:
                    yield batch(b.column(0), rows, at)
                    rows, at = [], []
            yield batch(b.column(0), rows, at)

    kind = df.schema[id_col].dataType.simpleString()
    named = df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, path string, key string, text string")
    exact, like = F.lower("key").isin(*SECRET_KEYS), F.lower("key").rlike(SECRET_PATTERN)
    return named.where((exact | like) & significant(F.col("text"))).select(id_col, "path", "key", F.col("text").alias("value"), F.when(exact, "high").otherwise("medium").alias("confidence"))


def _cells(line: Column, sep: Column) -> Column:
    """The fields of a line; quoted fields may hold the delimiter and doubled quotes."""
    plain = F.split(line, F.concat(F.lit("["), sep, F.lit("]")), -1)
    quoted = F.regexp_extract_all(F.concat(sep, line), F.concat(F.lit("["), sep, F.lit(']("(?:[^"]|"")*"|[^'), sep, F.lit("]*)")), F.lit(1))
    unquoted = F.transform(quoted, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(line.contains('"'), unquoted).otherwise(plain)


def delimiter(line: Column) -> Column:
    """The most frequent of , tab ; | in a line; the earlier one on ties."""
    counts = [F.struct(F.regexp_count(line, F.lit(f"[{d}]")).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate((",", "\t", ";", "|"))]
    return F.array_max(F.array(*counts))["d"]


def csv_names(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_no, header, value): plausible names under headers that name people."""
    rows = df.select(F.col(id_col), F.split(text_col, r"\r?\n").alias("lines")).withColumn("sep", delimiter(F.get("lines", 0)))
    rows = rows.withColumn("head", _cells(F.get("lines", 0), F.col("sep")))
    body = rows.select(id_col, "sep", "head", F.posexplode("lines").alias("n", "line")).where("n > 0 AND line <> ''")
    body = body.withColumn("cells", _cells(F.col("line"), F.col("sep")))
    cells = body.select(id_col, (F.col("n") + 1).alias("row_no"), F.explode(F.arrays_zip("head", "cells")).alias("z"))
    named = cells.select(id_col, "row_no", F.col("z.head").alias("header"), F.col("z.cells").alias("value"))
    return named.where(F.lower(F.trim("header")).isin(*NAME_HEADERS) & plausible_name(F.col("value")))


def sheet_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sheet, row_no, cells) of texts with === name === lines before each sheet."""
    rows = df.select(F.col(id_col), F.posexplode(F.split(text_col, "\n", -1)).alias("n", "cells"))
    name = F.regexp_extract("cells", r"^=== (.+) ===$", 1)
    rows = rows.withColumn("own", F.when(name != "", name))
    sheet = F.last("own", ignorenulls=True).over(W.partitionBy(id_col).orderBy("n"))
    return rows.withColumn("sheet", sheet).where("own IS NULL").select(id_col, "sheet", (F.col("n") + 1).alias("row_no"), "cells")
