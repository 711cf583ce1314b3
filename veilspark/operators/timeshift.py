"""Time shift: find timestamps of nine shapes, move them, print them back in their own shape.

Wall time is moved; zone texts stay as they are. Where two shapes overlap, the earlier shape in the
list wins. All times are read in UTC; a shape without a year takes `assume_year`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.catalogue import MONTHS, Rule

from . import spans as sp

# The shapes in order of precedence, each from the document that describes it.
_CLOCK = "(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
_MON, _WEEKDAY = f"(?:{MONTHS})", "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
_DATE, _SLASHED = "[0-9]{4}-[01][0-9]-[0-3][0-9]", "[01][0-9]/[0-3][0-9]/[0-9]{4}"
_CLF = rf"[0-9]{{1,2}}/{_MON}/[0-9]{{4}}:{_CLOCK}(?: ?[+-][0-9]{{4}})?"
SHAPES = (
    ("iso", rf"{_DATE}[T ]{_CLOCK}(?:[.,][0-9]{{1,9}})?(?:Z|[+-][0-9]{{2}}:?[0-9]{{2}})?"),  # RFC 3339, ISO 8601
    ("apache_error", rf"\[{_WEEKDAY} {_MON} +[0-9]{{1,2}} {_CLOCK} [0-9]{{4}}\]"),  # Apache, ErrorLogFormat (ctime)
    ("apache_access", rf"\[{_CLF}\]"),  # Apache, LogFormat %t
    ("clf", _CLF),  # the same without brackets
    ("chat", rf"\({_WEEKDAY}, [0-9]{{1,2}} {_MON} [0-9]{{4}} {_CLOCK}\)"),  # RFC 5322 date in parentheses
    ("syslog", rf"{_MON} [ 0-9]?[0-9] {_CLOCK}"),  # RFC 3164, no year
    ("iso_date", _DATE),
    ("us_datetime", rf"{_SLASHED} {_CLOCK}"),
    ("us_date", _SLASHED),
)
#: How the part of each shape that is a time is read and printed; what stands around it stays.
FORMATS = {"iso": "yyyy-MM-dd HH:mm:ss", "apache_error": "MMM d HH:mm:ss yyyy", "apache_access": "d/MMM/yyyy:HH:mm:ss", "clf": "d/MMM/yyyy:HH:mm:ss", "chat": "d MMM yyyy HH:mm:ss", "syslog": "yyyy MMM d HH:mm:ss", "iso_date": "yyyy-MM-dd", "us_datetime": "MM/dd/yyyy HH:mm:ss", "us_date": "MM/dd/yyyy"}


def found(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the spans of all shapes; priority falls with the place in the list."""
    rules = [Rule(name, "time", 100 - i, pattern) for i, (name, pattern) in enumerate(SHAPES)]
    shaped = sp.detect(df, rules, text_col, "times")

    return shaped.withColumn("times", sp.without_clashes(F.col("times")))


def read(value: Column, shape: Column, assume_year: int = 2024) -> Column:
    """The time of a value; null if it is none (a 13th month, a word of three letters that is no month)."""
    blanks = F.regexp_replace(value, r"\s+", " ")
    part = (
        F.when(shape == "iso", F.concat(F.substring(value, 1, 10), F.lit(" "), F.substring(value, 12, 8)))
        .when(shape.isin("apache_access", "clf"), F.regexp_extract(value, rf"([0-9]{{1,2}}/{_MON}/[0-9]{{4}}:{_CLOCK})", 1))
        .when(shape == "apache_error", F.regexp_extract(blanks, rf"({_MON} [0-9]{{1,2}} {_CLOCK} [0-9]{{4}})", 1))
        .when(shape == "chat", F.regexp_extract(blanks, rf"([0-9]{{1,2}} {_MON} [0-9]{{4}} {_CLOCK})", 1))
        .when(shape == "syslog", F.concat(F.lit(f"{assume_year} "), blanks))
        .otherwise(blanks)
    )
    out = F.when(F.lit(False), F.lit(None).cast("timestamp"))
    for name, form in FORMATS.items():
        out = out.when(shape == name, F.try_to_timestamp(part, F.lit(form)))
    return out


def printed(at: Column, shape: Column, value: Column) -> Column:
    """The time in its shape; separators, fractions and zone texts stay as they are."""
    zone = F.regexp_extract(value, rf"[0-9]{{4}}:{_CLOCK}(.*)$", 1)
    day = F.date_format(at, "dd/MMM/yyyy:HH:mm:ss")
    return F.coalesce(
        F.when(shape == "iso", F.concat(F.date_format(at, "yyyy-MM-dd"), F.substring(value, 11, 1), F.date_format(at, "HH:mm:ss"), F.substring(value, 20, 40)))
        .when(shape == "apache_error", F.concat(F.lit("["), F.date_format(at, "EEE MMM dd HH:mm:ss yyyy"), F.lit("]")))
        .when(shape == "apache_access", F.concat(F.lit("["), day, zone))
        .when(shape == "clf", F.concat(day, zone))
        .when(shape == "chat", F.concat(F.lit("("), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(")")))
        .when(shape == "syslog", F.date_format(at, "MMM dd HH:mm:ss"))
        .when(shape == "iso_date", F.date_format(at, "yyyy-MM-dd"))
        .when(shape == "us_datetime", F.date_format(at, "MM/dd/yyyy HH:mm:ss"))
        .when(shape == "us_date", F.date_format(at, "MM/dd/yyyy")),
        value,
    )


def moved(at: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(at) + seconds)


def at_line_start(text: Column, start: Column) -> Column:
    return (start == 0) | (F.substring(text, start, F.lit(1)) == "\n")


def shifted(df: DataFrame, seconds: int | None = None, first_at: str | None = None, only_line_start: bool = False, assume_year: int = 2024) -> DataFrame:
    """df with moved texts: by seconds, or so that each document's first time becomes first_at."""
    held = found(df)
    if only_line_start:
        held = held.withColumn("times", F.filter("times", lambda s: at_line_start(F.col("text"), s["start"])))
    held = held.withColumn("ats", F.transform("times", lambda s: read(s["value"], s["rule"], assume_year)))
    first = F.get(F.filter("ats", lambda a: a.isNotNull()), 0)
    by = F.lit(seconds or 0).cast("long") if first_at is None else F.coalesce(F.unix_timestamp(F.lit(first_at).cast("timestamp")) - F.unix_timestamp(first), F.lit(0).cast("long"))
    held = held.withColumn("by", by)
    new = F.zip_with("times", "ats", lambda s, a: F.when(a.isNull(), s["value"]).otherwise(printed(moved(a, F.col("by")), s["rule"], s["value"])))
    held = held.withColumn("new", new)
    return held.withColumn("text", sp.applied(F.col("text"), F.col("times"), F.col("new"))).withColumn("n_times", F.size("times").cast("long")).drop("ats", "by", "new", "times")


def preview(df: DataFrame, seconds: int, most: int = 3, assume_year: int = 2024) -> DataFrame:
    """(doc_id, n, before, after): the first times of each document and what they become."""
    held = found(df).select("doc_id", F.slice("times", 1, most).alias("times"))
    rows = sp.rows_of(held, "times", ["doc_id"], "n")
    at = read(F.col("s.value"), F.col("s.rule"), assume_year)
    after = F.when(at.isNull(), F.col("s.value")).otherwise(printed(moved(at, F.lit(seconds)), F.col("s.rule"), F.col("s.value")))
    return rows.select("doc_id", (F.col("n") + 1).alias("n"), F.col("s.value").alias("before"), after.alias("after"))
