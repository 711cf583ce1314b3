"""Syntax verdicts that SQL has no parser for: YAML, TOML and XML, in Arrow batches."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable
from xml.parsers import expat

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERDICT = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("line", T.IntegerType())])


def _each(texts: pd.Series, verdict: Callable[[str], tuple[bool, int | None]]) -> pd.DataFrame:
    """The verdicts of a batch; equal texts are parsed once."""
    texts = texts.fillna("")
    known = {t: verdict(t) for t in texts.unique()}
    return pd.DataFrame([known[t] for t in texts], columns=["valid", "line"]).astype({"line": "Int32"})


@F.pandas_udf(VERDICT)
def toml_verdict(texts: pd.Series) -> pd.DataFrame:
    """Whether a text is TOML, and the line of the first error where the parser tells it."""

    def one(text: str) -> tuple[bool, int | None]:
        try:
            tomllib.loads(text)
            return True, None
        except tomllib.TOMLDecodeError as e:
            found = re.search(r"line (\d+)", str(e))
            return False, int(found[1]) if found else None

    return _each(texts, one)


@F.pandas_udf(VERDICT)
def yaml_verdict(texts: pd.Series) -> pd.DataFrame:
    """Whether a text is YAML; needs PyYAML on the executors."""
    import yaml

    def one(text: str) -> tuple[bool, int | None]:
        try:
            for _ in yaml.parse(text, Loader=yaml.SafeLoader):
                pass
            return True, None
        except yaml.YAMLError as e:
            mark = getattr(e, "problem_mark", None)
            return False, mark.line + 1 if mark else None

    return _each(texts, one)


@F.pandas_udf(VERDICT)
def xml_verdict(texts: pd.Series) -> pd.DataFrame:
    """Whether a text is well-formed XML, and the line of the first error."""

    def one(text: str) -> tuple[bool, int | None]:
        parser = expat.ParserCreate()
        try:
            parser.Parse(text.encode(), True)
            return True, None
        except expat.ExpatError as e:
            return False, e.lineno

    return _each(texts, one)
