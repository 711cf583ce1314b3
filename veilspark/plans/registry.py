"""All registered queries and their DuckDB twins.

Each module of this folder, imported in its __init__, adds its own queries with @query; a query takes (spark, sf_dir).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.sources.shared import spread

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over all cores."""
    return spread(table(spark, sf_dir, "documents"))


def sql(text: str) -> str:
    """A string for SQL."""
    return "'" + text.replace("'", "''") + "'"

