"""Text files, archives, rule sets, mappings: readers and writers."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.catalogue import Rule, merged

#: Extensions of text members.
TEXT_EXTENSIONS = ("txt", "log", "csv", "tsv", "json", "jsonl", "xml", "html", "yaml", "yml", "toml", "ini", "conf", "cfg", "md", "sql", "py", "js", "ts", "sh", "eml", "gpx", "env")
SNIFFED = 8192


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, size): whole files of a folder and those below it; gzip is read as it is."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("size"))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, text, size) of the text members of zip archives.

    Folders, __MACOSX, dot files, other extensions, members with a NUL at their beginning and members that
    are not UTF-8 are left out. One archive is one task's work, a member at a time.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame({"archive": [path], "name": [info.filename], "content": [z.read(info)], "size": [info.file_size]})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, name string, content binary, size long")
    base = F.substring_index("name", "/", -1)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    usual = ~F.contains("name", F.lit("__MACOSX")) & ~F.startswith(base, F.lit(".")) & F.lower(F.substring_index(base, ".", -1)).isin(*TEXT_EXTENSIONS)
    rows = rows.where(usual & ~F.substring("content", 1, SNIFFED).cast("string").contains("\0"))
    return rows.select("archive", "name", text.alias("text"), "size").where("text IS NOT NULL")


def named_member(members: DataFrame, name: str | None = None) -> DataFrame:
    """One named member of each archive, or the first by name."""
    if name is not None:
        return members.where(F.col("name") == name)
    return members.groupBy("archive").agg(F.min_by(F.struct("name", "text", "size"), "name").alias("m")).select("archive", "m.*")


def write_texts(rows: DataFrame, path: str, compression: str = "none") -> None:
    rows.select("text").write.option("compression", compression).text(path)


def write_batch(rows: DataFrame, path: str) -> None:
    """Every processed file as a row keyed by scrubbed_<name>."""
    rows.withColumn("name", F.concat(F.lit("scrubbed_"), F.substring_index("path", "/", -1))).write.parquet(path)


def write_rules(spark: SparkSession, rules: list[Rule], path: str) -> None:
    spark.createDataFrame([(json.dumps({k: v for k, v in asdict(r).items() if k != "gate"}),) for r in rules], "value string").coalesce(1).write.text(path)


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """A saved rule set laid over the defaults; a rule set is configuration of bounded size."""
    return merged([json.loads(r.value) for r in spark.read.text(path).collect()])


def write_mapping_json(mapping: DataFrame, path: str) -> None:
    mapping.write.json(path)


def write_mapping_csv(mapping: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled."""
    mapping.write.option("quoteAll", True).option("escape", '"').option("header", True).csv(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, original string, number long").json(path)


def write_dictionary(numbered: DataFrame, path: str) -> None:
    """(kind, original, replacement, number) as JSON lines, one folder a kind; read_dictionary() reads it back."""
    numbered.select("kind", "original", "replacement", "number").write.partitionBy("kind").json(path)
