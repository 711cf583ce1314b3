"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources.shared import settled, shared_dir, spread, written

#: Characters of text that a Python task holds as Python objects at a time.
CHUNK_CHARS = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """(doc_id, quality), where the data has labels."""
    try:
        return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: As checkpointed(), but as a compressed column table whose size Spark knows.
stored = written


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have (Spark compares names in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_of(column) -> "F.Column":
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def small_slices(batch: pa.RecordBatch, text: int, most: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batch with at most so much text, or one longer row, each."""
    from_row, chars = 0, 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()):
        if i > from_row and chars + n > most:
            yield batch.slice(from_row, i - from_row)
            from_row, chars = i, 0
        chars += n
    if from_row < batch.num_rows:
        yield batch.slice(from_row)


def trim() -> None:
    """Gives freed memory back to the machine."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def released(run: Callable) -> Callable:
    """A task function that gives its freed memory back at the end: Spark keeps Python workers for later tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped
