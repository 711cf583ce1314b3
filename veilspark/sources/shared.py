"""Tables written in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: While on, Spark removes the shuffle files of a query as soon as it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders that written() filled since the innermost settled() began.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is named, a local session has one of its own; a cluster has none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="veilspark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame) -> DataFrame:
    """df, computed once and read back: for tables that a plan uses more than once, and for what must not be dealt anew.

    The write's shuffle files go when it ends: nothing reads them again, and a lost executor costs only what is running.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilspark-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    if (paths := _passing.get()) is not None:
        paths.append(path)
    return spark.read.parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, as written() gives it; the tables that make() wrote on its way are removed then.

    Only the result may be used afterwards. If anything fails, the tables stay for a look at them.
    """
    token = _passing.set([])
    try:
        done = make()
        paths = _passing.get()
    finally:
        _passing.reset(token)
    result = written(done)
    hadoop, jvm = done.sparkSession.sparkContext._jsc.hadoopConfiguration(), done.sparkSession.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(hadoop).delete(folder, True)
    return result


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files have fewer parts, as a small table in one file has: texts cost far more to scan than to deal.

    A table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores, whatever its files are: for narrow rows, such as keys, that cost far more to work on than to deal.

    A Parquet file's parts are cut by bytes, but a row group goes to one of them whole; so a table may have many parts and all of its rows in one.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))
