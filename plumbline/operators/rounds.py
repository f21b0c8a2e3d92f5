"""Results of a round, written to the shared folder and read again.

A checkpointed frame keeps the size that Spark estimated for it, and a join multiplies the estimates of its sides, so that
a loop that joins its own result soon plans with numbers of thousands of digits. A table that is read again has its true
size, a short plan, and costs a lost executor no more than a reread.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark setting that frees a query's shuffle files as soon as the query has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run inside free their shuffle files when they end, so that steps don't add up on disk."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of this machine only where none is set and Spark runs in one
    process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-plumbline-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again with its own schema."""
    path = f"{shared_folder(df.sparkSession)}/plumbline-{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more."""
    for df in tables:
        if df is not None and (files := df.inputFiles()):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that goes by shuffle: Spark takes the rows of an ``explode`` for as many as went in, and files
    for as large as they lie packed, and would broadcast either through the driver."""
    return df.hint("merge")


def estimated_bits(df: DataFrame) -> int:
    """Number of bits of the size that Spark plans with for ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length()


#: Rows that a task is given at most where their number is known.
TASK_ROWS = 1 << 19


def parts(spark: SparkSession, rows: int) -> int:
    """Number of partitions for so many rows, so that a task's memory doesn't grow with them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to a task for each core and to as many more as so many rows need, where a shuffle of few bytes
    that become many rows would be left to few tasks."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)
