"""What the training-data operators share: tables, scratch space on the shared folder, materialised steps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.rounds import freed_shuffles, shared_folder

#: Java regular expression of what separates words, the complement of ``[^\x20\x09-\x0D]+``.
WORD_BREAK = r"[ \t-\r]+"
#: The same characters, for ``translate``.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark)}/plumbline-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and reread it: lineage ends there, and a lost executor costs
    only a reread."""
    path = scratch(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete what :func:`materialise` wrote, once nothing reads it any more."""
    for df in tables:
        if files := df.inputFiles():
            session = df.sparkSession
            path = session._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers by the thousand rows, so that many long ones at once don't exhaust an executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(1000, int(spark.conf.get(key)) or 1000)))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none of a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def text_bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")
