"""Structured Streaming counterparts of the interactive protocol: the newest job of each drawing wins, and finished work
is counted in windows of event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.rounds import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/plumbline-{uuid.uuid4().hex}/{name}"


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    still = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(still.schema)
    files = still.inputFiles()
    if files and files[0].endswith(f"/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(files[0].rpartition("/")[0])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def drained(made: DataFrame, mode: str, name: str) -> DataFrame:
    """The result of a stream over all that is there now; each batch replaces what was written before."""
    spark, out = made.sparkSession, _folder(made.sparkSession, name)
    query = (
        made.writeStream.outputMode(mode)
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
        .option("checkpointLocation", _folder(spark, f"{name}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def windowed(events: DataFrame, every: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Number and sum of events of each type in windows of event time. In append or update mode, windows older than ``late``
    are closed and events for them dropped; in complete mode, as :func:`stream_windows` runs it, all events count."""
    w = events.withWatermark("at", late).groupBy(F.window("at", every), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 1000 + 0.5)).alias("total"))
    return w.select(F.unix_timestamp(F.col("window.start")).alias("start"), "event_type", "n", "total")


def newest(events: DataFrame) -> DataFrame:
    """The newest job of each user: the one state that a superseding protocol needs."""
    return events.groupBy("user_id").agg(F.max(F.struct("at", "event_id", "event_type")).alias("job")).select("user_id", F.col("job.event_id").alias("event_id"), F.col("job.event_type").alias("event_type"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(windowed(_events(spark, sf_dir)), "complete", "windows")


def stream_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(newest(_events(spark, sf_dir)), "complete", "newest")


WINDOW_SQL = """SELECT (floor(epoch(ts) / 21600) * 21600)::BIGINT AS start, event_type, count(*) AS n, sum(floor(value * 1000 + 0.5)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL"""
NEWEST_SQL = """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"""

QUERIES = {"stream_windows_events": (stream_windows, WINDOW_SQL), "stream_newest_job": (stream_newest, NEWEST_SQL)}
