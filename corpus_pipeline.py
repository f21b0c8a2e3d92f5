"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before it kept, and returns the columns of
``documents``; the last returns the packed pieces. A stage's result is written as Parquet and reread as the next one's
input, so that a lost executor costs no more than the stage at hand.

Nulls, empty texts, repeated rows and extra columns are treated as the operators' docstrings say; a document whose text
a stage empties stays, with an empty text. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, near_dedup, packing, quality_rules, substring_dedup
from plumbline.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and boilerplate lines of the others; texts without any stay as they are."""
    kept = quality_rules.keep(docs)
    n_chars = F.when(F.col("n_removed_lines") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays; documents without id stay. Of equal texts
    under one doc_id one row stays, that with the smallest columns; another text under the same id is judged by itself."""
    first = near_dedup.classes(docs).where("doc_id = class_id").select("doc_id", "copy").distinct()
    named = docs.withColumn("copy", F.md5(F.coalesce("text", F.lit(""))))
    whole = F.struct(*[c for c in COLUMNS if c not in ("doc_id", "text")], "text")
    kept = named.join(first, ["doc_id", "copy"], "left_semi").groupBy("doc_id", "copy").agg(F.min(whole).alias("row"))
    return kept.select("doc_id", "row.*").select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut; texts without any stay as they are."""
    cut = substring_dedup.remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences."""
    return packing.pieces(docs)


STAGES = [
    ("quality_rules", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: Signatures' classes, tokens and packing are beyond SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
