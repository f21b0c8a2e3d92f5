"""How document filters overlap: every filter's verdict in one mask, and the effect of every order from a histogram.

A document's failures are one mask of five bits, made by native expressions; whether an earlier document has the same text
comes from the smallest doc_id of each text. Documents then count in 32 cells for each part, and what any order of the
filters keeps, removes and loses follows from the cells alone, so that the 120 orders cost nothing that grows with the corpus.

Texts are told apart by their SHA-256. Rows are counted by (doc_id, digest, part, mask) before anything is grouped by text,
so that neither a text with many copies nor one repeated row gathers in a task: a text's group has a row for each of its
parts and labels only.

Edge cases: a null text is empty; a null part is the empty string; a null ``doc_id`` is smaller than none and has none smaller;
repeated rows each count, and are no copies of each other; of several labels of one document any that says 1 counts; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import table, words

#: Filters in the order of their bits.
FILTERS = "ABCDE"
#: Fewest words, least share of distinct words and greatest share of capitals in per cent, and characters that no text may hold.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, BARRED = 100, 80, 10, r"[#$%&*|]"
COPY_BIT = 1 << FILTERS.index("E")


def own_mask(text: Column, w: Column) -> Column:
    """Bits of the filters that a text alone decides; ``w``: its words."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failures = (
        F.size(w) < LEAST_WORDS,
        100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w),
        100 * capitals > MOST_CAPITALS * F.length(text),
        text.rlike(BARRED),
    )
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failures)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, those of quality 1 and the toxic ones."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"), words(F.col("text")).alias("w"))
    masked = split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_mask(F.col("text"), F.col("w")).alias("own"))
    rows = masked.groupBy("doc_id", "digest", "part", "own").agg(F.count("*").alias("n"))
    says = labels.groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    known = rows.join(says, "doc_id", "left").na.fill(False, ["good", "toxic"])
    # The least doc_id of these with its rows; rows without doc_id apart.
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    named = F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0))
    texts = known.groupBy("digest", "part", "own", "good", "toxic").agg(first.alias("first"), F.sum("n").alias("n"), named.alias("named"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    copies = F.col("named") - F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    counted = texts.select("part", "own", "good", "toxic", "n", copies.alias("copies"))
    kinds = F.explode(
        F.array(
            F.struct(F.col("own").alias("mask"), (F.col("n") - F.col("copies")).alias("k")),
            F.struct((F.col("own") + COPY_BIT).alias("mask"), F.col("copies").alias("k")),
        )
    )
    found = counted.select("part", "good", "toxic", kinds.alias("c")).select("part", "good", "toxic", "c.*").where("k > 0")
    return found.groupBy("part", "mask").agg(
        F.sum("k").alias("n"), F.sum(F.when(F.col("good"), F.col("k")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("k")).otherwise(0)).alias("toxic")
    )


def orders(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order of the filters step by step, from the cells: at most 32 of a part, gathered in one row."""
    bit = {f: 1 << k for k, f in enumerate(filters)}
    steps = [
        ("".join(p), k + 1, f, bit[f], sum(bit[g] for g in p[:k])) for p in permutations(filters) for k, f in enumerate(p)
    ]
    known = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("filter_order", "step", "filter", "bit", "before"), s, strict=True))) for s in steps))
    held = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    at = held.select("part", "cells", F.explode(known).alias("s")).select("part", "cells", "s.*")

    def total(count: str, hold) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda t, c: t + F.when(hold(c["mask"]), c[count]).otherwise(0))

    here = lambda m: (m.bitwiseAND(F.col("bit")) > 0) & (m.bitwiseAND(F.col("before")) == 0)
    done = at.select(
        "part",
        "filter_order",
        "step",
        "filter",
        total("n", lambda m: m.bitwiseAND(F.col("bit").bitwiseOR(F.col("before"))) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(F.col("bit")) > 0) & (m.bitwiseAND(F.col("before")) > 0)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    return done.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def op11_mask_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
says AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT d.part, coalesce(says.good, 0) AS good, coalesce(says.toxic, 0) AS toxic,
        len(w) < {LEAST_WORDS} AS a, 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) AS b,
        100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(d.text) AS c,
        regexp_matches(d.text, '{BARRED}') AS d, coalesce(d.doc_id > least.first, false) AS e
      FROM d JOIN least ON least.text = d.text LEFT JOIN says ON says.doc_id = d.doc_id),
cells AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
      FROM m GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(f, bit)),
perms AS (SELECT [p.f, q.f, r.f, s.f, t.f] AS names, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
      FROM letters p, letters q, letters r, letters s, letters t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
steps AS (SELECT array_to_string(names, '') AS filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[:k - 1]), 0)::INT AS before
      FROM perms, range(1, 6) x(k)),
done AS (SELECT part, filter_order, step::INT AS step, bit,
        coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
      FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM done
"""
