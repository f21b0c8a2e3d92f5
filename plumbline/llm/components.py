"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014) on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _cut(edges: DataFrame) -> DataFrame:
    """Checkpointed, so that a lost executor doesn't recompute earlier rounds."""
    scratch(edges.sparkSession, "")  # makes sure that a checkpoint folder is set
    return edges.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an undirected edge list; a component's name is its smallest node.

    Minima are aggregated before the shuffle, so that a hub's edges cost one row for each task; the join that deals a
    hub's minimum back to its edges is one that adaptive execution can split. Edges with a null end and loops are
    left out; repeated edges count once; no edges give no rows.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    edges = _cut(edges.distinct())
    before = _state(edges)
    while before[0]:
        # Large star: each node hands its larger neighbours to its smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node joins its smaller neighbours, and itself, to the smallest of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        edges = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = _cut(edges.select("e.u", "e.v").where("u <> v").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
