"""Carriers as rows ``(path_id, seq, x, y)`` that a wave is laid on, and rows of a lattice joined again after a move."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHAPES = ("sine", "sawtooth", "square")


def phases(carrier: DataFrame, rate: Column) -> DataFrame:
    """``carrier`` with ``phi``: the running integral of ``rate`` over length, by the trapezoid of both ends of a step."""
    order = Window.partitionBy("path_id").orderBy("seq")
    c = carrier.withColumn("_rate", rate)
    dx, dy = F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)
    step = (F.col("_rate") + F.lag("_rate").over(order)) / 2 * F.sqrt(dx * dx + dy * dy)
    c = c.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return c.withColumn("phi", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_rate", "_step")


def level(shape: str, phi: Column) -> Column:
    if shape == "sine":
        return F.sin(phi)
    if shape == "square":
        return F.when(F.sin(phi) >= 0, 1.0).otherwise(-1.0)
    return F.asin(F.sin(phi - math.pi / 2)) * (2 / math.pi)


def modulated(carrier: DataFrame, shape: str) -> DataFrame:
    """(path_id, seq, part, x, y): the wave of ``carrier`` (.., nx, ny, phi, amp), moved along the normals.

    Each sample gives part 0 of its seq. Shapes with corners also turn wherever the phase passes a multiple of a half
    turn between a sample and the one before: parts below 0, in order, a square with both of its levels. A sample's
    turns are a sequence of its own row, so that one window is the only shuffle.
    """
    if shape not in SHAPES:
        raise ValueError(f"no such wave: {shape}")
    order = Window.partitionBy("path_id").orderBy("seq")
    here = ["x", "y", "nx", "ny", "amp", "phi"]
    rows = carrier.select("path_id", "seq", *here, *[F.lag(c).over(order).alias(f"{c}0") for c in here])
    on = {c: F.col(c) + F.col(f"n{c}") * F.col("amp") * level(shape, F.col("phi")) for c in ("x", "y")}
    if shape == "sine":
        return rows.select("path_id", "seq", F.lit(0).alias("part"), on["x"].alias("x"), on["y"].alias("y"))
    first, last = F.floor(F.col("phi0") / math.pi) + 1, F.floor(F.col("phi") / math.pi)
    turns = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("k", F.explode_outer(F.concat(turns, F.array(F.lit(None).cast("bigint")))))
    sides = F.when(F.col("k").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("side", F.explode_outer(sides) if shape == "square" else F.lit(0))
    t = (F.col("k") * math.pi - F.col("phi0")) / (F.col("phi") - F.col("phi0"))
    at = {c: F.col(f"{c}0") + t * (F.col(c) - F.col(f"{c}0")) for c in here[:-1]}
    size = F.sqrt(at["nx"] * at["nx"] + at["ny"] * at["ny"])
    end = F.when(F.col("k") % 2 == 0, -1.0).otherwise(1.0) * (1 - 2 * F.col("side"))
    turned = {c: at[c] + at[f"n{c}"] / F.when(size > 0, size).otherwise(1.0) * at["amp"] * end for c in ("x", "y")}
    part = F.when(F.col("k").isNull(), 0).otherwise(2 * (F.col("k") - last) - 2 + F.col("side")).cast("int")
    return rows.select("path_id", "seq", part.alias("part"), *[F.when(F.col("k").isNull(), on[c]).otherwise(turned[c]).alias(c) for c in ("x", "y")])


def rebuilt(lattice: DataFrame, moved: DataFrame) -> DataFrame:
    """(row_id, run, seq, x, y): each row of a lattice (row_id, seq, pid) through the points that are left of it (pid, x, y),
    cut where one is gone; a run has two points at least. Runs are numbered from 1 within a row."""
    kept = lattice.join(moved.select("pid", "x", "y"), "pid")
    row = Window.partitionBy("row_id").orderBy("seq")
    kept = kept.withColumn("_island", F.col("seq") - F.row_number().over(row))
    kept = kept.withColumn("_size", F.count("*").over(Window.partitionBy("row_id", "_island"))).where("_size > 1")
    return kept.select("row_id", F.dense_rank().over(Window.partitionBy("row_id").orderBy("_island")).alias("run"), "seq", "x", "y")


def child_order(tree: DataFrame) -> DataFrame:
    """``tree`` (pid, parent, x, y) with ``rank`` (from 1) of each node among its parent's children, by the angle from the
    way back to the parent's own parent (the x axis at a root), ties by pid."""
    up = tree.select(F.col("pid").alias("parent"), F.col("parent").alias("_grand"), F.col("x").alias("_px"), F.col("y").alias("_py"))
    top = tree.select(F.col("pid").alias("_grand"), F.col("x").alias("_gx"), F.col("y").alias("_gy"))
    n = tree.join(up, "parent").join(top, "_grand", "left")
    back = F.when(F.col("_gx").isNotNull(), F.atan2(F.col("_gy") - F.col("_py"), F.col("_gx") - F.col("_px"))).otherwise(0.0)
    turn = F.atan2(F.col("y") - F.col("_py"), F.col("x") - F.col("_px")) - back
    turn = turn - 2 * math.pi * F.floor(turn / (2 * math.pi))
    n = n.withColumn("turn", turn)
    order = Window.partitionBy("parent").orderBy("turn", "pid")
    return n.select("pid", "parent", "turn", F.row_number().over(order).alias("rank"))
