"""Halftoning by crosses: a block gets a cross if that brings it nearer to its target's tone, and is then cut in four.

All blocks of a depth are judged in one round from the ink that the rounds before have laid. A pixel is one row, with its
``SIDE`` by ``SIDE`` samples as bits that are set while they are bare, and its block's place beside them, so that a round is one
aggregate over blocks and one join with their verdicts. A cross inks samples of its own block; bare ones alone count, so
that what crosses share isn't counted twice. Blocks no wider and no higher than the pen are left as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.rounds import materialise, release

#: Samples along a pixel's side, and deepest round.
SIDE, DEPTH = 3, 9
BLOCK = ["img", "path", "x0", "y0", "bw", "bh"]


def struck(pen: float) -> Column:
    """The samples of a pixel (ix, iy) that the cross of its block (x0, y0, bw, bh; pixels from 1 on) inks, as bits. An arm runs
    from the first pixel's middle to the last one's, with flat ends; that of a single pixel has no length."""
    at = lambda p: (p - 1) * SIDE + 1
    reach = pen * SIDE / 2
    along = {}
    for axis, start, size in (("ix", "x0", "bw"), ("iy", "y0", "bh")):
        middle = F.col(start) + (F.col(size) - 1) / 2
        for k in range(SIDE):
            sample = F.col(axis) * SIDE + k + 1
            on_arm = (sample >= at(F.col(start))) & (sample <= at(F.col(start) + F.col(size) - 1)) & (F.col(size) > 1)
            along[axis, k] = (F.abs(sample - at(middle)) < reach, on_arm)
    bits = []
    for j in range(SIDE):
        for i in range(SIDE):
            (near_x, on_x), (near_y, on_y) = along["ix", i], along["iy", j]
            bits.append(F.when((near_x & on_y) | (near_y & on_x), 1 << (j * SIDE + i)).otherwise(0))
    return reduce(Column.__add__, bits)


def crossed(images: DataFrame, w: int, h: int, pen: float, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(img, path, x1, y1, x2, y2) of the arms that draw each image, and every block that was judged: (img, path, x0, y0, bw,
    bh, inked, kept), the samples that its cross inks or would, and whether it has one. A block's path has a digit from 0
    to 3 for each cut: the upper left part first, the lower right one last."""
    place = [F.lit("").alias("path"), F.lit(1).alias("x0"), F.lit(1).alias("y0"), F.lit(w).alias("bw"), F.lit(h).alias("bh")]
    bare = F.lit((1 << SIDE * SIDE) - 1).alias("bare")
    pixels = materialise(images.select("img", "ix", "iy", F.col("v").cast("double").alias("v"), bare, *place))
    judged: list[DataFrame] = []
    for level in range(depth + 1):
        # Tones are added up in whole parts of a unit, so that no order of them decides a verdict.
        sums = pixels.withColumn("hit", struck(pen)).groupBy(*BLOCK).agg(
            F.sum(F.floor(F.col("v") * 1e9 + 0.5).cast("long")).alias("v"), F.sum(F.bit_count("bare")).alias("bare"), F.sum(F.bit_count(F.col("bare").bitwiseAND(F.col("hit")))).alias("inked")
        )
        samples = F.col("bw") * F.col("bh") * SIDE * SIDE
        target, now, then = F.col("v") / 1e9 / (F.col("bw") * F.col("bh")), F.col("bare") / samples, (F.col("bare") - F.col("inked")) / samples
        room = ~((F.col("bw") <= pen) & (F.col("bh") <= pen)) & F.lit(level < depth)
        kept = room & ~(F.abs(target - now) < F.abs(target - then))
        made = materialise(sums.select(*BLOCK, F.col("inked").cast("long").alias("inked"), kept.alias("kept")))
        judged.append(made)
        half = lambda c: (F.floor((F.col(c) + 2) / 2 + 0.5) - 1).cast("int")
        cut = made.where("kept").select("img", "path", half("bw").alias("mw"), half("bh").alias("mh")).where("mw >= 1 and mh >= 1")
        on = pixels.join(cut, ["img", "path"]).where("mw < bw and mh < bh").withColumn("bare", F.col("bare").bitwiseAND(F.bitwise_not(struck(pen))))
        right, low = F.col("ix") + 1 >= F.col("x0") + F.col("mw"), F.col("iy") + 1 >= F.col("y0") + F.col("mh")
        part = [
            F.concat("path", F.when(low, 2).otherwise(0) + F.when(right, 1).otherwise(0)).alias("path"),
            F.when(right, F.col("x0") + F.col("mw")).otherwise(F.col("x0")).alias("x0"),
            F.when(low, F.col("y0") + F.col("mh")).otherwise(F.col("y0")).alias("y0"),
            F.when(right, F.col("bw") - F.col("mw")).otherwise(F.col("mw")).alias("bw"),
            F.when(low, F.col("bh") - F.col("mh")).otherwise(F.col("mh")).alias("bh"),
        ]
        after = materialise(on.select("img", "ix", "iy", "v", "bare", *part))
        release(pixels)
        pixels = after
        if pixels.isEmpty():
            break
    blocks = reduce(DataFrame.unionByName, judged)
    vx, hy = F.col("x0") + (F.col("bw") - 1) / 2, F.col("y0") + (F.col("bh") - 1) / 2
    arm = lambda *c: F.struct(*[v.cast("double").alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), c, strict=True)])
    arms = F.array(arm(vx, F.col("y0"), vx, F.col("y0") + F.col("bh") - 1), arm(F.col("x0"), hy, F.col("x0") + F.col("bw") - 1, hy))
    return blocks.where("kept").select("img", "path", F.explode(arms).alias("a")).select("img", "path", "a.*"), blocks
