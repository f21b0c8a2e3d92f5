"""Points moved to the centres of ink of their cells, again and again, until they rest.

Ink is written down once, in blocks of pixels that are a row each. In a round a block first gets the few seeds that can be the
nearest to any pixel of its box, from tables without pixels; its pixels then choose among these within the row and go straight
into sums, so that no pixel is repeated, or written once more, from round to round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import half_up
from plumbline.operators.rounds import large, materialise, release

#: An image rests once none of its points moves this far; places count in these parts of a pixel, which no simple fraction halves.
SETTLED, GRAIN = 0.05, 999983.0
#: What rounding may take off a place that lies at an exact half of a part, as every other one halfway to a whole pixel does.
SLACK = 5e-8
#: A block, and the box about its pixels' centres.
BLOCK, BOX = ["img", "_bx", "_by"], ["x0", "x1", "y0", "y1"]


def inked_blocks(images: DataFrame, cell: float) -> DataFrame:
    """(img, _bx, _by, x0, x1, y0, y1, xs, ys, ms): places and ink of the pixels of each block of side ``cell`` that have any."""
    ink = images.select("img", "ix", "iy", (1 - F.col("v").cast("double")).alias("m")).where("m > 0 and ix is not null and iy is not null")
    at = [F.floor((F.col(c) + 1) / cell).alias(b) for c, b in (("ix", "_bx"), ("iy", "_by"))]
    box = [(f(c) + 1.0).alias(n) for n, f, c in zip(BOX, (F.min, F.max) * 2, ("ix", "ix", "iy", "iy"), strict=True)]
    own = ink.withColumns({"_bx": at[0], "_by": at[1]}).groupBy(*BLOCK).agg(*box, F.collect_list(F.struct("ix", "iy", "m")).alias("p"))
    return own.select(*BLOCK, *BOX, F.col("p.ix").alias("xs"), F.col("p.iy").alias("ys"), F.col("p.m").alias("ms"))


def contenders(boxes: DataFrame, seeds: DataFrame, cell: float, most: int) -> list[DataFrame]:
    """(img, _bx, _by, near, sure) tables: where ``sure``, all seeds (pid, x, y) that can be nearest to a pixel of the block.

    A block asks the cells around its own. One of the seeds found is no farther from any pixel than from the box's farthest
    corner; if a seed beyond the cells asked could be as near, the block goes on with a ring twice as wide.
    """
    laid = seeds.select("img", F.floor(F.col("x") / cell).alias("_cx"), F.floor(F.col("y") / cell).alias("_cy"), "pid", "x", "y")
    pending = large(boxes).join(seeds.select("img").distinct(), "img", "left_semi")
    squares = lambda a, b: a * a + b * b
    off = [F.greatest(F.col(lo) - F.col(c), F.lit(0.0), F.col(c) - F.col(hi)) for c, lo, hi in (("x", "x0", "x1"), ("y", "y0", "y1"))]
    far = [F.greatest(F.col(c) - F.col(lo), F.col(hi) - F.col(c)) for c, lo, hi in (("x", "x0", "x1"), ("y", "y0", "y1"))]
    seed = F.when(F.col("pid").isNotNull(), F.struct("pid", "x", "y", squares(*off).alias("off")))
    reach, made = 2, []
    while True:
        span = F.sequence(F.lit(-reach), F.lit(reach))
        asked = pending.withColumn("_cx", F.explode(span)).withColumn("_cy", F.explode(span)).withColumns({"_cx": F.col("_bx") + F.col("_cx"), "_cy": F.col("_by") + F.col("_cy")})
        met = large(asked).join(laid, ["img", "_cx", "_cy"], "left")
        met = met.groupBy(*BLOCK, *BOX).agg(F.collect_list(seed).alias("near"), F.min(squares(*far)).alias("far"))
        near = F.filter("near", lambda s: s["off"] <= F.col("far") * (1 + 1e-9))
        sure = F.coalesce(F.col("far") < (reach * cell) ** 2, F.lit(False)) | F.lit(reach >= most)
        made.append(materialise(met.select(*BLOCK, *BOX, F.transform(near, lambda s: F.struct(s["pid"].alias("pid"), s["x"].alias("x"), s["y"].alias("y"))).alias("near"), sure.alias("sure"))))
        pending = made[-1].where("not sure").select(*BLOCK, *BOX)
        if reach >= most or pending.isEmpty():
            return made
        reach *= 2


def centres(blocks: DataFrame, made: list[DataFrame]) -> DataFrame:
    """(img, pid, m, sx, sy): the ink of the pixels that are nearest to each seed, the smaller pid on a tie, and its moments."""
    near = None
    for table in made:
        sure = table.where("sure").select(*BLOCK, "near")
        near = sure if near is None else near.unionByName(sure)

    def pixel(x: Column, i: Column) -> Column:
        y = F.get("ys", i)
        d2 = lambda s: (s["x"] - x - 1) * (s["x"] - x - 1) + (s["y"] - y - 1) * (s["y"] - y - 1)
        nearest = F.array_min(F.transform("near", lambda s: F.struct(d2(s).alias("d2"), s["pid"].alias("pid"))))
        return F.struct(nearest["pid"].alias("pid"), x.alias("x"), y.alias("y"), F.get("ms", i).alias("m"))

    own = large(blocks.select(*BLOCK, "xs", "ys", "ms")).join(near, BLOCK).select("img", F.explode_outer(F.transform("xs", pixel)).alias("p")).select("img", "p.*")
    # Decimals add up to the same sum in any order, so that equal images rest at equal places.
    m = F.col("m").cast("decimal(20,18)")
    total = lambda c: F.sum(c).cast("double")
    return own.groupBy("img", "pid").agg(total(m).alias("m"), *[total(m * (F.col(c) + 1)).alias(f"s{c}") for c in "xy"])


def relaxed(images: DataFrame, seeds: DataFrame, w: int, h: int, rounds: int, damping: float = 1.0, longest: float | None = None, cell: float = 16.0) -> DataFrame:
    """(img, pid, x, y, rounds): ``seeds`` (img, pid, x, y) of each image after at most that many rounds, and how many were made.

    A point goes ``damping`` of the way to the centre of the ink of the pixels that are nearest to it, ``longest`` at most; one
    without ink stays. An image that rests is left alone while the others go on. No point comes or goes.
    """
    place = lambda c: half_up(c * GRAIN + SLACK) / GRAIN
    state = materialise(seeds.select("img", "pid", place(F.col("x")).alias("x"), place(F.col("y")).alias("y"), F.lit(0).alias("rounds"), F.lit(True).alias("live")))
    blocks = materialise(inked_blocks(images, cell))
    for _ in range(rounds):
        live = state.where("live")
        if live.isEmpty():
            break
        near = contenders(blocks.select(*BLOCK, *BOX), live, cell, int(max(w, h) / cell) + 2)
        step = large(live).join(centres(blocks, near), ["img", "pid"], "left")
        dx, dy = (F.coalesce((F.col(f"s{c}") / F.col("m") - F.col(c)) * damping, F.lit(0.0)) for c in "xy")
        size = F.sqrt(dx * dx + dy * dy)
        short = F.lit(1.0) if longest is None else F.when(size > longest, longest / size).otherwise(1.0)
        moved = step.select("img", "pid", place(F.col("x") + dx * short).alias("x"), place(F.col("y") + dy * short).alias("y"), (F.col("rounds") + 1).alias("rounds"), F.least(size, size * short).alias("moved"))
        rests = moved.select("img", "pid", "x", "y", "rounds", (F.max("moved").over(Window.partitionBy("img")) >= SETTLED).alias("live"))
        after = materialise(rests.unionByName(state.where("not live")))
        release(state, *near)
        state = after
    release(blocks)
    return state.drop("live")
