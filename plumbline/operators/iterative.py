"""Operators that repeat a join until nothing changes: weighted distance, components, spanning forest, exact subdivision.

Each round is one set of DataFrame operations, written to the shared folder and read again (:mod:`.rounds`), so that
neither plans nor lost executors grow the work; the number of rounds follows the depth of the result and not the number
of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.rounds import materialise, release

#: Moves of a chess king, and those of a knight.
KING = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
KNIGHT = [(dx, dy) for dx in (-2, -1, 1, 2) for dy in (-2, -1, 1, 2) if abs(dx) != abs(dy)]


def _passed(dx: int, dy: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """The two pixels between which a knight's move passes: the straight and the diagonal step along its long side."""
    sx, sy = (dx > 0) - (dx < 0), (dy > 0) - (dy < 0)
    return ((sx, 0) if abs(dx) == 2 else (0, sy)), (sx, sy)


def moves_of(weights: DataFrame, moves: int) -> DataFrame:
    """``weights`` with ``steps``, the moves that each pixel has: all of a king's, and with 16 those of a knight that pass
    between two pixels that are there."""
    step = lambda dx, dy: F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit((dx * dx + dy * dy) ** 0.5).alias("len"))
    king = F.array(*[step(*m) for m in KING])
    if moves != 16:
        return weights.select("img", "ix", "iy", "v", king.alias("steps"))
    index = {m: i for i, m in enumerate(KING)}
    seen = weights.select("img", "ix", "iy", F.posexplode(king).alias("i", "s"))
    seen = seen.select("img", (F.col("ix") - F.col("s.dx")).alias("ix"), (F.col("iy") - F.col("s.dy")).alias("iy"), "i")
    near = seen.groupBy("img", "ix", "iy").agg(F.collect_set("i").alias("near"))
    there = lambda m: F.array_contains("near", index[m])
    knight = F.array_compact(F.array(*[F.when(there(_passed(*m)[0]) & there(_passed(*m)[1]), step(*m)) for m in KNIGHT]))
    none = F.array().cast("array<int>")
    joined = weights.join(near, ["img", "ix", "iy"], "left").withColumn("near", F.coalesce("near", none))
    return joined.select("img", "ix", "iy", "v", F.concat(king, knight).alias("steps"))


def geodesic(weights: DataFrame, seeds: DataFrame, moves: int = 8) -> DataFrame:
    """(img, ix, iy, d): least sum over paths of mean weight times length from the nearest seed (img, ix, iy); ``v`` of
    ``weights`` is a pixel's weight. Pixels that no path reaches are left out; a knight's move (``moves=16``) is barred if
    one of the two pixels that it passes between is missing.

    Each round relaxes the pixels around those that changed, and only them.
    """
    weights = materialise(moves_of(weights, moves))
    best = materialise(weights.join(seeds.select("img", "ix", "iy").distinct(), ["img", "ix", "iy"]).select("img", "ix", "iy", "v", "steps", F.lit(0.0).alias("d")))
    front = best
    while not front.isEmpty():
        reach = front.withColumn("s", F.explode("steps")).select("img", (F.col("ix") + F.col("s.dx")).alias("ix"), (F.col("iy") + F.col("s.dy")).alias("iy"), F.col("v").alias("u"), F.col("d").alias("from"), "s.len")
        asked = reach.join(weights, ["img", "ix", "iy"]).groupBy("img", "ix", "iy", "v", "steps").agg(F.min(F.col("from") + (F.col("u") + F.col("v")) / 2 * F.col("len")).alias("d"))
        old = best.select("img", "ix", "iy", F.col("d").alias("old"))
        new = materialise(asked.join(old, ["img", "ix", "iy"], "left").where("old is null or d < old - 1e-12").drop("old"))
        kept = materialise(best.join(new.select("img", "ix", "iy"), ["img", "ix", "iy"], "left_anti").unionByName(new))
        release(best if best is not front else None, front)
        front, best = new, kept
    return best.select("img", "ix", "iy", "d")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node of the links (x, y): the smallest node that links lead to. Names jump along: each
    round a node takes the least name near it, and then that name's own name."""
    both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    both = materialise(both)
    name = materialise(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
    while True:
        near = both.join(name.select(F.col("x").alias("y"), F.col("m").alias("my")), "y").groupBy("x").agg(F.min("my").alias("my"))
        low = materialise(name.join(near, "x").select("x", F.least("m", "my").alias("m"), F.col("m").alias("old")))
        up = low.select(F.col("x").alias("m"), F.col("m").alias("mm"))
        jump = materialise(low.join(up, "m").select("x", F.least("m", "mm").alias("m"), "old"))
        release(name, low)
        name = jump.select("x", "m")
        if jump.where("m <> old").isEmpty():
            return name.select(F.col("x").alias("node"), F.col("m").alias("component"))


def topmost(up: DataFrame) -> DataFrame:
    """(node, top): where the way up from each node of ``up`` (node, top), a forest whose roots lead to themselves, ends; in each
    round a node goes up as far again as it has come."""
    up = materialise(up)
    while True:
        above = up.select(F.col("node").alias("top"), F.col("top").alias("higher"))
        after = materialise(up.join(above, "top").select("node", F.col("higher").alias("top"), (F.col("higher") != F.col("top")).alias("news")))
        release(up)
        up = after.drop("news")
        if after.where("news").isEmpty():
            return up


def forest(edges: DataFrame) -> DataFrame:
    """(a, b, w) of the least spanning forest of ``edges`` (a, b, w), ties by the smaller nodes, by Borůvka's rounds:
    each tree takes its lightest edge out, and trees joined by those become one. These lead from tree to tree up to two that
    took the same edge, of which the smaller one is the root. Edges inside a tree are dropped from the rounds after."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").where("a < b").groupBy("a", "b").agg(F.min("w").alias("w"))
    left = materialise(edges.select("a", "b", "w", F.col("a").alias("ta"), F.col("b").alias("tb")))
    taken: list[DataFrame] = []
    while not left.isEmpty():
        light = left.select(F.explode(F.array("ta", "tb")).alias("tree"), F.struct("w", "a", "b", "ta", "tb").alias("e"))
        light = materialise(light.groupBy("tree").agg(F.min("e").alias("e")).select("tree", "e.*"))
        taken.append(light.select("a", "b", "w").distinct())
        hooked = light.select("tree", F.when(F.col("ta") == F.col("tree"), F.col("tb")).otherwise(F.col("ta")).alias("up"))
        back = hooked.select(F.col("tree").alias("up"), F.col("up").alias("back"))
        root = (F.col("back") == F.col("tree")) & (F.col("tree") < F.col("up"))
        name = topmost(hooked.join(back, "up").select(F.col("tree").alias("node"), F.when(root, F.col("tree")).otherwise(F.col("up")).alias("top")))
        renamed = lambda c: name.select(F.col("node").alias(c), F.col("top").alias(f"new_{c}"))
        moved = left.join(renamed("ta"), "ta").join(renamed("tb"), "tb").select("a", "b", "w", F.col("new_ta").alias("ta"), F.col("new_tb").alias("tb"))
        after = materialise(moved.where("ta <> tb"))
        release(left)
        left = after
    return reduce(DataFrame.unionByName, taken) if taken else edges.limit(0)


def subdivided(raster: DataFrame, count: int) -> DataFrame:
    """(img, path, n, x, y): ``count`` points for each image, placed by splitting boxes in two by the ink in each half;
    ``m`` of ``raster`` is a pixel's ink in whole units.

    A box owes a number of points; its longer side is halved, each half owes its share of the ink, rounded down, and the
    point left over goes to the larger remainder, never to an empty half. A box that owes one point puts it at its
    centre of ink. All boxes of a level are split in one round: a box's pixels carry its name, so that its ink is one
    aggregate. Ink counts in whole units and shares are compared as products, so that no order of adding up matters.
    """
    ink = raster.select("img", "ix", "iy", F.col("m").cast("long").alias("m")).where("m > 0")
    live = Window.partitionBy("img")
    pixel = ink.withColumn("n", F.least(F.lit(count), F.count("*").over(live)).cast("int")).withColumn("path", F.lit(""))
    pixel = materialise(pixel)
    done: list[DataFrame] = []
    centre = lambda c: (F.sum(F.col("m") * (F.col(c) + 1)) / F.sum("m")).alias(c[1:])
    while not pixel.isEmpty():
        box = pixel.groupBy("img", "path", "n").agg(F.count("*").alias("k"), centre("ix"), centre("iy"), *[f(c).alias(f"{s}_{c}") for c in ("ix", "iy") for s, f in (("lo", F.min), ("hi", F.max))])
        box = materialise(box)
        done.append(box.where("n = 1 or k = 1").select("img", "path", "n", "x", "y"))
        wide = F.col("hi_ix") - F.col("lo_ix") >= F.col("hi_iy") - F.col("lo_iy")
        mid = lambda c: F.col(f"lo_{c}") + F.floor((F.col(f"hi_{c}") - F.col(f"lo_{c}") + 2) / 2).cast("int")
        cuts = box.where("n > 1 and k > 1").select("img", "path", wide.alias("wide"), mid("ix").alias("cx"), mid("iy").alias("cy"))
        half = F.when(F.when(F.col("wide"), F.col("ix") < F.col("cx")).otherwise(F.col("iy") < F.col("cy")), "A").otherwise("B")
        rest = pixel.join(cuts, ["img", "path"]).select("img", "path", "n", "ix", "iy", "m", half.alias("half"))
        share = rest.groupBy("img", "path", "n").agg(*[F.sum(F.when(F.col("half") == h, F.col("m")).otherwise(F.lit(0))).alias(f"m{h}") for h in "AB"])
        whole = F.col("mA") + F.col("mB")
        owed = share.withColumn("nA", F.expr("(2 * n * mA + mA + mB) div (2 * (mA + mB))")).select("img", "path", F.when(whole > 0, F.col("nA")).cast("int").alias("nA"))
        split = rest.join(owed, ["img", "path"])
        n = F.when(F.col("half") == "A", F.col("nA")).otherwise(F.col("n") - F.col("nA")).cast("int")
        after = materialise(split.select("img", "ix", "iy", "m", n.alias("n"), F.concat("path", "half").alias("path")).where("n > 0"))
        release(pixel)
        pixel = after
    return reduce(DataFrame.unionByName, done) if done else raster.sparkSession.createDataFrame([], "img string, path string, n int, x double, y double")
