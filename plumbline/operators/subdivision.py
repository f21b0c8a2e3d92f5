"""Halftoning by cutting: polygons are halved until their outlines alone lay down the ink that their pixels ask for.

All polygons of a depth are cut in one round, from a page's single one on. A polygon's pixels carry its name, so that what
decides its cut are aggregates of them: ink, axis and mean direction, then ink by thirty-one slices across the cut's normal.
Thirty places for the cut are weighed within the polygon's row: a line halves a convex ring where its corners change sides,
a corner on the line counts with what lies above, and lengths on either side follow from the corners' distances to it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import maps
from plumbline.functions.scalar import half_up
from plumbline.operators import raster
from plumbline.operators.rounds import materialise, release, spread

#: Places that are tried for a cut, deepest round, and least pixels of a polygon that is cut.
SWEEP, ROUNDS, LEAST = 30, 13, 4
#: Places count as equally good where what they leave uneven differs by less than this part of a unit; the first one wins.
EVEN = 1e9
#: Pixels stand off the grid by at most this, so that few lie exactly on a cut.
OFF_GRID = 1e-5


def directed(images: DataFrame, pen: float) -> DataFrame:
    """(img, ix, iy, k, theta): each pixel's darkness and direction."""
    toned = images.withColumn("k", 1 - F.col("v").cast("double"))
    return raster.structure_tensor(toned, max(1.0, pen), max(1.5, 2 * pen), ("k",)).select("img", "ix", "iy", "k", "theta")


def set_off(pixels: DataFrame, w: int) -> DataFrame:
    """``pixels`` with their places (x, y), which are worked out wherever they are needed and never written."""
    number = F.col("iy").cast("long") * w + F.col("ix")
    return pixels.withColumn("x", F.col("ix") + 1 + (number * 2654435761) % 1000 / 1000.0 * OFF_GRID).withColumn("y", F.col("iy") + 1.0)


def aimed(polygons: DataFrame, pixels: DataFrame, pen: float, w: int) -> DataFrame:
    """``polygons`` (img, path, ring) with their pixels' ``n`` and ink ``dark``, ``perimeter``, whether they ask for a cut, and
    the cut's normal (nx, ny) with the span [low, low + span] of the ring along it."""
    sums = set_off(pixels, w).groupBy("img", "path").agg(
        F.count("*").alias("n"),
        F.sum("k").alias("dark"),
        *[F.avg(c).alias(n) for n, c in (("ax", F.col("x")), ("ay", F.col("y")), ("xx", F.col("x") * F.col("x")), ("xy", F.col("x") * F.col("y")), ("yy", F.col("y") * F.col("y")))],
        F.sum(F.cos(2 * F.col("theta"))).alias("c2"),
        F.sum(F.sin(2 * F.col("theta"))).alias("s2"),
    )
    axis = F.atan2(2 * (F.col("xy") - F.col("ax") * F.col("ay")), (F.col("xx") - F.col("ax") * F.col("ax")) - (F.col("yy") - F.col("ay") * F.col("ay"))) / 2
    mean = F.atan2("s2", "c2") / 2
    mean = F.when(mean < 0, mean + math.pi).otherwise(mean)
    off = lambda a: F.abs(F.cos(a - axis))
    t = F.when(off(mean) <= off(mean + math.pi / 2), mean).otherwise(mean + math.pi / 2)
    after = lambda i: F.get("ring", (i + 1) % F.size("ring"))
    length = lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))
    total = lambda f: F.aggregate(F.transform("ring", lambda p, i: f(p, after(i))), F.lit(0.0), lambda s, v: s + v)
    p = polygons.join(sums, ["img", "path"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("dark", F.coalesce("dark", F.lit(0.0)))
    p = p.withColumn("perimeter", total(length)).withColumn("area", F.abs(total(lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2)
    enough = F.col("perimeter") * maps.ink_rate(F.col("perimeter"), F.size("ring"), pen) > F.col("dark")
    p = p.withColumn("asks", (F.col("n") >= LEAST) & (F.col("area") > 0) & ~enough).withColumn("t", t)
    p = p.withColumn("nx", -F.sin("t")).withColumn("ny", F.cos("t"))
    along = F.transform("ring", lambda p: F.col("nx") * p["x"] + F.col("ny") * p["y"])
    p = p.withColumn("low", F.array_min(along)).withColumn("span", F.array_max(along) - F.array_min(along))
    return p.select("img", "path", "ring", "n", "dark", "perimeter", "area", "asks", "nx", "ny", "low", "span")


def placed(asking: DataFrame, slices: DataFrame, pen: float) -> DataFrame:
    """``asking`` with ``at``, where along its normal each polygon is cut; those that no cut betters are left out.

    The cut evens out ink to outline between the halves, and is kept if their mean is no farther from half a pen than
    the whole's. ``slices`` (img, path, slice, dark): a polygon's ink by slices of its span.
    """
    held = slices.groupBy("img", "path").agg(F.collect_list(F.struct("slice", "dark")).alias("slices"))
    p = asking.join(held, ["img", "path"])
    far = lambda v: F.col("nx") * v["x"] + F.col("ny") * v["y"]
    run = lambda v: F.col("ny") * v["x"] - F.col("nx") * v["y"]
    side = lambda p, q: F.struct(far(p).alias("a"), far(q).alias("b"), run(p).alias("u"), run(q).alias("v"), F.sqrt((far(q) - far(p)) * (far(q) - far(p)) + (run(q) - run(p)) * (run(q) - run(p))).alias("len"))
    p = p.withColumn("sides", F.transform("ring", lambda v, i: side(v, F.get("ring", (i + 1) % F.size("ring")))))

    def weighed(s: Column) -> Column:
        c = F.col("low") + F.col("span") * (s / (SWEEP + 1))
        start = F.struct(F.lit(0.0).alias("below"), F.lit(float("inf")).alias("lo"), F.lit(float("-inf")).alias("hi"))

        def add(t: Column, e: Column) -> Column:
            a, b = e["a"] - c, e["b"] - c
            crosses, share = (a < 0) != (b < 0), a / (a - b)
            under = F.when(~crosses, F.when(a < 0, e["len"]).otherwise(0.0)).otherwise(e["len"] * F.when(a < 0, share).otherwise(1 - share))
            place = e["u"] + share * (e["v"] - e["u"])
            return F.struct((t["below"] + under).alias("below"), F.when(crosses, F.least(t["lo"], place)).otherwise(t["lo"]).alias("lo"), F.when(crosses, F.greatest(t["hi"], place)).otherwise(t["hi"]).alias("hi"))

        def judged(t: Column) -> Column:
            chord = t["hi"] - t["lo"]
            pb, pa = t["below"] + chord, F.col("perimeter") - t["below"] + chord
            kb = F.aggregate("slices", F.lit(0.0), lambda z, x: z + F.when(x["slice"] < s, x["dark"]).otherwise(0.0))
            ka = F.col("dark") - kb
            return F.struct(half_up(F.abs(ka / pa - kb / pb) * EVEN).alias("uneven"), s.alias("s"), c.alias("at"), ((ka / pa + kb / pb) / 2).alias("mixed"))

        return F.aggregate("sides", start, add, judged)

    p = p.withColumn("best", F.array_min(F.transform(F.sequence(F.lit(1), F.lit(SWEEP)), weighed)))
    better = F.abs(pen / 2 - F.col("best.mixed")) <= F.abs(pen / 2 - F.col("dark") / F.col("perimeter"))
    return p.where(better).select("img", "path", "ring", "nx", "ny", F.col("best.at").alias("at"))


def halves(cuts: DataFrame) -> DataFrame:
    """``cuts`` (img, path, ring, nx, ny, at) with ``below`` and ``above``, the two rings, and ``ends``, the cut's two points
    in order along it."""
    off = lambda p: F.col("nx") * p["x"] + F.col("ny") * p["y"] - F.col("at")
    c = cuts.withColumn("r", F.transform("ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), off(p).alias("d"))))

    def crossing(p: Column, i: Column) -> Column:
        q = F.get("r", (i + 1) % F.size("r"))
        t = p["d"] / (p["d"] - q["d"])
        at = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
        return F.when((p["d"] < 0) != (q["d"] < 0), at)

    corner = lambda p, keep: F.when(keep, F.struct(p["x"].alias("x"), p["y"].alias("y")))
    part = lambda keep: F.flatten(F.transform("r", lambda p, i: F.array_compact(F.array(corner(p, keep(p)), crossing(p, i)))))
    ends = F.array_compact(F.transform("r", crossing))
    run = lambda p: F.col("ny") * p["x"] - F.col("nx") * p["y"]
    ordered = F.array_sort(F.transform(ends, lambda p: F.struct(run(p).alias("run"), p.alias("p"))))
    return c.select("img", "path", "nx", "ny", "at", part(lambda p: p["d"] < 0).alias("below"), part(lambda p: p["d"] >= 0).alias("above"), F.transform(ordered, lambda e: e["p"]).alias("ends"))


def whole_pages(images: DataFrame, page: list[tuple[float, float]], pen: float) -> tuple[DataFrame, DataFrame]:
    """(img, path, ring) of each image's page, and its pixels, written down."""
    whole = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in page])
    pixels = materialise(directed(images, pen).withColumn("path", F.lit("")))
    return pixels.select("img").distinct().select("img", F.lit("").alias("path"), whole.alias("ring")), pixels


def cut(asking: DataFrame, pixels: DataFrame, pen: float, w: int) -> DataFrame:
    """The halves of the polygons that ask for a cut and are bettered by one; tasks grow in number with the pixels."""
    along = F.col("nx") * F.col("x") + F.col("ny") * F.col("y")
    number = F.greatest(F.lit(0), F.least(F.lit(SWEEP), F.floor((along - F.col("low")) / F.col("span") * (SWEEP + 1)).cast("int")))
    of = spread(pixels.select("img", "path", "ix", "iy", "k"), pixels.count(), "img", "path")
    slices = set_off(of, w).join(asking.select("img", "path", "nx", "ny", "low", "span"), ["img", "path"]).groupBy("img", "path", number.alias("slice")).agg(F.sum("k").alias("dark"))
    return halves(placed(asking, slices, pen))


def chords(made: DataFrame) -> DataFrame:
    """(img, path, x1, y1, x2, y2) of the cuts of :func:`cut`."""
    return made.select("img", "path", *[F.col("ends")[i][c].alias(f"{c}{i + 1}") for i in (0, 1) for c in "xy"])


def first_cuts(images: DataFrame, page: list[tuple[float, float]], pen: float, w: int) -> DataFrame:
    """The cuts of :func:`cut_up`'s first round; what they leave isn't judged."""
    polygons, pixels = whole_pages(images, page, pen)
    judged = materialise(aimed(polygons, pixels, pen, w))
    return chords(materialise(cut(judged.where("asks"), pixels, pen, w)))


def cut_up(images: DataFrame, page: list[tuple[float, float]], pen: float, w: int, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The cuts (img, path, x1, y1, x2, y2) that draw each image within a convex page, and the pieces (img, path, ring, n, dark,
    area) that they leave. A piece below a cut has a 0 added to its path, one above a 1."""
    polygons, pixels = whole_pages(images, page, pen)
    cuts: list[DataFrame] = []
    pieces: list[DataFrame] = []
    left = ["img", "path", "ring", "n", "dark", "area"]
    for depth in range(rounds + 1):
        judged = materialise(aimed(polygons, pixels, pen, w))
        made = materialise(cut(judged.where("asks" if depth < rounds else "false"), pixels, pen, w))
        pieces.append(judged.join(made.select("img", "path"), ["img", "path"], "left_anti").select(*left))
        if made.isEmpty():
            break
        cuts.append(chords(made))
        two = F.explode(F.array(*[F.struct(F.concat("path", F.lit(s)).alias("path"), F.col(c).alias("ring")) for s, c in (("0", "below"), ("1", "above"))]))
        polygons = made.select("img", two.alias("h")).select("img", "h.*")
        along = F.col("nx") * F.col("x") + F.col("ny") * F.col("y")
        after = set_off(spread(pixels, pixels.count(), "img", "path"), w).join(made.select("img", "path", "nx", "ny", "at"), ["img", "path"])
        after = materialise(after.withColumn("path", F.concat("path", F.when(along < F.col("at"), "0").otherwise("1"))).drop("nx", "ny", "at", "x", "y"))
        release(pixels)
        pixels = after
    none = images.select("img", F.lit("").alias("path"), *[F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2")]).limit(0)
    return reduce(DataFrame.unionByName, cuts) if cuts else none, reduce(DataFrame.unionByName, pieces)
