"""Lines that split and merge from band to band of a page, as many in each as its darkness asks for.

A band's lines stand where its running darkness passes whole numbers of pens. Two bands' lines are matched in order, so that
none cross: where the next band has fewer several end in one, where it has more one goes on as several. How far lines step
sideways on the way makes them longer, and the second pass places fewer of them there. All that a band's matching needs is the
lines of two bands, one row, whose length the page's width bounds; running darkness is a window over each band.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import half_up
from plumbline.operators import tiles
from plumbline.operators.rounds import large, materialise, release

#: Running darkness counts as past a whole number from this on, and lines slant over at most so many band heights.
PAST, STEEPEST = 1e-9, 4
#: Darkness counts in whole steps of this part of a unit, so that no order of adding it up decides where a line stands.
GRAIN = 1e9


def matched(a: Column, b: Column) -> Column:
    """Pairs (i, j, again) of two ascending lists, in order: ``again`` where ``i`` has a pair already. Each step goes on in
    both lists or in the one whose next entry is nearer, so that every entry has a pair and no two pairs cross."""
    n, m = F.size(a), F.size(b)

    def onward(s: Column, _: Column) -> Column:
        i, j = s["i"], s["j"]
        more_i, more_j = i + 1 < n, j + 1 < m
        both = F.abs(F.get(a, i + 1) - F.get(b, j + 1))
        only_i, only_j = F.abs(F.get(a, i + 1) - F.get(b, j)), F.abs(F.get(a, i) - F.get(b, j + 1))
        diagonal = more_i & more_j & (both <= only_i) & (both <= only_j)
        step_i = diagonal | (more_i & (~more_j | (only_i <= only_j)))
        step_j = diagonal | (more_j & ~step_i)
        i2, j2 = F.when(step_i, i + 1).otherwise(i), F.when(step_j, j + 1).otherwise(j)
        pair = F.struct(i2.alias("i"), j2.alias("j"), (~step_i).alias("again"))
        return F.struct(i2.alias("i"), j2.alias("j"), F.when(more_i | more_j, F.concat(s["out"], F.array(pair))).otherwise(s["out"]).alias("out"))

    zero, none = F.lit(0), F.array().cast("array<struct<i:int,j:int,again:boolean>>")
    start = F.struct(zero.alias("i"), zero.alias("j"), F.array(F.struct(zero.alias("i"), zero.alias("j"), F.lit(False).alias("again"))).alias("out"))
    return F.when((n > 0) & (m > 0), F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n + m - 2)), start, onward, lambda s: s["out"])).otherwise(none)


def crossings(dark: DataFrame, pen: float, first: float) -> DataFrame:
    """(img, band, vs): where the running darkness of each band passes whole numbers, in order; ``dark`` (img, band, m, k) has
    every place ``m`` of each band, and ``first`` is the place of the first."""
    order = Window.partitionBy("img", "band").orderBy("m")
    p = F.sum(half_up(F.col("k") * GRAIN).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(GRAIN * pen)
    run = dark.select("img", "band", "m", p.alias("p"))
    run = run.withColumn("q", F.lead("p").over(order)).withColumn("p0", F.first("p").over(order))
    low = F.greatest(F.floor(F.col("p")) + 1, F.ceil(F.col("p0") + PAST))
    whole = F.when(low <= F.floor("q"), F.sequence(low.cast("int"), F.floor("q").cast("int")))
    at = run.where("q is not null").select("img", "band", "m", "p", "q", F.explode(whole).alias("k"))
    v = first + F.col("m") + (F.col("k") - F.col("p")) / (F.col("q") - F.col("p"))
    return at.groupBy("img", "band").agg(F.array_sort(F.collect_list(v)).alias("vs"))


def slanted(lines: DataFrame, frames: DataFrame, places: int, first: float) -> DataFrame:
    """(img, band, m, cos): how much of a line's length goes along ``u`` at each place, from the steps between the lines
    (img, band, vs) of a band and the next, or the last and itself; between two lines it changes evenly."""
    none = F.array().cast("array<double>")
    own = frames.select("img", "height", "bands", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("band"))
    own = large(own).join(lines, ["img", "band"], "left")
    after = lines.select("img", (F.col("band") - 1).alias("band"), F.col("vs").alias("next"))
    both = own.join(large(after), ["img", "band"], "left").withColumn("vs", F.coalesce("vs", none))
    both = both.withColumn("next", F.when(F.col("band") == F.col("bands") - 1, F.col("vs")).otherwise(F.coalesce("next", none)))
    step = lambda p: F.least(STEEPEST * F.col("height"), F.abs(F.get("next", p["j"]) - F.get("vs", p["i"])))
    both = both.withColumn("pairs", matched(F.col("vs"), F.col("next")))
    both = both.withColumn("sv", F.transform("pairs", lambda p: F.get("vs", p["i"]))).withColumn("ss", F.transform("pairs", step))

    def steepness(m: Column) -> Column:
        v = m + first
        j = F.size(F.filter("sv", lambda x, i: (i > 0) & (x < v)))
        x0, x1, s0, s1 = F.get("sv", j), F.get("sv", j + 1), F.get("ss", j), F.get("ss", j + 1)
        between = s0 + (s1 - s0) * (v - x0) / F.greatest(F.lit(1e-9), x1 - x0)
        return F.when(v <= F.get("sv", F.lit(0)), F.get("ss", F.lit(0))).when(j + 1 >= F.size("sv"), F.element_at("ss", -1)).otherwise(between)

    cos = F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda m: F.when(F.size("sv") == 0, 1.0).otherwise(F.col("height") / F.sqrt(F.col("height") * F.col("height") + F.pow(steepness(m), F.lit(2.0)))))
    return both.select("img", "band", F.posexplode(cos).alias("m", "cos"))


def split_merge(images: DataFrame, page: list[tuple[float, float]], angle: float, scale: float, pen: float, splits: bool = True) -> DataFrame:
    """(img, band, i, j, x1, y1, x2, y2): the lines of each image between the middles of one band and the next; the first and
    last reach the page's edge. Without ``splits`` only a line's first continuation is drawn."""
    c, s = math.cos(angle), math.sin(angle)
    across, along = [y * c - x * s for x, y in page], [x * c + y * s for x, y in page]
    first, places = min(across), max(2, math.ceil(max(across) - min(across)) + 1)
    # Tables that several steps read are written down: a plan that works them out anew at each place has some thirty joins,
    # and the driver holds its text once more with each of their stages.
    images = materialise(images)
    frames = materialise(tiles.band_frames(images, page, angle, scale, pen))
    # Places off the image have no darkness, but the running sum passes them.
    every = frames.select("img", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("band")).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    box = images.agg(F.min("ix"), F.max("ix"), F.min("iy"), F.max("iy")).first()
    got = tiles.band_darkness(images, page, angle, scale, pen, None if None in box else tuple(box))
    dark = large(every).join(got, ["img", "band", "m"], "left").na.fill(0.0, ["k"])
    dark = materialise(dark)
    release(images)
    even = materialise(crossings(dark, pen, first))
    slant = slanted(even, frames, places, first)
    lines = materialise(crossings(large(dark).join(slant, ["img", "band", "m"]).withColumn("k", F.col("k") * F.col("cos")), pen, first))
    release(dark, even)
    after = lines.select("img", (F.col("band") - 1).alias("band"), F.col("vs").alias("next"))
    pair = large(lines).join(after, ["img", "band"]).join(large(frames.select("img", "bands", "height")), "img")
    pair = pair.withColumn("p", F.explode(matched(F.col("vs"), F.col("next"))))
    if not splits:
        pair = pair.where("not p.again")
    u1 = min(along) + F.when(F.col("band") == 0, 0.0).otherwise(F.col("band") + 0.5) * F.col("height")
    u2 = min(along) + F.when(F.col("band") == F.col("bands") - 2, F.col("bands")).otherwise(F.col("band") + 1.5) * F.col("height")
    v1, v2 = F.get("vs", F.col("p.i")), F.get("next", F.col("p.j"))
    place = [(u * c - v * s).alias(f"x{n}") for n, u, v in ((1, u1, v1), (2, u2, v2))] + [(u * s + v * c).alias(f"y{n}") for n, u, v in ((1, u1, v1), (2, u2, v2))]
    return pair.select("img", "band", F.col("p.i").alias("i"), F.col("p.j").alias("j"), *place)
