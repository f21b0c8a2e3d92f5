"""Look-ups between points and rasters, tables and seeds, as equi-joins on cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.rounds import materialise


def bilinear(points: DataFrame, raster: DataFrame, w: int, h: int) -> DataFrame:
    """(img, pid, v) of ``points`` (pid, x, y; pixels from 1 on), for the points inside the raster: each point asks for the four
    pixels around it, with a weight each, and needs all of them."""
    fx, fy = F.col("x") - 1, F.col("y") - 1
    x0 = F.greatest(F.lit(0), F.least(F.lit(w - 2), F.floor(fx))).cast("int")
    y0 = F.greatest(F.lit(0), F.least(F.lit(h - 2), F.floor(fy))).cast("int")
    tx, ty = fx - x0, fy - y0
    corner = lambda dx, dy: F.struct((x0 + dx).alias("ix"), (y0 + dy).alias("iy"), ((tx if dx else 1 - tx) * (ty if dy else 1 - ty)).alias("k"))
    corners = F.array(*[corner(dx, dy) for dx in (0, 1) for dy in (0, 1)])
    ok = (fx >= 0) & (fx <= w - 1) & (fy >= 0) & (fy <= h - 1)
    asked = points.where(ok).select("pid", F.explode(corners).alias("c")).select("pid", "c.*")
    got = asked.join(raster, ["ix", "iy"]).groupBy("img", "pid").agg(F.sum(F.col("k") * F.col("v")).alias("v"), F.count("*").alias("n"))
    return got.where("n = 4").select("img", "pid", "v")


def pixel_of(c: Column, n: int) -> Column:
    """The pixel, from 0, nearest to a coordinate counted from 1, within the raster."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(c + 0.5) - 1)).cast("int")


def nearest_pixel(points: DataFrame, raster: DataFrame, w: int, h: int) -> DataFrame:
    at = points.withColumn("ix", pixel_of(F.col("x"), w)).withColumn("iy", pixel_of(F.col("y"), h))
    return at.join(raster, ["ix", "iy"]).select("img", "pid", "v")


def interpolated(values: DataFrame, knots: DataFrame, by: list[str], width: float) -> DataFrame:
    """``values`` (by, id, u) with the table's value at u: knots (by, x, y) ascending in x, ends held.

    Each stretch between two knots is laid over buckets of ``width``, so that a value meets the stretches of its own
    bucket alone, whatever the size of the table.
    """
    order = Window.partitionBy(*by).orderBy("x")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = knots.select(*by, F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(order).alias("x1"), F.lead("y").over(order).alias("y1"), F.min("x").over(whole).alias("lo"), F.max("x").over(whole).alias("hi"))
    ends = k.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    bucket = lambda c: F.floor(c / width)
    laid = k.where("x1 is not null").withColumn("b", F.explode(F.sequence(bucket(F.col("x0")), bucket(F.col("x1")))))
    at = F.greatest("lo", F.least("hi", F.col("u")))
    asked = values.join(ends, by).withColumn("at", at).withColumn("b", bucket(F.col("at")))
    hit = asked.join(laid.drop("lo", "hi"), [*by, "b"]).where("at >= x0 and (at < x1 or (at = x1 and x1 = hi))")
    value = F.when(F.col("x1") > F.col("x0"), F.col("y0") + (F.col("at") - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).otherwise(F.col("y0"))
    return hit.groupBy(*by, "id").agg(F.max(value).alias("y"))


def nearest_seed(pixels: DataFrame, seeds: DataFrame, cell: float, w: int, h: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ix, iy, pid, d2): the seed nearest to each pixel among those of its group, the smaller pid on a tie.

    Seeds are bucketed in cells. A pixel asks the cells around its own; if the best found there could be beaten from
    farther away, or there is none, it goes on with the cells of a ring twice as wide that it hasn't asked yet, so that
    the search is exact and most pixels meet few seeds.
    """
    key = [*by, "ix", "iy"]
    pending = pixels.select(*key, (F.col("ix") + 1.0).alias("x"), (F.col("iy") + 1.0).alias("y"))
    none = F.lit(None).cast(f"struct<d2:double,pid:{dict(seeds.dtypes)['pid']}>")
    pending = pending.withColumn("b", none)
    placed = seeds.select(*by, "pid", F.col("x").cast("double").alias("sx"), F.col("y").cast("double").alias("sy"))
    placed = placed.withColumn("_bx", F.floor(F.col("sx") / cell)).withColumn("_by", F.floor(F.col("sy") / cell))
    asked_to, reach, found = -1, 1, None
    most = int(max(w, h) / cell) + 2
    while True:
        span = F.sequence(F.lit(-reach), F.lit(reach))
        asked = pending.select(*key, "x", "y", F.explode(span).alias("dx")).withColumn("dy", F.explode(span)).where(F.greatest(F.abs("dx"), F.abs("dy")) > asked_to)
        asked = asked.withColumn("_bx", F.floor(F.col("x") / cell) + F.col("dx")).withColumn("_by", F.floor(F.col("y") / cell) + F.col("dy"))
        d2 = (F.col("sx") - F.col("x")) * (F.col("sx") - F.col("x")) + (F.col("sy") - F.col("y")) * (F.col("sy") - F.col("y"))
        near = asked.join(placed, [*by, "_bx", "_by"]).groupBy(*key).agg(F.min(F.struct(d2.alias("d2"), F.col("pid").alias("pid"))).alias("n"))
        best = pending.join(near, key, "left").withColumn("b", F.least("b", "n")).drop("n")
        # A seed outside the cells asked is at least ``reach`` cells away.
        best = materialise(best.withColumn("sure", F.coalesce(F.col("b.d2") <= (reach * cell) ** 2, F.lit(False)) | F.lit(reach >= most)))
        sure = best.where("sure and b is not null").select(*key, "b.pid", "b.d2")
        found = sure if found is None else found.unionByName(sure)
        pending = best.where("not sure").drop("sure")
        if reach >= most or pending.isEmpty():
            return found
        asked_to, reach = reach, reach * 2
