"""Rendering strokes to a raster, and how well a drawing holds its target's tone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import raster as rasters

TILE = 16


def inked(segments: DataFrame, w: int, h: int, radius: float) -> DataFrame:
    """(img, px, py) of the samples closer than ``radius`` to a segment (img, x1, y1, x2, y2), in pixels from 0 on.

    A segment is laid over the tiles that its pen can reach, and within a tile over the samples of its box there; only
    these are tested, so work follows the length of the strokes and not strokes times pixels.
    """
    lo = lambda a, b: F.least(F.col(a), F.col(b)) - radius
    hi = lambda a, b: F.greatest(F.col(a), F.col(b)) + radius
    tile = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n // TILE), F.floor(c / TILE))).cast("int")
    s = segments.where(F.greatest(F.abs("x1"), F.abs("y1"), F.abs("x2"), F.abs("y2")) < 1e300)
    s = s.withColumn("tx", F.explode(F.sequence(tile(lo("x1", "x2"), w), tile(hi("x1", "x2"), w))))
    s = s.withColumn("ty", F.explode(F.sequence(tile(lo("y1", "y2"), h), tile(hi("y1", "y2"), h))))
    first = lambda c, a, b, n: F.greatest(F.lit(0), F.col(c) * TILE, F.ceil(lo(a, b)).cast("int"))
    last = lambda c, a, b, n: F.least(F.lit(n - 1), F.col(c) * TILE + TILE - 1, F.floor(hi(a, b)).cast("int"))
    spans = {p: (first(*a), last(*a)) for p, a in (("px", ("tx", "x1", "x2", w)), ("py", ("ty", "y1", "y2", h)))}
    for p, (a, b) in spans.items():
        s = s.withColumn(p, F.explode(F.when(a <= b, F.sequence(a, b))))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy) / size))).otherwise(0.0)
    ex, ey = F.col("px") - F.col("x1") - t * dx, F.col("py") - F.col("y1") - t * dy
    return s.where(ex * ex + ey * ey < radius * radius).select("img", "px", "py").distinct()


def rendered(segments: DataFrame, images: DataFrame, w: int, h: int, pen: float, sample: int) -> DataFrame:
    """Raster of strokes (img, x1, y1, x2, y2; pixels from 1 on): white less the share of each pixel's ``sample`` by
    ``sample`` points that are inked. ``images``: (img, ix, iy) of every pixel wanted."""
    scaled = segments.select("img", *[((F.col(c) - 1) * sample + 1 - 1).alias(c) for c in ("x1", "y1", "x2", "y2")])
    ink = inked(scaled, w * sample, h * sample, pen * sample / 2)
    cover = ink.groupBy("img", F.floor(F.col("px") / sample).cast("int").alias("ix"), F.floor(F.col("py") / sample).cast("int").alias("iy")).agg(F.count("*").alias("n"))
    return images.select("img", "ix", "iy").join(cover, ["img", "ix", "iy"], "left").select("img", "ix", "iy", (1 - F.coalesce("n", F.lit(0)) / (sample * sample)).cast("float").alias("v"))


def tone_error(drawn: DataFrame, target: DataFrame, pen: float) -> DataFrame:
    """Root mean square and largest difference of the blurred images, and the share of pixels over 0.15."""
    radius = max(3, int(3 * pen + 0.5))
    blurred = [rasters.blur(r, radius, radius / 3).withColumnRenamed("v", n) for r, n in ((drawn, "a"), (target, "b"))]
    e = blurred[0].join(blurred[1], ["img", "ix", "iy"]).withColumn("e", F.col("a").cast("double") - F.col("b").cast("double"))
    return e.groupBy("img").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rms"), F.max(F.abs("e")).alias("most"), F.avg((F.abs("e") > 0.15).cast("double")).alias("clipped"))


def bands(target: DataFrame, drawn: DataFrame, w: int, n: int) -> DataFrame:
    """Mean of target and drawing in each of ``n`` upright bands."""
    band = F.least(F.lit(n - 1), F.floor(F.col("ix") * n / w)).cast("int")
    both = target.select("img", "ix", "iy", F.col("v").alias("t")).join(drawn, ["img", "ix", "iy"])
    return both.groupBy("img", band.alias("band")).agg(F.avg(F.col("t").cast("double")).alias("target"), F.avg(F.col("v").cast("double")).alias("rendered"))
