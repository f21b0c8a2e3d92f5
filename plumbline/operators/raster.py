"""Raster operators on ``(img, ix, iy, v)``: resizing, separable filters, morphology, orientation, box sums.

Row and column filters gather one line of pixels into an array (a line is bounded by the image's size) and work on it
with higher-order functions: one shuffle for each axis, and no pixel is repeated for a filter's taps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaussian(size: int, sigma: float) -> list[float]:
    """Weights of an odd number of taps, adding up to 1."""
    n = max(1, size) | 1
    sigma = max(sigma, 1e-6)
    raw = [math.exp(-((i - n // 2) ** 2) / (2 * sigma * sigma)) for i in range(n)]
    return [x / sum(raw) for x in raw]


def filtered(raster: DataFrame, along: str, taps: list[float], store: str = "float", values: tuple[str, ...] = ("v",), kept: tuple[str, ...] = ()) -> DataFrame:
    """Weighted sum of each pixel's neighbours along one axis, edges repeated outwards, of each of ``values``; the columns
    ``kept`` stay as they are."""
    other, half = "iy" if along == "ix" else "ix", len(taps) // 2
    weights = F.array(*[F.lit(t) for t in taps])
    lines = raster.groupBy("img", other).agg(F.array_sort(F.collect_list(F.struct(along, *values, *kept))).alias("s"))
    line = lambda c: F.transform("s", lambda p: p[c].cast("double")).alias(f"line_{c}")
    lines = lines.select("img", other, *map(line, values), *(["s"] if kept else []))
    n = F.size(f"line_{values[0]}")

    def at(x: Column) -> Column:
        reach = F.sequence(F.lit(0), F.lit(len(taps) - 1))
        near = lambda c, j: F.get(f"line_{c}", F.greatest(F.lit(0), F.least(n - 1, x + j - half)))
        mean = lambda c: F.aggregate(reach, F.lit(0.0), lambda s, j: s + F.get(weights, j) * near(c, j)).cast(store).alias(c)
        return F.struct(*map(mean, values), *[F.get("s", x)[c].alias(c) for c in kept])

    made = lines.select("img", other, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), at)).alias(along, "made"))
    return made.select("img", "ix", "iy", *[F.col(f"made.{c}").alias(c) for c in (*values, *kept)])


def blur(raster: DataFrame, size: int, sigma: float, store: str = "float", values: tuple[str, ...] = ("v",), kept: tuple[str, ...] = ()) -> DataFrame:
    taps = gaussian(size, sigma)
    return filtered(filtered(raster, "ix", taps, store, values, kept), "iy", taps, store, values, kept)


def shrink(raster: DataFrame, w: int, h: int, new_w: int, new_h: int) -> DataFrame:
    """Area-weighted mean over the source pixels that each new pixel overlaps; ``new_w <= w`` and ``new_h <= h``."""
    sx, sy = w / new_w, h / new_h

    def cells(axis: str, scale: float, n: int) -> Column:
        first = F.floor(F.col(axis) / scale).cast("int")
        last = F.least(F.lit(n - 1), F.floor((F.col(axis) + 1) / scale - 1e-9).cast("int"))
        overlap = lambda d: F.least(F.col(axis) + 1.0, (d + 1) * scale) - F.greatest(F.col(axis) + 0.0, d * scale)
        return F.transform(F.sequence(first, F.greatest(first, last)), lambda d: F.struct(d.alias("d"), overlap(d).alias("k")))

    laid = raster.withColumn("a", F.explode(cells("ix", sx, new_w))).withColumn("b", F.explode(cells("iy", sy, new_h)))
    weight = F.col("a.k") * F.col("b.k")
    return laid.groupBy("img", F.col("a.d").alias("ix"), F.col("b.d").alias("iy")).agg((F.sum(F.col("v") * weight) / F.sum(weight)).alias("v"))


def grow(raster: DataFrame, w: int, h: int, new_w: int, new_h: int) -> DataFrame:
    """Bilinear sampling at the new pixels' centres; ``new_w >= w`` and ``new_h >= h``."""

    def taps(axis: str, n: int, new_n: int) -> Column:
        scale = n / new_n
        return F.expr(
            f"filter(transform(sequence(greatest(0, int(floor(({axis} - 0.5D) / {scale!r}D)) - 2), least({new_n - 1}, int(floor(({axis} + 1.5D) / {scale!r}D)) + 2)), "
            f"d -> struct(d as d, greatest(0D, 1D - abs(greatest(0D, least({n - 1}D, (d + 0.5D) * {scale!r}D - 0.5D)) - {axis})) as k)), t -> t.k > 0)"
        )

    laid = raster.withColumn("a", F.explode(taps("ix", w, new_w))).withColumn("b", F.explode(taps("iy", h, new_h)))
    return laid.groupBy("img", F.col("a.d").alias("ix"), F.col("b.d").alias("iy")).agg(F.sum(F.col("v") * F.col("a.k") * F.col("b.k")).alias("v"))


def neighbourhood(raster: DataFrame, half: int, w: int, h: int, edge: str) -> DataFrame:
    """(img, ix, iy, u): each pixel with the values of the square around it. ``edge``: ``mirror`` or ``drop``."""
    span = F.array(*[F.lit(d) for d in range(-half, half + 1)])
    if edge == "drop":
        moved = raster.withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span))
        moved = moved.select("img", (F.col("ix") + F.col("dx")).alias("ix"), (F.col("iy") + F.col("dy")).alias("iy"), F.col("v").alias("u"))
        return moved.where(f"ix between 0 and {w - 1} and iy between 0 and {h - 1}")
    fold = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.when(c < 0, -c - 1).when(c >= n, 2 * n - c - 1).otherwise(c)))
    asked = raster.select("img", "ix", "iy", F.explode(span).alias("dx")).withColumn("dy", F.explode(span))
    asked = asked.select("img", "ix", "iy", fold(F.col("ix") + F.col("dx"), w).alias("qx"), fold(F.col("iy") + F.col("dy"), h).alias("qy"))
    source = raster.select("img", F.col("ix").alias("qx"), F.col("iy").alias("qy"), F.col("v").alias("u"))
    return asked.join(source, ["img", "qx", "qy"]).select("img", "ix", "iy", "u")


def median(raster: DataFrame, size: int, w: int, h: int) -> DataFrame:
    """Middle value of the square of ``size`` around each pixel, mirrored at the edges."""
    k = max(3, size) | 1
    near = neighbourhood(raster, k // 2, w, h, "mirror").groupBy("img", "ix", "iy").agg(F.array_sort(F.collect_list("u")).alias("s"))
    return near.select("img", "ix", "iy", F.get("s", F.lit((k * k - 1) >> 1)).alias("v"))


def dilated(mask: DataFrame, w: int, h: int) -> DataFrame:
    """A pixel is in if any of the nine around it is; nothing is outside the raster."""
    return neighbourhood(mask, 1, w, h, "drop").groupBy("img", "ix", "iy").agg(F.max("u").alias("v"))


def gradients(raster: DataFrame) -> DataFrame:
    """``raster`` with half the difference of each pixel's neighbours, gx and gy; a missing neighbour is the pixel itself."""
    row, column = Window.partitionBy("img", "iy").orderBy("ix"), Window.partitionBy("img", "ix").orderBy("iy")
    diff = lambda w: (F.coalesce(F.lead("v").over(w), F.col("v")).cast("double") - F.coalesce(F.lag("v").over(w), F.col("v"))) / 2
    return raster.withColumn("gx", diff(row)).withColumn("gy", diff(column))


def structure_tensor(raster: DataFrame, r_gradient: float, r_tensor: float, kept: tuple[str, ...] = ()) -> DataFrame:
    """(img, ix, iy, t11, t12, t22, theta, coherence): the smoothed outer product of gradients, the direction along
    which the image changes least, and how clear it is; the raster's columns ``kept`` go along."""
    smooth = blur(raster, max(3, math.floor(3 * r_gradient + 0.5)), max(0.5, r_gradient), kept=kept)
    g = gradients(smooth)
    size, sigma = max(3, math.floor(3 * r_tensor + 0.5)), max(0.5, r_tensor)
    parts = {"t11": F.col("gx") * F.col("gx"), "t12": F.col("gx") * F.col("gy"), "t22": F.col("gy") * F.col("gy")}
    # The three products are blurred in one pass.
    products = g.select("img", "ix", "iy", *[v.cast("float").alias(n) for n, v in parts.items()], *kept)
    blurred = blur(products, size, sigma, values=tuple(parts), kept=kept)
    t = blurred.select("img", "ix", "iy", *[F.col(n).cast("double").alias(n) for n in parts], *kept)
    spread = F.sqrt((F.col("t11") - F.col("t22")) * (F.col("t11") - F.col("t22")) + 4 * F.col("t12") * F.col("t12"))
    theta = F.atan2(2 * F.col("t12"), F.col("t11") - F.col("t22")) / 2 + math.pi / 2
    return t.withColumn("theta", theta).withColumn("coherence", spread / (F.col("t11") + F.col("t22") + 1e-12))


def edge_strength(raster: DataFrame, sigma: float) -> DataFrame:
    """Size of the Laplacian of the blurred image, in units of the image's largest."""
    size = max(3, 2 * math.ceil(3 * sigma) + 1)
    smooth = blur(raster, size, sigma)
    row, column = Window.partitionBy("img", "iy").orderBy("ix"), Window.partitionBy("img", "ix").orderBy("iy")
    own = F.col("v").cast("double")
    around = [F.coalesce(f("v").over(w), F.col("v")).cast("double") for w in (row, column) for f in (F.lead, F.lag)]
    strength = smooth.select("img", "ix", "iy", F.abs(around[0] + around[1] + around[2] + around[3] - 4 * own).alias("e"))
    most = strength.groupBy("img").agg(F.max("e").alias("most"))
    return strength.join(most, "img").select("img", "ix", "iy", F.when(F.col("most") > 0, F.col("e") / F.col("most")).otherwise(0.0).alias("v"))


def box_sums(raster: DataFrame, value: Column) -> DataFrame:
    """(img, ix, iy, s): sum of ``value`` over all pixels up to and including the pixel in both axes; one running sum
    for each axis."""
    row = Window.partitionBy("img", "iy").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    column = Window.partitionBy("img", "ix").orderBy("iy").rowsBetween(Window.unboundedPreceding, 0)
    return raster.select("img", "ix", "iy", F.sum(value).over(row).alias("r")).select("img", "ix", "iy", F.sum("r").over(column).alias("s"))
