"""Pages cut into bands, lattices and tiles, and the ink that each part asks for."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.maps import HEX_DENSITY
from plumbline.functions.scalar import clamp, half_up
from plumbline.operators import lookup, raster
from plumbline.operators.rounds import large


def dark() -> Column:
    return 1 - clamp(F.col("v").cast("double"), 0.0, 1.0)


def band_frames(images: DataFrame, page: list[tuple[float, float]], angle: float, scale: float, pen: float) -> DataFrame:
    """(img, kmean, bands, height): bands across a page turned by ``angle``, each as high as strokes of the image's mean
    darkness would stand apart, at least a pen and six to a page."""
    along = [x * math.cos(angle) + y * math.sin(angle) for x, y in page]
    span = max(along) - min(along)
    mean = images.groupBy("img").agg(F.greatest(F.lit(0.02), F.avg(dark())).alias("kmean"))
    height = F.greatest(F.lit(pen), F.least(F.lit(span / 6), scale * pen / F.col("kmean")))
    bands = F.greatest(F.lit(2), half_up(span / height)).cast("int")
    return mean.withColumn("bands", bands).withColumn("height", span / F.col("bands"))


def band_darkness(images: DataFrame, page: list[tuple[float, float]], angle: float, scale: float, pen: float, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(img, band, m, k): darkness of each band at each unit along it: the mean of samples across the band, of which those
    off the image count as white. Only places with a pixel have a row. Samples meet pixels by an equi-join; where the least
    and greatest ``ix`` and ``iy`` of all images are given as a ``box``, those beyond it aren't shuffled."""
    c, s = math.cos(angle), math.sin(angle)
    u_lo = min(x * c + y * s for x, y in page)
    across = [y * c - x * s for x, y in page]
    v_lo, n_v = min(across), max(2, math.ceil(max(across) - min(across)) + 1)
    f = band_frames(images, page, angle, scale, pen).withColumn("n", F.greatest(F.lit(2), F.ceil("height")).cast("int"))
    sample = f.withColumn("band", F.explode(F.sequence(F.lit(0), F.col("bands") - 1))).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    sample = sample.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))))
    u, v = u_lo + F.col("band") * F.col("height") + (F.col("s") + 0.5) * F.col("height") / F.col("n"), v_lo + F.col("m")
    at = lambda a: (F.floor(a + 0.5) - 1).cast("int")
    asked = sample.select("img", "band", "m", "n", at(u * c - v * s).alias("ix"), at(u * s + v * c).alias("iy"))
    if box is not None:
        asked = asked.where(F.col("ix").between(*box[:2]) & F.col("iy").between(*box[2:]))
    return large(asked).join(images, ["img", "ix", "iy"]).groupBy("img", "band", "m").agg((F.sum(dark()) / F.max("n")).alias("k"))


def lattice(w: int, h: int, dot: float, hexagonal: bool) -> tuple[int, int, float, float, float, float]:
    """(columns, rows, first x, first y, step in x, step in y) of dots of radius ``dot`` that just cover a page."""
    dx = dot * math.sqrt(3 if hexagonal else 2)
    dy = dx * math.sqrt(3) / 2 if hexagonal else dx
    cols, rows = max(2, math.floor((w - 1) / dx + 1.5)), max(2, math.floor((h - 1) / dy + 1.5))
    return cols, rows, 1 + (w - 1 - (cols - 1) * dx) / 2, 1 + (h - 1 - (rows - 1) * dy) / 2, dx, dy


def lattice_cells(spark: SparkSession, w: int, h: int, dot: float, hexagonal: bool) -> DataFrame:
    """(pid, i, j, x, y) of a lattice's cells; odd rows of a hexagonal one stand half a step to the right."""
    cols, rows, x0, y0, dx, dy = lattice(w, h, dot, hexagonal)
    c = spark.range(cols * rows).select(F.col("id").alias("pid"), F.floor(F.col("id") / cols).cast("int").alias("i"), (F.col("id") % cols).cast("int").alias("j"))
    shift = F.when(F.col("i") % 2 == 1, 0.5 if hexagonal else 0.0).otherwise(0.0)
    return c.select("pid", "i", "j", (x0 + (F.col("j") + shift) * dx).alias("x"), (y0 + F.col("i") * dy).alias("y"))


def lattice_darkness(images: DataFrame, w: int, h: int, dot: float, hexagonal: bool) -> DataFrame:
    """(img, pid, k): darkness of each cell, from the image shrunk to a pixel for each; odd hexagonal rows are read half a
    cell to the right, and no farther than the last."""
    cols, rows, *_ = lattice(w, h, dot, hexagonal)
    cells = lattice_cells(images.sparkSession, w, h, dot, hexagonal)
    shift = F.when(F.col("i") % 2 == 1, 0.5 if hexagonal else 0.0).otherwise(0.0)
    at = cells.select("pid", F.least(F.lit(float(cols)), F.col("j") + 1 + shift).alias("x"), (F.col("i") + 1.0).alias("y"))
    got = lookup.bilinear(at, raster.shrink(images, w, h, cols, rows), cols, rows)
    return got.select("img", "pid", dark().alias("k"))


def lattice_links(cells: DataFrame, cols: int, rows: int, hexagonal: bool) -> DataFrame:
    """(pid, near) of each cell and its four or six neighbours on the lattice."""
    odd = F.when(F.col("i") % 2 == 1, 1).otherwise(-1)
    sides = [(0, F.lit(-1)), (0, F.lit(1)), (-1, F.lit(0)), (1, F.lit(0))] + ([(-1, odd), (1, odd)] if hexagonal else [])
    to = F.array(*[F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j")) for di, dj in sides])
    n = cells.select("pid", F.explode(to).alias("t")).where(F.col("t.i").between(0, rows - 1) & F.col("t.j").between(0, cols - 1))
    return n.select("pid", (F.col("t.i") * cols + F.col("t.j")).cast("long").alias("near"))


def owed(pixels: DataFrame, seeds: DataFrame, reach: float, cell: float, w: int, h: int) -> DataFrame:
    """(pid, ink, pixels): the darkness of the pixels (ix, iy, v) nearest to each seed; those farther than ``reach`` from
    any seed can't be drawn and come under a null pid."""
    label = lookup.nearest_seed(pixels, seeds, cell, w, h)
    near = F.when(F.col("d2") <= reach * reach, F.col("pid"))
    k = pixels.join(label, ["ix", "iy"], "left").select(near.alias("pid"), dark().alias("k")).where("k > 0")
    return k.groupBy("pid").agg(F.sum("k").alias("ink"), F.count("*").alias("pixels"))


def tiles(kind: str, sizes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """``sizes`` (key, side) with the cells (``row`` and ``col`` from 0, ``ring``) that cover a box: squares of that side, or
    pointed hexagons of the same area, odd rows half a step to the left."""
    x0, y0, x1, y1 = box
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    if kind == "square":
        side = F.col("side")
        s = sizes.withColumn("_nx", F.ceil((x1 - x0) / side)).withColumn("_ny", F.ceil((y1 - y0) / side))
        s = s.withColumn("_row", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1))).withColumn("_col", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1)))
        x, y = x0 + F.col("_col") * side, y0 + F.col("_row") * side
        ring = F.array(point(x, y), point(x + side, y), point(x + side, y + side), point(x, y + side))
        return s.select("key", "side", F.col("_row").cast("int").alias("row"), F.col("_col").cast("int").alias("col"), ring.alias("ring"))
    radius = F.col("side") * math.sqrt(2 / (3 * math.sqrt(3)))
    s = sizes.withColumn("_r", radius).withColumn("_w", F.col("_r") * math.sqrt(3))
    s = s.withColumn("_row", F.explode(F.sequence(F.lit(0), F.ceil((y1 + F.col("_r") - y0) / (1.5 * F.col("_r"))) - 1)))
    s = s.withColumn("_x", x0 - F.when(F.col("_row") % 2 == 1, F.col("_w") / 2).otherwise(0.0))
    s = s.withColumn("_col", F.explode(F.sequence(F.lit(0), F.ceil((x1 + F.col("_w") / 2 - F.col("_x")) / F.col("_w")) - 1)))
    x, y = F.col("_x") + F.col("_col") * F.col("_w"), y0 + F.col("_row") * (1.5 * F.col("_r"))
    corners = [(math.cos(math.pi / 2 + k * math.pi / 3), math.sin(math.pi / 2 + k * math.pi / 3)) for k in range(6)]
    ring = F.array(*[point(x + F.col("_r") * c, y + F.col("_r") * s) for c, s in corners])
    return s.select("key", "side", F.col("_row").cast("int").alias("row"), F.col("_col").cast("int").alias("col"), ring.alias("ring"))


def tile_edges(cells: DataFrame, box: tuple[float, float, float, float], grain: float = 1e-6) -> DataFrame:
    """(key, ax, ay, bx, by, shared): each side of the cells' rings once, whichever cell it belongs to, in units of
    ``grain``; sides that lie on the box itself are left out."""
    unit = lambda c: half_up(c / grain).cast("long")
    p = F.transform("ring", lambda p: F.struct(unit(p["x"]).alias("x"), unit(p["y"]).alias("y")))
    side = cells.select("key", p.alias("p")).select("key", F.explode(F.transform("p", lambda a, i: F.array_sort(F.array(a, F.get("p", (i + 1) % F.size("p")))))).alias("s"))
    side = side.select("key", F.col("s")[0].alias("a"), F.col("s")[1].alias("b")).where("a <> b")
    lo_x, lo_y, hi_x, hi_y = (math.floor(c / grain + 0.5) for c in box)
    on = lambda axis, at: (F.col(f"a.{axis}") == at) & (F.col(f"b.{axis}") == at)
    inner = side.where(~(on("x", lo_x) | on("x", hi_x) | on("y", lo_y) | on("y", hi_y)))
    return inner.groupBy("key", "a", "b").agg(F.count("*").alias("shared")).select("key", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), "shared")


def perimeter(images: DataFrame, page: tuple[float, float, float, float], w: int, h: int, count: float) -> DataFrame:
    """(img, side, i, x, y): points along a page's four sides, as dense there as ``count`` points would be on the whole
    image by its darkness. Each side is walked in steps of a pixel whose length over the local spacing adds up; points
    stand at equal parts of that sum, the first on the corner."""
    x0, y0, x1, y1 = page
    total = images.groupBy("img").agg(F.sum(dark()).alias("total"))
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    sides = []
    for i, ((ax, ay), (bx, by)) in enumerate(zip(corners, corners[1:] + corners[:1], strict=True)):
        steps = max(2, math.ceil(math.hypot(bx - ax, by - ay)))
        sides.append((i, ax, ay, bx, by, steps, math.hypot(bx - ax, by - ay)))
    side = images.sparkSession.createDataFrame(sides, "side int, ax double, ay double, bx double, by double, steps int, len double")
    step = side.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("steps"))))
    t = (F.col("k") - 0.5) / F.col("steps")
    step = step.withColumn("ix", lookup.pixel_of(F.col("ax") + (F.col("bx") - F.col("ax")) * t, w)).withColumn("iy", lookup.pixel_of(F.col("ay") + (F.col("by") - F.col("ay")) * t, h))
    density = F.greatest(F.lit(1e-9), dark() * F.greatest(F.lit(1.0), F.lit(float(count))) / F.col("total"))
    laid = step.join(images, ["ix", "iy"]).join(total, "img").withColumn("d", F.col("len") / F.col("steps") / F.sqrt(HEX_DENSITY / density))
    order = Window.partitionBy("img", "side").orderBy("k")
    laid = laid.withColumn("p1", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.withColumn("p0", F.coalesce(F.lag("p1").over(order), F.lit(0.0)))
    whole = laid.withColumn("p", F.max("p1").over(Window.partitionBy("img", "side"))).withColumn("n", F.greatest(F.lit(1), half_up(F.col("p"))).cast("int"))
    # The points of a step are those whose share of the sum falls into it.
    lo, hi = F.ceil(F.col("p0") / F.col("p") * F.col("n")).cast("int"), (F.ceil(F.col("p1") / F.col("p") * F.col("n")) - 1).cast("int")
    hi = F.least(hi, F.col("n") - 1)
    put = whole.where(lo <= hi).withColumn("i", F.explode(F.sequence(lo, hi)))
    along = (F.col("k") - 1 + (F.col("i") * F.col("p") / F.col("n") - F.col("p0")) / (F.col("p1") - F.col("p0"))) / F.col("steps")
    return put.select("img", "side", "i", (F.col("ax") + (F.col("bx") - F.col("ax")) * along).alias("x"), (F.col("ay") + (F.col("by") - F.col("ay")) * along).alias("y"))


def blended(tensor: DataFrame, flat: float) -> DataFrame:
    """(img, ix, iy, cx, cy): the stroke's direction, as a unit vector of twice its angle: the tensor's as far as it is
    coherent, ``flat`` for the rest."""
    fx, fy = math.cos(2 * flat), math.sin(2 * flat)
    a, b = F.col("t11") - F.col("t22"), 2 * F.col("t12")
    spread, trace = F.sqrt(a * a + b * b), F.col("t11") + F.col("t22")
    sure = F.when(trace > 0, spread / trace).otherwise(0.0)
    unit = F.when(spread > 0, 1 / spread).otherwise(0.0)
    t = tensor.select("img", "ix", "iy", (fx * (1 - sure) - sure * a * unit).alias("bx"), (fy * (1 - sure) - sure * b * unit).alias("by"))
    m = F.sqrt(F.col("bx") * F.col("bx") + F.col("by") * F.col("by"))
    return t.select("img", "ix", "iy", F.when(m > 0, F.col("bx") / m).otherwise(fx).alias("cx"), F.when(m > 0, F.col("by") / m).otherwise(fy).alias("cy"))
