"""Pen paths as rows ``(path_id, seq, x, y)``: lengths, resampling, joining, ordering, metrics, SVG text."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import geometry

KEY = ["path_id"]


def _along(by: list[str] = KEY) -> Window:
    return Window.partitionBy(*by).orderBy("seq")


def with_length(paths: DataFrame, by: list[str] = KEY) -> DataFrame:
    """``paths`` with ``s``, the length of the path up to each point."""
    order = _along(by)
    dx, dy = F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)
    step = F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    return paths.withColumn("step", step).withColumn("s", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def resampled(paths: DataFrame, step: float) -> DataFrame:
    """Points at equal distances along each path, close to ``step`` apart, both ends exact. A point is made from the
    stretch it falls on, so no join is needed."""
    order = _along()
    total = F.max("s").over(Window.partitionBy("path_id"))
    s = with_length(paths).withColumn("total", total).withColumn("n", F.greatest(F.lit(1), F.floor(F.col("total") / step + 0.5)).cast("int"))
    s = s.select("path_id", "x", "y", "s", "total", "n", *[F.lead(c).over(order).alias(f"{c}1") for c in ("x", "y", "s")]).where("s1 > s")
    gap = F.col("total") / F.col("n")
    first = F.ceil(F.col("s") / gap - 1e-9).cast("int")
    last = F.when(F.col("s1") >= F.col("total"), F.col("n")).otherwise((F.ceil(F.col("s1") / gap - 1e-9) - 1).cast("int"))
    on = s.where(first <= last).withColumn("seq", F.explode(F.sequence(first, last)))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("seq") * gap - F.col("s")) / (F.col("s1") - F.col("s"))))
    # The last point is the path's own end: n times a part of the length may miss it by a rounding.
    t = F.when(F.col("seq") == F.col("n"), 1.0).otherwise(t)
    place = lambda c: F.when(t == 1, F.col(f"{c}1")).otherwise(F.col(c) + t * (F.col(f"{c}1") - F.col(c)))
    return on.select("path_id", "seq", place("x").alias("x"), place("y").alias("y"))


def stepped(paths: DataFrame, step: float) -> DataFrame:
    """Points at 0, ``step``, 2 ``step``, ... along each path, as far as it goes; what is left over has no point."""
    order = _along()
    s = with_length(paths).select("path_id", "x", "y", "s", *[F.lead(c).over(order).alias(f"{c}1") for c in ("x", "y", "s")]).where("s1 > s")
    first = F.when(F.col("s") > 0, F.floor(F.col("s") / step).cast("int") + 1).otherwise(0)
    on = s.withColumn("seq", F.explode(F.sequence(first, F.greatest(first, F.floor(F.col("s1") / step).cast("int"))))).where(F.col("seq") * step <= F.col("s1"))
    t = (F.col("seq") * step - F.col("s")) / (F.col("s1") - F.col("s"))
    return on.select("path_id", "seq", (F.col("x") + t * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y1") - F.col("y"))).alias("y"))


def clipped(paths: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """(path_id, run, seq, x, y): the parts of each path inside a polygon, in order along it. Each stretch is cut within its
    row; stretches that go on where the one before ended are one run."""
    order = _along()
    pairs = paths.select(F.struct("path_id", "seq").alias("seg_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(order).alias("x2"), F.lead("y").over(order).alias("y2"))
    piece = geometry.clipped(pairs.where("x2 is not null"), ring).select("seg_id.path_id", "seg_id.seq", "part", "x1", "y1", "x2", "y2")
    along = Window.partitionBy("path_id").orderBy("seq", "part")
    dx, dy = F.col("x1") - F.lag("x2").over(along), F.col("y1") - F.lag("y2").over(along)
    new = F.coalesce((dx * dx + dy * dy > 1e-18).cast("int"), F.lit(1))
    run = piece.withColumn("new", new).withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    end, start = F.struct(F.lit(1).alias("e"), F.col("x2").alias("x"), F.col("y2").alias("y")), F.struct(F.lit(0).alias("e"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    points = run.select("path_id", "run", "seq", "part", F.explode(F.when(F.col("new") == 1, F.array(start, end)).otherwise(F.array(end))).alias("p"))
    place = F.row_number().over(Window.partitionBy("path_id", "run").orderBy("seq", "part", "p.e")) - 1
    return points.select("path_id", "run", place.alias("seq"), "p.x", "p.y")


def kept_runs(paths: DataFrame, raster: DataFrame, w: int, h: int, least: int) -> DataFrame:
    """(path_id, run, seq, x, y): stretches of ``least`` points or more that lie on kept pixels. ``raster``: the kept
    (ix, iy); a point belongs to its nearest pixel, and one off the raster isn't kept."""
    at = paths.withColumns({"ix": (F.floor(F.col("x") + 0.5) - 1).cast("int"), "iy": (F.floor(F.col("y") + 0.5) - 1).cast("int")})
    on = at.where((F.col("ix") >= 0) & (F.col("ix") < w) & (F.col("iy") >= 0) & (F.col("iy") < h)).join(raster.select("ix", "iy").distinct(), ["ix", "iy"], "left_semi")
    order = _along()
    on = on.withColumn("island", F.col("seq") - F.row_number().over(order))
    size = F.count("*").over(Window.partitionBy("path_id", "island"))
    on = on.withColumn("size", size).where(F.col("size") >= least)
    return on.select("path_id", F.dense_rank().over(Window.partitionBy("path_id").orderBy("island")).alias("run"), "seq", "x", "y")


def dot_strokes(dots: DataFrame, pen: float) -> DataFrame:
    """(path_id, seq, x, y): each dot (path_id, x, y, r) as one stroke: a spiral of the pen's pitch from its middle, then a
    ring whose radius makes the inked area that of the dot; a dot no larger than the pen is a point.

    A spiral's next angle depends on its radius there, so its points are one fold within the row.
    """
    # A chord strays no further from the arc than this share of the pen.
    sag = 0.03 * pen
    end = F.col("r") - pen / 2
    sides = F.greatest(F.lit(8), F.ceil(2 * math.pi / F.least(F.lit(1.0), 2 * F.acos(F.greatest(F.lit(-1.0), 1 - sag / end)))).cast("int"))
    d = dots.withColumn("n", F.when(end > sag, sides))
    area, round_ = F.col("n") / 2 * F.sin(2 * math.pi / F.col("n")), 2 * F.col("n") * F.sin(math.pi / F.col("n"))
    b, c = round_ * (pen / 2), math.pi * (pen / 2) ** 2 - math.pi * F.col("r") * F.col("r")
    d = d.withColumn("ring", (F.sqrt(b * b - 4 * area * c) - b) / (2 * area)).withColumn("total", 2 * math.pi * F.col("ring") / pen)
    step = lambda radius: F.least(F.lit(1.0), F.greatest(F.lit(0.02), F.sqrt(8 * sag / F.greatest(radius, F.lit(sag)))))
    turns = F.sequence(F.lit(0), F.ceil(F.col("total") / step(F.col("ring"))).cast("int"))

    def onward(s: Column, _: Column) -> Column:
        inside = s["t"] < F.col("total")
        return F.struct(
            F.when(inside, s["t"] + step(s["t"] * (pen / (2 * math.pi)))).otherwise(s["t"]).alias("t"),
            F.when(inside, F.concat(s["all"], F.array(s["t"]))).otherwise(s["all"]).alias("all"),
        )

    state = F.struct(F.lit(0.0).alias("t"), F.array().cast("array<double>").alias("all"))
    d = d.withColumn("spiral", F.when(F.col("n").isNotNull(), F.aggregate(turns, state, onward, lambda s: s["all"])))
    point = lambda radius, t: F.struct((F.col("x") + radius * F.cos(t)).alias("x"), (F.col("y") + radius * F.sin(t)).alias("y"))
    inner = F.transform("spiral", lambda t: point(t * (pen / (2 * math.pi)), t))
    outer = F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: point(F.col("ring"), F.col("total") + 2 * math.pi * i / F.col("n")))
    points = F.when(F.col("n").isNotNull(), F.concat(inner, outer)).otherwise(F.array(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))
    out = d.select("path_id", points.alias("p")).select("path_id", F.posexplode_outer("p").alias("seq", "q")).where("q is not null")
    return out.select("path_id", "seq", "q.x", "q.y")


def between(paths: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """The part of each path from length ``lo`` to ``hi``, ends interpolated."""
    order = _along()
    s = with_length(paths).select("*", *[F.lead(c).over(order).alias(f"{c}1") for c in ("x", "y", "s")]).where("s1 > s")
    a, b = F.greatest(F.col("s"), lo), F.least(F.col("s1"), hi)
    s = s.where((a < b) | ((a == b) & (a == lo)))
    at = lambda d, c: F.col(c) + (d - F.col("s")) / (F.col("s1") - F.col("s")) * (F.col(f"{c}1") - F.col(c))
    ends = F.array(F.struct(F.lit(0).alias("e"), a.alias("d")), F.struct(F.lit(1).alias("e"), b.alias("d")))
    points = s.select("path_id", "seq", "x", "y", "s", "x1", "y1", "s1", F.explode(ends).alias("p"))
    made = points.select("path_id", F.col("p.d").alias("d"), at(F.col("p.d"), "x").alias("x"), at(F.col("p.d"), "y").alias("y")).groupBy("path_id", "d").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return made.select("path_id", (F.row_number().over(Window.partitionBy("path_id").orderBy("d")) - 1).alias("seq"), "x", "y")


def normals(paths: DataFrame) -> DataFrame:
    """Unit normals from the points before and after."""
    order = _along()
    d = lambda c: F.coalesce(F.lead(c).over(order), F.col(c)) - F.coalesce(F.lag(c).over(order), F.col(c))
    n = paths.withColumn("dx", d("x")).withColumn("dy", d("y"))
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return n.where(size > 0).select("path_id", "seq", (-F.col("dy") / size).alias("nx"), (F.col("dx") / size).alias("ny"))


def runs(paths: DataFrame, jump: float) -> DataFrame:
    """``paths`` with ``run``, a number that rises where a step is longer than ``jump``."""
    order = _along()
    dx, dy = F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)
    new = F.coalesce((dx * dx + dy * dy > jump * jump).cast("int"), F.lit(0))
    return paths.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def gathered(paths: DataFrame, by: list[str]) -> DataFrame:
    """One row for each path: its points ``p`` in order, its ends ``a`` and ``b``, ``length`` and ``n`` points. A path is
    one pen stroke, so its points fit in a row; what follows needs no further shuffle of points."""
    g = paths.groupBy(*by, "path_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    after = F.slice("p", 2, F.greatest(F.lit(0), F.size("p") - 1))
    step = F.zip_with(after, F.slice("p", 1, F.greatest(F.lit(0), F.size("p") - 1)), lambda q, o: F.sqrt((q["x"] - o["x"]) * (q["x"] - o["x"]) + (q["y"] - o["y"]) * (q["y"] - o["y"])))
    end = lambda e: F.struct(e["x"].alias("x"), e["y"].alias("y"))
    return g.select(
        *by,
        "path_id",
        "p",
        end(F.get("p", F.lit(0))).alias("a"),
        end(F.element_at("p", -1)).alias("b"),
        F.aggregate(step, F.lit(0.0), lambda s, d: s + d).alias("length"),
        F.size("p").cast("long").alias("n"),
    )


def ends_of(paths: DataFrame, by: list[str]) -> DataFrame:
    """One row for each path: its ends, length and number of points."""
    return gathered(paths, by).drop("p")


def joined(paths: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Paths of each layer, in order of their ids, appended to the one before where they start closer than
    ``tolerance`` to its end; the repeated point goes, and a dot is never appended."""
    e = gathered(paths, by)
    order = Window.partitionBy(*by).orderBy("path_id")
    dx, dy = F.col("a.x") - F.lag("b.x").over(order), F.col("a.y") - F.lag("b.y").over(order)
    near = F.coalesce((dx * dx + dy * dy < tolerance * tolerance) & (F.col("n") > 1), F.lit(False))
    e = e.withColumn("near", near).withColumn("group", F.sum((~F.col("near")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("p", F.when(F.col("near"), F.slice("p", 2, F.size("p"))).otherwise(F.col("p")))
    before = Window.partitionBy(*by, "group").orderBy("path_id").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("at", F.coalesce(F.sum(F.size("p")).over(before), F.lit(0)))
    out = e.select(*by, F.col("group").alias("path_id"), "at", F.posexplode_outer("p").alias("i", "q")).where("q is not null")
    return out.select(*by, "path_id", (F.col("at") + F.col("i")).alias("seq"), "q.x", "q.y")


def metrics(paths: DataFrame, by: list[str]) -> DataFrame:
    """Drawn length, pen-up travel from the origin, number of paths and points of each layer."""
    e = ends_of(paths, by)
    order = Window.partitionBy(*by).orderBy("path_id")
    dx = F.col("a.x") - F.coalesce(F.lag("b.x").over(order), F.lit(0.0))
    dy = F.col("a.y") - F.coalesce(F.lag("b.y").over(order), F.lit(0.0))
    e = e.withColumn("travel", F.sqrt(dx * dx + dy * dy))
    return e.groupBy(*by).agg(F.sum("length").alias("drawn"), F.sum("travel").alias("travel"), F.count("*").alias("paths"), F.sum("n").alias("points"))


def svg_number(v: Column) -> Column:
    """Three decimals at most, without trailing zeros; what isn't a finite number is 0."""
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e300)
    thousandths = F.floor(F.when(finite, v).otherwise(0.0) * 1000 + 0.5).cast("long")
    size = F.abs(thousandths)
    whole, part = F.floor(size / 1000).cast("long").cast("string"), F.lpad((size % 1000).cast("string"), 3, "0")
    text = F.regexp_replace(F.regexp_replace(F.concat(whole, F.lit("."), part), "0+$", ""), r"\.$", "")
    return F.concat(F.when(thousandths < 0, "-").otherwise(""), text)


def svg_paths(paths: DataFrame, by: list[str]) -> DataFrame:
    """Path data of each path: a move, then lines; a dot is a line of next to no length."""
    point = F.concat(F.when(F.col("seq") == 0, "M").otherwise("L"), svg_number(F.col("x")), F.lit(" "), svg_number(F.col("y")))
    g = paths.select(*by, "path_id", "seq", point.alias("t")).groupBy(*by, "path_id").agg(F.array_sort(F.collect_list(F.struct("seq", "t"))).alias("s"))
    text = F.array_join(F.transform("s", lambda p: p["t"]), " ")
    return g.select(*by, "path_id", F.when(F.size("s") == 1, F.concat(text, F.lit(" l0.001 0"))).otherwise(text).alias("d"))


def svg_lines(paths: DataFrame, by: str, width: float, height: float, pen: float) -> DataFrame:
    """(layer, line, text): the lines of each layer's SVG drawing in millimetres, one for each path between a head and a
    foot, so that a drawing of any size is rows to be written in order and never one string."""
    order = Window.partitionBy(by).orderBy("path_id")
    line = lambda n, t: F.struct(n.cast("long").alias("line"), t.alias("text"))
    body = svg_paths(paths, [by]).select(by, (F.row_number().over(order) + 1).alias("n"), F.lead(F.lit(1)).over(order).isNull().alias("end"), F.concat(F.lit('<path d="'), "d", F.lit('"/>')).alias("text"))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}mm" height="{height:g}mm" viewBox="0 0 {width:g} {height:g}">'
    group = f'<g fill="none" stroke="#000" stroke-linecap="round" stroke-linejoin="round" stroke-width="{pen:g}">'
    own, n = F.array(line(F.col("n"), F.col("text"))), F.col("n")
    # The first path brings the head, the last one the foot, so that paths are gathered once.
    with_head = F.when(n == 2, F.concat(F.array(line(F.lit(0), F.lit(head)), line(F.lit(1), F.lit(group))), own)).otherwise(own)
    lines = F.when(F.col("end"), F.concat(with_head, F.array(line(n + 1, F.lit("</g>")), line(n + 2, F.lit("</svg>"))))).otherwise(with_head)
    return body.select(by, F.explode_outer(lines).alias("e")).select(by, "e.line", "e.text")


def _area_kept(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Visvalingam's order by a heap: the point whose triangle with its neighbours is smallest goes first."""
    import heapq

    n = len(x)
    before, after = np.arange(n) - 1, np.arange(n) + 1
    area = np.full(n, np.inf)
    size = lambda i: abs((x[before[i]] - x[i]) * (y[after[i]] - y[i]) - (x[after[i]] - x[i]) * (y[before[i]] - y[i])) / 2
    heap = []
    for i in range(1, n - 1):
        area[i] = size(i)
        heap.append((area[i], i))
    heapq.heapify(heap)
    kept = np.ones(n, bool)
    while heap:
        a, i = heapq.heappop(heap)
        if not kept[i] or a != area[i]:
            continue
        if a >= least:
            break
        kept[i] = False
        p, q = before[i], after[i]
        after[p], before[q] = q, p
        for j in (p, q):
            if 0 < j < n - 1:
                area[j] = max(size(j), a)
                heapq.heappush(heap, (area[j], j))
    return kept


def simplified(paths: DataFrame, scale: float) -> DataFrame:
    """Each path without the points whose triangles are smaller than ``scale`` squared, smallest first."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        kept = pdf[_area_kept(pdf["x"].to_numpy(), pdf["y"].to_numpy(), scale * scale)].copy()
        kept["seq"] = range(len(kept))
        return kept

    return paths.select("path_id", "seq", "x", "y").groupBy("path_id").applyInPandas(solve, "path_id long, seq int, x double, y double")
