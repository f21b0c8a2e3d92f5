"""The flagship: a raster hatched by parallel strokes, rendered, and held against its target's tone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import geometry, raster, render
from plumbline.plans import sql
from plumbline.plans.sql import q
from plumbline.sources import rasters
from plumbline.sources.rasters import LI_H, LI_W

PEN, LEVELS, ANGLE, SAMPLE, BANDS = 1.5, 8, math.radians(26.0), 4, 10


class Layout:
    """The candidate lines of a page of ``w`` by ``h`` pixels: they depend on its corners alone."""

    def __init__(self, w: int, h: int, pen: float = PEN, angle: float = ANGLE):
        self.w, self.h, self.pen = w, h, pen
        self.c, self.s = math.cos(angle), math.sin(angle)
        self.xm, self.ym = (w + 1) / 2, (h + 1) / 2
        corners = [(x - self.xm, y - self.ym) for x in (1, w) for y in (1, h)]
        across, along = [self.c * x - self.s * y for x, y in corners], [self.s * x + self.c * y for x, y in corners]
        self.lines = max(1, math.floor((max(across) - min(across)) / pen + 1.5))
        self.first = (max(across) + min(across)) / 2 - (self.lines - 1) / 2 * pen
        self.low, self.step = min(along) - 2 * pen, 2 * pen
        self.samples = int((max(along) + 2 * pen - self.low) / self.step) + 1
        self.page = [(1.0, 1.0), (float(w), 1.0), (float(w), float(h)), (1.0, float(h))]

    def place(self, i: Column, j: Column) -> tuple[Column, Column]:
        """Pixel coordinates, from 1 on, of sample ``j`` of line ``i``."""
        a, b = self.first + i * self.pen, self.low + j * self.step
        return self.c * a + self.s * b + self.xm, self.c * b - self.s * a + self.ym


def hatched(target: DataFrame, layout: Layout, levels: int = LEVELS) -> DataFrame:
    """(img, seg_id, part, x1, y1, x2, y2): strokes that reproduce the target's tone.

    Each line has a threshold, in bit-reversed order; it is drawn where the smoothed target's level is above it. Samples
    of a line ask the raster for their four pixels in one equi-join, and runs are islands of a window along the line.
    """
    spark = target.sparkSession
    size = max(3, math.floor(layout.pen * levels / 3 + 0.5))
    smooth = raster.blur(target, size, size / 2)
    level = smooth.select("img", "ix", "iy", F.floor((1 - F.col("v").cast("double")) * levels + 0.5).alias("level"))
    n = layout.samples
    at = spark.range(layout.lines * n).select(F.floor(F.col("id") / n).cast("int").alias("line"), (F.col("id") % n).cast("int").alias("j"))
    x, y = layout.place(F.col("line"), F.col("j"))
    # A sample counts as on the page if it, or one of the eight around it, is.
    near = F.lit(False)
    for di in (-1, 0, 1):
        for dj in (-1, 0, 1):
            i, j = F.col("line") + di, F.col("j") + dj
            nx, ny = layout.place(i, j)
            near = near | ((i >= 0) & (i < layout.lines) & (j >= 0) & (j < n) & (nx >= 1) & (nx <= layout.w) & (ny >= 1) & (ny <= layout.h))
    at = at.where(near).select("line", "j", (x - 1).alias("fx"), (y - 1).alias("fy"))
    at = at.where((F.col("fx") >= 0) & (F.col("fx") <= layout.w - 1) & (F.col("fy") >= 0) & (F.col("fy") <= layout.h - 1))
    x0, y0 = (F.greatest(F.lit(0), F.least(F.lit(m - 2), F.floor(c))).cast("int") for c, m in (("fx", layout.w), ("fy", layout.h)))
    tx, ty = F.col("fx") - x0, F.col("fy") - y0
    corner = lambda dx, dy: F.struct((x0 + dx).alias("ix"), (y0 + dy).alias("iy"), ((tx if dx else 1 - tx) * (ty if dy else 1 - ty)).alias("k"))
    asked = at.select("line", "j", F.explode(F.array(*[corner(dx, dy) for dx in (0, 1) for dy in (0, 1)])).alias("c")).select("line", "j", "c.*")
    bits = (levels - 1).bit_length()
    shown = asked.join(level, ["ix", "iy"]).groupBy("img", "line", "j").agg(F.sum(F.col("k") * F.col("level")).alias("level"))
    on = shown.where(F.col("level") > S.reversed_bits(F.col("line") % levels, bits) + 1e-9).select("img", "line", "j")
    order = Window.partitionBy("img", "line").orderBy("j")
    new = F.coalesce((F.lag("j").over(order) != F.col("j") - 1).cast("int"), F.lit(1))
    runs = on.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("img", "line", "run").agg(F.greatest(F.lit(0), F.min("j") - 1).alias("a"), F.max("j").alias("b")).where("a < b")
    (ax, ay), (bx, by) = layout.place(F.col("line"), F.col("a")), layout.place(F.col("line"), F.col("b"))
    strokes = runs.select(F.struct("img", "line", "run").alias("seg_id"), ax.alias("x1"), ay.alias("y1"), bx.alias("x2"), by.alias("y2"))
    return geometry.clipped(strokes, layout.page).select("seg_id.img", "seg_id.line", "seg_id.run", "part", "x1", "y1", "x2", "y2")


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = hatched(rasters.lineitem_raster(spark, sf_dir), Layout(LI_W, LI_H))
    return s.select("img", "line", F.col("run").cast("long").alias("run"), F.col("part").cast("long").alias("part"), *[S.quantised(F.col(c), 1e3).alias(c) for c in ("x1", "y1", "x2", "y2")])


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    target = rasters.lineitem_raster(spark, sf_dir)
    return target, render.rendered(hatched(target, Layout(LI_W, LI_H)), target, LI_W, LI_H, PEN, SAMPLE)


def rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir)[1].select("img", "ix", "iy", S.quantised(F.col("v"), 1e4).alias("v"))


def tone_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, drawn = _drawn(spark, sf_dir)
    b = render.bands(target, drawn, LI_W, BANDS)
    return b.select("img", "band", S.quantised(F.col("target"), 1e4).alias("target"), S.quantised(F.col("rendered"), 1e4).alias("rendered"))


def tone_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, drawn = _drawn(spark, sf_dir)
    e = render.tone_error(drawn, target, PEN)
    return e.select("img", *[S.quantised(F.col(c), 1e4).alias(c) for c in ("rms", "most", "clipped")])


def _sql() -> str:
    g = Layout(LI_W, LI_H)
    size = max(3, math.floor(PEN * LEVELS / 3 + 0.5))
    bits = (LEVELS - 1).bit_length()
    threshold = " + ".join(f"((line % {LEVELS}) >> {b} & 1) * {2 ** (bits - 1 - b)}" for b in range(bits))
    x = lambda i, j: f"({g.c!r}::DOUBLE * ({g.first!r}::DOUBLE + {i} * {g.pen}) + {g.s!r}::DOUBLE * ({g.low!r}::DOUBLE + {j} * {g.step}) + {g.xm})"
    y = lambda i, j: f"({g.c!r}::DOUBLE * ({g.low!r}::DOUBLE + {j} * {g.step}) - {g.s!r}::DOUBLE * ({g.first!r}::DOUBLE + {i} * {g.pen}) + {g.ym})"
    return f"""{sql.LI}, {sql.blur("sm", "li", size, size / 2, LI_W, LI_H)},
lev AS (SELECT img, ix, iy, floor((1 - v::DOUBLE) * {LEVELS} + 0.5) AS level FROM sm),
smp AS (SELECT a.i::INT AS line, b.j::INT AS j, {x("a.i", "b.j")} - 1 AS fx, {y("a.i", "b.j")} - 1 AS fy FROM range({g.lines}) a(i), range({g.samples}) b(j)),
inp AS (SELECT *, fx BETWEEN 0 AND {LI_W - 1} AND fy BETWEEN 0 AND {LI_H - 1} AS ok FROM smp),
cor AS (SELECT line, j, fx, fy, greatest(0, least({LI_W - 2}, floor(fx))) AS x0, greatest(0, least({LI_H - 2}, floor(fy))) AS y0 FROM inp WHERE ok),
sho AS (SELECT img, line, j, sum(level * (CASE WHEN ix = x0 THEN 1 - (fx - x0) ELSE fx - x0 END) * (CASE WHEN iy = y0 THEN 1 - (fy - y0) ELSE fy - y0 END)) AS level
 FROM cor JOIN lev ON ix BETWEEN x0 AND x0 + 1 AND iy BETWEEN y0 AND y0 + 1 GROUP BY ALL),
on_ AS (SELECT img, line, j, j - row_number() OVER (PARTITION BY img, line ORDER BY j) AS island FROM sho WHERE level > {threshold} + 1e-9),
run AS (SELECT img, line, row_number() OVER (PARTITION BY img, line ORDER BY min(j)) AS run, greatest(0, min(j) - 1) AS a, max(j) AS b FROM on_ GROUP BY img, line, island),
seg AS (SELECT {{'img': img, 'line': line, 'run': run}} AS seg_id, {x("line", "a")} AS x1, {y("line", "a")} AS y1, {x("line", "b")} AS x2, {y("line", "b")} AS y2 FROM run WHERE a < b),
{_crossings_sql(g.page)},
stk AS (SELECT seg_id.img AS img, seg_id.line AS line, seg_id.run AS run, row_number() OVER (PARTITION BY seg_id ORDER BY a) - 1 AS part, ax AS x1, ay AS y1, bx AS x2, b_y AS y2
 FROM line WHERE {sql.inside("((ax + bx) / 2)", "((ay + b_y) / 2)", g.page)}),
sub AS (SELECT img, (x1 - 1) * {SAMPLE} AS x1, (y1 - 1) * {SAMPLE} AS y1, (x2 - 1) * {SAMPLE} AS x2, (y2 - 1) * {SAMPLE} AS y2 FROM stk),
tst AS (SELECT img, px, py, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0) AS t
 FROM sub, range({LI_W * SAMPLE}) p(px), range({LI_H * SAMPLE}) r(py)
 WHERE px BETWEEN least(x1, x2) - {PEN * SAMPLE / 2} AND greatest(x1, x2) + {PEN * SAMPLE / 2} AND py BETWEEN least(y1, y2) - {PEN * SAMPLE / 2} AND greatest(y1, y2) + {PEN * SAMPLE / 2}),
ink AS (SELECT DISTINCT img, px, py FROM tst WHERE pow(px - x1 - greatest(0, least(1, coalesce(t, 0))) * dx, 2) + pow(py - y1 - greatest(0, least(1, coalesce(t, 0))) * dy, 2) < {(PEN * SAMPLE / 2) ** 2}),
drw AS (SELECT li.img, li.ix, li.iy, (1 - count(ink.px) / {SAMPLE * SAMPLE}.0::DOUBLE)::FLOAT AS v FROM li LEFT JOIN ink ON ink.img = li.img AND ink.px // {SAMPLE} = li.ix AND ink.py // {SAMPLE} = li.iy GROUP BY ALL)"""


def _crossings_sql(page: list[tuple[float, float]]) -> str:
    from plumbline.plans.strokes import _crossings

    return _crossings(page)


_BASE = _sql()
STROKES_SQL = f"WITH {_BASE} SELECT img, line, run, part, {q('x1', '1e3')} AS x1, {q('y1', '1e3')} AS y1, {q('x2', '1e3')} AS x2, {q('y2', '1e3')} AS y2 FROM stk"
RENDER_SQL = f"WITH {_BASE} SELECT img, ix, iy, {q('v', '1e4')} AS v FROM drw"
BANDS_SQL = f"""WITH {_BASE} SELECT img, least({BANDS - 1}, ix * {BANDS} // {LI_W})::INT AS band, {q("avg(li.v::DOUBLE)", "1e4")} AS target, {q("avg(drw.v::DOUBLE)", "1e4")} AS rendered
FROM li JOIN drw USING (img, ix, iy) GROUP BY ALL"""
ERROR_SQL = f"""WITH {_BASE}, {sql.blur("ba", "drw", 5, 5 / 3, LI_W, LI_H)}, {sql.blur("bb", "li", 5, 5 / 3, LI_W, LI_H)},
e AS (SELECT img, ba.v::DOUBLE - bb.v::DOUBLE AS e FROM ba JOIN bb USING (img, ix, iy))
SELECT img, {q("sqrt(avg(e * e))", "1e4")} AS rms, {q("max(abs(e))", "1e4")} AS most, {q("avg(CASE WHEN abs(e) > 0.15 THEN 1 ELSE 0 END)", "1e4")} AS clipped FROM e GROUP BY img"""


QUERIES = {
    "hatching_strokes_li": (strokes, STROKES_SQL),
    "render_strokes_li": (rendering, RENDER_SQL),
    "tone_bands_hatching": (tone_bands, BANDS_SQL),
    "tone_error_hatching": (tone_error, ERROR_SQL),
}
