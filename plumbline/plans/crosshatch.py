"""Crosshatching: layers of parallel strokes at different angles, each over what is darker than its rung of a ladder."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import maps as L
from plumbline.functions import scalar as S
from plumbline.operators import geometry, raster, render
from plumbline.plans import hatching, sql
from plumbline.plans.fields import PAGE, _fold
from plumbline.plans.sql import q
from plumbline.sources import rasters
from plumbline.sources.rasters import LI_H, LI_W

PEN, LEVELS, DARKEST, STEP, HALVINGS = 1.5, 5, 0.95, 0.5, 8


class Layers:
    """Angle, phase and reach of each layer: they depend on the page and the number of levels alone."""

    def __init__(self, w: int, h: int, pen: float = PEN, levels: int = LEVELS, darkest: float = DARKEST):
        self.w, self.h, self.pen, self.levels, self.darkest = w, h, pen, levels, darkest
        self.gap = pen / (1 - (1 - darkest) ** (1 / levels))
        self.size = max(3, math.floor(pen / 2 + 0.5) * 2 + 1)
        self.rows = []
        for i, t in enumerate(L.most_orthogonal([math.pi * k / levels for k in range(levels)])):
            c, s = math.cos(t), math.sin(t)
            along = [c * y - s * x for x in (1, w) for y in (1, h)]
            n = math.floor((max(along) - min(along)) / STEP + 1e-9) + 1
            self.rows.append((i + 1, c, s, (1 if levels == 1 else i / (levels - 1)) * self.gap, min(along), max(along), n))


def leveled(target: DataFrame, layers: Layers, page: list[tuple[float, float]]) -> DataFrame:
    """(img, ix, iy, level): the rung of each pixel's median, none outside the page."""
    smooth = geometry.whitened(raster.median(target, layers.size, layers.w, layers.h), page)
    return smooth.select("img", "ix", "iy", L.rung_of(F.col("v").cast("double"), layers.levels, layers.darkest).alias("level"))


def _at(u: Column) -> tuple[Column, Column]:
    """Pixel coordinates, from 1 on, of the place ``u`` along a line."""
    return F.col("p") * F.col("c") - F.col("s") * u, F.col("p") * F.col("s") + F.col("c") * u


def _cell(x: Column) -> Column:
    return (S.half_up(x) - 1).cast("int")


def crosshatched(target: DataFrame, layers: Layers, page: list[tuple[float, float]]) -> DataFrame:
    """(img, layer, line, run, x1, y1, x2, y2): strokes over the pixels of each layer's level or darker.

    Samples of a line ask for their pixel in one equi-join and runs are islands along the line. A run's ends are halved
    down to a fraction of a step: within a step a line passes no more than two more pixels, which the two ends ask for in
    one join each, so that the halving is arithmetic within a row.
    """
    level = leveled(target, layers, page)
    lay = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("layer", "c", "s", "phase", "lo", "hi", "n"), row, strict=True)]) for row in layers.rows])
    dark = level.where("level > 0").select("img", "ix", "iy", F.explode(F.filter(lay, lambda e: e["layer"] <= F.col("level"))).alias("e")).select("img", "ix", "iy", "e.*")
    f = (F.col("ix") + 1) * F.col("c") + (F.col("iy") + 1) * F.col("s") + F.col("phase")
    reach = dark.groupBy("img", "layer", "c", "s", "phase", "lo", "hi", "n").agg(F.min(f).alias("least"), F.max(f).alias("most"))
    first = F.floor(F.col("least") / layers.gap) * layers.gap + layers.gap / 2
    line = reach.withColumn("first", first).where("first <= most").withColumn("line", F.explode(F.sequence(F.lit(0), F.floor((F.col("most") - F.col("first")) / layers.gap).cast("int"))))
    line = line.select("img", "layer", "line", "c", "s", "lo", "hi", "n", (F.col("first") + F.col("line") * layers.gap - F.col("phase")).alias("p"))
    x, y = _at(F.col("lo") + F.col("j") * STEP)
    sample = line.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumns({"ix": _cell(x), "iy": _cell(y)})
    on = sample.join(level, ["img", "ix", "iy"]).where("level >= layer")
    key = ["img", "layer", "line"]
    island = F.col("j") - F.row_number().over(Window.partitionBy(*key).orderBy("j"))
    run = on.withColumn("island", island).groupBy(*key, "c", "s", "p", "lo", "hi", "n", "island").agg(F.min("j").alias("a"), F.max("j").alias("b"))
    ends = F.array(F.struct(F.lit(0).alias("end"), F.col("a").alias("on"), (F.col("a") - 1).alias("off")), F.struct(F.lit(1).alias("end"), F.col("b").alias("on"), (F.col("b") + 1).alias("off")))
    e = run.select("*", F.explode(ends).alias("e")).select(*key, "island", "c", "s", "p", "lo", "hi", "n", "e.*")
    place = lambda c: F.col("lo") + F.col(c) * STEP
    e = e.withColumns({f"{n}_{c}": _cell(v) for c in ("on", "off") for n, v in zip(("ix", "iy"), _at(place(c)), strict=True)})
    for name, (i, j) in {"in_x": ("on", "off"), "in_y": ("off", "on")}.items():
        there = level.select("img", F.col("ix").alias(f"ix_{i}"), F.col("iy").alias(f"iy_{j}"), F.col("level").alias(name))
        e = e.join(there, ["img", f"ix_{i}", f"iy_{j}"], "left")

    def halve(s: Column, _: Column) -> Column:
        m = (s["a"] + s["b"]) / 2
        mx, my = _at(m)
        same_x, same_y = _cell(mx) == F.col("ix_on"), _cell(my) == F.col("iy_on")
        dark = F.when(same_x & same_y, True).when(same_x, F.coalesce(F.col("in_x") >= F.col("layer"), F.lit(False))).when(same_y, F.coalesce(F.col("in_y") >= F.col("layer"), F.lit(False))).otherwise(False)
        return F.struct(F.when(dark, s["a"]).otherwise(m).alias("a"), F.when(dark, m).otherwise(s["b"]).alias("b"))

    start = F.struct(place("off").alias("a"), place("on").alias("b"))
    halved = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: s["b"])
    u = F.when(F.col("off") < 0, F.col("lo")).when(F.col("off") >= F.col("n"), F.col("hi")).otherwise(halved)
    e = e.withColumn("u", u)
    (px, py), at = _at(F.col("u")), F.struct("x", "y")
    stroke = e.withColumns({"x": px, "y": py}).groupBy(*key, "island").agg(F.max(F.when(F.col("end") == 0, at)).alias("a"), F.max(F.when(F.col("end") == 1, at)).alias("b"))
    stroke = stroke.select(*key, "island", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    number = F.row_number().over(Window.partitionBy(*key).orderBy("island"))
    return stroke.where(dx * dx + dy * dy > layers.pen * layers.pen).withColumn("run", number).drop("island")


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = crosshatched(rasters.lineitem_raster(spark, sf_dir), Layers(LI_W, LI_H), PAGE)
    return s.select("img", "layer", "line", "run", *[S.quantised(F.col(c), 1e3).alias(c) for c in ("x1", "y1", "x2", "y2")])


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the staircase that crosshatching aims at, and of the drawing, in each upright band."""
    target, layers = rasters.lineitem_raster(spark, sf_dir), Layers(LI_W, LI_H)
    ladder = F.array(*[F.lit(1 - r) for r in L.rungs(LEVELS, DARKEST)])
    aim = leveled(target, layers, PAGE).select("img", "ix", "iy", F.element_at(ladder, F.col("level") + 1).alias("v"))
    drawn = render.rendered(crosshatched(target, layers, PAGE), target, LI_W, LI_H, PEN, hatching.SAMPLE)
    b = render.bands(aim, drawn, LI_W, hatching.BANDS)
    return b.select("img", "band", S.quantised(F.col("target"), 1e4).alias("target"), S.quantised(F.col("rendered"), 1e4).alias("rendered"))


def _sql() -> str:
    g = Layers(LI_W, LI_H)
    half = g.size // 2
    ladder = L.rungs(LEVELS, DARKEST)
    k = f"greatest(0, least({DARKEST}, (1 - v) * {DARKEST}::DOUBLE))"
    rung = " ".join(f"WHEN k < {ladder[i + 1]!r}::DOUBLE THEN {i} + (k - {ladder[i]!r}::DOUBLE) / {ladder[i + 1] - ladder[i]!r}::DOUBLE" for i in range(LEVELS))
    lay = ", ".join(f"({i}, {c!r}::DOUBLE, {s!r}::DOUBLE, {ph!r}::DOUBLE, {lo!r}::DOUBLE, {hi!r}::DOUBLE, {n})" for i, c, s, ph, lo, hi, n in g.rows)
    x, y = (lambda u: f"(p * c - s * {u})"), (lambda u: f"(p * s + c * {u})")
    return f"""{sql.LI}, nb AS (SELECT p.img, p.ix, p.iy, n.v FROM li p, range({-half}, {half + 1}) dx(a), range({-half}, {half + 1}) dy(b), li n
 WHERE n.img = p.img AND n.ix = {_fold("p.ix + a", LI_W)} AND n.iy = {_fold("p.iy + b", LI_H)}),
med AS (SELECT img, ix, iy, list_sort(list(v))[{g.size * g.size // 2 + 1}] AS v FROM nb GROUP BY ALL),
lev AS (SELECT img, ix, iy, floor(CASE {rung} ELSE {LEVELS} END + 0.5)::INT AS level FROM (SELECT img, ix, iy, {k} AS k FROM med)),
lay(layer, c, s, phase, lo, hi, n) AS (VALUES {lay}),
ext AS (SELECT img, layer, c, s, phase, lo, hi, n, min((ix + 1) * c + (iy + 1) * s + phase) AS least_, max((ix + 1) * c + (iy + 1) * s + phase) AS most_ FROM lev JOIN lay ON layer <= level GROUP BY ALL),
fst AS (SELECT *, floor(least_ / {g.gap!r}::DOUBLE) * {g.gap!r}::DOUBLE + {g.gap / 2!r}::DOUBLE AS first_ FROM ext),
ln AS (SELECT img, layer, r.k::INT AS line, c, s, lo, hi, n, first_ + r.k * {g.gap!r}::DOUBLE - phase AS p FROM fst, range(1000) r(k) WHERE first_ <= most_ AND r.k <= floor((most_ - first_) / {g.gap!r}::DOUBLE)),
smp AS (SELECT ln.*, r.j, lo + r.j * {STEP} AS u FROM ln, range(1000) r(j) WHERE r.j < n),
on_ AS (SELECT smp.*, j - row_number() OVER (PARTITION BY smp.img, layer, line ORDER BY j) AS island FROM smp JOIN lev l ON l.img = smp.img AND l.ix = floor({x("u")} + 0.5) - 1 AND l.iy = floor({y("u")} + 0.5) - 1 WHERE l.level >= layer),
rn AS (SELECT img, layer, line, c, s, p, lo, hi, n, island, min(j) AS ja, max(j) AS jb FROM on_ GROUP BY ALL),
bis AS (SELECT 0 AS i, img, layer, line, c, s, p, lo, hi, n, island, e.e AS e, CASE WHEN e.e = 0 THEN ja - 1 ELSE jb + 1 END AS off, lo + (CASE WHEN e.e = 0 THEN ja - 1 ELSE jb + 1 END) * {STEP} AS a, lo + (CASE WHEN e.e = 0 THEN ja ELSE jb END) * {STEP} AS b FROM rn, (VALUES (0), (1)) e(e)
 UNION ALL SELECT i + 1, t.img, t.layer, line, c, s, p, lo, hi, n, island, e, off, CASE WHEN l.level >= t.layer THEN a ELSE (a + b) / 2 END, CASE WHEN l.level >= t.layer THEN (a + b) / 2 ELSE b END
 FROM bis t LEFT JOIN lev l ON l.img = t.img AND l.ix = floor({x("((a + b) / 2)")} + 0.5) - 1 AND l.iy = floor({y("((a + b) / 2)")} + 0.5) - 1 WHERE i < {HALVINGS}),
fin AS (SELECT *, CASE WHEN off < 0 THEN lo WHEN off >= n THEN hi ELSE b END AS u FROM bis WHERE i = {HALVINGS}),
seg AS (SELECT img, layer, line, island, max(CASE WHEN e = 0 THEN {x("u")} END) AS x1, max(CASE WHEN e = 0 THEN {y("u")} END) AS y1, max(CASE WHEN e = 1 THEN {x("u")} END) AS x2, max(CASE WHEN e = 1 THEN {y("u")} END) AS y2 FROM fin GROUP BY ALL),
stk AS (SELECT *, row_number() OVER (PARTITION BY img, layer, line ORDER BY island)::INT AS run FROM seg WHERE (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) > {PEN * PEN})"""


_BASE = _sql()
_DRAWN = hatching._BASE[hatching._BASE.index("sub AS (") :]
STROKES_SQL = f"WITH RECURSIVE {_BASE} SELECT img, layer, line, run, {q('x1', '1e3')} AS x1, {q('y1', '1e3')} AS y1, {q('x2', '1e3')} AS x2, {q('y2', '1e3')} AS y2 FROM stk"
BANDS_SQL = f"""WITH RECURSIVE {_BASE}, {_DRAWN}
SELECT lev.img, least({hatching.BANDS - 1}, ix * {hatching.BANDS} // {LI_W})::INT AS band, {q(f"avg([{', '.join(f'{1 - r!r}::DOUBLE' for r in L.rungs(LEVELS, DARKEST))}][level + 1])", "1e4")} AS target, {q("avg(drw.v::DOUBLE)", "1e4")} AS rendered
FROM lev JOIN drw USING (img, ix, iy) GROUP BY ALL"""

QUERIES = {"crosshatch_strokes_li": (strokes, STROKES_SQL), "crosshatch_bands_li": (bands, BANDS_SQL)}
