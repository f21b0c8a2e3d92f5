"""Queries over cells and pieces of the page: Voronoi cells of each label's vectors, and pages cut up by their ink."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import geometry, relax, subdivision, voronoi
from plumbline.plans import sql
from plumbline.plans.fields import PAGE, _diff
from plumbline.plans.parts import UNEVEN
from plumbline.plans.sql import q
from plumbline.sources import rasters
from plumbline.sources.rasters import LI_H, LI_W


def labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = rasters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), "label")
    return rasters.embedding_points(spark, sf_dir).join(labels, "pid")


def voronoi_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and centroid of each vector's cell among those of its label; the cells of a label make up the page."""
    made = voronoi.cells(labelled_points(spark, sf_dir), ["label"], PAGE)
    m = geometry.ring_measures(made.drop("x", "y"))
    return m.select("label", "pid", *[S.quantised(F.col(c), 1e3).alias(c) for c in ("area", "cx", "cy")])


_SIDE = "(x - sx) * (2 * p.x - x - sx) + (y - sy) * (2 * p.y - y - sy)"
_RING = ", ".join(f"{{'x': {x}::DOUBLE, 'y': {y}::DOUBLE}}" for x, y in PAGE)
#: Every other seed of the label cuts, in order of distance.
VORONOI_SQL = f"""WITH RECURSIVE {sql.EMB}, one AS (SELECT label, x, y, min(pid) AS pid FROM emb JOIN embeddings ON vec_id = pid GROUP BY ALL),
cut AS (SELECT a.label, a.pid, b.x AS sx, b.y AS sy, row_number() OVER (PARTITION BY a.label, a.pid ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.pid) AS k
 FROM one a JOIN one b ON a.label = b.label AND a.pid <> b.pid),
cell AS (SELECT label, pid, x, y, 0::BIGINT AS k, [{_RING}] AS ring FROM one
 UNION ALL SELECT label, pid, x, y, k, list_filter(flatten(list_transform(range(1, len(ring) + 1), lambda i: [
   CASE WHEN s[i] >= 0 THEN ring[i] END,
   CASE WHEN (s[i] >= 0) <> (s[i % len(ring) + 1] >= 0) THEN {{'x': ring[i].x + s[i] / (s[i] - s[i % len(ring) + 1]) * (ring[i % len(ring) + 1].x - ring[i].x),
     'y': ring[i].y + s[i] / (s[i] - s[i % len(ring) + 1]) * (ring[i % len(ring) + 1].y - ring[i].y)}} END])), lambda p: p IS NOT NULL)
  FROM (SELECT c.label, c.pid, c.x, c.y, cut.k, c.ring, list_transform(c.ring, lambda p: {_SIDE}) AS s FROM cell c JOIN cut ON cut.label = c.label AND cut.pid = c.pid AND cut.k = c.k + 1)),
last AS (SELECT label, pid, arg_max(ring, k) AS ring FROM cell GROUP BY ALL),
e AS (SELECT label, pid, unnest(list_transform(range(1, len(ring) + 1), lambda i: {{'x': ring[i].x, 'y': ring[i].y, 'u': ring[i % len(ring) + 1].x, 'v': ring[i % len(ring) + 1].y}})) AS e FROM last),
t AS (SELECT label, pid, sum(e.x * e.v - e.u * e.y) AS c, sum((e.x + e.u) * (e.x * e.v - e.u * e.y)) AS mx, sum((e.y + e.v) * (e.x * e.v - e.u * e.y)) AS my FROM e GROUP BY ALL)
SELECT label, pid, {q("abs(c) / 2", "1e3")} AS area, {q("mx / (3 * c)", "1e3")} AS cx, {q("my / (3 * c)", "1e3")} AS cy FROM t"""


#: Pen of the drawings that are cut up, and their page: every pixel is whole in it.
PEN, CUT_PAGE = 0.8, [(0.5, 0.5), (LI_W + 0.5, 0.5), (LI_W + 0.5, LI_H + 0.5), (0.5, LI_H + 0.5)]


def _cut_up(spark: SparkSession, sf_dir: str, rounds: int = subdivision.ROUNDS) -> tuple[DataFrame, DataFrame]:
    return subdivision.cut_up(rasters.supplier_raster(spark, sf_dir), CUT_PAGE, PEN, LI_W, rounds)


def first_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut that halves each supplier's whole page, where one is called for."""
    made = subdivision.first_cuts(rasters.supplier_raster(spark, sf_dir), CUT_PAGE, PEN, LI_W)
    return made.select("img", *[S.quantised(F.col(c), 1e2).alias(c) for c in ("x1", "y1", "x2", "y2")])


def cut_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must come out even for each image: one piece more than cuts, and the page's area, pixels and ink in the pieces."""
    cuts, pieces = _cut_up(spark, sf_dir)
    n = cuts.groupBy("img").agg(F.count("*").alias("cuts"))
    p = pieces.groupBy("img").agg(F.count("*").alias("pieces"), F.sum("area").alias("area"), F.sum("n").alias("pixels"), F.sum("dark").alias("dark"))
    both = p.join(n, "img", "left")
    return both.select("img", (F.col("pieces") - F.coalesce("cuts", F.lit(0))).alias("more"), S.quantised(F.col("area"), 1e4).alias("area"), "pixels", S.quantised(F.col("dark"), 1e4).alias("dark"))


def _first_sql() -> str:
    g, t = max(1.0, PEN), max(1.5, 2 * PEN)
    size, sizes = max(3, math.floor(3 * g + 0.5)), max(3, math.floor(3 * t + 0.5))
    parts = ", ".join(sql.blur(f"b{n}", f"p{n}", sizes, t, LI_W, LI_H) for n in ("11", "12", "22"))
    ring = ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE, {u}::DOUBLE, {v}::DOUBLE)" for i, ((x, y), (u, v)) in enumerate(zip(CUT_PAGE, CUT_PAGE[1:] + CUT_PAGE[:1], strict=True)))
    around = sum(math.dist(p, r) for p, r in zip(CUT_PAGE, CUT_PAGE[1:] + CUT_PAGE[:1], strict=True))
    n = subdivision.SWEEP
    return f"""{sql.SUPPLIER_LI}, {sql.blur("s", "li", size, max(0.5, g), LI_W, LI_H)},
g AS (SELECT img, ix, iy, {_diff("ix", "iy")} AS gx, {_diff("iy", "ix")} AS gy FROM s),
p11 AS (SELECT img, ix, iy, (gx * gx)::FLOAT AS v FROM g), p12 AS (SELECT img, ix, iy, (gx * gy)::FLOAT AS v FROM g), p22 AS (SELECT img, ix, iy, (gy * gy)::FLOAT AS v FROM g), {parts},
px AS MATERIALIZED (SELECT img, ix + 1 + (iy * {LI_W} + ix)::BIGINT * 2654435761 % 1000 / 1000 * {subdivision.OFF_GRID!r}::DOUBLE AS x, iy + 1::DOUBLE AS y, 1 - li.v AS k,
  atan2(2 * b12.v::DOUBLE, b11.v::DOUBLE - b22.v::DOUBLE) / 2 + pi() / 2 AS th FROM li JOIN b11 USING (img, ix, iy) JOIN b12 USING (img, ix, iy) JOIN b22 USING (img, ix, iy)),
st AS (SELECT img, sum(k) AS dark, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS axis, atan2(sum(sin(2 * th)), sum(cos(2 * th))) / 2 AS m FROM px GROUP BY img),
tt AS (SELECT img, dark, CASE WHEN abs(cos(m - axis)) <= abs(cos(m + pi() / 2 - axis)) THEN m ELSE m + pi() / 2 END AS t FROM (SELECT img, dark, axis, CASE WHEN m < 0 THEN m + pi() ELSE m END AS m FROM st)
  WHERE {around!r} * {PEN / 2!r} * greatest(0.1, 1 - {len(CUT_PAGE) * PEN / around!r}::DOUBLE) <= dark),
ring(i, x, y, u, v) AS (VALUES {ring}),
sp AS (SELECT img, any_value(dark) AS dark, any_value(t) AS t, min(cos(t) * y - sin(t) * x) AS low, max(cos(t) * y - sin(t) * x) AS high FROM tt, ring GROUP BY img),
sw AS (SELECT *, low + (high - low) * s / {n + 1}::DOUBLE AS c FROM sp, range(1, {n + 1}) r(s)),
hf AS (SELECT img, s, i, cos(t) * y - sin(t) * x - c AS a, cos(t) * v - sin(t) * u - c AS b, x, y, u, v, sqrt((u - x) ^ 2 + (v - y) ^ 2) AS len, t FROM sw, ring),
cr AS (SELECT *, x + a / (a - b) * (u - x) AS cx, y + a / (a - b) * (v - y) AS cy FROM hf),
ch AS (SELECT img, s, sum(CASE WHEN a < 0 AND b < 0 THEN len WHEN a >= 0 AND b >= 0 THEN 0 WHEN a < 0 THEN len * a / (a - b) ELSE len * b / (b - a) END) AS under,
  arg_min(struct_pack(x := cx, y := cy), cos(t) * cx + sin(t) * cy) FILTER ((a < 0) <> (b < 0)) AS p, arg_max(struct_pack(x := cx, y := cy), cos(t) * cx + sin(t) * cy) FILTER ((a < 0) <> (b < 0)) AS r FROM cr GROUP BY ALL),
dk AS (SELECT sw.img, sw.s, any_value(sw.dark) AS dark, coalesce(sum(k) FILTER (cos(t) * px.y - sin(t) * px.x < c), 0) AS kb FROM sw JOIN px USING (img) GROUP BY ALL),
jd AS (SELECT img, s, p, r, dark, kb / (under + len) AS rb, (dark - kb) / ({around!r} - under + len) AS ra FROM (SELECT *, sqrt((p.x - r.x) ^ 2 + (p.y - r.y) ^ 2) AS len FROM ch) JOIN dk USING (img, s)),
bs AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY floor(abs(ra - rb) * {subdivision.EVEN!r}::DOUBLE + 0.5), s) AS o FROM jd)"""


FIRST_SQL = f"""WITH {_first_sql()} SELECT img, {q("p.x", "1e2")} AS x1, {q("p.y", "1e2")} AS y1, {q("r.x", "1e2")} AS x2, {q("r.y", "1e2")} AS y2 FROM bs
WHERE o = 1 AND abs({PEN / 2!r} - (ra + rb) / 2) <= abs({PEN / 2!r} - dark / {sum(math.dist(p, r) for p, r in zip(CUT_PAGE, CUT_PAGE[1:] + CUT_PAGE[:1], strict=True))!r})"""
BALANCE_SQL = f"""WITH {sql.SUPPLIER_LI} SELECT img, 1::BIGINT AS more, {q(str(float(LI_W * LI_H)), "1e4")} AS area, count(*) AS pixels, {q("sum(1 - v)", "1e4")} AS dark FROM li GROUP BY img"""


#: Points of an image, rounds of relaxing them, the part of the way that they go in one, and the farthest that they go.
POINTS, RELAX_ROUNDS, DAMPING, LONGEST = 12, 4, 0.5, 1.5


def relaxed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve darkest pixels of each supplier's image, moved towards the centres of ink of their cells."""
    images = rasters.supplier_raster(spark, sf_dir)
    number = F.col("iy") * LI_W + F.col("ix")
    order = Window.partitionBy("img").orderBy("v", number)
    seeds = images.withColumn("r", F.row_number().over(order)).where(F.col("r") <= POINTS)
    seeds = seeds.select("img", F.col("r").cast("long").alias("pid"), (F.col("ix") + 1.0).alias("x"), (F.col("iy") + 1.0).alias("y"))
    made = relax.relaxed(images, seeds, LI_W, LI_H, RELAX_ROUNDS, DAMPING, LONGEST)
    return made.select("img", "pid", *[S.quantised(F.col(c), UNEVEN / 10).alias(c) for c in "xy"], "rounds")


def _relax_sql() -> str:
    g = repr(relax.GRAIN)
    steps = [f"""{sql.SUPPLIER_LI}, r0 AS MATERIALIZED (SELECT img, pid, ix + 1::DOUBLE AS x, iy + 1::DOUBLE AS y, 0 AS rounds, true AS live
  FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY v, iy * {LI_W} + ix) AS pid FROM li) WHERE pid <= {POINTS})"""]
    for k in range(RELAX_ROUNDS):
        steps.append(f"""n{k} AS (SELECT img, ix, iy, m, arg_min(pid, {{'d': d, 'pid': pid}}) AS pid FROM (SELECT li.img, li.ix, li.iy, 1 - v AS m, pid, (x - ix - 1) * (x - ix - 1) + (y - iy - 1) * (y - iy - 1) AS d
  FROM li JOIN r{k} r ON r.img = li.img AND r.live WHERE v < 1) GROUP BY ALL),
c{k} AS (SELECT img, pid, sum(m * (ix + 1)) / sum(m) AS cx, sum(m * (iy + 1)) / sum(m) AS cy FROM n{k} GROUP BY ALL),
d{k} AS (SELECT r.*, coalesce((cx - x) * {DAMPING}, 0) AS dx, coalesce((cy - y) * {DAMPING}, 0) AS dy FROM r{k} r LEFT JOIN c{k} USING (img, pid)),
s{k} AS (SELECT *, sqrt(dx * dx + dy * dy) AS size, CASE WHEN sqrt(dx * dx + dy * dy) > {LONGEST} THEN {LONGEST} / sqrt(dx * dx + dy * dy) ELSE 1 END AS short FROM d{k}),
r{k + 1} AS MATERIALIZED (SELECT img, pid, CASE WHEN live THEN floor((x + dx * short) * {g}::DOUBLE + 0.5) / {g}::DOUBLE ELSE x END AS x, CASE WHEN live THEN floor((y + dy * short) * {g}::DOUBLE + 0.5) / {g}::DOUBLE ELSE y END AS y,
  rounds + live::INT AS rounds, live AND max(size * short) OVER (PARTITION BY img) >= {relax.SETTLED} AS live FROM s{k})""")
    return ", ".join(steps)


RELAX_SQL = f"WITH {_relax_sql()} SELECT img, pid, {q('x', repr(UNEVEN / 10))} AS x, {q('y', repr(UNEVEN / 10))} AS y, rounds FROM r{RELAX_ROUNDS}"


QUERIES = {
    "relaxed_points_supplier": (relaxed_points, RELAX_SQL),
    "subdivision_first_supplier": (first_cuts, FIRST_SQL),
    "subdivision_balance_supplier": (cut_balance, BALANCE_SQL),
    "voronoi_cells_emb": (voronoi_cells, VORONOI_SQL),
}
