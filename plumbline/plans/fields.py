"""Queries over raster operators: resizing, filters, orientation, box sums, look-ups, fits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import geometry, lookup, raster
from plumbline.plans import sql
from plumbline.plans.sql import q
from plumbline.sources import rasters
from plumbline.sources.rasters import EV_H, EV_W, LI_H, LI_W

TRIANGLE = [(2.0, 2.0), (40.0, 3.0), (10.0, 10.5)]
PAGE = [(1.0, 1.0), (float(LI_W), 1.0), (float(LI_W), float(LI_H)), (1.0, float(LI_H))]


def _out(df: DataFrame, scale: float = 1e4, *extra: str) -> DataFrame:
    return df.select("img", "ix", "iy", *extra, S.quantised(F.col("v"), scale).alias("v"))


def blurred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(raster.blur(rasters.lineitem_raster(spark, sf_dir), 5, 1.2))


BLUR_SQL = f"WITH {sql.LI}, {sql.blur('b', 'li', 5, 1.2, LI_W, LI_H)} SELECT img, ix, iy, {q('v', '1e4')} AS v FROM b"


def shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(raster.shrink(rasters.lineitem_raster(spark, sf_dir), LI_W, LI_H, 17, 4))


SHRINK_SQL = f"""
WITH {sql.LI}, w AS (SELECT img, X.x, Y.y, v, greatest(0, least(ix + 1, (X.x + 1) * {LI_W / 17!r}) - greatest(ix, X.x * {LI_W / 17!r}))
  * greatest(0, least(iy + 1, (Y.y + 1) * {LI_H / 4!r}) - greatest(iy, Y.y * {LI_H / 4!r})) AS k FROM li, range(17) X(x), range(4) Y(y))
SELECT img, x::INT AS ix, y::INT AS iy, {q("sum(v * k) / sum(k)", "1e4")} AS v FROM w WHERE k > 0 GROUP BY ALL"""


def grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(raster.grow(rasters.lineitem_raster(spark, sf_dir), LI_W, LI_H, 83, 29))


GROW_SQL = f"""
WITH {sql.LI}, x AS (SELECT d AS ix, greatest(0, least({LI_W - 1}, (d + 0.5) * {LI_W / 83!r}::DOUBLE - 0.5)) AS f FROM range(83) r(d)),
y AS (SELECT d AS iy, greatest(0, least({LI_H - 1}, (d + 0.5) * {LI_H / 29!r}::DOUBLE - 0.5)) AS f FROM range(29) r(d))
SELECT li.img, x.ix::INT AS ix, y.iy::INT AS iy, {q("sum(li.v * greatest(0, 1 - abs(x.f - li.ix)) * greatest(0, 1 - abs(y.f - li.iy)))", "1e4")} AS v
FROM x, y, li WHERE abs(x.f - li.ix) < 1 AND abs(y.f - li.iy) < 1 GROUP BY ALL"""


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed order of preparation: resize, smooth, clamp, tone curve."""
    smooth = raster.blur(raster.shrink(rasters.lineitem_raster(spark, sf_dir), LI_W, LI_H, 25, 11), 3, 0.5)
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v").cast("double")))
    return _out(smooth.withColumn("v", 1 - F.pow(1 - v, F.lit(1.4))))


PREPARE_SQL = f"""
WITH {sql.LI}, r AS (SELECT img, ix // 2 AS ix, iy, sum(v) / 2 AS v FROM li GROUP BY ALL), {sql.blur('b', 'r', 3, 0.5, 25, LI_H)}
SELECT img, ix, iy, {q("1 - pow(1 - greatest(0, least(1, v::DOUBLE)), 1.4)", "1e4")} AS v FROM b"""


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(raster.median(rasters.event_raster(spark, sf_dir), 3, EV_W, EV_H))


def _fold(c: str, n: int) -> str:
    return f"greatest(0, least({n - 1}, CASE WHEN {c} < 0 THEN -({c}) - 1 WHEN {c} >= {n} THEN {2 * n - 1} - ({c}) ELSE {c} END))"


MEDIAN_SQL = f"""
WITH {sql.EV}, a AS (SELECT p.img, p.ix, p.iy, n.v FROM ev p, range(-1, 2) dx(a), range(-1, 2) dy(b), ev n
 WHERE n.img = p.img AND n.ix = {_fold("p.ix + a", EV_W)} AND n.iy = {_fold("p.iy + b", EV_H)})
SELECT img, ix, iy, {q("list_sort(list(v))[5]", "1e4")} AS v FROM a GROUP BY ALL"""


def dilated(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = rasters.event_raster(spark, sf_dir).withColumn("v", (F.col("v") < 0.4).cast("int"))
    return raster.dilated(mask, EV_W, EV_H).select("img", "ix", "iy", "v")


DILATE_SQL = f"""
WITH {sql.EV} SELECT p.img, p.ix, p.iy, max(CASE WHEN n.v < 0.4 THEN 1 ELSE 0 END)::INT AS v
FROM ev p JOIN ev n ON n.img = p.img AND abs(n.ix - p.ix) <= 1 AND abs(n.iy - p.iy) <= 1 GROUP BY ALL"""


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = raster.structure_tensor(rasters.lineitem_raster(spark, sf_dir), 1.0, 1.0)
    return t.select("img", "ix", "iy", *[S.quantised(F.col(c)).alias(c) for c in ("t11", "t12", "t22")], S.quantised(F.col("coherence"), 100.0).alias("coherence"))


def _diff(axis: str, other: str) -> str:
    w = f"(PARTITION BY img, {other} ORDER BY {axis})"
    return f"(coalesce(lead(v) OVER {w}, v)::DOUBLE - coalesce(lag(v) OVER {w}, v)::DOUBLE) / 2"


_T = ", ".join(sql.blur(f"b{n}", f"p{n}", 3, 1.0, LI_W, LI_H) for n in ("11", "12", "22"))
TENSOR_SQL = f"""
WITH {sql.LI}, {sql.blur('s', 'li', 3, 1.0, LI_W, LI_H)},
g AS (SELECT img, ix, iy, {_diff("ix", "iy")} AS gx, {_diff("iy", "ix")} AS gy FROM s),
p11 AS (SELECT img, ix, iy, (gx * gx)::FLOAT AS v FROM g), p12 AS (SELECT img, ix, iy, (gx * gy)::FLOAT AS v FROM g),
p22 AS (SELECT img, ix, iy, (gy * gy)::FLOAT AS v FROM g), {_T},
t AS (SELECT img, ix, iy, b11.v::DOUBLE AS t11, b12.v::DOUBLE AS t12, b22.v::DOUBLE AS t22 FROM b11 JOIN b12 USING (img, ix, iy) JOIN b22 USING (img, ix, iy))
SELECT img, ix, iy, {q("t11")} AS t11, {q("t12")} AS t12, {q("t22")} AS t22,
 {q("sqrt((t11 - t22) * (t11 - t22) + 4 * t12 * t12) / (t11 + t22 + 1e-12)", "100")} AS coherence FROM t"""


def edge_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(raster.edge_strength(rasters.event_raster(spark, sf_dir), 1.0), 1e3)


_LAP = " + ".join(f"coalesce({f}(v) OVER (PARTITION BY img, {o} ORDER BY {a}), v)::DOUBLE" for a, o in (("ix", "iy"), ("iy", "ix")) for f in ("lead", "lag"))
EDGE_SQL = f"""
WITH {sql.EV}, {sql.blur('s', 'ev', 7, 1.0, EV_W, EV_H)}, e AS (SELECT img, ix, iy, abs({_LAP} - 4 * v::DOUBLE) AS e FROM s)
SELECT img, ix, iy, {q("CASE WHEN max(e) OVER (PARTITION BY img) > 0 THEN e / max(e) OVER (PARTITION BY img) ELSE 0 END", "1e3")} AS v FROM e"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink, and its moments, of the box up to each pixel."""
    li = rasters.lineitem_raster(spark, sf_dir)
    ink = 1 - F.col("v")
    sums = [raster.box_sums(li, m).withColumnRenamed("s", n) for n, m in (("mass", ink), ("mx", ink * (F.col("ix") + 1)), ("my", ink * (F.col("iy") + 1)))]
    both = sums[0].join(sums[1], ["img", "ix", "iy"]).join(sums[2], ["img", "ix", "iy"])
    return both.select("img", "ix", "iy", *[S.quantised(F.col(c), 1e3).alias(c) for c in ("mass", "mx", "my")])


BOX_SQL = f"""
WITH {sql.LI} SELECT a.img, a.ix, a.iy, {q("sum(1 - b.v)", "1e3")} AS mass, {q("sum((1 - b.v) * (b.ix + 1))", "1e3")} AS mx, {q("sum((1 - b.v) * (b.iy + 1))", "1e3")} AS my
FROM li a JOIN li b ON b.img = a.img AND b.ix <= a.ix AND b.iy <= a.iy GROUP BY ALL"""


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels inside a triangle, and the raster made white outside it."""
    li = rasters.lineitem_raster(spark, sf_dir)
    keep = geometry.inside(F.col("ix") + 1.0, F.col("iy") + 1.0, TRIANGLE)
    return li.select("img", "ix", "iy", keep.cast("int").alias("inside"), S.quantised(F.when(keep, F.col("v")).otherwise(1.0)).alias("v"))


_IN = sql.inside("(ix + 1)", "(iy + 1)", TRIANGLE)
MASK_SQL = f"WITH {sql.LI} SELECT img, ix, iy, CASE WHEN {_IN} THEN 1 ELSE 0 END::INT AS inside, {q(f'CASE WHEN {_IN} THEN v ELSE 1 END')} AS v FROM li"


def bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lookup.bilinear(rasters.embedding_points(spark, sf_dir), rasters.lineitem_raster(spark, sf_dir), LI_W, LI_H)
    return got.select("img", "pid", S.quantised(F.col("v"), 1e5).alias("v"))


BILINEAR_SQL = f"""
WITH {sql.LI}, {sql.EMB}, p AS (SELECT pid, x - 1 AS fx, y - 1 AS fy, greatest(0, least({LI_W - 2}, floor(x - 1))) AS x0, greatest(0, least({LI_H - 2}, floor(y - 1))) AS y0 FROM emb)
SELECT li.img, pid, {q("sum(v * (CASE WHEN ix = x0 THEN 1 - (fx - x0) ELSE fx - x0 END) * (CASE WHEN iy = y0 THEN 1 - (fy - y0) ELSE fy - y0 END))", "1e5")} AS v
FROM p JOIN li ON ix BETWEEN x0 AND x0 + 1 AND iy BETWEEN y0 AND y0 + 1 WHERE fx BETWEEN 0 AND {LI_W - 1} AND fy BETWEEN 0 AND {LI_H - 1} GROUP BY ALL"""


def nearest_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lookup.nearest_pixel(rasters.embedding_points(spark, sf_dir), rasters.lineitem_raster(spark, sf_dir), LI_W, LI_H)
    return got.select("img", "pid", S.quantised(F.col("v")).alias("v"))


NEAREST_SQL = f"""
WITH {sql.LI}, {sql.EMB} SELECT li.img, pid, {q("v")} AS v FROM emb JOIN li
ON ix = greatest(0, least({LI_W - 1}, floor(x + 0.5) - 1)) AND iy = greatest(0, least({LI_H - 1}, floor(y + 0.5) - 1))"""


def seed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding point nearest to each pixel."""
    got = lookup.nearest_seed(rasters.grid(spark, LI_W, LI_H), rasters.embedding_points(spark, sf_dir), 3.0, LI_W, LI_H)
    return got.select("ix", "iy", "pid", S.quantised(F.col("d2"), 1e5).alias("d2"))


LABEL_SQL = f"""
WITH {sql.EMB}, d AS (SELECT a.x::INT AS ix, b.y::INT AS iy, pid, (emb.x - a.x - 1) * (emb.x - a.x - 1) + (emb.y - b.y - 1) * (emb.y - b.y - 1) AS d2
 FROM range({LI_W}) a(x), range({LI_H}) b(y), emb)
SELECT ix, iy, pid, {q("d2", "1e5")} AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY d2, pid) AS r FROM d) WHERE r = 1"""


def ink_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of relaxation: the centre of ink of each seed's cell, for each image."""
    li = rasters.lineitem_raster(spark, sf_dir)
    label = lookup.nearest_seed(rasters.grid(spark, LI_W, LI_H), rasters.embedding_points(spark, sf_dir), 3.0, LI_W, LI_H)
    m = 1 - F.col("v")
    g = li.join(label, ["ix", "iy"]).groupBy("img", "pid").agg(F.sum(m).alias("m"), F.sum(m * (F.col("ix") + 1)).alias("sx"), F.sum(m * (F.col("iy") + 1)).alias("sy"))
    return g.where("m > 0").select("img", "pid", *[S.quantised(F.col(f"s{c}") / F.col("m"), 1e4).alias(c) for c in ("x", "y")])


CENTROID_SQL = f"""
WITH {sql.LI}, {sql.EMB}, l AS (SELECT ix, iy, pid FROM (SELECT a.x AS ix, b.y AS iy, pid, row_number() OVER (PARTITION BY a.x, b.y
  ORDER BY (emb.x - a.x - 1) * (emb.x - a.x - 1) + (emb.y - b.y - 1) * (emb.y - b.y - 1), pid) AS r FROM range({LI_W}) a(x), range({LI_H}) b(y), emb) WHERE r = 1)
SELECT img, pid, {q("sum((1 - v) * (ix + 1)) / sum(1 - v)", "1e4")} AS x, {q("sum((1 - v) * (iy + 1)) / sum(1 - v)", "1e4")} AS y
FROM li JOIN l USING (ix, iy) GROUP BY ALL HAVING sum(1 - v) > 0"""


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares plane and long axis of the ink of each 10 by 11 tile."""
    li = rasters.lineitem_raster(spark, sf_dir).select("img", F.floor(F.col("ix") / 10).cast("int").alias("tile"), F.col("ix").alias("x"), F.col("iy").alias("y"), "v", (1 - F.col("v")).alias("m"))
    fit = geometry.plane_fit(li, ["img", "tile"])
    axis = geometry.principal_axis(li, ["img", "tile"])
    made = fit.join(axis, ["img", "tile"])
    return made.select("img", "tile", *[S.quantised(F.col(c)).alias(c) for c in ("gx", "gy")], *[S.quantised(F.col(c), 1e4).alias(c) for c in ("ax", "ay", "axis")])


PLANE_SQL = f"""
WITH {sql.LI}, t AS (SELECT img, (ix // 10)::INT AS tile, ix::DOUBLE AS x, iy::DOUBLE AS y, v, 1 - v AS m FROM li),
g AS (SELECT img, tile, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy, covar_pop(x, v) AS xz, covar_pop(y, v) AS yz,
 sum(m * x) / sum(m) AS ax, sum(m * y) / sum(m) AS ay, sum(m * x * x) / sum(m) AS mxx, sum(m * x * y) / sum(m) AS mxy, sum(m * y * y) / sum(m) AS myy FROM t GROUP BY ALL)
SELECT img, tile, {q("(xz * yy - yz * xy) / (xx * yy - xy * xy)")} AS gx, {q("(yz * xx - xz * xy) / (xx * yy - xy * xy)")} AS gy,
 {q("ax", "1e4")} AS ax, {q("ay", "1e4")} AS ay, {q("atan2(2 * (mxy - ax * ay), (mxx - ax * ax) - (myy - ay * ay)) / 2", "1e4")} AS axis FROM g"""


def noise_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of plane waves of seeded directions and phases over a grid, a field for each region."""
    waves, k = 16, 2 * math.pi / 14
    seeds = rasters.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("key"), (F.col("r_regionkey") + 7).alias("seed"))
    drawn = seeds.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))
    drawn = drawn.select("key", (math.pi * (F.col("n") + S.draw(F.col("seed"), 2 * F.col("n"))) / waves).alias("t"), (2 * math.pi * S.draw(F.col("seed"), 2 * F.col("n") + 1)).alias("p"))
    # A field's waves are one small array, so that each pixel sums over it without being repeated.
    fields = drawn.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("t", "p"))).alias("waves"))
    pixels = rasters.grid(spark, 40, 30).crossJoin(F.broadcast(fields))
    term = lambda s, w: s + F.cos(k * ((F.col("ix") + 1) * F.cos(w["t"]) + (F.col("iy") + 1) * F.sin(w["t"])) + w["p"])
    return pixels.select("key", "ix", "iy", S.quantised(F.aggregate("waves", F.lit(0.0), term) * math.sqrt(2 / waves), 1e4).alias("v"))


NOISE_SQL = f"""
WITH s AS (SELECT r_regionkey::INT AS key, r_regionkey + 7 AS seed, n, j FROM region, range(16) a(n), range(2) b(j)),
a AS (SELECT key, n, j, (seed + (2 * n + j + 2) * 1831565813) % 4294967296 AS a FROM s),
t AS (SELECT key, n, j, ((xor(a, a >> 15)::HUGEINT * (a | 1)::HUGEINT) % 4294967296)::BIGINT AS t FROM a),
u AS (SELECT key, n, j, xor(t, (t + ((xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT) % 4294967296)::BIGINT) % 4294967296) AS t FROM t),
d AS (SELECT key, n, max(CASE WHEN j = 0 THEN xor(t, t >> 14) END) / 4294967296.0::DOUBLE AS u, max(CASE WHEN j = 1 THEN xor(t, t >> 14) END) / 4294967296.0::DOUBLE AS p FROM u GROUP BY ALL)
SELECT key, x::INT AS ix, y::INT AS iy, {q(f"sqrt(2 / 16.0) * sum(cos({2 * math.pi / 14!r} * ((x + 1) * cos(pi() * (n + u) / 16) + (y + 1) * sin(pi() * (n + u) / 16)) + 2 * pi() * p))", "1e4")} AS v
FROM d, range(40) a(x), range(30) b(y) GROUP BY ALL"""


def contour_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marching squares at one level: the edges of each cell that its contour joins, and where it crosses them."""
    li = rasters.lineitem_raster(spark, sf_dir)
    level = 0.25
    corner = lambda n, dx, dy: li.select("img", (F.col("ix") - dx).alias("ix"), (F.col("iy") - dy).alias("iy"), F.col("v").alias(n))
    c = corner("tl", 0, 0).join(corner("tr", 1, 0), ["img", "ix", "iy"]).join(corner("bl", 0, 1), ["img", "ix", "iy"]).join(corner("br", 1, 1), ["img", "ix", "iy"])
    up = lambda n: (F.col(n) >= level).cast("int")
    case = up("tl") + 2 * up("tr") + 4 * up("br") + 8 * up("bl")
    high = (F.col("tl") + F.col("tr") + F.col("bl") + F.col("br")) / 4 >= level
    pair = lambda *p: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in p])
    # Sides: 0 top, 1 right, 2 bottom, 3 left.
    plain = {1: (3, 0), 2: (0, 1), 3: (3, 1), 4: (1, 2), 6: (0, 2), 7: (3, 2), 8: (2, 3), 9: (0, 2), 11: (1, 2), 12: (1, 3), 13: (0, 1), 14: (3, 0)}
    sides = F.when((case == 5) & high, pair((0, 1), (2, 3))).when(case == 5, pair((3, 0), (1, 2))).when((case == 10) & high, pair((3, 0), (1, 2))).when(case == 10, pair((0, 1), (2, 3)))
    for k, p in plain.items():
        sides = sides.when(case == k, pair(tuple(sorted(p))))
    t = lambda a, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (level - F.col(a)) / F.nullif(F.col(b) - F.col(a), F.lit(0.0))))
    x, y = F.col("ix") + 1.0, F.col("iy") + 1.0
    at = lambda s, i: F.when(s == 0, (x + t("tl", "tr"), y)[i]).when(s == 1, (x + 1, y + t("tr", "br"))[i]).when(s == 2, (x + t("bl", "br"), y + 1)[i]).otherwise((x, y + t("tl", "bl"))[i])
    s = c.withColumn("s", F.explode(sides))
    a, b = F.least("s.a", "s.b"), F.greatest("s.a", "s.b")
    return s.select("img", "ix", "iy", a.alias("a"), b.alias("b"), *[S.quantised(at(e, i), 1e4).alias(f"{c}{n}") for n, e in ((1, a), (2, b)) for i, c in enumerate("xy")])


def _side(e: str, i: int) -> str:
    t = lambda a, b: f"greatest(0, least(1, (0.25 - {a}) / nullif({b} - {a}, 0)))"
    at = [("ix + 1 + " + t("tl", "tr"), "iy + 1"), ("ix + 2", "iy + 1 + " + t("tr", "br")), ("ix + 1 + " + t("bl", "br"), "iy + 2"), ("ix + 1", "iy + 1 + " + t("tl", "bl"))]
    return f"CASE {e} " + " ".join(f"WHEN {k} THEN {p[i]}" for k, p in enumerate(at)) + " END"


CONTOUR_SQL = f"""
WITH {sql.LI}, c AS (SELECT a.img, a.ix, a.iy, a.v AS tl, b.v AS tr, c.v AS bl, d.v AS br FROM li a
 JOIN li b ON b.img = a.img AND b.ix = a.ix + 1 AND b.iy = a.iy JOIN li c ON c.img = a.img AND c.ix = a.ix AND c.iy = a.iy + 1
 JOIN li d ON d.img = a.img AND d.ix = a.ix + 1 AND d.iy = a.iy + 1),
k AS (SELECT *, (tl >= 0.25)::INT + 2 * (tr >= 0.25)::INT + 4 * (br >= 0.25)::INT + 8 * (bl >= 0.25)::INT AS kind, (tl + tr + bl + br) / 4 >= 0.25 AS high FROM c),
-- A side is crossed where its corners differ; of four crossed sides the pairs depend on the cell's middle.
e AS (SELECT *, CASE WHEN kind IN (5, 10) THEN CASE WHEN (kind = 5) = high THEN [[0, 1], [2, 3]] ELSE [[0, 3], [1, 2]] END
  WHEN kind IN (0, 15) THEN [] ELSE [list_filter([0, 1, 2, 3], lambda s: CASE s WHEN 0 THEN (tl >= 0.25) <> (tr >= 0.25) WHEN 1 THEN (tr >= 0.25) <> (br >= 0.25)
    WHEN 2 THEN (bl >= 0.25) <> (br >= 0.25) ELSE (tl >= 0.25) <> (bl >= 0.25) END)] END AS p FROM k),
s AS (SELECT *, q[1]::INT AS a, q[2]::INT AS b FROM (SELECT *, unnest(p) AS q FROM e))
SELECT img, ix, iy, a, b, {q(_side("a", 0), "1e4")} AS x1, {q(_side("a", 1), "1e4")} AS y1, {q(_side("b", 0), "1e4")} AS x2, {q(_side("b", 1), "1e4")} AS y2 FROM s"""


QUERIES = {
    "raster_blur_li": (blurred, BLUR_SQL),
    "raster_shrink_li": (shrunk, SHRINK_SQL),
    "raster_grow_li": (grown, GROW_SQL),
    "raster_prepare_li": (prepared, PREPARE_SQL),
    "raster_median_ev": (medians, MEDIAN_SQL),
    "raster_dilate_ev": (dilated, DILATE_SQL),
    "raster_tensor_li": (tensors, TENSOR_SQL),
    "raster_edges_ev": (edge_strengths, EDGE_SQL),
    "raster_boxes_li": (boxes, BOX_SQL),
    "mask_triangle_li": (masks, MASK_SQL),
    "lookup_bilinear_emb": (bilinear, BILINEAR_SQL),
    "lookup_nearest_emb": (nearest_pixels, NEAREST_SQL),
    "knn_label_emb": (seed_labels, LABEL_SQL),
    "relax_step_emb": (ink_centroids, CENTROID_SQL),
    "plane_fit_li": (planes, PLANE_SQL),
    "noise_field_region": (noise_field, NOISE_SQL),
    "contour_segments_li": (contour_segments, CONTOUR_SQL),
}
