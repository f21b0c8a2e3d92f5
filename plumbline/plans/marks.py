"""Queries over mark placement: dot lattices, diagonal cells, radial transport, capacity, tours, tessellation, folds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import lookup
from plumbline.plans import sql
from plumbline.plans.sql import q
from plumbline.plans.strokes import RINGS, STROKES, _rings, _strokes
from plumbline.sources import rasters
from plumbline.sources.rasters import LI_H, LI_W

DOT = 0.8


def _extra(pitch: float) -> float:
    """How much more than a cell's area a dot inks."""
    return math.pi * DOT * DOT / (pitch * pitch) - 1


def dot_dither(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dots drawn at random in a square lattice, with a chance that allows for ink on the neighbours' cells."""
    extra = _extra(DOT * math.sqrt(2))
    k = 1 - F.col("v")
    p = ((1 + extra) - F.sqrt((1 + extra) * (1 + extra) - 4 * extra * k)) / (2 * extra)
    cell = rasters.lineitem_raster(spark, sf_dir).withColumn("p", p)
    return cell.select("img", "ix", "iy", (S.draw(11, F.col("iy") * LI_W + F.col("ix")) < F.col("p")).cast("int").alias("dot"))


def _draw_sql(seed: str, n: str) -> str:
    a = f"(({seed} + ({n} + 2) * 1831565813) % 4294967296)"
    t = f"(((xor({a}, {a} >> 15)::HUGEINT * ({a} | 1)::HUGEINT) % 4294967296)::BIGINT)"
    u = f"xor({t}, ({t} + ((xor({t}, {t} >> 7)::HUGEINT * ({t} | 61)::HUGEINT) % 4294967296)::BIGINT) % 4294967296)"
    return f"(xor({u}, {u} >> 14) / 4294967296.0::DOUBLE)"


_E = repr(_extra(DOT * math.sqrt(2)))
DITHER_SQL = f"""
WITH {sql.LI}, p AS (SELECT *, ((1 + {_E}) - sqrt((1 + {_E}) * (1 + {_E}) - 4 * {_E}::DOUBLE * (1 - v))) / (2 * {_E}::DOUBLE) AS p FROM li)
SELECT img, ix, iy, CASE WHEN {_draw_sql("11::BIGINT", f"(iy * {LI_W} + ix)::BIGINT")} < p THEN 1 ELSE 0 END::INT AS dot FROM p"""


def effective_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink of a dot pattern: one for each drawn cell, and what its neighbours' dots spill on one that isn't; beside the
    ink wanted."""
    extra = _extra(DOT * math.sqrt(2))
    li = rasters.lineitem_raster(spark, sf_dir).withColumn("dot", ((F.col("ix") + F.col("iy")) % 3 == 0) & (F.col("v") < 0.3))
    moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    spill = li.where("dot").withColumn("d", F.explode(moves)).select("img", (F.col("ix") + F.col("d.dx")).alias("ix"), (F.col("iy") + F.col("d.dy")).alias("iy"))
    spill = spill.groupBy("img", "ix", "iy").agg(F.count("*").alias("n"))
    cell = li.join(spill, ["img", "ix", "iy"], "left").withColumn("ink", F.when(F.col("dot"), 1.0).otherwise(F.coalesce("n", F.lit(0)) * (extra / 4)))
    return cell.groupBy("img").agg(S.quantised(F.sum("ink"), 1e3).alias("ink"), S.quantised(F.sum(1 - F.col("v")), 1e3).alias("wanted"), F.sum(F.col("dot").cast("int")).alias("dots"))


INK_SQL = f"""
WITH {sql.LI}, d AS (SELECT *, (ix + iy) % 3 = 0 AND v < 0.3 AS dot FROM li),
n AS (SELECT d.img, d.ix, d.iy, any_value(d.v) AS v, any_value(d.dot) AS dot, count(o.ix) AS n FROM d LEFT JOIN d o ON o.img = d.img AND o.dot AND abs(o.ix - d.ix) + abs(o.iy - d.iy) = 1 GROUP BY ALL)
SELECT img, {q(f"sum(CASE WHEN dot THEN 1 ELSE n * ({_E}::DOUBLE / 4) END)", "1e3")} AS ink, {q("sum(1 - v)", "1e3")} AS wanted, sum(dot::INT)::BIGINT AS dots FROM n GROUP BY img"""


def diagonal_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each marked cell of a serpentine walk gets one of two diagonals by a seeded draw; its stroke's ends."""
    from plumbline.plans.strokes import crossings

    marked = crossings(spark, sf_dir).withColumn("rise", S.draw(5, F.col("k")) < 0.5)
    y1, y2 = F.when(F.col("rise"), F.col("iy") + 1).otherwise(F.col("iy")), F.when(F.col("rise"), F.col("iy")).otherwise(F.col("iy") + 1)
    return marked.select("img", "k", F.col("ix").alias("x1"), y1.alias("y1"), (F.col("ix") + 1).alias("x2"), y2.alias("y2"))


def _diagonal_sql() -> str:
    from plumbline.plans.strokes import CROSSING_SQL

    rise = f"{_draw_sql('5::BIGINT', 'k')} < 0.5"
    return f"""WITH m AS ({CROSSING_SQL}) SELECT img, k, ix AS x1, CASE WHEN {rise} THEN iy + 1 ELSE iy END::INT AS y1, (ix + 1)::INT AS x2, CASE WHEN {rise} THEN iy ELSE iy + 1 END::INT AS y2 FROM m"""


RAYS, RADII, REACH, PITCH = 32, 64, 20.0, 3.0


def ray_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ray, k, r, m): the ink along each ray from the middle, up to each radius: a window over the ray's radii."""
    li = rasters.whole_lineitem_raster(spark, sf_dir)
    cx, cy, dr = (LI_W + 1) / 2, (LI_H + 1) / 2, REACH / (RADII - 1)
    ray = spark.range(RAYS * RADII).select(F.floor(F.col("id") / RADII).cast("int").alias("ray"), (F.col("id") % RADII).cast("int").alias("k"))
    turn = (F.col("ray") + 0.5) * (2 * math.pi / RAYS)
    ray = ray.withColumn("r", F.col("k") * dr)
    fx, fy = F.floor(cx + F.col("r") * F.cos(turn) + 0.5) - 1, F.floor(cy + F.col("r") * F.sin(turn) + 0.5) - 1
    rho = ray.withColumn("ix", fx.cast("int")).withColumn("iy", fy.cast("int")).join(li, ["ix", "iy"], "left").select("ray", "k", "r", (F.coalesce(1 - F.col("v"), F.lit(0.0)) * F.col("r")).alias("f"))
    along = Window.partitionBy("ray").orderBy("k")
    step = F.coalesce((F.col("f") + F.lag("f").over(along)) / 2 * dr, F.lit(0.0))
    return rho.withColumn("step", step).withColumn("m", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0)))


def source_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radius of the disc that holds points enough for the ray that needs most, with a margin."""
    need = ray_masses(spark, sf_dir).groupBy("ray").agg(F.max("m").alias("m")).agg(F.max("m").alias("need"))
    reach = PITCH * F.sqrt(2 * F.col("need"))
    margin = F.greatest(3 * PITCH * PITCH / F.greatest(F.lit(1e-6), reach * (2 * math.pi / RAYS)), F.lit(2 * PITCH))
    return need.select(S.quantised(F.col("need"), 1e3).alias("need"), S.quantised(reach + margin, 1e3).alias("radius"))


def radial_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of an even square lattice in a disc moved along their rays so that their density follows the ink.

    A point looks its mass up among its own ray's stretches by an equi-join on ray and bucket of mass.
    """
    mass, cx, cy = ray_masses(spark, sf_dir), (LI_W + 1) / 2, (LI_H + 1) / 2
    total = mass.groupBy("ray").agg(F.max("m").alias("total"))
    n = int(REACH / PITCH) + 1
    grid = spark.range((2 * n + 1) ** 2).select(F.col("id").alias("id"), ((F.floor(F.col("id") / (2 * n + 1)) - n + 0.5) * PITCH).alias("x"), ((F.col("id") % (2 * n + 1) - n + 0.25) * PITCH).alias("y"))
    angle = F.atan2("y", "x")
    point = grid.withColumn("s", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).withColumn("a", F.when(angle < 0, angle + 2 * math.pi).otherwise(angle))
    point = point.withColumn("ray", F.least(F.lit(RAYS - 1), F.floor(F.col("a") / (2 * math.pi / RAYS))).cast("int"))
    want = point.withColumn("u", F.col("s") * F.col("s") / (2 * PITCH * PITCH)).join(total, "ray").where("u <= total")
    hit = lookup.interpolated(want.select("ray", "id", "u"), mass.select("ray", F.col("m").alias("x"), F.col("r").alias("y")), ["ray"], 1.0)
    moved = want.join(hit.withColumnRenamed("y", "r"), ["ray", "id"])
    return moved.select("id", "ray", S.quantised(cx + F.col("r") * F.cos("a"), 1e3).alias("x"), S.quantised(cy + F.col("r") * F.sin("a"), 1e3).alias("y"))


_N = int(REACH / PITCH) + 1
TRANSPORT_SQL = f"""
WITH {sql.LI_WHOLE}, ray AS (SELECT a.ray, b.k, b.k * {REACH / (RADII - 1)!r}::DOUBLE AS r, (a.ray + 0.5) * {2 * math.pi / RAYS!r}::DOUBLE AS t FROM range({RAYS}) a(ray), range({RADII}) b(k)),
f AS (SELECT ray, k, r, coalesce(1 - v, 0) * r AS f FROM ray LEFT JOIN li ON ix = floor({(LI_W + 1) / 2} + r * cos(t) + 0.5) - 1 AND iy = floor({(LI_H + 1) / 2} + r * sin(t) + 0.5) - 1),
s AS (SELECT *, coalesce((f + lag(f) OVER (PARTITION BY ray ORDER BY k)) / 2 * {REACH / (RADII - 1)!r}::DOUBLE, 0) AS step FROM f),
m AS (SELECT ray, k, r, sum(step) OVER (PARTITION BY ray ORDER BY k ROWS UNBOUNDED PRECEDING) AS m FROM s),
e AS (SELECT ray, m AS m0, r AS r0, lead(m) OVER w AS m1, lead(r) OVER w AS r1, max(m) OVER (PARTITION BY ray) AS total FROM m WINDOW w AS (PARTITION BY ray ORDER BY k)),
g AS (SELECT id, (id // {2 * _N + 1} - {_N} + 0.5) * {PITCH}::DOUBLE AS x, (id % {2 * _N + 1} - {_N} + 0.25) * {PITCH}::DOUBLE AS y FROM range({(2 * _N + 1) ** 2}) r(id)),
p AS (SELECT id, sqrt(x * x + y * y) AS s, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END AS a FROM g),
w AS (SELECT id, a, least({RAYS - 1}, floor(a / {2 * math.pi / RAYS!r}::DOUBLE)) AS ray, s * s / {2 * PITCH * PITCH} AS u FROM p),
h AS (SELECT w.id, w.ray, w.a, CASE WHEN m1 > m0 THEN r0 + (u - m0) / (m1 - m0) * (r1 - r0) ELSE r0 END AS r FROM w JOIN e ON e.ray = w.ray AND m1 IS NOT NULL AND u <= total AND u >= m0 AND (u < m1 OR (u = m1 AND m1 = total))),
b AS (SELECT id, ray, a, max(r) AS r FROM h GROUP BY ALL)
SELECT id, ray::INT AS ray, {q(f"{(LI_W + 1) / 2} + r * cos(a)", "1e3")} AS x, {q(f"{(LI_H + 1) / 2} + r * sin(a)", "1e3")} AS y FROM b"""


RADIUS_SQL = f"""{TRANSPORT_SQL[: TRANSPORT_SQL.index(",\ne AS (")]}, n AS (SELECT max(m) AS need FROM m)
SELECT {q("need", "1e3")} AS need, {q(f"{PITCH} * sqrt(2 * need) + greatest({3 * PITCH * PITCH}::DOUBLE / ({PITCH} * sqrt(2 * need) * {2 * math.pi / RAYS!r}::DOUBLE), {2 * PITCH})", "1e3")} AS radius FROM n"""


def chord_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink that all chords between a ring's nodes could lay in each cell of side 4, sampled 16 times along each chord."""
    ring = _rings(spark, sf_dir).groupBy("poly_id").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("s"))
    pairs = ring.select("poly_id", "s", F.posexplode("s").alias("p", "a")).select("poly_id", "a", F.explode(F.slice("s", F.col("p") + 2, F.greatest(F.lit(0), F.size("s") - F.col("p") - 1))).alias("b"))
    length = F.sqrt((F.col("a.x") - F.col("b.x")) * (F.col("a.x") - F.col("b.x")) + (F.col("a.y") - F.col("b.y")) * (F.col("a.y") - F.col("b.y")))
    laid = pairs.withColumn("ink", length / 16).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(15))))
    t = (F.col("t") + 0.5) / 16
    cell = lambda c: F.floor((F.col(f"a.{c}") + t * (F.col(f"b.{c}") - F.col(f"a.{c}"))) / 4 + 0.123).cast("int")
    return laid.groupBy("poly_id", cell("x").alias("gx"), cell("y").alias("gy")).agg(S.quantised(F.sum("ink"), 1e2).alias("ink"))


CAPACITY_SQL = f"""
WITH {RINGS} SELECT a.poly_id, floor((a.x + (t + 0.5) / 16 * (b.x - a.x)) / 4 + 0.123)::INT AS gx, floor((a.y + (t + 0.5) / 16 * (b.y - a.y)) / 4 + 0.123)::INT AS gy,
 {q("sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 16)", "1e2")} AS ink FROM poly a JOIN poly b ON a.poly_id = b.poly_id AND a.k < b.k, range(16) r(t) GROUP BY ALL"""


def hilbert_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tour of each label's points in the order of a Hilbert curve: its length and its first and last point."""
    side = 64
    e = rasters.table(spark, sf_dir, "embeddings").select("vec_id", "label").withColumnRenamed("vec_id", "pid").join(rasters.embedding_points(spark, sf_dir), "pid")
    cell = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor((F.col(c) - 1) / (n - 1) * side))).cast("int")
    placed = e.withColumn("h", S.hilbert_index(side, cell("x", LI_W), cell("y", LI_H)))
    order = Window.partitionBy("label").orderBy("h", "pid")
    dx, dy = F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)
    walk = placed.withColumn("step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    ends = F.struct("h", "pid")
    return walk.groupBy("label").agg(F.count("*").alias("n"), S.quantised(F.sum("step"), 1e3).alias("length"), F.min(ends)["pid"].alias("first"), F.max(ends)["pid"].alias("last"))


TOUR_SQL = f"""
WITH RECURSIVE {sql.EMB}, c AS (SELECT pid, label, x, y, greatest(0, least(63, floor((x - 1) / {LI_W - 1} * 64)))::BIGINT AS px, greatest(0, least(63, floor((y - 1) / {LI_H - 1} * 64)))::BIGINT AS py
 FROM emb JOIN embeddings ON vec_id = pid),
h AS (SELECT pid, px, py, 0::BIGINT AS d, 32::BIGINT AS s FROM c UNION ALL
 SELECT pid, CASE WHEN (py & s) > 0 THEN px WHEN (px & s) > 0 THEN s - 1 - py ELSE py END, CASE WHEN (py & s) > 0 THEN py WHEN (px & s) > 0 THEN s - 1 - px ELSE px END,
  d + s * s * CASE WHEN (px & s) > 0 AND (py & s) > 0 THEN 2 WHEN (px & s) > 0 THEN 3 WHEN (py & s) > 0 THEN 1 ELSE 0 END, s // 2 FROM h WHERE s > 0),
w AS (SELECT c.*, h.d, coalesce(sqrt(pow(x - lag(x) OVER o, 2) + pow(y - lag(y) OVER o, 2)), 0) AS step FROM c JOIN h ON h.pid = c.pid AND h.s = 0 WINDOW o AS (PARTITION BY label ORDER BY h.d, c.pid))
SELECT label, count(*) AS n, {q("sum(step)", "1e3")} AS length, arg_min(pid, {{'d': d, 'pid': pid}}) AS first, arg_max(pid, {{'d': d, 'pid': pid}}) AS last FROM w GROUP BY label"""


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles drawn as polygons whose sides stray no more than 0.05 from the arc."""
    c = rasters.table(spark, sf_dir, "supplier").select("s_suppkey", (2 + F.abs("s_acctbal") / 1000).alias("r"))
    n = F.greatest(F.lit(8), F.ceil(math.pi / F.acos(1 - 0.05 / F.col("r"))).cast("int"))
    p = c.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    t = F.col("k") / F.col("n") * (2 * math.pi)
    return p.select("s_suppkey", "k", S.quantised(F.col("r") * F.cos(t), 1e4).alias("x"), S.quantised(F.col("r") * F.sin(t), 1e4).alias("y"))


OUTLINE_SQL = f"""
WITH c AS (SELECT s_suppkey, 2 + abs(s_acctbal) / 1000 AS r FROM supplier), n AS (SELECT *, greatest(8, ceil(pi() / acos(1 - 0.05 / r)))::INT AS n FROM c),
k AS (SELECT *, unnest(range(n + 1)) AS k FROM n)
SELECT s_suppkey, k::INT AS k, {q("r * cos(k::DOUBLE / n * 2 * pi())", "1e4")} AS x, {q("r * sin(k::DOUBLE / n * 2 * pi())", "1e4")} AS y FROM k"""


def channel_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of four inks folded to one drawing: counts and lengths add up, errors take mean or maximum; and the
    time to plot it, with the pen up three times as fast as down."""
    o = rasters.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("img"), F.pmod("o_custkey", F.lit(4)).alias("channel"))
    per = o.agg(F.sum("o_totalprice").alias("drawn"), F.count("*").alias("paths"), F.avg(F.col("o_totalprice") / 1e6).alias("rms"), F.max("o_totalprice").alias("most"))
    g = per.groupBy("img").agg(F.sum("drawn").alias("drawn"), F.sum("paths").alias("paths"), F.avg("rms").alias("rms"), F.max("most").alias("most"))
    return g.select("img", S.quantised(F.col("drawn"), 1.0).alias("drawn"), "paths", S.quantised(F.col("rms")).alias("rms"), S.quantised(F.col("most"), 1e2).alias("most"), S.quantised(F.col("drawn") / 3 + F.col("paths") / 9.0, 1.0).alias("time"))


FOLD_SQL = f"""
WITH p AS (SELECT o_orderstatus AS img, o_custkey % 4 AS channel, sum(o_totalprice) AS drawn, count(*) AS paths, avg(o_totalprice / 1e6) AS rms, max(o_totalprice) AS most FROM orders GROUP BY ALL)
SELECT img, {q("sum(drawn)", "1")} AS drawn, sum(paths)::BIGINT AS paths, {q("avg(rms)")} AS rms, {q("max(most)", "1e2")} AS most, {q("sum(drawn) / 3 + sum(paths) / 9.0::DOUBLE", "1")} AS time FROM p GROUP BY img"""


def worst_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtractive composite of four ink planes, and of their errors against the line item raster the signed one that is
    largest; ties go to the first ink."""
    li = rasters.lineitem_raster(spark, sf_dir)
    inks = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.pmod(F.floor(F.col("v") * 1000) * m, F.lit(97)).cast("double")).alias("u")) for i, m in enumerate((7, 13, 29, 31))])
    e = li.withColumn("p", F.explode(inks)).select("img", "ix", "iy", "p.i", (F.col("p.u") / 96.0).alias("cover"), (F.floor(F.col("v") * 1000) / 1000.0 - F.col("p.u") / 96.0).alias("e"))
    worst = F.max_by("e", F.struct(F.abs("e"), -F.col("i")))
    paper = F.exp(F.sum(F.log(1 - F.col("cover") * 0.9)))
    return e.groupBy("img", "ix", "iy").agg(S.quantised(worst, 1e5).alias("worst"), S.quantised(paper, 1e5).alias("paper"))


WORST_SQL = f"""
WITH {sql.LI}, e AS (SELECT img, ix, iy, i, (floor(v * 1000)::BIGINT * m % 97) / 96.0::DOUBLE AS cover, floor(v * 1000) / 1000.0::DOUBLE - (floor(v * 1000)::BIGINT * m % 97) / 96.0::DOUBLE AS e
 FROM li, (VALUES (0, 7), (1, 13), (2, 29), (3, 31)) k(i, m))
SELECT img, ix, iy, {q("arg_max(e, {'a': abs(e), 'i': -i})", "1e5")} AS worst, {q("exp(sum(ln(1 - cover * 0.9)))", "1e5")} AS paper FROM e GROUP BY ALL"""


def pen_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moves between each path and the next of its layer, from the origin on."""
    from plumbline.operators import paths

    e = paths.ends_of(_strokes(spark, sf_dir), ["layer"])
    order = Window.partitionBy("layer").orderBy("path_id")
    before = lambda c: F.coalesce(F.lag(f"b.{c}").over(order), F.lit(0.0))
    return e.select("layer", "path_id", *[S.quantised(v, 1e3).alias(n) for n, v in (("x1", before("x")), ("y1", before("y")), ("x2", F.col("a.x")), ("y2", F.col("a.y")))])


PEN_UP_SQL = f"""
WITH {STROKES} SELECT layer, path_id, {q("coalesce(lag(bx) OVER w, 0)", "1e3")} AS x1, {q("coalesce(lag(b_y) OVER w, 0)", "1e3")} AS y1, {q("ax", "1e3")} AS x2, {q("ay", "1e3")} AS y2
FROM ends WINDOW w AS (PARTITION BY layer ORDER BY path_id)"""


def stripe_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines across each image whose spacing follows the mean darkness of the bins they cross.

    Bins' means, filled from the left and then the right, give a rate; its running integral is the phase, and a line
    stands wherever the phase passes an odd number of half turns.
    """
    binned = rasters.lineitem_raster(spark, sf_dir).groupBy("img", F.floor(F.col("ix") / 2).cast("int").alias("bin")).agg(F.avg(1 - F.col("v")).alias("k"))
    bins = rasters.lineitem_raster(spark, sf_dir).select("img").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(LI_W // 2 - 1)))).join(binned, ["img", "bin"], "left")
    left, right = Window.partitionBy("img").orderBy("bin"), Window.partitionBy("img").orderBy(F.desc("bin"))
    k = F.coalesce(F.last("k", True).over(left), F.last("k", True).over(right), F.lit(0.0))
    rate = S.harmonic_rate(1 - F.col("filled"), 2.0, 12.0)
    r = bins.withColumn("filled", k).withColumn("rate", rate)
    step = F.coalesce((F.col("rate") + F.lag("rate").over(left)) / 2 * 2.0, F.lit(0.0))
    phase = r.withColumn("step", step).withColumn("phase", F.sum("step").over(left.rowsBetween(Window.unboundedPreceding, 0)))
    phase = phase.withColumn("after", F.lead("phase").over(left))
    first, last = F.floor(F.col("phase") + 0.5).cast("int") + 1, F.floor(F.col("after") + 0.5).cast("int")
    line = phase.where("after is not null").where(first <= last).withColumn("i", F.explode(F.sequence(first, last)))
    at = (F.col("bin") + (F.col("i") - 0.5 - F.col("phase")) / (F.col("after") - F.col("phase"))) * 2.0 + 1
    return line.select("img", "i", S.quantised(at, 1e4).alias("at"))


STRIPE_SQL = f"""
WITH {sql.LI}, b AS (SELECT img, (ix // 2)::INT AS bin, avg(1 - v) AS k FROM li GROUP BY ALL),
g AS (SELECT i.img, x.bin, b.k FROM (SELECT DISTINCT img FROM li) i CROSS JOIN range({LI_W // 2}) x(bin) LEFT JOIN b ON b.img = i.img AND b.bin = x.bin),
f AS (SELECT img, bin, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY img ORDER BY bin), last_value(k IGNORE NULLS) OVER (PARTITION BY img ORDER BY bin DESC), 0) AS k FROM g),
r AS (SELECT *, 1 / 2.0::DOUBLE + (1 - k) * (1 / 12.0::DOUBLE - 1 / 2.0::DOUBLE) AS rate FROM f),
s AS (SELECT *, coalesce((rate + lag(rate) OVER (PARTITION BY img ORDER BY bin)) / 2 * 2.0, 0) AS step FROM r),
p AS (SELECT img, bin, sum(step) OVER (PARTITION BY img ORDER BY bin ROWS UNBOUNDED PRECEDING) AS phase FROM s),
a AS (SELECT *, lead(phase) OVER (PARTITION BY img ORDER BY bin) AS after FROM p),
l AS (SELECT *, unnest(range(floor(phase + 0.5)::BIGINT + 1, floor(after + 0.5)::BIGINT + 1)) AS i FROM a WHERE after IS NOT NULL)
SELECT img, i::INT AS i, {q("(bin + (i - 0.5 - phase) / (after - phase)) * 2.0 + 1", "1e4")} AS "at" FROM l"""


QUERIES = {
    "dot_dither_li": (dot_dither, DITHER_SQL),
    "effective_ink_li": (effective_ink, INK_SQL),
    "diagonal_cells_li": (diagonal_cells, _diagonal_sql()),
    "transport_radial_li": (radial_transport, TRANSPORT_SQL),
    "source_radius_li": (source_radius, RADIUS_SQL),
    "chord_capacity_customer": (chord_capacity, CAPACITY_SQL),
    "hilbert_tour_emb": (hilbert_tour, TOUR_SQL),
    "outlines_supplier": (outlines, OUTLINE_SQL),
    "channel_fold_orders": (channel_fold, FOLD_SQL),
    "worst_error_li": (worst_error, WORST_SQL),
    "pen_up_moves_li": (pen_up, PEN_UP_SQL),
    "stripe_offsets_li": (stripe_offsets, STRIPE_SQL),
}
