"""Queries over points, polygons and pen paths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import geometry, lookup, paths
from plumbline.operators.rounds import parts
from plumbline.plans import sql
from plumbline.plans.fields import TRIANGLE
from plumbline.plans.sql import q
from plumbline.sources import rasters
from plumbline.sources.rasters import LI_H, LI_W

_P = "(PARTITION BY path_id ORDER BY seq)"


def arc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.with_length(rasters.user_paths(spark, sf_dir)).select("path_id", F.col("seq").cast("long").alias("seq"), S.quantised(F.col("s"), 1e3).alias("s"))


ARC_SQL = f"WITH {sql.PATH}, {sql.LENGTH} SELECT path_id, seq, {q('s', '1e3')} AS s FROM len"


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Events without a user are no path.
    r = paths.resampled(rasters.user_paths(spark, sf_dir).where("path_id is not null"), 50.0)
    return r.select("path_id", "seq", S.quantised(F.col("x"), 1e3).alias("x"), S.quantised(F.col("y"), 1e3).alias("y"))


RESAMPLE_SQL = f"""
WITH {sql.PATH}, {sql.LENGTH}, t AS (SELECT path_id, max(s) AS total, greatest(1, floor(max(s) / 50 + 0.5))::INT AS n FROM len GROUP BY path_id),
e AS (SELECT path_id, x, y, s, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(s) OVER w AS s1 FROM len WINDOW w AS {_P}),
k AS (SELECT path_id, total, n, unnest(range(n + 1)) AS k FROM t),
h AS (SELECT k.path_id, k, total / n * k AS d, e.*, row_number() OVER (PARTITION BY k.path_id, k ORDER BY e.s DESC) AS r
  FROM k JOIN e ON e.path_id = k.path_id AND e.s1 > e.s AND e.s <= total / n * k + 1e-9 * total / n)
SELECT path_id, k::INT AS seq, {q("x + greatest(0, least(1, (d - s) / (s1 - s))) * (x1 - x)", "1e3")} AS x, {q("y + greatest(0, least(1, (d - s) / (s1 - s))) * (y1 - y)", "1e3")} AS y FROM h WHERE r = 1"""


def middle_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path from its first 100 to its first 400 units of length: how much is there, and between which points."""
    part = paths.between(rasters.user_paths(spark, sf_dir), F.lit(100.0), F.lit(400.0))
    e = paths.ends_of(part, [])
    made = [S.quantised(v, 1e2).alias(n) for n, v in (("x1", F.col("a.x")), ("y1", F.col("a.y")), ("x2", F.col("b.x")), ("y2", F.col("b.y")), ("length", F.col("length")))]
    return e.select("path_id", "n", *made)


PART_SQL = f"""
WITH {sql.PATH}, {sql.LENGTH}, e AS (SELECT path_id, x, y, s, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(s) OVER w AS s1 FROM len WINDOW w AS {_P}),
c AS (SELECT *, greatest(s, 100.0::DOUBLE) AS a, least(s1, 400.0::DOUBLE) AS b FROM e WHERE s1 > s AND s < 400 AND s1 > 100),
p AS (SELECT path_id, a AS d, x + (a - s) / (s1 - s) * (x1 - x) AS px, y + (a - s) / (s1 - s) * (y1 - y) AS py FROM c
 UNION ALL SELECT path_id, b, x + (b - s) / (s1 - s) * (x1 - x), y + (b - s) / (s1 - s) * (y1 - y) FROM c)
SELECT path_id, count(DISTINCT d) AS n, {q("arg_min(px, d)", "1e2")} AS x1, {q("arg_min(py, d)", "1e2")} AS y1, {q("arg_max(px, d)", "1e2")} AS x2, {q("arg_max(py, d)", "1e2")} AS y2,
 {q("max(d) - min(d)", "1e2")} AS length FROM p GROUP BY path_id"""


def path_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = paths.normals(rasters.user_paths(spark, sf_dir))
    return n.select("path_id", F.col("seq").cast("long").alias("seq"), S.quantised(F.col("nx"), 1e4).alias("nx"), S.quantised(F.col("ny"), 1e4).alias("ny"))


NORMAL_SQL = f"""
WITH {sql.PATH}, d AS (SELECT path_id, seq, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM path WINDOW w AS {_P})
SELECT path_id, seq, {q("-dy / sqrt(dx * dx + dy * dy)", "1e4")} AS nx, {q("dx / sqrt(dx * dx + dy * dy)", "1e4")} AS ny FROM d WHERE dx * dx + dy * dy > 0"""


def jump_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths cut where a step is longer than 60, each piece with its points and length."""
    cut = paths.runs(rasters.user_paths(spark, sf_dir), 60.0)
    return cut.groupBy("path_id", "run").agg(F.count("*").alias("n"), F.min("seq").cast("long").alias("first"), S.quantised(F.max("x") - F.min("x"), 1e3).alias("span"))


JUMP_SQL = f"""
WITH {sql.PATH}, j AS (SELECT *, coalesce(CASE WHEN pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) > 3600 THEN 1 ELSE 0 END, 0) AS new FROM path WINDOW w AS {_P}),
r AS (SELECT *, sum(new) OVER (PARTITION BY path_id ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM j)
SELECT path_id, run, count(*) AS n, min(seq) AS first, {q("max(x) - min(x)", "1e3")} AS span FROM r GROUP BY ALL"""


def _strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short paths in order, a layer for each supplier: one or two points from a line item's numbers."""
    li = rasters.table(spark, sf_dir, "lineitem")
    x, y = F.floor(F.col("l_quantity")).cast("double"), F.floor(F.col("l_discount") * 100 + 0.5).cast("double")
    # All that follows goes layer by layer, and needs no other shuffle.
    rows = li.select(F.col("l_suppkey").cast("string").alias("layer"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("path_id"), x.alias("x"), y.alias("y"), "l_partkey")
    rows = rows.repartition(parts(spark, 2 * li.count()), "layer")
    grouped = rows.groupBy("layer", "path_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min("l_partkey").alias("k"))
    ends = F.array(F.struct(F.lit(0).alias("seq"), F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.lit(1).alias("seq"), (F.col("x") + F.pmod("k", F.lit(3))).alias("x"), (F.col("y") + 1).alias("y")))
    return grouped.select("layer", "path_id", F.explode(F.when(F.pmod("path_id", F.lit(7)) == 0, F.slice(ends, 1, 1)).otherwise(ends)).alias("e")).select("layer", "path_id", "e.*")


STROKES = """g AS (SELECT l_suppkey::VARCHAR AS layer, l_orderkey * 10 + l_linenumber AS path_id, min(floor(l_quantity)) AS x, min(floor(l_discount * 100 + 0.5)) AS y, min(l_partkey) AS k
 FROM lineitem GROUP BY ALL),
path AS (SELECT layer, path_id, 0 AS seq, x, y FROM g UNION ALL SELECT layer, path_id, 1, x + k % 3, y + 1 FROM g WHERE path_id % 7 <> 0),
ends AS (SELECT layer, path_id, arg_min(x, seq) AS ax, arg_min(y, seq) AS ay, arg_max(x, seq) AS bx, arg_max(y, seq) AS b_y, count(*) AS n,
  sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS length FROM path GROUP BY ALL)"""


def joined_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that start within 6 of the end before are joined; how many points each has, and where it ends."""
    j = paths.ends_of(paths.joined(_strokes(spark, sf_dir), ["layer"], 6.0), ["layer"])
    return j.select("layer", "path_id", "n", *[S.quantised(v, 1e3).alias(n) for n, v in (("x1", F.col("a.x")), ("y1", F.col("a.y")), ("x2", F.col("b.x")), ("y2", F.col("b.y")))])


JOIN_SQL = f"""
WITH {STROKES}, o AS (SELECT *, coalesce(pow(ax - lag(bx) OVER w, 2) + pow(ay - lag(b_y) OVER w, 2) < 36 AND n > 1, false) AS near FROM ends WINDOW w AS (PARTITION BY layer ORDER BY path_id)),
k AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY layer ORDER BY path_id ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM o)
SELECT layer, grp AS path_id, sum(n - CASE WHEN near THEN 1 ELSE 0 END)::BIGINT AS n, {q("arg_min(ax, path_id)", "1e3")} AS x1, {q("arg_min(ay, path_id)", "1e3")} AS y1,
 {q("arg_max(bx, path_id)", "1e3")} AS x2, {q("arg_max(b_y, path_id)", "1e3")} AS y2 FROM k GROUP BY ALL"""


def path_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = paths.metrics(_strokes(spark, sf_dir), ["layer"])
    return m.select("layer", S.quantised(F.col("drawn"), 1e3).alias("drawn"), S.quantised(F.col("travel"), 1e3).alias("travel"), "paths", "points")


METRIC_SQL = f"""
WITH {STROKES}, t AS (SELECT *, sqrt(pow(ax - coalesce(lag(bx) OVER w, 0), 2) + pow(ay - coalesce(lag(b_y) OVER w, 0), 2)) AS travel FROM ends WINDOW w AS (PARTITION BY layer ORDER BY path_id))
SELECT layer, {q("sum(length)", "1e3")} AS drawn, {q("sum(travel)", "1e3")} AS travel, count(*) AS paths, sum(n)::BIGINT AS points FROM t GROUP BY layer"""


def svg_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _strokes(spark, sf_dir).withColumn("x", F.col("x") / 8.0 - 2).withColumn("y", F.col("y") / 16.0)
    return paths.svg_paths(scaled, ["layer"])


def _num(v: str) -> str:
    t = f"CAST(floor(({v})::DOUBLE * 1000 + 0.5) AS BIGINT)"
    return f"(CASE WHEN {t} < 0 THEN '-' ELSE '' END || regexp_replace(regexp_replace((abs({t}) // 1000)::VARCHAR || '.' || lpad((abs({t}) % 1000)::VARCHAR, 3, '0'), '0+$', ''), '\\.$', ''))"


SVG_SQL = f"""
WITH {STROKES} SELECT layer, path_id, string_agg(CASE WHEN seq = 0 THEN 'M' ELSE 'L' END || {_num("x / 8.0 - 2")} || ' ' || {_num("y / 16.0")}, ' ' ORDER BY seq)
 || CASE WHEN count(*) = 1 THEN ' l0.001 0' ELSE '' END AS d FROM path GROUP BY ALL"""


def svg_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each layer as the lines of an SVG file."""
    scaled = _strokes(spark, sf_dir).select("layer", "path_id", "seq", (F.col("x") / 8.0 - 2).alias("x"), (F.col("y") / 16.0).alias("y"))
    return paths.svg_lines(scaled, "layer", 210.0, 297.0, 0.5)


DRAWING_SQL = f"""
WITH p AS ({SVG_SQL}), b AS (SELECT layer, row_number() OVER (PARTITION BY layer ORDER BY path_id) + 1 AS line, '<path d="' || d || '"/>' AS text FROM p),
n AS (SELECT layer, max(line) AS last FROM b GROUP BY layer)
SELECT layer, line, text FROM b
UNION ALL SELECT layer, 0, '<svg xmlns="http://www.w3.org/2000/svg" width="210mm" height="297mm" viewBox="0 0 210 297">' FROM n
UNION ALL SELECT layer, 1, '<g fill="none" stroke="#000" stroke-linecap="round" stroke-linejoin="round" stroke-width="0.5">' FROM n
UNION ALL SELECT layer, last + 1, '</g>' FROM n UNION ALL SELECT layer, last + 2, '</svg>' FROM n"""


def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping spans of each supplier, in days, joined across gaps of up to 5 days."""
    days = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("double")
    spans = rasters.table(spark, sf_dir, "lineitem").select("l_suppkey", days.alias("lo"), (days + F.col("l_linenumber")).alias("hi"))
    m = geometry.merged(spans, ["l_suppkey"], 5.0)
    return m.select("l_suppkey", F.col("island").alias("island"), S.quantised(F.col("lo"), 1.0).alias("lo"), S.quantised(F.col("hi"), 1.0).alias("hi"), "n")


MERGE_SQL = """
WITH s AS (SELECT l_suppkey, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))::DOUBLE AS lo, l_linenumber FROM lineitem),
i AS (SELECT l_suppkey, lo, lo + l_linenumber AS hi FROM s),
f AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 THEN 1
  WHEN row_number() OVER (PARTITION BY l_suppkey ORDER BY lo, hi) = 1 THEN 1 ELSE 0 END AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM f)
SELECT l_suppkey, island, min(lo)::BIGINT AS lo, max(hi)::BIGINT AS hi, count(*) AS n FROM g GROUP BY ALL"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = rasters.table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("seg_id"), F.pmod("o_custkey", F.lit(53)).cast("double").alias("x1"), F.pmod("o_custkey", F.lit(13)).cast("double").alias("y1"),
        (F.pmod("o_orderkey", F.lit(49)) + 0.25).alias("x2"), (F.pmod("o_orderkey", F.lit(17)) - 1.5).alias("y2"),
    )


SEGMENTS = "seg AS (SELECT o_orderkey AS seg_id, (o_custkey % 53)::DOUBLE AS x1, (o_custkey % 13)::DOUBLE AS y1, o_orderkey % 49 + 0.25::DOUBLE AS x2, o_orderkey % 17 - 1.5::DOUBLE AS y2 FROM orders)"


def clipped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of segments inside a triangle."""
    c = geometry.clipped(_segments(spark, sf_dir), TRIANGLE)
    return c.select("seg_id", F.col("part").cast("long").alias("part"), *[S.quantised(F.col(n), 1e3).alias(n) for n in ("x1", "y1", "x2", "y2")])


def _crossings(ring: list[tuple[float, float]]) -> str:
    rows = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True))
    det = "((x2 - x1) * (qy - py) - (y2 - y1) * (qx - px))"
    return f"""ring(px, py, qx, qy) AS (VALUES {rows}),
hit AS (SELECT seg_id, ((px - x1) * (qy - py) - (py - y1) * (qx - px)) / {det} AS t, ((px - x1) * (y2 - y1) - (py - y1) * (x2 - x1)) / {det} AS u FROM seg, ring WHERE abs({det}) > 1e-12),
stop AS (SELECT seg_id, min(t) AS t FROM (SELECT seg_id, t FROM hit WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 UNION ALL SELECT seg_id, 0.0 FROM seg UNION ALL SELECT seg_id, 1.0 FROM seg) JOIN seg USING (seg_id)
 GROUP BY seg_id, floor((x1 + t * (x2 - x1)) * 1e10 + 0.5), floor((y1 + t * (y2 - y1)) * 1e10 + 0.5)),
piece AS (SELECT seg_id, t AS a, lead(t) OVER (PARTITION BY seg_id ORDER BY t) AS b FROM stop),
line AS (SELECT seg_id, a, x1 + a * (x2 - x1) AS ax, y1 + a * (y2 - y1) AS ay, x1 + b * (x2 - x1) AS bx, y1 + b * (y2 - y1) AS b_y FROM piece JOIN seg USING (seg_id) WHERE b IS NOT NULL)"""


CLIP_SQL = f"""
WITH {SEGMENTS}, {_crossings(TRIANGLE)}
SELECT seg_id, row_number() OVER (PARTITION BY seg_id ORDER BY a) - 1 AS part, {q("ax", "1e3")} AS x1, {q("ay", "1e3")} AS y1, {q("bx", "1e3")} AS x2, {q("b_y", "1e3")} AS y2
FROM line WHERE {sql.inside("((ax + bx) / 2)", "((ay + b_y) / 2)", TRIANGLE)}"""


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon of each sixty customers in a row: their balances about a circle."""
    c = rasters.table(spark, sf_dir, "customer").withColumn("poly_id", F.floor(F.col("c_custkey") / 60))
    k = Window.partitionBy("poly_id").orderBy("c_custkey")
    n = F.count("*").over(Window.partitionBy("poly_id"))
    turn = 2 * math.pi * (F.row_number().over(k) - 1) / n
    r = 50 + F.col("c_acctbal") / 500
    return c.select("poly_id", F.row_number().over(k).alias("k"), (r * F.cos(turn)).alias("x"), (r * F.sin(turn)).alias("y"))


RINGS = """turn AS (SELECT c_custkey // 60 AS poly_id, row_number() OVER (PARTITION BY c_custkey // 60 ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_custkey // 60) AS n, 50 + c_acctbal / 500 AS r
 FROM customer),
poly AS (SELECT poly_id, k, r * cos(2 * pi() * (k - 1) / n) AS x, r * sin(2 * pi() * (k - 1) / n) AS y FROM turn),
edge AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM poly WINDOW w AS (PARTITION BY poly_id ORDER BY k))"""


def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = _rings(spark, sf_dir)
    m = geometry.measures(ring, ["poly_id"]).join(geometry.convex(ring, ["poly_id"]), "poly_id")
    return m.select("poly_id", "convex", *[S.quantised(F.col(c), 1e3).alias(c) for c in ("perimeter", "area", "cx", "cy", "lo_x", "hi_x", "lo_y", "hi_y")])


POLYGON_SQL = f"""
WITH {RINGS}, t AS (SELECT *, coalesce(lead(x2) OVER w, first(x2) OVER w) AS x3, coalesce(lead(y2) OVER w, first(y2) OVER w) AS y3 FROM edge WINDOW w AS (PARTITION BY poly_id ORDER BY k)),
g AS (SELECT *, x * y2 - x2 * y AS c, (x2 - x) * (y3 - y2) - (y2 - y) * (x3 - x2) AS z FROM t)
SELECT poly_id, NOT (max(z) > 1e-12 AND min(z) < -1e-12) AS convex, {q("sum(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)))", "1e3")} AS perimeter, {q("abs(sum(c)) / 2", "1e3")} AS area,
 {q("CASE WHEN abs(sum(c)) < 1e-12 THEN avg(x) ELSE sum((x + x2) * c) / (3 * sum(c)) END", "1e3")} AS cx, {q("CASE WHEN abs(sum(c)) < 1e-12 THEN avg(y) ELSE sum((y + y2) * c) / (3 * sum(c)) END", "1e3")} AS cy,
 {q("min(x)", "1e3")} AS lo_x, {q("max(x)", "1e3")} AS hi_x, {q("min(y)", "1e3")} AS lo_y, {q("max(y)", "1e3")} AS hi_y FROM g GROUP BY poly_id"""


def chord_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = geometry.chords(_rings(spark, sf_dir).select(F.col("poly_id").alias("ring"), F.col("k").alias("i"), "x", "y"), 40.0)
    return c.select("ring", "n", S.quantised(F.col("mean_length"), 1e3).alias("mean_length"))


CHORD_SQL = f"""
WITH {RINGS} SELECT a.poly_id AS ring, count(*) AS n, {q("avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)))", "1e3")} AS mean_length
FROM poly a JOIN poly b ON a.poly_id = b.poly_id AND a.k < b.k WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) >= 40 GROUP BY a.poly_id"""


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean direction of the first two components of each label's vectors."""
    e = rasters.table(spark, sf_dir, "embeddings").select("label", F.atan2(F.col("embedding")[1].cast("double"), F.col("embedding")[0].cast("double")).alias("t"))
    return geometry.mean_direction(e, ["label"], "t").select("label", S.quantised(F.col("theta"), 1e4).alias("theta"))


DIRECTION_SQL = f"""
WITH e AS (SELECT label, atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE) AS t FROM embeddings), g AS (SELECT label, atan2(sum(sin(2 * t)), sum(cos(2 * t))) / 2 AS t FROM e GROUP BY label)
SELECT label, {q("CASE WHEN t < 0 THEN t + pi() ELSE t END", "1e4")} AS theta FROM g"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours among triangles: two for each cell of a supplier's raster that has line items."""
    # Neither grids nor counts are needed: cells with line items are those of their pixels.
    n = rasters.table(spark, sf_dir, "lineitem").count()
    cell = rasters.lineitem_cells(spark, sf_dir, F.col("l_suppkey")).where("img is not null")
    cell = cell.repartition(parts(spark, n), "img", "ix", "iy").distinct()
    a = (F.col("img").cast("long") * (LI_H + 1) + F.col("iy")) * (LI_W + 1) + F.col("ix")
    two = F.array(F.struct(F.lit(0).alias("h"), a.alias("v0"), (a + 1).alias("v1"), (a + LI_W + 1).alias("v2")), F.struct(F.lit(1).alias("h"), (a + 1).alias("v0"), (a + LI_W + 2).alias("v1"), (a + LI_W + 1).alias("v2")))
    number = (F.col("img").cast("long") * LI_H + F.col("iy")) * LI_W + F.col("ix")
    f = cell.select(number.alias("n"), F.explode(two).alias("t")).select((F.col("n") * 2 + F.col("t.h")).alias("f"), "t.v0", "t.v1", "t.v2")
    return geometry.face_neighbours(f, parts(spark, 6 * n))


FACE_SQL = f"""
WITH {sql.SUPPLIER_LI}, c AS (SELECT (img * {LI_H} + iy) * {LI_W} + ix AS n, (img * {LI_H + 1} + iy) * {LI_W + 1} + ix AS a FROM li WHERE v < 1),
f AS (SELECT n * 2 AS f, a AS v0, a + 1 AS v1, a + {LI_W + 1} AS v2 FROM c UNION ALL SELECT n * 2 + 1, a + 1, a + {LI_W + 2}, a + {LI_W + 1} FROM c),
e AS (SELECT f, 0 AS k, v1 AS a, v2 AS b FROM f UNION ALL SELECT f, 1, v2, v0 FROM f UNION ALL SELECT f, 2, v0, v1 FROM f)
SELECT e.f, e.k, least(e.a, e.b) AS lo, greatest(e.a, e.b) AS hi, CASE WHEN e.a < e.b THEN 1 ELSE -1 END AS sign, o.f AS other
FROM e LEFT JOIN e o ON o.f <> e.f AND least(o.a, o.b) = least(e.a, e.b) AND greatest(o.a, o.b) = greatest(e.a, e.b)"""


def interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's price looked up in its priority's table of customers' balances against quantiles."""
    knots = rasters.table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), "p_size", "p_retailprice").groupBy("key", "p_size").agg(F.max("p_retailprice").alias("y"))
    knots = knots.select("key", F.col("p_size").cast("double").alias("x"), "y")
    values = rasters.table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("id"), (F.pmod("p_partkey", F.lit(613)) / 11.0 - 2).alias("u"))
    return lookup.interpolated(values, knots, ["key"], 8.0).select("key", "id", S.quantised(F.col("y"), 1e3).alias("y"))


INTERPOLATION_SQL = f"""
WITH k AS (SELECT p_brand AS key, p_size::DOUBLE AS x, max(p_retailprice) AS y FROM part GROUP BY ALL),
s AS (SELECT key, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, max(x) OVER (PARTITION BY key) AS hi, min(x) OVER (PARTITION BY key) AS lo FROM k WINDOW w AS (PARTITION BY key ORDER BY x)),
v AS (SELECT p_brand AS key, p_partkey AS id, (p_partkey % 613) / 11.0::DOUBLE - 2 AS u FROM part)
SELECT v.key, v.id, {q("y0 + (greatest(lo, least(hi, u)) - x0) / (x1 - x0) * (y1 - y0)", "1e3")} AS y FROM v JOIN s ON s.key = v.key AND x1 IS NOT NULL
 AND greatest(lo, least(hi, u)) >= x0 AND (greatest(lo, least(hi, u)) < x1 OR (greatest(lo, least(hi, u)) = x1 AND x1 = hi))"""


def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells marked where a serpentine running sum of mark shares passes a whole number."""
    share = S.mark_fraction(1 - F.col("v"), 0.9, 0.3)
    order = Window.partitionBy("img").orderBy("iy", F.when(F.col("iy") % 2 == 1, -F.col("ix")).otherwise(F.col("ix")))
    # Shares in whole units of 1e-9, so that a running sum doesn't depend on the order of adding.
    cell = rasters.lineitem_raster(spark, sf_dir).withColumn("p", S.quantised(share, 1e9))
    c = cell.select("img", "ix", "iy", (F.row_number().over(order) - 1).alias("k"), F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    ahead = c.withColumn("after", F.lead("c").over(Window.partitionBy("img").orderBy("k"))).withColumn("most", F.max("c").over(Window.partitionBy("img")))
    first = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("c") / 1e9))
    hit = (F.coalesce(first * 1000000000 < F.col("after"), F.lit(True))) & (first * 1000000000 <= F.col("most"))
    return ahead.where(hit).select("img", F.col("k").cast("long").alias("k"), "ix", "iy", "c")


CROSSING_SQL = f"""
WITH {sql.LI}, p AS (SELECT *, CAST(floor((1.2 - sqrt(1.44 - 1.2 * greatest(0, least(0.9, 1 - v)))) / 0.6 * 1e9 + 0.5) AS BIGINT) AS p FROM li),
c AS (SELECT img, ix, iy, row_number() OVER w - 1 AS k, (sum(p) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS c FROM p WINDOW w AS (PARTITION BY img ORDER BY iy, CASE WHEN iy % 2 = 1 THEN -ix ELSE ix END)),
a AS (SELECT *, lead(c) OVER (PARTITION BY img ORDER BY k) AS after, max(c) OVER (PARTITION BY img) AS most, greatest(1, ceil(c / 1e9::DOUBLE))::BIGINT * 1000000000 AS v0 FROM c)
SELECT img, k, ix, iy, c FROM a WHERE (after IS NULL OR v0 < after) AND v0 <= most"""


def diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-dimensional error diffusion along each row of pixels: ink where the carried darkness reaches a half."""
    li = rasters.lineitem_raster(spark, sf_dir)
    line = li.groupBy("img", "iy").agg(F.array_sort(F.collect_list(F.struct("ix", S.quantised(1 - F.col("v")).alias("k")))).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<int>").alias("dots"))

    def step(a: Column, p: Column) -> Column:
        total = a["carry"] + p["k"]
        dot = (total >= 500000).cast("int")
        return F.struct((total - dot * 1000000).cast("long").alias("carry"), F.concat(a["dots"], F.array(dot)).alias("dots"))

    dots = line.select("img", "iy", F.posexplode(F.aggregate("s", start, step, lambda a: a["dots"])).alias("ix", "dot"))
    return dots.select("img", "ix", "iy", "dot")


DIFFUSION_SQL = f"""
WITH RECURSIVE {sql.LI}, k AS (SELECT img, ix, iy, {q("1 - v")} AS k FROM li),
r AS (SELECT img, ix, iy, CASE WHEN k >= 500000 THEN 1 ELSE 0 END AS dot, k - CASE WHEN k >= 500000 THEN 1000000 ELSE 0 END AS carry FROM k WHERE ix = 0
 UNION ALL SELECT k.img, k.ix, k.iy, CASE WHEN r.carry + k.k >= 500000 THEN 1 ELSE 0 END, r.carry + k.k - CASE WHEN r.carry + k.k >= 500000 THEN 1000000 ELSE 0 END
 FROM r JOIN k ON k.img = r.img AND k.iy = r.iy AND k.ix = r.ix + 1)
SELECT img, ix, iy, dot FROM r"""


QUERIES = {
    "arc_length_path": (arc_lengths, ARC_SQL),
    "resample_path": (resampled, RESAMPLE_SQL),
    "subpath_path": (middle_parts, PART_SQL),
    "normals_path": (path_normals, NORMAL_SQL),
    "jump_runs_path": (jump_runs, JUMP_SQL),
    "join_paths_li": (joined_paths, JOIN_SQL),
    "path_metrics_li": (path_metrics, METRIC_SQL),
    "svg_paths_li": (svg_texts, SVG_SQL),
    "svg_lines_li": (svg_drawing, DRAWING_SQL),
    "merge_intervals_li": (merged_intervals, MERGE_SQL),
    "clip_segments_orders": (clipped_segments, CLIP_SQL),
    "polygon_measures_customer": (polygon_measures, POLYGON_SQL),
    "chord_stats_customer": (chord_stats, CHORD_SQL),
    "mean_direction_emb": (directions, DIRECTION_SQL),
    "face_neighbours_supplier": (faces, FACE_SQL),
    "asof_table_part": (interpolation, INTERPOLATION_SQL),
    "serpentine_crossings_li": (crossings, CROSSING_SQL),
    "error_diffusion_li": (diffusion, DIFFUSION_SQL),
}
