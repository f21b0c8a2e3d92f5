"""Queries over the order-dependent and iterative operators; their SQL, where it exists, checks what must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import iterative, kernels, paths, trees
from plumbline.operators.rounds import parts
from plumbline.plans import sql
from plumbline.plans.sql import q
from plumbline.plans.strokes import STROKES, _strokes
from plumbline.sources import rasters


def geodesics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = rasters.lineitem_raster(spark, sf_dir).withColumn("v", 1 + 5 * F.col("v"))
    d = iterative.geodesic(li, li.where("ix % 12 = 3 and iy % 5 = 2"))
    return d.select("img", "ix", "iy", S.quantised(F.col("d"), 1e4).alias("d"))


#: Rounds of relaxation: no pixel is more than 24 useful steps from a seed.
GEODESIC_SQL = f"""
WITH RECURSIVE {sql.LI}, w AS (SELECT img, ix, iy, 1 + 5 * v AS v FROM li),
r AS (SELECT 0 AS k, img, ix, iy, v, CASE WHEN ix % 12 = 3 AND iy % 5 = 2 THEN 0.0::DOUBLE ELSE 1e9::DOUBLE END AS d FROM w
 UNION ALL SELECT k + 1, img, ix, iy, v, d FROM (SELECT a.k, b.img, b.ix, b.iy, b.v, min(a.d + (a.v + b.v) / 2 * sqrt((a.ix - b.ix) * (a.ix - b.ix) + (a.iy - b.iy) * (a.iy - b.iy))) AS d
  FROM r a JOIN w b ON a.img = b.img AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 WHERE a.k < 24 GROUP BY ALL))
SELECT img, ix, iy, {q("d", "1e4")} AS d FROM r WHERE k = 24"""


def _near_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between suppliers and their neighbours in a ring, with made-up weights that are all different."""
    n = rasters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.explode(F.array(F.lit(1), F.lit(7), F.lit(31))).alias("step"), "s_nationkey")
    b = F.col("a") + F.col("step") * (1 + F.col("s_nationkey") % 3)
    return n.select("a", b.alias("b"), (F.pmod(F.col("a") * 7919 + b * 104729, F.lit(1000003)) + F.col("a") / 1e6).alias("w"))


def forests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterative.forest(_near_edges(spark, sf_dir)).select("a", "b", S.quantised(F.col("w"), 1e3).alias("w"))


#: An edge belongs to the least forest unless lighter edges already join its ends.
FOREST_SQL = f"""
WITH RECURSIVE n AS (SELECT s_suppkey AS a, s_suppkey + step * (1 + s_nationkey % 3) AS b FROM supplier, (VALUES (1), (7), (31)) k(step)),
e AS (SELECT a, b, min((a * 7919 + b * 104729) % 1000003 + a / 1e6::DOUBLE) AS w FROM n GROUP BY ALL),
both_ AS (SELECT a AS x, b AS y, a, b, w FROM e UNION ALL SELECT b, a, a, b, w FROM e),
r(ea, eb, ew, node) AS (SELECT a, b, w, a FROM e UNION SELECT r.ea, r.eb, r.ew, o.y FROM r JOIN both_ o ON o.x = r.node AND (o.w, o.a, o.b) < (r.ew, r.ea, r.eb))
SELECT a, b, {q("w", "1e3")} AS w FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.ea = e.a AND r.eb = e.b AND r.node = e.b)"""


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest of the edges up to a length, as strokes along its heavy paths."""
    short = _near_edges(spark, sf_dir).where(F.col("w") <= CUT).select("a", "b", "w")
    edges = iterative.forest(short).select("a", "b", F.col("w").alias("len"))
    return trees.heavy_paths(edges).select("path", F.col("seq").cast("long").alias("seq"), "node")


#: Edges longer than this are left out of the strokes.
CUT = 700_000
_LEAST = FOREST_SQL[: FOREST_SQL.rindex("\nSELECT a, b")]
TREE_SQL = f"""{_LEAST.replace("FROM n GROUP BY ALL)", f"FROM n GROUP BY ALL HAVING w <= {CUT})")},
f AS MATERIALIZED (SELECT a, b, w FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.ea = e.a AND r.eb = e.b AND r.node = e.b)),
l AS (SELECT a AS x, b AS y, w FROM f UNION ALL SELECT b, a, w FROM f),
reach(x, y) AS (SELECT x, x FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y),
t(node, parent, w, depth) AS (SELECT x, NULL::BIGINT, 0::DOUBLE, 0 FROM reach GROUP BY x HAVING min(y) = x
 UNION ALL SELECT l.y, l.x, l.w, t.depth + 1 FROM t JOIN l ON l.x = t.node WHERE l.y IS DISTINCT FROM t.parent),
up(node, anc, len) AS (SELECT node, node, 0::DOUBLE FROM t UNION ALL SELECT up.node, t.parent, up.len + t.w FROM up JOIN t ON t.node = up.anc WHERE t.parent IS NOT NULL),
h AS (SELECT anc AS node, max(len) AS h FROM up GROUP BY anc),
hv AS (SELECT node FROM (SELECT t.node, row_number() OVER (PARTITION BY t.parent ORDER BY h.h DESC, t.node) AS k FROM t JOIN h ON h.node = t.node WHERE t.parent IS NOT NULL) WHERE k = 1),
p(path, seq, node) AS (SELECT node, CASE WHEN parent IS NULL THEN 0 ELSE 1 END, node FROM t WHERE node NOT IN (SELECT node FROM hv)
 UNION ALL SELECT p.path, p.seq + 1, t.node FROM p JOIN t ON t.parent = p.node WHERE t.node IN (SELECT node FROM hv))
SELECT path, seq::BIGINT AS seq, node FROM p UNION ALL SELECT t.node, 0, t.parent FROM t WHERE parent IS NOT NULL AND node NOT IN (SELECT node FROM hv)"""


def subdivisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = rasters.lineitem_raster(spark, sf_dir).withColumn("m", S.quantised(1 - F.col("v")))
    p = iterative.subdivided(li, 60)
    return p.select("img", "path", "n", S.quantised(F.col("x"), 1e4).alias("x"), S.quantised(F.col("y"), 1e4).alias("y"))


SUBDIVIDE_SQL = f"""
WITH RECURSIVE {sql.LI}, ink AS (SELECT img, ix, iy, {q("1 - v")} AS m FROM li WHERE {q("1 - v")} > 0),
n AS (SELECT img, least(60, count(*))::INT AS n FROM ink GROUP BY img),
t AS (SELECT img, '' AS path, n, list({{'x': ix, 'y': iy, 'm': m}}) AS p FROM ink JOIN n USING (img) GROUP BY img, n
 UNION ALL SELECT img, path || h, CASE h WHEN 'A' THEN na ELSE n - na END, CASE h WHEN 'A' THEN pa ELSE pb END FROM (
  SELECT *, ((2 * n * ma + ma + mb) // (2 * (ma + mb)))::INT AS na FROM (
  SELECT *, coalesce(list_sum(list_transform(pa, lambda c: c.m)), 0) AS ma, coalesce(list_sum(list_transform(pb, lambda c: c.m)), 0) AS mb FROM (
  SELECT img, path, n, list_filter(p, lambda c: CASE WHEN wide THEN c.x < cx ELSE c.y < cy END) AS pa, list_filter(p, lambda c: NOT CASE WHEN wide THEN c.x < cx ELSE c.y < cy END) AS pb FROM (
  SELECT *, hx - lx >= hy - ly AS wide, lx + (hx - lx + 2) // 2 AS cx, ly + (hy - ly + 2) // 2 AS cy FROM (
  SELECT *, list_min(list_transform(p, lambda c: c.x)) AS lx, list_max(list_transform(p, lambda c: c.x)) AS hx, list_min(list_transform(p, lambda c: c.y)) AS ly, list_max(list_transform(p, lambda c: c.y)) AS hy
  FROM t WHERE n > 1 AND len(p) > 1))))), (VALUES ('A'), ('B')) k(h) WHERE CASE h WHEN 'A' THEN na ELSE n - na END > 0)
SELECT img, path, n, {q("list_sum(list_transform(p, lambda c: c.m * (c.x + 1))) / list_sum(list_transform(p, lambda c: c.m))", "1e4")} AS x,
 {q("list_sum(list_transform(p, lambda c: c.m * (c.y + 1))) / list_sum(list_transform(p, lambda c: c.m))", "1e4")} AS y FROM t WHERE n = 1 OR len(p) = 1"""


def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = paths.ends_of(_strokes(spark, sf_dir), ["layer"])
    return kernels.visiting_order(e.select("layer", "path_id", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by_")), "layer", parts(spark, rasters.table(spark, sf_dir, "lineitem").count()))


def order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any order of paths must hold: each is visited once, at gapless places."""
    return path_order(spark, sf_dir).groupBy("layer").agg(F.count_distinct("path_id").alias("paths"), F.min("place").alias("first"), F.max("place").alias("last"))


ORDER_SQL = f"WITH {STROKES} SELECT layer, count(*) AS paths, 0::BIGINT AS first, count(*) - 1 AS last FROM ends GROUP BY layer"


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = kernels.packed_circles(rasters.lineitem_raster(spark, sf_dir), 0.8, 3.0)
    return c.select("img", *[S.quantised(F.col(n), 1e4).alias(n) for n in ("x", "y", "r")])


def dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.spread_error(rasters.event_raster(spark, sf_dir))


def dash_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = rasters.lineitem_raster(spark, sf_dir).select("img", F.col("iy").alias("line"), F.col("ix").alias("k"), (1 - F.col("v")).alias("owed"))
    return kernels.dashes(li, 0.5, 2.0, 1.0).select("img", "line", S.quantised(F.col("a"), 1e3).alias("a"), S.quantised(F.col("b"), 1e3).alias("b"))


def meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rasters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("label").cast("long").alias("key"))
    return kernels.triangles(e.join(rasters.embedding_points(spark, sf_dir), "pid"))


def scatters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = kernels.scattered(rasters.lineitem_raster(spark, sf_dir), 80)
    return p.select("img", "k", S.quantised(F.col("x"), 1e4).alias("x"), S.quantised(F.col("y"), 1e4).alias("y"))


def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = paths.simplified(rasters.user_paths(spark, sf_dir), 8.0)
    return s.select("path_id", "seq", S.quantised(F.col("x"), 1e3).alias("x"), S.quantised(F.col("y"), 1e3).alias("y"))


QUERIES = {
    "geodesic_li": (geodesics, GEODESIC_SQL),
    "forest_supplier": (forests, FOREST_SQL),
    "tree_paths_supplier": (tree_paths, TREE_SQL),
    "subdivide_li": (subdivisions, SUBDIVIDE_SQL),
    "path_order_li": (path_order, None),
    "path_order_counts_li": (order_counts, ORDER_SQL),
    "circle_packing_li": (circles, None),
    "error_diffusion_2d_ev": (dots, None),
    "dash_strokes_li": (dash_strokes, None),
    "delaunay_emb": (meshes, None),
    "scatter_points_li": (scatters, None),
    "simplify_path": (simple_paths, None),
}
