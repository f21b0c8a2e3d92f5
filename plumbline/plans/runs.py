"""Queries over parts of paths: clipped, kept by a mask, stepped, and dots drawn as one stroke."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import paths
from plumbline.plans import sql
from plumbline.plans.sql import q
from plumbline.plans.strokes import _P, _crossings
from plumbline.sources import rasters
from plumbline.sources.rasters import LI_H, LI_W

FIELD = [(24.0, 5.0), (600.0, 2.0), (500.0, 90.0), (300.0, 40.0), (100.0, 60.0)]
STEP, LEAST, DARK, PEN = 40.0, 3, 0.75, 0.8


def _out(df: DataFrame, keys: list[str], scale: float) -> DataFrame:
    return df.select(*[F.col(k).cast("long").alias(k) for k in keys], *[S.quantised(F.col(c), scale).alias(c) for c in ("x", "y")])


def clipped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each user's path inside a polygon that isn't convex."""
    return _out(paths.clipped(rasters.user_paths(spark, sf_dir), FIELD), ["path_id", "run", "seq"], 1e2)


def clip_sql(source: str, ring: list[tuple[float, float]]) -> str:
    """``pt``, the points (path_id, run, seq, a, e, x, y) of what is inside a polygon of the paths in ``source``."""
    return f"""seg AS (SELECT {{'p': path_id, 's': seq}} AS seg_id, x AS x1, y AS y1, x2, y2 FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM {source} WINDOW w AS {_P}) WHERE x2 IS NOT NULL),
{_crossings(ring)},
pc AS (SELECT seg_id.p AS path_id, seg_id.s AS seq, a, ax, ay, bx, b_y FROM line WHERE {sql.inside("((ax + bx) / 2)", "((ay + b_y) / 2)", ring)}),
nw AS (SELECT *, CASE WHEN pow(ax - lag(bx) OVER w, 2) + pow(ay - lag(b_y) OVER w, 2) <= 1e-18 THEN 0 ELSE 1 END AS new FROM pc WINDOW w AS (PARTITION BY path_id ORDER BY seq, a)),
rn AS (SELECT *, sum(new) OVER (PARTITION BY path_id ORDER BY seq, a ROWS UNBOUNDED PRECEDING) AS run FROM nw),
pt AS (SELECT path_id, run, seq, a, 1 AS e, bx AS x, b_y AS y FROM rn UNION ALL SELECT path_id, run, seq, a, 0, ax, ay FROM rn WHERE new = 1)"""


CLIP_SQL = f"""
WITH {sql.PATH}, {clip_sql("path", FIELD)}
SELECT path_id, run::BIGINT AS run, row_number() OVER (PARTITION BY path_id, run ORDER BY seq, a, e) - 1 AS seq, {q("x", "1e2")} AS x, {q("y", "1e2")} AS y FROM pt"""


def kept_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's points, taken as a path, where they lie on dark pixels, in runs of three or more."""
    e = rasters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("label").alias("path_id")).join(rasters.embedding_points(spark, sf_dir), "pid")
    path = e.select("path_id", (F.row_number().over(Window.partitionBy("path_id").orderBy("pid")) - 1).alias("seq"), "x", "y")
    dark = rasters.whole_lineitem_raster(spark, sf_dir).where(F.col("v") < DARK)
    return _out(paths.kept_runs(path, dark, LI_W, LI_H, LEAST), ["path_id", "run", "seq"], 1e4)


KEPT_SQL = f"""
WITH {sql.LI_WHOLE}, {sql.EMB}, p AS (SELECT label AS path_id, row_number() OVER (PARTITION BY label ORDER BY pid) - 1 AS seq, x, y FROM emb JOIN embeddings ON vec_id = pid),
o AS (SELECT path_id, seq, x, y, seq - row_number() OVER (PARTITION BY path_id ORDER BY seq) AS island FROM p JOIN li ON ix = floor(x + 0.5) - 1 AND iy = floor(y + 0.5) - 1 WHERE v < {DARK}),
s AS (SELECT *, count(*) OVER (PARTITION BY path_id, island) AS size FROM o)
SELECT path_id::BIGINT AS path_id, dense_rank() OVER (PARTITION BY path_id ORDER BY island) AS run, seq, {q("x", "1e4")} AS x, {q("y", "1e4")} AS y FROM s WHERE size >= {LEAST}"""


def stepped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at a fixed step along each path, the rest left over."""
    return _out(paths.stepped(rasters.user_paths(spark, sf_dir), STEP), ["path_id", "seq"], 1e2)


STEP_SQL = f"""
WITH {sql.PATH}, {sql.LENGTH}, e AS (SELECT path_id, x, y, s, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(s) OVER w AS s1 FROM len WINDOW w AS {_P}),
k AS (SELECT path_id, unnest(range(floor(max(s) / {STEP})::BIGINT + 1)) AS k FROM len GROUP BY path_id)
SELECT k.path_id, k AS seq, {q(f"x + (k * {STEP} - s) / (s1 - s) * (x1 - x)", "1e2")} AS x, {q(f"y + (k * {STEP} - s) / (s1 - s) * (y1 - y)", "1e2")} AS y
FROM k JOIN e ON e.path_id = k.path_id AND s1 > s AND k * {STEP} <= s1 AND (k * {STEP} > s OR (k = 0 AND s = 0))"""


def dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dot of each supplier's size, drawn as one stroke."""
    d = rasters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path_id"), F.lit(10.0).alias("x"), F.lit(20.0).alias("y"), (0.4 + F.abs("s_acctbal") / 2500).alias("r"))
    return _out(paths.dot_strokes(d, PEN), ["path_id", "seq"], 1e3)


_SAG = 0.03 * PEN
_NEXT = f"least(1, greatest(0.02, sqrt({8 * _SAG!r}::DOUBLE / greatest({PEN / (2 * math.pi)!r}::DOUBLE * t, {_SAG!r}::DOUBLE))))"
DOT_SQL = f"""
WITH RECURSIVE d AS (SELECT s_suppkey AS path_id, 0.4::DOUBLE + abs(s_acctbal)::DOUBLE / 2500 AS r FROM supplier),
n AS (SELECT *, greatest(8, ceil(2 * pi() / least(1, 2 * acos(greatest(-1, 1 - {_SAG!r}::DOUBLE / (r - {PEN / 2}::DOUBLE))))))::INT AS n FROM d WHERE r - {PEN / 2}::DOUBLE > {_SAG!r}::DOUBLE),
c AS (SELECT *, n / 2.0::DOUBLE * sin(2 * pi() / n) AS c1, 2.0::DOUBLE * n * sin(pi() / n) * {PEN / 2}::DOUBLE AS b FROM n),
g AS (SELECT *, (sqrt(b * b - 4 * c1 * ({math.pi * PEN * PEN / 4!r}::DOUBLE - pi() * r * r)) - b) / (2 * c1) AS ring FROM c),
w AS (SELECT path_id, n, ring, 2 * pi() * ring / {PEN}::DOUBLE AS total FROM g),
t AS (SELECT path_id, 0 AS k, 0.0::DOUBLE AS t, total FROM w UNION ALL SELECT path_id, k + 1, t + {_NEXT}, total FROM t WHERE t + {_NEXT} < total),
m AS (SELECT path_id, max(k) + 1 AS k0 FROM t GROUP BY path_id),
p AS (SELECT path_id, k AS seq, {PEN / (2 * math.pi)!r}::DOUBLE * t AS rho, t FROM t
 UNION ALL SELECT w.path_id, k0 + i, ring, total + 2 * pi() * i / n FROM w JOIN m USING (path_id), range(200) r(i) WHERE i <= n
 UNION ALL SELECT path_id, 0, 0, 0 FROM d WHERE NOT r - {PEN / 2}::DOUBLE > {_SAG!r}::DOUBLE)
SELECT path_id, seq::BIGINT AS seq, {q("10 + rho * cos(t)", "1e3")} AS x, {q("20 + rho * sin(t)", "1e3")} AS y FROM p"""


QUERIES = {
    "clip_paths_path": (clipped_paths, CLIP_SQL),
    "kept_runs_emb": (kept_paths, KEPT_SQL),
    "stepped_path": (stepped_paths, STEP_SQL),
    "dot_strokes_supplier": (dots, DOT_SQL),
}
