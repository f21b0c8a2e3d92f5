"""Queries over contours: the level lines of each supplier's smoothed raster, and their lengths and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import contours, raster
from plumbline.plans import sql
from plumbline.plans.sql import q
from plumbline.sources import rasters
from plumbline.sources.rasters import LI_H, LI_W

#: Levels between the steps of a thousandth to which the field is rounded, so that no pixel lies on one.
LEVELS, SIZE, SIGMA = [0.7505, 0.8005, 0.8505], 5, 1.2


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed quantity by discount, an image for each supplier."""
    smooth = raster.blur(rasters.supplier_raster(spark, sf_dir), SIZE, SIGMA)
    return smooth.select("img", "ix", "iy", (S.quantised(F.col("v").cast("double"), 1e3) / 1e3).alias("v"))


def level_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every level line, point by point: open ones from border to border, closed ones with their first point at the end."""
    made = contours.lines(field(spark, sf_dir), LEVELS, LI_W)
    return made.select("img", S.quantised(F.col("level"), 1e4).alias("level"), "line", F.col("seq").cast("long").alias("seq"), F.col("closed").cast("int").alias("closed"), *[S.quantised(F.col(c), 1e3).alias(c) for c in "xy"])


def _lines_sql() -> str:
    t = lambda a, b: f"(level - {a}) / ({b} - {a})"
    k = f"2 * (iy::BIGINT * {LI_W} + ix)"
    sides = [(k, f"ix + 1 + {t('tl', 'tr')}", "iy + 1"), (f"{k} + 3", "ix + 2", f"iy + 1 + {t('tr', 'br')}"), (f"{k} + {2 * LI_W}", f"ix + 1 + {t('bl', 'br')}", "iy + 2"), (f"{k} + 1", "ix + 1", f"iy + 1 + {t('tl', 'bl')}")]
    at = lambda i: "CASE s " + " ".join(f"WHEN {n} THEN {side[i]}" for n, side in enumerate(sides)) + " END"
    return f"""{sql.SUPPLIER_LI}, {sql.blur("b", "li", SIZE, SIGMA, LI_W, LI_H)},
f AS MATERIALIZED (SELECT img, ix, iy, floor(v::DOUBLE * 1000 + 0.5) / 1000 AS v FROM b),
c AS (SELECT a.img, level, a.ix, a.iy, a.v AS tl, b.v AS tr, c.v AS bl, d.v AS br FROM f a, (SELECT unnest({LEVELS}::DOUBLE[]) AS level), f b, f c, f d
 WHERE b.img = a.img AND b.ix = a.ix + 1 AND b.iy = a.iy AND c.img = a.img AND c.ix = a.ix AND c.iy = a.iy + 1 AND d.img = a.img AND d.ix = a.ix + 1 AND d.iy = a.iy + 1),
h AS (SELECT *, tl >= level AS h1, tr >= level AS h2, br >= level AS h3, bl >= level AS h4, (tl + tr + bl + br) / 4 >= level AS mid FROM c),
p AS (SELECT *, CASE WHEN h1 = h3 AND h2 = h4 AND h1 <> h2 THEN CASE WHEN h1 = mid THEN [[0, 1], [2, 3]] ELSE [[0, 3], [1, 2]] END
  ELSE [list_filter([0, 1, 2, 3], lambda s: CASE s WHEN 0 THEN h1 <> h2 WHEN 1 THEN h2 <> h3 WHEN 2 THEN h3 <> h4 ELSE h1 <> h4 END)] END AS pairs FROM h WHERE NOT (h1 = h2 AND h2 = h3 AND h3 = h4)),
e AS (SELECT row_number() OVER () AS seg, * FROM (SELECT * EXCLUDE pairs, unnest(pairs) AS pair FROM p)),
n AS MATERIALIZED (SELECT seg, img, level, {at(0)} AS node, {at(1)} AS x, {at(2)} AS y FROM (SELECT *, unnest(pair) AS s FROM e)),
lk AS MATERIALIZED (SELECT a.img, a.level, a.node AS u, b.node AS v FROM n a JOIN n b ON a.seg = b.seg AND a.node <> b.node),
deg AS (SELECT img, level, u, count(*) AS n, min(v) AS lo FROM lk GROUP BY ALL),
walk AS (SELECT img, level, u AS line, 0::BIGINT AS seq, -1::BIGINT AS prev, u AS cur, false AS closed FROM deg WHERE n = 1
  UNION ALL SELECT img, level, u, 1, u, lo, true FROM deg WHERE n = 2
  UNION ALL SELECT w.img, w.level, w.line, w.seq + 1, w.cur, lk.v, w.closed FROM walk w JOIN lk ON lk.img = w.img AND lk.level = w.level AND lk.u = w.cur AND lk.v <> w.prev WHERE NOT w.closed OR w.cur > w.line),
good AS (SELECT img, level, line, closed FROM walk GROUP BY ALL HAVING CASE WHEN closed THEN min(cur) = line ELSE max_by(cur, seq) > line END),
pts AS (SELECT w.img, w.level, w.line, w.seq, w.cur, w.closed FROM walk w JOIN good USING (img, level, line, closed) UNION ALL SELECT img, level, line, 0, line, true FROM good WHERE closed)"""


LINES_SQL = f"""WITH RECURSIVE {_lines_sql()}
SELECT pts.img, {q("pts.level", "1e4")} AS level, line, seq, pts.closed::INT AS closed, {q("x", "1e3")} AS x, {q("y", "1e3")} AS y
FROM pts JOIN (SELECT img, level, node, min(x) AS x, min(y) AS y FROM n GROUP BY ALL) m ON m.img = pts.img AND m.level = pts.level AND m.node = pts.cur"""


QUERIES = {"contour_lines_supplier": (level_lines, LINES_SQL)}
