"""Queries over crosses in quartered blocks: each supplier's blocks, and the ink asked for, laid down and still owed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import quadtree
from plumbline.operators.quadtree import SIDE
from plumbline.operators.rounds import materialise
from plumbline.plans import sql
from plumbline.plans.sql import q
from plumbline.sources import rasters
from plumbline.sources.rasters import LI_H, LI_W

PEN = 0.5


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block that was judged, and the samples that its cross inks or would."""
    made = quadtree.crossed(rasters.supplier_raster(spark, sf_dir), LI_W, LI_H, PEN)[1]
    return made.select("img", "path", "x0", "y0", "bw", "bh", "inked", F.col("kept").cast("int").alias("kept"))


def tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink of each image in pixels: what is asked, laid down by crosses, and owed; crosses, and blocks without one."""
    images = materialise(rasters.supplier_raster(spark, sf_dir))
    made = quadtree.crossed(images, LI_W, LI_H, PEN)[1]
    asked = images.groupBy("img").agg(F.sum(1 - F.col("v")).alias("asked"))
    laid = made.groupBy("img").agg((F.sum(F.when(F.col("kept"), F.col("inked")).otherwise(0)) / (SIDE * SIDE)).alias("laid"), F.sum(F.col("kept").cast("long")).alias("crosses"), F.sum((~F.col("kept")).cast("long")).alias("declined"))
    both = asked.join(laid, "img")
    return both.select("img", S.quantised(F.col("asked"), 1e4).alias("asked"), S.quantised(F.col("laid"), 1e4).alias("laid"), S.quantised(F.col("asked") - F.col("laid"), 1e4).alias("owed"), "crosses", "declined")


_ALL = SIDE * SIDE
_MX, _MY = f"((x0 + (bw - 1) / 2.0 - 1) * {SIDE} + 1)", f"((y0 + (bh - 1) / 2.0 - 1) * {SIDE} + 1)"
_IN_X = f"(bw > 1 AND c.x >= (x0 - 1) * {SIDE} + 1 AND c.x <= (x0 + bw - 2) * {SIDE} + 1)"
_IN_Y = f"(bh > 1 AND c.y >= (y0 - 1) * {SIDE} + 1 AND c.y <= (y0 + bh - 2) * {SIDE} + 1)"
_HIT = f"((abs(c.x - {_MX}) < {PEN * SIDE / 2!r} AND {_IN_Y}) OR (abs(c.y - {_MY}) < {PEN * SIDE / 2!r} AND {_IN_X}))"
_V = "list_sum(list_transform(p, lambda c: c.v))::DOUBLE / 1e9 / (bw * bh)"
#: Blocks hold their pixels and bare samples as lists; a kept one gives its four parts theirs.
_BLOCKS = f"""WITH RECURSIVE {sql.SUPPLIER_LI},
b(img, path, x0, y0, bw, bh, depth, p, s, inked, kept) AS (
 SELECT *, depth < {quadtree.DEPTH} AND NOT (bw <= {PEN} AND bh <= {PEN}) AND NOT abs({_V} - len(s) / (bw * bh * {_ALL})::DOUBLE) < abs({_V} - (len(s) - inked) / (bw * bh * {_ALL})::DOUBLE) AS kept FROM (
  SELECT *, len(list_filter(s, lambda c: {_HIT})) AS inked FROM (
   SELECT img, '' AS path, 1 AS x0, 1 AS y0, {LI_W} AS bw, {LI_H} AS bh, 0 AS depth, list({{'x': ix + 1, 'y': iy + 1, 'v': floor(v * 1e9 + 0.5)::BIGINT}}) AS p,
    flatten(list(list_transform(range({_ALL}), lambda k: {{'x': ix * {SIDE} + k % {SIDE} + 1, 'y': iy * {SIDE} + k // {SIDE} + 1}}))) AS s FROM li GROUP BY img))
 UNION ALL
 SELECT *, depth < {quadtree.DEPTH} AND NOT (bw <= {PEN} AND bh <= {PEN}) AND NOT abs({_V} - len(s) / (bw * bh * {_ALL})::DOUBLE) < abs({_V} - (len(s) - inked) / (bw * bh * {_ALL})::DOUBLE) AS kept FROM (
  SELECT *, len(list_filter(s, lambda c: {_HIT})) AS inked FROM (
   SELECT img, path || (2 * lo + ri) AS path, nx AS x0, ny AS y0, nw AS bw, nh AS bh, depth, list_filter(p, lambda c: c.x BETWEEN nx AND nx + nw - 1 AND c.y BETWEEN ny AND ny + nh - 1) AS p,
    list_filter(s, lambda c: c.x BETWEEN (nx - 1) * {SIDE} + 1 AND (nx + nw - 1) * {SIDE} AND c.y BETWEEN (ny - 1) * {SIDE} + 1 AND (ny + nh - 1) * {SIDE}) AS s FROM (
    SELECT img, path, ri, lo, x0 + ri * mw AS nx, y0 + lo * mh AS ny, CASE ri WHEN 1 THEN bw - mw ELSE mw END AS nw, CASE lo WHEN 1 THEN bh - mh ELSE mh END AS nh, depth + 1 AS depth, p, list_filter(s, lambda c: NOT {_HIT}) AS s
    FROM (SELECT *, (floor((bw + 2) / 2.0 + 0.5) - 1)::INT AS mw, (floor((bh + 2) / 2.0 + 0.5) - 1)::INT AS mh FROM b WHERE kept), (VALUES (0), (1)) i(ri), (VALUES (0), (1)) j(lo)
    WHERE mw >= 1 AND mh >= 1 AND mw < bw AND mh < bh))))"""
BLOCKS_SQL = f"{_BLOCKS} SELECT img, path, x0, y0, bw, bh, inked::BIGINT AS inked, kept::INT AS kept FROM b"
TALLY_SQL = f"""{_BLOCKS}, t AS (SELECT img, sum(CASE WHEN kept THEN inked ELSE 0 END) / {_ALL}::DOUBLE AS laid, sum(kept::INT)::BIGINT AS crosses, sum((NOT kept)::INT)::BIGINT AS declined FROM b GROUP BY img),
a AS (SELECT img, sum(1 - v) AS asked FROM li GROUP BY img)
SELECT img, {q("asked", "1e4")} AS asked, {q("laid", "1e4")} AS laid, {q("asked - laid", "1e4")} AS owed, crosses, declined FROM a JOIN t USING (img)"""


QUERIES = {"quad_blocks_supplier": (blocks, BLOCKS_SQL), "quad_tally_supplier": (tally, TALLY_SQL)}
