"""Wiggly lines: one carrier to and fro across the page, and on it a wave that is the shorter the darker the image is."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import maps as L
from plumbline.functions import scalar as S
from plumbline.operators import lookup, paths, waves
from plumbline.plans import sql
from plumbline.plans.fields import PAGE
from plumbline.plans.parts import WAVE_CTES
from plumbline.plans.runs import clip_sql
from plumbline.plans.sql import q
from plumbline.plans.strokes import _P
from plumbline.sources import rasters
from plumbline.sources.rasters import LI_H, LI_W

PEN, HEIGHT, SWING, SHORTEST, STEP, KNOTS = 0.5, 2.4, 1.9, 1.5, 0.25, 200
LONGEST = 5 * HEIGHT
#: Brightness of the shortest and of the longest wave.
BAND = tuple(1 - L.sawtooth_ratio(PEN, HEIGHT, SWING, length) for length in (SHORTEST, LONGEST))


def corners(w: int, h: int, height: float) -> list[tuple[int, float, float]]:
    """(seq, x, y) of rows ``height`` apart about the middle of the page, joined at their ends."""
    rows = max(1, math.floor((h - 1) / height) + 1)
    y0 = (1 + h) / 2 - (rows - 1) * height / 2
    ends = [(y0 + r * height, x) for r in range(rows) for x in ((1.0, float(w)) if r % 2 == 0 else (float(w), 1.0))]
    return [(i, x, y) for i, (y, x) in enumerate(ends)]


def knots(spark: SparkSession) -> DataFrame:
    """(shape, x, y): brightness of a wave and its length."""
    length = SHORTEST + F.col("id") / (KNOTS - 1) * (LONGEST - SHORTEST)
    t = spark.range(KNOTS).select(F.lit("sawtooth").alias("shape"), length.alias("y"))
    return t.select("shape", (1 - S.wave_coverage("sawtooth", PEN, HEIGHT, F.lit(SWING), F.col("y"))).alias("x"), "y")


def lengths(spark: SparkSession, images: DataFrame, carrier: DataFrame) -> DataFrame:
    """(path_id, seq, length) of the wave for each image at each sample of the carrier."""
    bright = lookup.bilinear(carrier.select(F.col("seq").alias("pid"), "x", "y"), images, LI_W, LI_H)
    asked = bright.select(F.lit("sawtooth").alias("shape"), F.struct("img", "pid").alias("id"), L.into_band(S.clamp(F.col("v").cast("double"), 0.0, 1.0), BAND).alias("u"))
    got = lookup.interpolated(asked, knots(spark), ["shape"], 0.02)
    return got.select(F.col("id.img").alias("path_id"), F.col("id.pid").alias("seq"), F.greatest(F.lit(SHORTEST), F.col("y")).alias("length"))


def drawn(spark: SparkSession, images: DataFrame) -> DataFrame:
    """(path_id, run, seq, x, y): the wave of each image, path_id, as far as it is on the page."""
    line = spark.createDataFrame([(1, *c) for c in corners(LI_W, LI_H, HEIGHT)], "path_id int, seq int, x double, y double")
    carrier = paths.resampled(line, STEP)
    carrier = carrier.join(paths.normals(carrier), ["path_id", "seq"]).drop("path_id")
    waved = waves.phases(lengths(spark, images, carrier).join(carrier, "seq"), 2 * math.pi / F.col("length")).withColumn("amp", F.lit(SWING / 2))
    made = waves.modulated(waved, "sawtooth")
    place = F.row_number().over(Window.partitionBy("path_id").orderBy("seq", "part"))
    return paths.clipped(made.select("path_id", place.alias("seq"), "x", "y"), PAGE)


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drawn(spark, rasters.lineitem_raster(spark, sf_dir))
    return d.select(F.col("path_id").alias("img"), F.col("run").cast("long").alias("run"), F.col("seq").cast("long").alias("seq"), S.quantised(F.col("x"), 1e3).alias("x"), S.quantised(F.col("y"), 1e3).alias("y"))


_CORNERS = ", ".join(f"(1, {i}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, x, y in corners(LI_W, LI_H, HEIGHT))
_A, _W, _H = f"{SWING}::DOUBLE", f"{PEN}::DOUBLE", f"{HEIGHT}::DOUBLE"
STROKES_SQL = f"""
WITH {sql.LI}, path(path_id, seq, x, y) AS (VALUES {_CORNERS}), {sql.LENGTH},
re AS (SELECT x, y, s, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(s) OVER w AS s1 FROM len WINDOW w AS {_P}),
rt AS (SELECT max(s) AS total, greatest(1, floor(max(s) / {STEP} + 0.5))::INT AS n FROM len), rk AS (SELECT *, unnest(range(n + 1)) AS k FROM rt),
rh AS (SELECT k, total / n * k AS pos, re.*, row_number() OVER (PARTITION BY k ORDER BY s DESC) AS r FROM rk JOIN re ON s1 > s AND s <= total / n * k + 1e-9 * total / n),
car AS (SELECT k AS seq, x + greatest(0, least(1, (pos - s) / (s1 - s))) * (x1 - x) AS x, y + greatest(0, least(1, (pos - s) / (s1 - s))) * (y1 - y) AS y FROM rh WHERE r = 1),
cd AS (SELECT *, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM car WINDOW w AS (ORDER BY seq)),
cn AS (SELECT seq, x, y, -dy / sqrt(dx * dx + dy * dy) AS nx, dx / sqrt(dx * dx + dy * dy) AS ny, greatest(0, least({LI_W - 2}, floor(x - 1))) AS qx, greatest(0, least({LI_H - 2}, floor(y - 1))) AS qy FROM cd),
br AS (SELECT li.img, seq, sum(v * (CASE WHEN ix = qx THEN 1 - (x - 1 - qx) ELSE x - 1 - qx END) * (CASE WHEN iy = qy THEN 1 - (y - 1 - qy) ELSE y - 1 - qy END)) AS v FROM cn JOIN li ON ix BETWEEN qx AND qx + 1 AND iy BETWEEN qy AND qy + 1 GROUP BY ALL),
tl AS (SELECT i, {SHORTEST} + i / {KNOTS - 1}::DOUBLE * {LONGEST - SHORTEST!r}::DOUBLE AS l FROM range({KNOTS}) r(i)),
tb AS (SELECT i, l, 1 - greatest(0, least(1, {_W} * (4 * l * sqrt(4 * {_A} * {_A} + l * l) + {_W} * l * (pi() - 2 * atan(l / (2 * {_A}))) - 4 * {_W} * {_A}) / (4 * {_H} * l * l))) AS b FROM tl),
tr AS (SELECT *, lead(l) OVER (ORDER BY i) AS l1, lead(b) OVER (ORDER BY i) AS b1 FROM tb), tm AS (SELECT min(b) AS lo, max(b) AS hi FROM tb),
bu AS (SELECT img, seq, greatest(lo, least(hi, greatest(0, least(1, v)) * {BAND[1] - BAND[0]!r}::DOUBLE + {BAND[0]!r}::DOUBLE)) AS u, hi FROM br, tm),
bl AS (SELECT img, seq, greatest({SHORTEST}, max(l + (u - b) / (b1 - b) * (l1 - l))) AS length FROM bu JOIN tr ON u >= b AND (u < b1 OR (u = b1 AND b1 = hi)) GROUP BY ALL),
n AS (SELECT img AS path_id, seq, x, y, nx, ny, {SWING / 2}::DOUBLE AS amp, {2 * math.pi!r}::DOUBLE / length AS rate FROM bl JOIN cn USING (seq)),
s AS (SELECT *, coalesce((rate + lag(rate) OVER w) / 2 * sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS step FROM n WINDOW w AS {_P}),
{WAVE_CTES},
wv AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY seq, part) AS seq, x, y FROM r WHERE shape = 'sawtooth'), {clip_sql("wv", PAGE)}
SELECT path_id AS img, run::BIGINT AS run, row_number() OVER (PARTITION BY path_id, run ORDER BY seq, a, e) - 1 AS seq, {q("x", "1e3")} AS x, {q("y", "1e3")} AS y FROM pt"""

QUERIES = {"wiggly_lines_li": (strokes, STROKES_SQL)}
