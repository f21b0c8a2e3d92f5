"""Queries over dot lattices: the dots of one threshold for each supplier's image, their ink, and dots moved by swaps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import dither, raster, tiles
from plumbline.plans import sql
from plumbline.plans.marks import _draw_sql
from plumbline.plans.parts import DOT, _lattice_sql
from plumbline.plans.sql import q
from plumbline.sources import rasters
from plumbline.sources.rasters import LI_H, LI_W

COLS, ROWS, X0, Y0, DX, DY = tiles.lattice(LI_W, LI_H, DOT, True)
#: How much more than its cell a dot inks, and a hexagonal cell's neighbours.
EXTRA, DEGREE, SEED = math.pi * DOT * DOT / (DX * DY) - 1, 6, 1


def links(spark: SparkSession) -> DataFrame:
    return tiles.lattice_links(tiles.lattice_cells(spark, LI_W, LI_H, DOT, True), COLS, ROWS, True)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Darkness of each cell of a hexagonal lattice, for each supplier, in billionths."""
    dark = tiles.lattice_darkness(rasters.supplier_raster(spark, sf_dir), LI_W, LI_H, DOT, True)
    return dark.select("img", "pid", (S.quantised(F.col("k"), 1e9) / 1e9).alias("k"))


def threshold_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where dots are drawn: the darkest cells of an image, as many as give its ink."""
    got = dither.threshold(cells(spark, sf_dir), links(spark), EXTRA, DEGREE, SEED)
    at = tiles.lattice_cells(spark, LI_W, LI_H, DOT, True).select("pid", *[S.quantised(F.col(c), 1e4).alias(c) for c in "xy"])
    return got.where("drawn = 1").join(at, "pid").select("img", "pid", "x", "y")


def threshold_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's dots, the ink they lay down with what they spill, and the ink wanted."""
    got = dither.inked(dither.threshold(cells(spark, sf_dir), links(spark), EXTRA, DEGREE, SEED), links(spark), EXTRA, DEGREE)
    return tone(got)


def tone(inked: DataFrame) -> DataFrame:
    """(img, dots, ink, wanted) of ``inked`` (img, pid, k, drawn, ink). What is wanted adds up from the darkest cell on, as in the
    SQL: in some images it is an exact half of the unit, which the order of adding rounds up or down. A lattice bounds the cells."""
    cells = F.array_sort(F.collect_list(F.struct("code", "pid", "k")))
    wanted = F.aggregate(cells, F.lit(0.0), lambda s, c: s + c["k"])
    sums = F.sum(F.col("drawn").cast("long")).alias("dots"), S.quantised(F.sum("ink"), 1e4).alias("ink"), S.quantised(wanted, 1e4).alias("wanted")
    return dither.coded(inked, SEED).groupBy("img").agg(*sums)


def blurred_error(pattern: DataFrame, scale: float = 1.0) -> DataFrame:
    """(img, error): sum of what the blurred ink differs from the blurred darkness by."""
    inked = dither.inked(pattern, links(pattern.sparkSession), EXTRA, DEGREE)
    gap = inked.select("img", F.floor(F.col("pid") / COLS).cast("int").alias("iy"), (F.col("pid") % COLS).cast("int").alias("ix"), (F.col("ink") - F.col("k")).alias("v"))
    reach = dither.Kernel(scale).reach
    return raster.blur(gap, 2 * reach + 1, scale / math.sqrt(2)).groupBy("img").agg(F.sum(F.abs("v").cast("double")).alias("error"))


def swap_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dots before and after the swaps, and whether the drawing's error has risen."""
    start = dither.materialise(dither.seeded(cells(spark, sf_dir), EXTRA, SEED))
    done = dither.swapped(start, COLS, ROWS, EXTRA, True)
    dots = done.groupBy("img").agg(F.count("*").alias("cells"), F.sum(F.col("drawn").cast("long")).alias("dots"))
    before, after = blurred_error(start).withColumnRenamed("error", "was"), blurred_error(done.select("img", "pid", "k", "drawn"))
    both = dots.join(before, "img").join(after, "img")
    return both.select("img", "cells", "dots", (F.col("error") > F.col("was") + 1e-3).cast("int").alias("risen"))


_CODE = f"floor((1 + {dither.JITTER!r}::DOUBLE - (k + ({_draw_sql(f'{SEED}::BIGINT', 'pid')} - 0.5) * {dither.JITTER!r}::DOUBLE)) * {float(1 << (dither.BITS - 1))!r}::DOUBLE)::BIGINT"
_SHARE = repr(EXTRA / DEGREE)
_CELLS = f"{sql.SUPPLIER_LI}, {_lattice_sql('hex', True)}, dk AS MATERIALIZED (SELECT img, pid::BIGINT AS pid, x, y, floor(k * 1e9 + 0.5) / 1e9 AS k FROM hex_k)"
_ORDERED = f"""{_CELLS}, co AS MATERIALIZED (SELECT *, {_CODE} AS code FROM dk),
lk AS (SELECT a.pid::BIGINT AS pid, b.pid::BIGINT AS near FROM hex_c a JOIN hex_c b ON (a.i = b.i AND abs(a.j - b.j) = 1) OR (abs(a.i - b.i) = 1 AND (a.j = b.j OR b.j - a.j = CASE WHEN a.i % 2 = 1 THEN 1 ELSE -1 END))),
ga AS (SELECT a.img, a.pid, a.x, a.y, a.k, a.code, 1 + sum(CASE WHEN (b.code, b.pid) < (a.code, a.pid) THEN -{_SHARE}::DOUBLE ELSE {_SHARE}::DOUBLE END) AS gain
 FROM co a JOIN lk ON lk.pid = a.pid JOIN co b ON b.img = a.img AND b.pid = lk.near GROUP BY ALL),
ru AS (SELECT *, sum(gain) OVER (PARTITION BY img ORDER BY code, pid ROWS UNBOUNDED PRECEDING) AS run, sum(k) OVER (PARTITION BY img) AS want FROM ga),
dr AS (SELECT *, run < want OR (run - gain < want AND abs(run - want) < abs(run - gain - want)) AS drawn FROM ru)"""
DOTS_SQL = f"WITH {_ORDERED} SELECT img, pid, {q('x', '1e4')} AS x, {q('y', '1e4')} AS y FROM dr WHERE drawn"
TONE_SQL = f"""WITH {_ORDERED} SELECT img, sum(drawn::INT)::BIGINT AS dots, {q("sum(CASE WHEN drawn THEN gain ELSE 0 END)", "1e4")} AS ink, {q("max(want)", "1e4")} AS wanted FROM dr GROUP BY img"""
_P = f"((1 + {EXTRA!r}::DOUBLE) - sqrt((1 + {EXTRA!r}::DOUBLE) * (1 + {EXTRA!r}::DOUBLE) - 4 * {EXTRA!r}::DOUBLE * k)) / (2 * {EXTRA!r}::DOUBLE)"
#: Swaps keep the number of dots, which is that of the random start, and never raise the error.
SWAP_SQL = f"""WITH {_CELLS} SELECT img, count(*) AS cells, sum(CASE WHEN {_draw_sql(f"{SEED}::BIGINT", "pid")} < {_P} THEN 1 ELSE 0 END)::BIGINT AS dots, 0::INT AS risen FROM dk GROUP BY img"""


QUERIES = {
    "dither_threshold_supplier": (threshold_dots, DOTS_SQL),
    "dither_tone_supplier": (threshold_tone, TONE_SQL),
    "dither_swaps_supplier": (swap_balance, SWAP_SQL),
}
