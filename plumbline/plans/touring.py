"""Queries over closed tours: each label's vectors along a Hilbert curve, and the tour's length once it is bettered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import tours
from plumbline.operators.rounds import materialise
from plumbline.plans.cells import labelled_points
from plumbline.plans.marks import TOUR_SQL
from plumbline.plans.sql import q
from plumbline.sources.rasters import LI_H, LI_W

SIDE = 64


def hilbert_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, seq, pid, x, y): each label's vectors by their place on a Hilbert curve."""
    cell = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(SIDE - 1), F.floor((F.col(c) - 1) / (n - 1) * SIDE))).cast("int")
    placed = labelled_points(spark, sf_dir).withColumn("h", S.hilbert_index(SIDE, cell("x", LI_W), cell("y", LI_H)))
    order = Window.partitionBy("label").orderBy("h", "pid")
    return placed.select("label", (F.row_number().over(order) - 1).cast("long").alias("seq"), "pid", "x", "y")


def tour_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's closed tour: its stops, how many different ones and places remain, its first length, and whether it is
    longer since."""
    start = materialise(hilbert_order(spark, sf_dir))
    done = materialise(tours.improved(start, ["label"]))
    kept = done.join(start.select("label", "pid"), ["label", "pid"]).groupBy("label").agg(F.countDistinct("pid").alias("stops"), F.countDistinct("seq").alias("places"))
    before, after = tours.lengths(start, ["label"]), tours.lengths(done, ["label"]).select("label", F.col("length").alias("now"))
    both = before.join(after, "label").join(kept, "label")
    return both.select("label", "n", "stops", "places", S.quantised(F.col("length"), 1e3).alias("length"), (F.col("now") > F.col("length") + 1e-6).cast("int").alias("longer"))


_WALK = TOUR_SQL[: TOUR_SQL.rindex("\nSELECT label")]
#: A bettered tour has the same stops and is no longer.
BALANCE_SQL = f"""{_WALK},
z AS (SELECT label, count(*) AS n, sum(step) AS open, arg_min(x, {{'d': d, 'pid': pid}}) AS ax, arg_min(y, {{'d': d, 'pid': pid}}) AS ay, arg_max(x, {{'d': d, 'pid': pid}}) AS bx, arg_max(y, {{'d': d, 'pid': pid}}) AS b_y FROM w GROUP BY label)
SELECT label, n, n AS stops, n AS places, {q("open + sqrt((ax - bx) ^ 2 + (ay - b_y) ^ 2)", "1e3")} AS length, 0::INT AS longer FROM z"""


QUERIES = {"tour_balance_emb": (tour_balance, BALANCE_SQL)}
