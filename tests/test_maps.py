"""Numbers that hold for a whole drawing, and crosshatching against the published tolerances."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import maps
from plumbline.operators import paths, render
from plumbline.plans import crosshatch
from plumbline.sources import rasters


def test_sizes_stay_within_their_budgets():
    assert maps.raster_size(100, 50, 30.0, 10.0) == (300, 150, 30.0)
    nx, ny, per_cm = maps.raster_size(200, 1400, 80.0, 42.0)
    assert nx * ny <= 1.001 * maps.MOST_PIXELS and per_cm == nx / 42.0
    assert maps.samples_a_side(300, 300) == 3 and maps.samples_a_side(1500, 1500) == 2 and maps.samples_a_side(4000, 3000) == 1
    assert maps.working_scale(2.0, 100, 100, 10_000) == 0.5 and maps.working_scale(1.0, 100, 100, 2_500) == 0.5


def test_spacings_and_bands():
    assert maps.floors(0.5) == (0.55, 0.25)
    assert maps.spacings(1.5, 0.2, 0.1) == (1.5, 2.25) and maps.spacings(1.5, 2, 40) == (3.0, 60.0)
    assert maps.stripe_band(1.5, 1.5, 3.0) == (0.0, 0.5)


def test_angles_go_farthest_first():
    got = maps.most_orthogonal([math.pi * k / 4 for k in range(4)])
    assert got[:2] == [0.0, math.pi / 2] and sorted(got) == [math.pi * k / 4 for k in range(4)]


def test_crosshatch_keeps_the_tone(spark):
    """Bands of a ramp within 0.12 of the staircase aimed at, 0.06 in the mean square."""
    w, h = 120, 60
    target = rasters.ramp(spark, w, h)
    layers = crosshatch.Layers(w, h)
    page = [(1.0, 1.0), (float(w), 1.0), (float(w), float(h)), (1.0, float(h))]
    strokes = crosshatch.crosshatched(target, layers, page)
    drawn = render.rendered(strokes, target, w, h, crosshatch.PEN, 4)
    aim = target.withColumn("v", maps.staircase(target.v.cast("double"), crosshatch.LEVELS, crosshatch.DARKEST))
    e = [r.rendered - r.target for r in render.bands(aim, drawn, w, 10).collect()]
    assert len(e) == 10 and max(map(abs, e)) < 0.12 and math.sqrt(sum(x * x for x in e) / 10) < 0.06


def test_a_dot_stroke_inks_its_dot(spark):
    """The published range of the spiral's fill is 0.9785 to 1.0060."""
    pen, r = 1.0, 3.0
    dot = spark.createDataFrame([("a", 8.0, 8.0, r)], "path_id string, x double, y double, r double")
    order = Window.partitionBy("path_id").orderBy("seq")
    p = paths.dot_strokes(dot, pen).select(F.lit("a").alias("img"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(order).alias("x2"), F.lead("y").over(order).alias("y2"))
    images = rasters.grid(spark, 16, 16).withColumn("img", F.lit("a"))
    ink = render.rendered(p.where("x2 is not null"), images, 16, 16, pen, 8).agg(F.sum(1 - F.col("v"))).first()[0]
    assert 0.96 < ink / (math.pi * r * r) < 1.02
