"""Lines that split and merge: matching against a plain walk, and the tone of drawings within the published bars."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import render, splitting, tiles
from plumbline.sources import rasters


def walk(a, b):
    if not a or not b:
        return []
    i = j = 0
    out = [(0, 0, False)]
    while i + 1 < len(a) or j + 1 < len(b):
        if i + 1 == len(a):
            j, again = j + 1, True
        elif j + 1 == len(b):
            i, again = i + 1, False
        else:
            both, di, dj = abs(a[i + 1] - b[j + 1]), abs(a[i + 1] - b[j]), abs(a[i] - b[j + 1])
            go_i = both <= min(di, dj) or di <= dj
            go_j = both <= min(di, dj) or not go_i
            i, j, again = i + go_i, j + go_j, not go_i
        out.append((i, j, again))
    return out


def test_lists_are_matched_in_order(spark):
    rng = random.Random(2)
    made = [(k, sorted(rng.uniform(0, 50) for _ in range(rng.randint(0, 25))), sorted(rng.uniform(0, 50) for _ in range(rng.randint(0, 25)))) for k in range(60)]
    made += [(100, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), (101, [5.0], [1.0, 2.0, 9.0]), (102, [1.0, 1.0, 1.0], [1.0, 1.0])]
    df = spark.createDataFrame(made, "k long, a array<double>, b array<double>")
    got = {r["k"]: [tuple(p) for p in r["p"]] for r in df.select("k", splitting.matched(F.col("a"), F.col("b")).alias("p")).collect()}
    for k, a, b in made:
        assert got[k] == walk(a, b)
        if a and b:
            assert {p[0] for p in got[k]} == set(range(len(a))) and {p[1] for p in got[k]} == set(range(len(b)))
            assert all(p[0] <= q[0] and p[1] <= q[1] for p, q in zip(got[k], got[k][1:]))


@pytest.mark.parametrize("kind", ["ramp", "radial"])
def test_tone_is_within_the_published_bars(spark, kind):
    """Ten bands of a ramp: no one off by 0.12, and the root mean square below 0.06."""
    w, h, pen = (300, 100, 1.5) if kind == "ramp" else (160, 160, 1.5)
    page = [(1.0, 1.0), (float(w), 1.0), (float(w), float(h)), (1.0, float(h))]
    image = (rasters.ramp if kind == "ramp" else rasters.radial)(spark, w, h).withColumn("v", F.col("v").cast("double")).cache()
    lines = splitting.split_merge(image, page, math.pi / 2, 1.0, pen).select("img", "x1", "y1", "x2", "y2")
    drawn = render.rendered(lines, image, w, h, pen, 4)
    off = [r["target"] - r["rendered"] for r in render.bands(image, drawn, w, 10).collect()]
    assert len(off) == 10 and max(map(abs, off)) < 0.12 and (sum(x * x for x in off) / 10) ** 0.5 < 0.06, off


def test_white_and_missing_pixels_have_no_lines(spark):
    page = [(1.0, 1.0), (40.0, 1.0), (40.0, 30.0), (1.0, 30.0)]
    white = [("white", x, y, 1.0) for x in range(40) for y in range(30)] + [("half", x, y, 0.2) for x in range(40) for y in range(15)]
    image = spark.createDataFrame(white, "img string, ix int, iy int, v double")
    got = splitting.split_merge(image, page, math.pi / 2, 1.0, 1.5).groupBy("img").count().collect()
    assert [r["img"] for r in got] == ["half"]
    few = splitting.split_merge(image, page, math.pi / 2, 1.0, 1.5, splits=False).count()
    assert few <= got[0]["count"]


def test_no_step_is_planned_more_than_once(spark):
    """The driver holds a plan's text for each of its stages: none may work the same tables out again and again."""
    page = [(1.0, 1.0), (20.0, 1.0), (20.0, 10.0), (1.0, 10.0)]
    image = spark.createDataFrame([("a", x, y, 0.3) for x in range(20) for y in range(10)], "img string, ix int, iy int, v double")
    lines = splitting.split_merge(image, page, math.pi / 2, 1.0, 1.5)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2
    assert lines.count()


def test_no_side_that_grows_with_the_images_is_broadcast(spark, monkeypatch):
    """Places of an image are many rows of few bytes: the driver must not gather them, though a plan holds them for small."""
    page = [(1.0, 1.0), (20.0, 1.0), (20.0, 10.0), (1.0, 10.0)]
    image = spark.createDataFrame([("a", x, y, 0.3) for x in range(20) for y in range(10)], "img string, ix int, iy int, v double")
    planned, write = [], splitting.materialise
    monkeypatch.setattr(splitting, "materialise", lambda df: planned.append(df) or write(df))
    planned.append(splitting.split_merge(image, page, math.pi / 2, 1.0, 1.5))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in planned]
    assert sum(p.count("SortMergeJoin") for p in plans) == 7 and not any("Broadcast" in p for p in plans)


def test_samples_beyond_all_images_are_left_out_before_they_meet_pixels(spark):
    """A page turned by an eighth has as many samples off the image as on it; none of a place's darkness is lost."""
    page = [(1.0, 1.0), (20.0, 1.0), (20.0, 10.0), (1.0, 10.0)]
    image = spark.createDataFrame([(i, x, y, ((x + y * i) % 5) / 5) for i in (1, 2) for x in range(20) for y in range(10)], "img int, ix int, iy int, v double")
    whole = tiles.band_darkness(image, page, math.pi / 4, 1.0, 1.5)
    boxed = tiles.band_darkness(image, page, math.pi / 4, 1.0, 1.5, (0, 19, 0, 9))
    rows = lambda df: {(r["img"], r["band"], r["m"]): round(r["k"], 9) for r in df.collect()}
    assert rows(whole) == rows(boxed) and len(rows(boxed)) > 20
