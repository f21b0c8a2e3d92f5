"""Voronoi cells and cut-up pages against plain versions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import render, subdivision, voronoi
from plumbline.sources import rasters

PAGE = [(0.0, 0.0), (30.0, 0.0), (34.0, 9.0), (18.0, 22.0), (0.0, 20.0)]


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def plain_cell(i, seeds):
    ring, (x, y) = PAGE, seeds[i]
    for j, (u, v) in seeds.items():
        if j == i:
            continue
        off = lambda p: (x - u) * (2 * p[0] - x - u) + (y - v) * (2 * p[1] - y - v)  # noqa: B023, E731
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            a, b = off(p), off(q)
            out += [p] if a >= 0 else []
            if (a >= 0) != (b >= 0):
                out.append((p[0] + a / (a - b) * (q[0] - p[0]), p[1] + a / (a - b) * (q[1] - p[1])))
        ring = out
    return ring


@pytest.mark.parametrize("grids", [voronoi.GRIDS, 2])
def test_cells_are_the_plain_ones(spark, monkeypatch, grids):
    monkeypatch.setattr(voronoi, "GRIDS", grids)
    rng = random.Random(8)
    groups = {
        "spread": {i: (rng.uniform(1, 20), rng.uniform(1, 19)) for i in range(60)},
        # A dense cluster, and a few seeds far from it.
        "dense": {i: (5 + rng.gauss(0, 0.01), 6 + rng.gauss(0, 0.01)) for i in range(80)} | {100: (25.0, 3.0), 101: (20.0, 15.0), 102: (2.0, 18.0)},
        "grid": {i: (2.0 + i % 5 * 3, 2.0 + i // 5 * 3) for i in range(25)},
        "one": {7: (3.0, 3.0)},
    }
    made = [(g, i, x, y) for g, seeds in groups.items() for i, (x, y) in seeds.items()] + [("spread", 999, *groups["spread"][0])]
    got = voronoi.cells(spark.createDataFrame(made, "g string, pid long, x double, y double"), ["g"], PAGE).collect()
    assert sorted((r["g"], r["pid"]) for r in got) == sorted((g, i) for g, seeds in groups.items() for i in seeds)
    total = dict.fromkeys(groups, 0.0)
    for r in got:
        ring, want = [(p["x"], p["y"]) for p in r["ring"]], plain_cell(r["pid"], groups[r["g"]])
        total[r["g"]] += area(ring)
        assert area(ring) == pytest.approx(area(want), abs=1e-9)
        for p in ring:  # no corner is nearer to another seed
            own = math.dist(p, groups[r["g"]][r["pid"]])
            assert all(own <= math.dist(p, s) + 1e-7 for s in groups[r["g"]].values())
    assert all(t == pytest.approx(area(PAGE), abs=1e-6) for t in total.values())


def test_seeds_of_a_cloud_meet_few_and_none_twice(spark, monkeypatch):
    """Those at its rim, whose cells reach far, don't meet the whole cloud."""
    rng, n, held, plain = random.Random(3), 1200, [], voronoi.met_in

    def spy(*args):
        made = plain(*args)
        held.extend((r["pid"], r["other"]) for r in made.select("pid", "other").collect())
        return made

    monkeypatch.setattr(voronoi, "met_in", spy)
    cloud = {i: (14 + rng.gauss(0, 1.5), 10 + rng.gauss(0, 0.5)) for i in range(n)}
    got = voronoi.cells(spark.createDataFrame([("a", i, *p) for i, p in cloud.items()], "g string, pid long, x double, y double"), ["g"], PAGE).collect()
    assert len(held) == len(set(held)) < 40 * n
    assert max(Counter(pid for pid, _ in held).values()) < n / 6
    rim = sorted(got, key=lambda r: -area([(p["x"], p["y"]) for p in r["ring"]]))[:20]
    assert len(got) == n and all(area([(p["x"], p["y"]) for p in r["ring"]]) == pytest.approx(area(plain_cell(r["pid"], cloud)), abs=1e-9) for r in rim)


def test_no_seeds_no_cells(spark):
    assert voronoi.cells(spark.createDataFrame([], "g string, pid long, x double, y double"), ["g"], PAGE).count() == 0


@pytest.fixture(scope="module")
def cut(spark):
    w, h = 60, 24
    tones = {"ramp": lambda x, y: x / (w - 1), "white": lambda x, y: 1.0, "radial": lambda x, y: min(1.0, math.dist((x, y), (29.5, 11.5)) / 32)}
    rows = [(n, x, y, float(f(x, y))) for n, f in tones.items() for x in range(w) for y in range(h)]
    page = [(0.5, 0.5), (w + 0.5, 0.5), (w + 0.5, h + 0.5), (0.5, h + 0.5)]
    images = spark.createDataFrame(rows, "img string, ix int, iy int, v double")
    cuts, pieces = subdivision.cut_up(images, page, 1.0, w)
    return {n: [r for r in cuts.collect() if r["img"] == n] for n in tones}, {n: [r for r in pieces.collect() if r["img"] == n] for n in tones}, w, h


def test_pieces_make_up_the_page(cut):
    cuts, pieces, w, h = cut
    for img, held in pieces.items():
        rings = {r["path"]: [(p["x"], p["y"]) for p in r["ring"]] for r in held}
        assert sum(map(area, rings.values())) == pytest.approx(w * h, abs=1e-6)
        assert sum(r["n"] for r in held) == w * h and len(held) == len(cuts[img]) + 1
        for ring in rings.values():  # pieces stay convex
            turns = [(b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2])]
            assert min(turns) > -1e-9 or max(turns) < 1e-9
    assert not cuts["white"] and len(cuts["ramp"]) > 40


def test_tone_of_a_cut_up_ramp_is_within_its_published_shortfall(spark):
    """Drawn, a linear ramp in ten bands is off by at most 0.225, and by 0.118 in the mean square."""
    w, h, pen = 600, 200, 1.5
    ramp = rasters.ramp(spark, w, h).withColumn("v", F.col("v").cast("double")).cache()
    page = [(1.0, 1.0), (float(w), 1.0), (float(w), float(h)), (1.0, float(h))]
    cuts, _ = subdivision.cut_up(ramp, page, pen, w)
    drawn = render.rendered(cuts, ramp, w, h, pen, 4)
    off = [r["target"] - r["rendered"] for r in render.bands(ramp, drawn, w, 10).collect()]
    assert max(map(abs, off)) <= 0.225 and (sum(x * x for x in off) / 10) ** 0.5 <= 0.118, off


def test_first_cuts_are_those_of_the_first_round(spark):
    w, h = 12, 9
    page = [(0.5, 0.5), (w + 0.5, 0.5), (w + 0.5, h + 0.5), (0.5, h + 0.5)]
    images = spark.createDataFrame([(img, x, y, (x * (3 + img) + y * y) % 11 / 11) for img in (1, 2) for x in range(w) for y in range(h)], "img int, ix int, iy int, v double")
    got = sorted(map(tuple, subdivision.first_cuts(images, page, 0.8, w).collect()))
    assert got and got == sorted(map(tuple, subdivision.cut_up(images, page, 0.8, w, 1)[0].collect()))
