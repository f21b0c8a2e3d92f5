"""Invariants of the iterative and order-dependent operators on small inputs."""

import heapq
import math
import random

import numpy as np
import pytest

from plumbline.operators import geometry, iterative, kernels, paths, raster, rounds
from plumbline.plans.hatching import Layout


def image(spark, w, h, f, img="a"):
    return spark.createDataFrame([(img, x, y, float(f(x, y))) for y in range(h) for x in range(w)], "img string, ix int, iy int, v double")


def test_geodesic_agrees_with_a_heap(spark):
    w, h, rng = 9, 7, random.Random(1)
    cost = {(x, y): 1 + rng.random() * 5 for x in range(w) for y in range(h)}
    seeds = spark.createDataFrame([("a", 0, 3), ("a", 8, 6)], "img string, ix int, iy int")
    got = {(r.ix, r.iy): r.d for r in iterative.geodesic(image(spark, w, h, lambda x, y: cost[x, y]), seeds).collect()}
    best, heap = {}, [(0.0, (0, 3)), (0.0, (8, 6))]
    while heap:
        d, p = heapq.heappop(heap)
        if p in best:
            continue
        best[p] = d
        for dx, dy in iterative.KING:
            q = (p[0] + dx, p[1] + dy)
            if q in cost:
                heapq.heappush(heap, (d + (cost[p] + cost[q]) / 2 * math.hypot(dx, dy), q))
    assert got.keys() == best.keys() and all(abs(got[p] - best[p]) < 1e-9 for p in best)


def test_knights_do_not_jump_over_gaps(spark):
    w, h, rng = 9, 8, random.Random(5)
    cost = {(x, y): 1 + rng.random() for x in range(w) for y in range(h) if rng.random() < 0.75 or (x, y) == (0, 0)}
    rows = spark.createDataFrame([("a", x, y, c) for (x, y), c in cost.items()], "img string, ix int, iy int, v double")
    got = {(r.ix, r.iy): r.d for r in iterative.geodesic(rows, spark.createDataFrame([("a", 0, 0)], "img string, ix int, iy int"), 16).collect()}
    best, heap = {}, [(0.0, (0, 0))]
    while heap:
        d, p = heapq.heappop(heap)
        if p in best:
            continue
        best[p] = d
        for dx, dy in iterative.KING + iterative.KNIGHT:
            q = (p[0] + dx, p[1] + dy)
            between = []
            if max(abs(dx), abs(dy)) == 2:
                sx, sy = int(math.copysign(1, dx)), int(math.copysign(1, dy))
                between = [(p[0] + sx, p[1] + sy), (p[0] + sx, p[1]) if abs(dx) == 2 else (p[0], p[1] + sy)]
            if q in cost and all(b in cost for b in between):
                heapq.heappush(heap, (d + (cost[p] + cost[q]) / 2 * math.hypot(dx, dy), q))
    assert got.keys() == best.keys() and all(abs(got[p] - best[p]) < 1e-9 for p in best)


def test_rounds_do_not_grow_the_size_estimate(spark):
    """A chain that takes many rounds: what Spark plans with stays of the size of the data."""
    edges = spark.createDataFrame([(i, i + 1, float((i * 37) % 101)) for i in range(60)], "a long, b long, w double")
    tree = iterative.forest(edges)
    assert tree.count() == 60 and rounds.estimated_bits(tree) < 40
    far = iterative.geodesic(image(spark, 12, 2, lambda x, y: 1.0), spark.createDataFrame([("a", 0, 0)], "img string, ix int, iy int"))
    assert far.count() == 24 and rounds.estimated_bits(far) < 40


def test_forest_is_least(spark):
    rng = random.Random(4)
    edges = [(a, b, rng.random()) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.3] + [(20, 21, 0.5), (21, 20, 0.2), (5, 5, 0.0)]
    got = iterative.forest(spark.createDataFrame(edges, "a long, b long, w double")).collect()
    tree, weight = {}, 0.0

    def find(x):
        while tree.get(x, x) != x:
            x = tree[x]
        return x

    for a, b, w in sorted(edges, key=lambda e: e[2]):
        if find(a) != find(b):
            tree[find(a)] = find(b)
            weight += w
    assert abs(sum(r.w for r in got) - weight) < 1e-9


def test_subdivision_keeps_the_count(spark):
    src = image(spark, 12, 9, lambda x, y: x / 11).selectExpr("*", "cast(floor((1 - v) * 1e6 + 0.5) as long) as m")
    for count in (1, 7, 40):
        got = iterative.subdivided(src, count).collect()
        assert sum(r.n for r in got) == count and len({r.path for r in got}) == len(got)
    assert iterative.subdivided(image(spark, 3, 3, lambda x, y: 1.0).selectExpr("*", "0L as m"), 5).count() == 0


def test_circles_do_not_overlap(spark):
    got = [(r.x, r.y, r.r) for r in kernels.packed_circles(image(spark, 20, 15, lambda x, y: x / 19), 0.8, 3.0).collect()]
    assert len(got) > 10
    assert all(math.hypot(a[0] - b[0], a[1] - b[1]) >= a[2] + b[2] - 1e-9 for i, a in enumerate(got) for b in got[:i])


@pytest.mark.parametrize("v", [0.1, 0.5, 0.8])
def test_error_diffusion_keeps_the_mean(spark, v):
    got = [r.dot for r in kernels.spread_error(image(spark, 24, 20, lambda x, y: v)).collect()]
    assert abs(sum(got) / len(got) - (1 - v)) < 0.02


def test_triangles_are_empty_circles(spark):
    rng = np.random.default_rng(2)
    p = rng.random((30, 2)) * 50
    got = kernels.triangles(spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(p)], "key long, pid long, x double, y double")).collect()
    for r in got:
        a, b, c = p[[r.a, r.b, r.c]]
        m = 2 * np.array([b - a, c - a])
        centre = np.linalg.solve(m, np.array([b @ b - a @ a, c @ c - a @ a]))
        assert (((p - centre) ** 2).sum(1) >= ((a - centre) ** 2).sum() * (1 - 1e-9) - 1e-9).all()
    # The triangles of a convex hull's points: 2 n - 2 - (points on the hull).
    assert 2 * 30 - 2 - 30 <= len(got) <= 2 * 30 - 5


def test_dashes_lay_what_is_owed(spark):
    rows = [("a", line, k, 0.21) for line in range(6) for k in range(40)]
    got = kernels.dashes(spark.createDataFrame(rows, "img string, line int, k int, owed double"), 0.5, 2.0, 1.0).collect()
    price = 2.0 * 0.5 + math.pi * 0.25 / 4
    assert abs(len(got) * price - 6 * 40 * 0.21) <= price
    by = {}
    for r in got:
        by.setdefault(r.line, []).append((r.a, r.b))
    assert all(b <= c for s in by.values() for (_, b), (c, _) in zip(sorted(s), sorted(s)[1:], strict=False))


def test_visiting_order_takes_each_path_once(spark):
    ends = [("l", i, float(i * 7 % 5), float(i), float(i * 3 % 4), float(i + 1)) for i in range(12)]
    got = kernels.visiting_order(spark.createDataFrame(ends, "layer string, path_id long, ax double, ay double, bx double, by_ double"), "layer").collect()
    assert sorted(r.path_id for r in got) == list(range(12)) and sorted(r.place for r in got) == list(range(12))


def test_simplification_keeps_ends_and_corners(spark):
    line = [(1, k, float(k), 0.0 if k < 10 else float(k - 10)) for k in range(20)]
    got = [(r.x, r.y) for r in paths.simplified(spark.createDataFrame(line, "path_id long, seq int, x double, y double"), 0.5).orderBy("seq").collect()]
    assert got == [(0.0, 0.0), (10.0, 0.0), (19.0, 9.0)]


def test_joined_paths_drop_the_shared_point_and_leave_dots(spark):
    rows = [("l", 1, 0, 0.0, 0.0), ("l", 1, 1, 1.0, 0.0), ("l", 2, 0, 1.0, 0.1), ("l", 2, 1, 2.0, 0.0), ("l", 3, 0, 2.0, 0.0), ("l", 4, 0, 9.0, 9.0), ("l", 4, 1, 9.0, 8.0)]
    got = paths.joined(spark.createDataFrame(rows, "layer string, path_id long, seq int, x double, y double"), ["layer"], 0.5)
    made = {}
    for r in got.orderBy("path_id", "seq").collect():
        made.setdefault(r.path_id, []).append((r.x, r.y))
    assert list(made.values()) == [[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)], [(2.0, 0.0)], [(9.0, 9.0), (9.0, 8.0)]]


def test_inside_counts_edges_and_corners(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]
    points = [(1.0, 1.0, True), (0.0, 0.0, True), (2.0, 2.0, True), (4.0, 0.0, True), (3.0, 3.0, False), (-0.1, 1.0, False), (0.0, 2.0, True)]
    df = spark.createDataFrame(points, "x double, y double, expected boolean")
    assert df.where(geometry.inside(df.x, df.y, ring) != df.expected).count() == 0


def test_blur_keeps_a_flat_field_and_resizing_its_mean(spark):
    flat = image(spark, 8, 6, lambda x, y: 0.3)
    assert all(abs(r.v - 0.3) < 1e-6 for r in raster.blur(flat, 5, 1.0).collect())
    src = image(spark, 12, 8, lambda x, y: (x * 5 + y * 3) % 7 / 7)
    small = raster.shrink(src, 12, 8, 5, 3)
    mean = lambda df: df.agg({"v": "avg"}).first()[0]
    assert small.count() == 15 and abs(mean(small) - mean(src)) < 1e-9
    assert raster.grow(flat, 8, 6, 13, 11).count() == 143


def test_layout_covers_the_page():
    g = Layout(50, 11)
    assert g.lines * g.pen >= 50 * abs(g.c) and g.low < -11 / 2
    assert g.samples * g.step >= 11 * abs(g.c)


def test_svg_numbers(spark):
    df = spark.createDataFrame([(1.0, "1"), (0.5, "0.5"), (-0.0004, "0"), (-1.25, "-1.25"), (1234.56789, "1234.568"), (float("nan"), "0"), (None, "0")], "v double, expected string")
    assert df.where(paths.svg_number(df.v) != df.expected).count() == 0
