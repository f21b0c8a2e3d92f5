"""Steps whose rows meet once: what goes through a shuffle, and that results are those of plain versions."""

import time

import numpy as np
import pytest

from plumbline.operators import dither, geometry, kernels, paths, raster, rounds, subdivision
from plumbline.sources import rasters


def shuffles(df):
    """Shuffles of the physical plan."""
    return sum(" Exchange " in f" {line.strip(' +-:*')} " for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_a_counted_raster_is_filled_up_within_its_image(spark):
    rows = [("a", 1, 0)] * 3 + [("a", 3, 2), ("b", 0, 0), ("c", 3, 2), (None, 2, 1)]
    got = rasters.counted(spark.createDataFrame(rows, "img string, ix int, iy int"), 4, 3)
    # Counts, then images; neither the grid nor a filter's lines go through another.
    assert shuffles(got) == shuffles(raster.blur(got, 5, 1.2)) == 2
    want = {(img, x, y): 1.0 for img in ("a", "b", "c", None) for x in range(4) for y in range(3)}
    want |= {("a", 1, 0): 0.0, ("a", 3, 2): 1 - 1 / 3, ("b", 0, 0): 0.0, ("c", 3, 2): 0.0}
    held = [((r["img"], r["ix"], r["iy"]), r["v"]) for r in got.collect()]
    assert len(held) == len(want) and dict(held) == want


def test_edges_of_faces_meet_in_one_shuffle(spark):
    faces = spark.createDataFrame([(1, 0, 1, 2), (2, 1, 3, 2), (3, 3, 1, 9)], "f long, v0 long, v1 long, v2 long")
    got = geometry.face_neighbours(faces, 7)
    assert shuffles(got) == 1 and got.rdd.getNumPartitions() == 7
    held = {(r["f"], r["lo"], r["hi"]): r["other"] for r in got.collect()}
    assert held == {(1, 1, 2): 2, (1, 0, 2): None, (1, 0, 1): None, (2, 2, 3): None, (2, 1, 2): 1, (2, 1, 3): 3, (3, 1, 9): None, (3, 3, 9): None, (3, 1, 3): 2}


def test_partitions_grow_with_the_rows(spark):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rounds.parts(spark, 10) == few and rounds.parts(spark, 100 * rounds.TASK_ROWS + 1) == 101


def test_tasks_grow_in_number_with_pixels_and_links(spark, monkeypatch):
    """However few bytes the counts are that pixels come from."""
    monkeypatch.setattr(rounds, "TASK_ROWS", 2)
    rows = spark.createDataFrame([("a", 1, 0), ("a", 3, 2), ("b", 0, 0), ("c", 3, 2)], "img string, ix int, iy int")
    got = rasters.counted(rows, 4, 3, 3)
    assert got.rdd.getNumPartitions() == 18 and shuffles(raster.blur(got, 5, 1.2)) == 2
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rasters.counted(rows, 4, 3).collect()))
    cells = spark.createDataFrame([(i, p, 0.5, p) for i in "ab" for p in range(6)], "img string, pid long, k double, code long")
    links = spark.createDataFrame([(p, q) for p in range(6) for q in (p - 1, p + 1) if 0 <= q < 6], "pid long, near long")
    got = dither.gains(cells, links, 0.25)
    assert got.rdd.getNumPartitions() == 12
    assert {(r["img"], r["pid"]): r["gain"] for r in got.collect()} == {(i, p): 1.25 if p == 0 else 0.75 if p == 5 else 1.0 for i in "ab" for p in range(6)}


def test_directions_come_with_their_pixels_without_a_shuffle(spark):
    """The three products go along the image's own lines, and so does its darkness."""
    rows = spark.createDataFrame([("a", 1, 0)] * 3 + [("a", 3, 2), ("b", 0, 0)], "img string, ix int, iy int")
    image = rasters.counted(rows, 4, 3)
    got = subdivision.directed(image, 0.8)
    assert shuffles(got) == shuffles(image) == 2
    # Nothing that can be worked out from a pixel's number is written.
    assert got.columns == ["img", "ix", "iy", "k", "theta"]
    own = {(r["img"], r["ix"], r["iy"]): 1 - r["v"] for r in image.collect()}
    assert {(r["img"], r["ix"], r["iy"]): r["k"] for r in got.collect()} == own
    field = raster.structure_tensor(image, 1.0, 1.6)
    for c in ("t11", "t12", "t22"):
        assert field.columns[3:] == ["t11", "t12", "t22", "theta", "coherence"]
        alone = raster.gradients(raster.blur(image, 3, 1.0))
        gx, gy = ("gx", "gx") if c == "t11" else ("gx", "gy") if c == "t12" else ("gy", "gy")
        alone = raster.blur(alone.selectExpr("img", "ix", "iy", f"cast({gx} * {gy} as float) as v"), 5, 1.6)
        assert {(r["img"], r["ix"], r["iy"]): r["v"] for r in alone.collect()} == {(r["img"], r["ix"], r["iy"]): r[c] for r in field.collect()}


def test_a_drawing_s_paths_are_gathered_once(spark):
    rows = [(layer, p, k, float(p + k), 1.0) for layer, n in (("a", 3), ("b", 1)) for p in range(n) for k in range(2)]
    points = spark.createDataFrame(rows, "layer string, path_id long, seq int, x double, y double").repartition(5, "layer")
    got = paths.svg_lines(points, "layer", 10.0, 20.0, 0.5)
    assert shuffles(got) == 1
    lines = {(r["layer"], r["line"]): r["text"] for r in got.collect()}
    assert sorted(lines) == [("a", k) for k in range(7)] + [("b", k) for k in range(5)]
    for layer, n in (("a", 3), ("b", 1)):
        assert lines[layer, 0].startswith("<svg ") and lines[layer, 1].startswith("<g ") and lines[layer, n + 2] == "</g>" and lines[layer, n + 3] == "</svg>"
        assert [lines[layer, k + 2] for k in range(n)] == [f'<path d="M{k} 1 L{k + 1} 1"/>' for k in range(n)]


@pytest.mark.parametrize(("side", "steps"), [(1, 32), (40, 3), (1 << 15, 32)])
def test_layers_side_by_side_are_visited_like_each_alone(spark, monkeypatch, side, steps):
    """Also where a layer goes on in the next batch of rows."""
    rng = np.random.default_rng(2)
    rows = [(layer, p, *map(float, rng.integers(0, 6, 4))) for layer, n in (("a", 50), ("b", 1), (None, 7), ("c", 23)) for p in range(n)]
    want = {}
    for layer in ("a", "b", None, "c"):
        left, at, place = [r for r in rows if r[0] == layer], (0.0, 0.0), 0
        while left:
            far = lambda x, y: (x - at[0]) ** 2 + (y - at[1]) ** 2  # noqa: E731, B023
            best = min(left, key=lambda r: (min(far(*r[2:4]), far(*r[4:6])), r[1]))
            turn = far(*best[4:6]) < far(*best[2:4])
            want[layer, best[1]] = (place, turn)
            left.remove(best)
            at, place = best[2:4] if turn else best[4:6], place + 1
    layer = np.repeat(np.arange(4), [50, 1, 7, 23])
    points = np.array([r[2:] for r in rows])
    monkeypatch.setattr(kernels, "STEPS", steps)
    at, turned = kernels.nearest_first(layer, points[:, :2], points[:, 2:])
    place = np.arange(len(rows)) - np.searchsorted(layer, layer)
    assert {rows[i][:2]: (k, t) for i, k, t in zip(at.tolist(), place.tolist(), turned.tolist(), strict=True)} == want
    ends = spark.createDataFrame(rows, "layer string, path_id long, ax double, ay double, bx double, by_ double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(side, 1000)))
    try:
        got = {(r["layer"], r["path_id"]): (r["place"], r["reversed"]) for r in kernels.visiting_order(ends, "layer", 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_a_mesh_costs_each_point_alike_and_has_empty_circles():
    """Twelve thousand points take seconds, where each against all triangles took a minute; a grid's circles hold four."""
    rng = np.random.default_rng(4)
    grid = rng.permutation(np.array([(x, y) for x in range(12) for y in range(12)], float))
    for points, faces in ((rng.random((300, 2)) * 50, None), (grid, 2 * 11 * 11)):
        n = len(points)
        mesh = kernels._mesh(np.vstack([points, points.mean(0) + 1e5 * np.array([[-2, -1], [2, -1], [0, 2]])]))
        inner = mesh[(mesh < n).all(1)]
        assert len(mesh) == 2 * n + 1 and (faces is None or len(inner) == faces)
        a, b, c = (points[inner[:, k]] for k in range(3))
        cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
        assert (cross(b - a, c - a) > 0).all()
        for q in points:
            u, v, w = a - q, b - q, c - q
            det = (u**2).sum(1) * cross(v, w) - (v**2).sum(1) * cross(u, w) + (w**2).sum(1) * cross(u, v)
            assert (det <= 1e-6).all()
    points = rng.random((12000, 2)) * 50
    began = time.process_time()
    mesh = kernels._mesh(np.vstack([points, points.mean(0) + 1e5 * np.array([[-2, -1], [2, -1], [0, 2]])]))
    assert len(mesh) == 24001 and time.process_time() - began < 12
