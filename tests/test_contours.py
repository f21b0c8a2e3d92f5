"""Contours: chains against a plain walk, and places on their levels."""

import random
from collections import defaultdict

import pytest

from plumbline.operators import contours, raster
from plumbline.plans import contours as plan
from plumbline.sources import rasters


def chains(spark, links):
    df = spark.createDataFrame([("g", min(a, b), max(a, b)) for a, b in links], "img string, a long, b long")
    out = defaultdict(list)
    for r in contours.linked(df, ["img"]).collect():
        out[r["line"], r["closed"]].append((r["seq"], r["node"]))
    return {k: [n for _, n in sorted(v)] for k, v in out.items()}


def test_chains_of_any_length_and_name(spark):
    rng = random.Random(4)
    names = rng.sample(range(10_000), 700)
    want, links, at = {}, [], 0
    for n, closed in ((2, False), (3, False), (3, True), (4, True), (7, True), (64, False), (65, True), (129, True), (200, False)):
        run = names[at : at + n]
        at += n
        links += list(zip(run, run[1:])) + ([(run[-1], run[0])] if closed else [])
        if closed:
            k = run.index(min(run))
            run = run[k:] + run[:k]
            run = [run[0], *(run[1:] if run[1] < run[-1] else run[:0:-1]), run[0]]
        elif run[0] > run[-1]:
            run = run[::-1]
        want[run[0], closed] = run
    rng.shuffle(links)
    assert chains(spark, links) == want


def test_no_links_no_chains(spark):
    none = spark.createDataFrame([], "img string, a long, b long")
    assert contours.linked(none, ["img"]).count() == 0


def test_lines_of_a_cone_are_circles_and_those_of_a_plane_straight(spark):
    w, h = 41, 37
    cone = [("cone", x, y, float(((x - 20) ** 2 + (y - 18) ** 2) ** 0.5)) for x in range(w) for y in range(h)]
    plane = [("plane", x, y, float(x) + 0.25) for x in range(w) for y in range(h)]
    df = spark.createDataFrame(cone + plane, "img string, ix int, iy int, v double")
    held = defaultdict(list)
    for r in contours.lines(df, [7.5, 12.1], w).collect():
        held[r["img"], r["level"]].append(r)
    assert set(held) == {(i, v) for i in ("cone", "plane") for v in (7.5, 12.1)}
    for (img, level), rows in held.items():
        rows.sort(key=lambda r: r["seq"])
        assert len({r["line"] for r in rows}) == 1 and [r["seq"] for r in rows] == list(range(len(rows)))
        if img == "plane":
            assert not rows[0]["closed"] and len(rows) == h and all(abs(r["x"] - (level + 0.75)) < 1e-9 for r in rows)
        else:
            assert rows[0]["closed"] and (rows[0]["x"], rows[0]["y"]) == (rows[-1]["x"], rows[-1]["y"])
            assert all(abs(((r["x"] - 21) ** 2 + (r["y"] - 19) ** 2) ** 0.5 - level) < 0.05 for r in rows)
            steps = [((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2) ** 0.5 for a, b in zip(rows, rows[1:])]
            assert max(steps) < 1.5


def test_saddles_part_by_their_middle(spark):
    high = [("high", 0, 0, 1.0), ("high", 1, 0, 0.2), ("high", 0, 1, 0.3), ("high", 1, 1, 1.0)]
    low = [("low", x, y, 1.0 if x == y else -1.0) for x in (0, 1) for y in (0, 1)]
    df = spark.createDataFrame(high + low, "img string, ix int, iy int, v double")
    pairs = defaultdict(set)
    for r in contours.segments(df, [0.5], 2).collect():
        pairs[r["img"]].add((r["a"], r["b"]))
    # Edges: 0 top, 1 left, 3 right, 4 bottom.
    assert pairs == {"high": {(0, 3), (1, 4)}, "low": {(0, 1), (3, 4)}}


def shuffles(df):
    """Shuffles of the physical plan."""
    return sum(" Exchange " in f" {line.strip(' +-:*')} " for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_cells_meet_their_corners_without_a_shuffle(spark):
    rows = spark.createDataFrame([("a", x, y) for x in range(5) for y in range(x)], "img string, ix int, iy int")
    smooth = raster.blur(rasters.counted(rows, 5, 4), 5, 1.2)
    assert shuffles(contours.segments(smooth, [0.5], 5)) == shuffles(smooth)


@pytest.mark.parametrize("side", [1, 3, 128])
def test_chains_do_not_depend_on_tiles(spark, monkeypatch, side):
    """Nor on how many stretches are walked at once; a hole in the raster ends a line."""
    rng = random.Random(6)
    w, h = 9, 8
    rows = [(img, x, y, rng.random()) for img in "ab" for x in range(w) for y in range(h) if img != "b" or (x, y) not in {(3, 3), (6, 2)}]
    df = spark.createDataFrame(rows, "img string, ix int, iy int, v double")
    parts = contours.segments(df, [0.4, 0.6], w).cache()
    want = {tuple(r) for r in contours.linked(parts, ["img", "level"]).select("img", "level", "line", "seq", "node", "closed").collect()}
    at = {(r["img"], r["level"], r[c]): (r[f"x{c}"], r[f"y{c}"]) for r in parts.collect() for c in "ab"}
    want = {(img, level, line, seq, closed, *at[img, level, node]) for img, level, line, seq, node, closed in want}
    monkeypatch.setattr(contours, "TILE", side)
    monkeypatch.setattr(contours, "SIDE_BY_SIDE", 40)
    got = [tuple(r) for r in contours.lines(df, [0.4, 0.6], w).select("img", "level", "line", "seq", "closed", "x", "y").collect()]
    assert len(got) == len(want) and set(got) == want and {r[4] for r in got} == {True, False}


def test_lines_within_a_tile_are_written_once(spark, monkeypatch):
    """Rounds of joins are for what crosses a tile's border only."""
    written = []
    monkeypatch.setattr(contours, "materialise", lambda df: written.append(df) or df)
    df = spark.createDataFrame([("a", x, y, float(abs(x - 20) + abs(y - 18))) for x in range(41) for y in range(37)], "img string, ix int, iy int, v double")
    assert contours.lines(df, [7.5, plan.LEVELS[0]], 41).count() == 4 * 15 + 1 + 5 and len(written) == 1
