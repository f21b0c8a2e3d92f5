"""Waves on carriers and parts of pages against what they are to draw."""

import math

from plumbline.operators import tiles, waves
from plumbline.plans import wiggly
from plumbline.sources.rasters import LI_H, LI_W
from pyspark.sql import functions as F


def flat(spark, values):
    rows = [(n, x, y, v) for n, v in values.items() for y in range(LI_H) for x in range(LI_W)]
    return spark.createDataFrame(rows, "img string, ix int, iy int, v double")


def test_wiggly_lines_draw_the_tone_asked(spark):
    """Ink in the strips of the three rows in the middle, which the page's edge doesn't cut, and away from the joints."""
    values, margin = {"dark": 0.2, "mid": 0.5, "light": 0.8}, 3.0
    y0 = wiggly.corners(LI_W, LI_H, wiggly.HEIGHT)[0][2]
    low, high = y0 + wiggly.HEIGHT / 2, y0 + 3.5 * wiggly.HEIGHT
    length, last = {n: 0.0 for n in values}, {}
    for r in wiggly.drawn(spark, flat(spark, values)).orderBy("path_id", "run", "seq").collect():
        x, y = last.get((r.path_id, r.run), (r.x, r.y))
        if low <= (y + r.y) / 2 <= high and 1 + margin <= (x + r.x) / 2 <= LI_W - margin:
            length[r.path_id] += math.hypot(r.x - x, r.y - y)
        last[r.path_id, r.run] = (r.x, r.y)
    area = (high - low) * (LI_W - 1 - 2 * margin)
    for n, v in values.items():
        asked = 1 - (v * (wiggly.BAND[1] - wiggly.BAND[0]) + wiggly.BAND[0])
        assert abs(length[n] * wiggly.PEN / area / asked - 1) < 0.1, (n, length[n] * wiggly.PEN / area, asked)


def test_square_waves_pass_both_levels_at_each_turn(spark):
    line = spark.createDataFrame([(1, i, float(i), 0.0, 0.0, 1.0, i * 2.0, 1.0) for i in range(9)], "path_id int, seq int, x double, y double, nx double, ny double, phi double, amp double")
    made = waves.modulated(line, "square").orderBy("seq", "part").collect()
    turns = [r for r in made if r.part < 0]
    assert len(turns) == 2 * math.floor(16 / math.pi)
    for i in range(0, len(turns), 2):
        a, b = turns[i], turns[i + 1]
        assert abs(a.x - b.x) < 1e-12 and abs(a.y + b.y) < 1e-12 and abs(a.y) == 1
        assert abs(a.x - (i // 2 + 1) * math.pi / 2) < 1e-12
    assert waves.modulated(line.limit(0), "sawtooth").count() == 0


def test_tiles_cover_their_box_once(spark):
    sizes = spark.createDataFrame([(1, 4.0), (2, 7.5)], "key int, side double")
    for kind in ("square", "hex"):
        got = tiles.tiles(kind, sizes, (0.0, 0.0, 20.0, 15.0))
        cx = F.aggregate("ring", F.lit(0.0), lambda s, p: s + p["x"]) / F.size("ring")
        cy = F.aggregate("ring", F.lit(0.0), lambda s, p: s + p["y"]) / F.size("ring")
        centres = [(r.key, round(r.cx, 6), round(r.cy, 6)) for r in got.select("key", cx.alias("cx"), cy.alias("cy")).collect()]
        assert len(centres) == len(set(centres))
        edges = tiles.tile_edges(got, (0.0, 0.0, 20.0, 15.0)).collect()
        assert edges and max(r.shared for r in edges) == 2


def test_bands_keep_a_flat_tone(spark):
    page = [(1.0, 1.0), (float(LI_W), 1.0), (float(LI_W), float(LI_H)), (1.0, float(LI_H))]
    k = tiles.band_darkness(flat(spark, {"a": 0.25}), page, 0.0, 1.0, 0.5)
    assert all(0 < r.k <= 0.75 + 1e-9 for r in k.collect()) and k.where("k > 0.749").count() > 0.8 * k.count()
