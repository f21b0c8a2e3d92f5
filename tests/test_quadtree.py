"""Crosses in quartered blocks against a plain version, depth by depth."""

import math
import random
from collections import Counter

import pytest

from plumbline.operators import quadtree
from plumbline.operators.quadtree import SIDE
from plumbline.plans import crosses


def plain(image, w, h, pen, depth):
    """{path: (x0, y0, bw, bh, inked, kept)} and the samples that stay bare."""
    bare = {(x, y) for x in range(1, w * SIDE + 1) for y in range(1, h * SIDE + 1)}
    level, out = [("", 1, 1, w, h)], {}
    for d in range(depth + 1):
        after = []
        for path, x0, y0, bw, bh in level:
            first = lambda p: (p - 1) * SIDE + 1
            own = {(x, y) for x in range(first(x0), first(x0 + bw)) for y in range(first(y0), first(y0 + bh))}
            cx, cy, r = first(x0 + (bw - 1) / 2), first(y0 + (bh - 1) / 2), pen * SIDE / 2
            hit = {(x, y) for x, y in own if (bh > 1 and abs(x - cx) < r and first(y0) <= y <= first(y0 + bh - 1)) or (bw > 1 and abs(y - cy) < r and first(x0) <= x <= first(x0 + bw - 1))}
            tone = sum(image[x - 1, y - 1] for x in range(x0, x0 + bw) for y in range(y0, y0 + bh)) / (bw * bh)
            now, ink = len(own & bare), len(hit & bare)
            kept = d < depth and not (bw <= pen and bh <= pen) and not abs(tone - now / len(own)) < abs(tone - (now - ink) / len(own))
            out[path] = (x0, y0, bw, bh, ink, kept)
            mw, mh = math.floor((bw + 2) / 2 + 0.5) - 1, math.floor((bh + 2) / 2 + 0.5) - 1
            if kept:
                bare -= hit
                if 1 <= mw < bw and 1 <= mh < bh:
                    after += [(f"{path}{2 * lo + ri}", x0 + ri * mw, y0 + lo * mh, bw - mw if ri else mw, bh - mh if lo else mh) for lo in (0, 1) for ri in (0, 1)]
        level = after
    return out, bare


@pytest.mark.parametrize(("pen", "depth"), [(0.5, 9), (1.5, 9), (0.5, 2)])
def test_blocks_are_the_plain_ones(spark, pen, depth):
    w, h, rng = 26, 19, random.Random(7)
    tones = {"ramp": lambda x, y: x / (w - 1), "white": lambda x, y: 1.0, "black": lambda x, y: 0.0, "noise": lambda x, y: rng.random()}
    images = {n: {(x, y): float(f(x, y)) for x in range(w) for y in range(h)} for n, f in tones.items()}
    df = spark.createDataFrame([(n, x, y, v) for n, i in images.items() for (x, y), v in i.items()], "img string, ix int, iy int, v double")
    arms, blocks = quadtree.crossed(df, w, h, pen, depth)
    rows, drawn = blocks.collect(), Counter(r["img"] for r in arms.collect())
    for n, image in images.items():
        want, bare = plain(image, w, h, pen, depth)
        assert {r["path"]: (r["x0"], r["y0"], r["bw"], r["bh"], r["inked"], r["kept"]) for r in rows if r["img"] == n} == want
        laid = sum(b[4] for b in want.values() if b[5])
        assert laid == w * h * SIDE * SIDE - len(bare) and drawn[n] == 2 * sum(b[5] for b in want.values())
    assert not drawn["white"] and drawn["black"] >= drawn["ramp"] > 0


def test_no_image_no_blocks(spark):
    none = spark.createDataFrame([], "img string, ix int, iy int, v double")
    arms, blocks = quadtree.crossed(none, 8, 8, 1.0)
    assert arms.count() == blocks.count() == 0


def test_a_tally_s_raster_is_counted_once(spark):
    """What is asked comes from the same pixels as what is laid."""
    made = crosses.tally(spark, "/root/testdata/sf0.001")
    assert made.count() and not [f for f in made.inputFiles() if "lineitem" in f]
