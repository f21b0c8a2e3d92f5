"""Relaxed points against a plain loop, and the published drift of density."""

import math
import random
from collections import Counter

import duckdb
import pytest

from plumbline.operators import relax
from plumbline.plans import cells


def plain(image, seeds, rounds, damping, longest):
    seeds, made = dict(seeds), 0
    for _ in range(rounds):
        made += 1
        sums = {p: [0.0, 0.0, 0.0] for p in seeds}
        for (x, y), v in image.items():
            if v < 1:
                p = min(seeds, key=lambda p: ((seeds[p][0] - x - 1) ** 2 + (seeds[p][1] - y - 1) ** 2, p))
                for k, t in enumerate((1, x + 1, y + 1)):
                    sums[p][k] += (1 - v) * t
        worst = 0.0
        for p, (m, sx, sy) in sums.items():
            x, y = seeds[p]
            dx, dy = ((sx / m - x) * damping, (sy / m - y) * damping) if m else (0.0, 0.0)
            size = math.hypot(dx, dy)
            k = longest / size if size > longest else 1.0
            seeds[p], worst = (x + dx * k, y + dy * k), max(worst, size * k)
        if worst < relax.SETTLED:
            break
    return seeds, made


@pytest.mark.parametrize(("damping", "longest"), [(1.0, None), (0.5, 0.7)])
def test_points_are_the_plain_ones(spark, damping, longest):
    rng, w, h = random.Random(4), 22, 17
    images = {"ramp": {(x, y): x / (w - 1) for x in range(w) for y in range(h)}, "noise": {(x, y): rng.random() for x in range(w) for y in range(h)}, "still": {(x, y): 0.0 if (x, y) in ((3, 3), (15, 9)) else 1.0 for x in range(w) for y in range(h)}}
    seeds = {"ramp": {p: (rng.uniform(1, w), rng.uniform(1, h)) for p in range(9)}, "noise": {p: (rng.uniform(1, w), rng.uniform(1, h)) for p in range(5)}, "still": {0: (4.0, 4.0), 1: (16.0, 10.0), 2: (1.0, 17.0)}}
    df = spark.createDataFrame([(i, x, y, float(v)) for i, im in images.items() for (x, y), v in im.items()], "img string, ix int, iy int, v double")
    at = spark.createDataFrame([(i, p, *xy) for i, s in seeds.items() for p, xy in s.items()], "img string, pid long, x double, y double")
    got = relax.relaxed(df, at, w, h, 5, damping, longest, 2.5).collect()
    assert Counter((r["img"], r["pid"]) for r in got) == Counter((i, p) for i, s in seeds.items() for p in s)
    for i in images:
        want, made = plain(images[i], seeds[i], 5, damping, longest or math.inf)
        for r in got:
            if r["img"] == i:
                assert math.dist((r["x"], r["y"]), want[r["pid"]]) < 1e-4 and r["rounds"] == made
    assert {r["rounds"] for r in got if r["img"] == "still"} == {1}


def test_density_drifts_as_published(spark):
    """Eight steps on a field of four to one from an even start: the ink of a light cell to a dark one's stays below the pull
    towards the root of the density, and starts from points as dense as the ink."""
    w, h = 80, 40
    df = spark.createDataFrame([("f", x, y, 0.2 if x < w // 2 else 0.8) for x in range(w) for y in range(h)], "img string, ix int, iy int, v double")
    dark = [(x, y) for x in range(16) for y in range(16)]
    light = [(x, y) for x in range(8) for y in range(8)]
    seeds = [("f", i, 1 + (x + 0.5) * 2.5, 1 + (y + 0.5) * 2.5) for i, (x, y) in enumerate(dark)] + [("f", 1000 + i, 41 + (x + 0.5) * 5.0, 1 + (y + 0.5) * 5.0) for i, (x, y) in enumerate(light)]
    got = relax.relaxed(df, spark.createDataFrame(seeds, "img string, pid long, x double, y double"), w, h, 8).collect()
    assert len(got) == len(seeds)
    left = sum(r["x"] < w / 2 + 0.5 for r in got)
    drift = (0.8 * w * h / 2 / left) / (0.2 * w * h / 2 / (len(got) - left))
    assert 1.0 <= drift <= 1.25, drift


def test_a_half_is_rounded_up_in_whatever_order_the_ink_is_added(spark):
    """Ink of thirds and sevenths whose centre lies on a whole pixel, half a part off the point's way to it."""
    w, h, n = 9, 3, 60
    ink = {(3, 1): 1 / 3, (5, 1): 1 / 3, (2, 1): 1 / 7, (6, 1): 1 / 7, (4, 0): 2 / 7, (4, 2): 2 / 7, (1, 1): 0.1, (7, 1): 0.1}
    rng = random.Random(5)
    rows = [(i, x, y, 1 - v) for i in range(n) for (x, y), v in ink.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "img long, ix int, iy int, v double").repartition(7)
    at = spark.createDataFrame([(i, 1, 4.0, 2.0) for i in range(n)], "img long, pid long, x double, y double")
    got = relax.relaxed(df, at, w, h, 1, 0.5, 1.5).collect()
    assert len(got) == n and {(r["x"], r["y"]) for r in got} == {((9 * 999983 + 1) / 2 / relax.GRAIN, 2.0)}


def test_pixels_are_written_once_and_no_round_leaves_a_table(spark, monkeypatch):
    """What lies on disk doesn't add up from round to round, and what grows with the images isn't broadcast."""
    w, h = 40, 30
    df = spark.createDataFrame([(i, x, y, ((x * 7 + y * 3 + i) % 11) / 11) for i in range(3) for x in range(w) for y in range(h)], "img long, ix int, iy int, v double")
    at = spark.createDataFrame([(i, p, 1.0 + p % 9, 1.0 + p // 9) for i in range(3) for p in range(20)], "img long, pid long, x double, y double")
    written, plans, gone = [], [], []
    write, free = relax.materialise, relax.release

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        written.append(write(df))
        return written[-1]

    monkeypatch.setattr(relax, "materialise", noted)
    monkeypatch.setattr(relax, "release", lambda *tables: gone.extend(map(id, tables)) or free(*tables))
    assert relax.relaxed(df, at, w, h, 3).count() == 60
    assert sum(id(t) not in gone for t in written) == 1
    assert not any("Broadcast" in p for p in plans)
    assert sum("ms" in t.columns for t in written) == 1 and not any({"m", "ix", "xs"} & set(t.columns) for t in written if "ms" not in t.columns)


def test_line_items_without_a_supplier_and_broken_quantities_are_those_of_the_sql(spark, tmp_path):
    """An image without a name is white, and its points rest where they are."""
    rng = random.Random(6)
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem (l_suppkey BIGINT, l_quantity DOUBLE, l_discount DOUBLE)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?)", [(rng.choice([1, 2, None]), rng.randint(2, 200) / 4, rng.randint(0, 10) / 100) for _ in range(300)])
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    want = con.execute(cells.RELAX_SQL).fetchall()
    got = [tuple(r) for r in cells.relaxed_points(spark, str(tmp_path)).collect()]
    assert len(got) == 36 and Counter(got) == Counter(want)
