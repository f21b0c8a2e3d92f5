import pytest

from plumbline.operators import render
from plumbline.plans.hatching import Layout, hatched
from plumbline.plans.registry import METHODS, Method, Param, method
from plumbline.sources import rasters


def test_unknown_names_get_the_first_method():
    assert method("nothing").id == method("parallel_hatching").id == "parallel_hatching"


def test_values_are_checked():
    angle, _, pen = method("").params
    assert angle.checked("30", {}) == 30.0 and angle.checked(float("nan"), {}) == 26.0 and angle.checked("x", {}) == 26.0
    assert angle.checked(500, {}) == 180.0 and pen.bounds({"width": 8.0}) == (0.1, 2.0)
    assert Param("kind", "a", options=("a", "b")).checked("c", {}) == "a"


def test_channels_turn_or_reseed():
    hatch = method("parallel_hatching")
    turned = [hatch.for_channel(hatch.defaults(), c)["angle"] for c in "cmyk"]
    assert [round(t, 6) for t in turned] == [41.0, 101.0, 26.0, 71.0]
    seeded = Method("s", "s", lambda *a: None, (Param("seed", 3.0),), seeds=("seed",))
    assert [seeded.for_channel({"seed": 3}, c)["seed"] for c in "cmyk"] == [3, 4, 5, 6]
    assert hatch.variation() == "angle" and seeded.variation() == "seed" and Method("n", "n", lambda *a: None).variation() is None


def test_a_method_runs_on_a_raster(spark):
    src = spark.createDataFrame([("a", x, y, x / 19) for y in range(12) for x in range(20)], "img string, ix int, iy int, v double")
    m = method("parallel_hatching")
    got = m.run(src, 20, 12, m.defaults()).collect()
    assert len(got) > 5 and len(got) == hatched(src, Layout(20, 12)).count()
    assert all(1 - 1e-6 <= v <= 20 + 1e-6 for r in got for v in (r.x1, r.x2)) and all(1 - 1e-6 <= v <= 12 + 1e-6 for r in got for v in (r.y1, r.y2))


@pytest.mark.parametrize("m", METHODS, ids=lambda m: m.id)
def test_methods_draw_on_the_page(spark, m):
    w, h = 40, 24
    src = spark.createDataFrame([(i, x, y, 1 - k * x / (w - 1)) for i, k in (("a", 1.0), ("b", 0.6), ("white", 0.0)) for y in range(h) for x in range(w)], "img string, ix int, iy int, v double")
    rows = m.run(src, w, h, m.defaults()).collect()
    assert {r.img for r in rows} == {"a", "b"} and {p.key for p in m.params} >= {"pen"}
    room = 3.5  # what a dot or a band may stand out by
    assert all(1 - room <= v <= n + room for r in rows for n, v in ((w, r.x1), (w, r.x2), (h, r.y1), (h, r.y2)))
    dark = {i: sum(((r.x1 - r.x2) ** 2 + (r.y1 - r.y2) ** 2) ** 0.5 for r in rows if r.img == i and r.x1 + r.x2 > w) for i in "ab"}
    light = {i: sum(((r.x1 - r.x2) ** 2 + (r.y1 - r.y2) ** 2) ** 0.5 for r in rows if r.img == i and r.x1 + r.x2 <= w) for i in "ab"}
    assert dark["a"] > dark["b"] and all(dark[i] > light[i] for i in "ab")


@pytest.mark.parametrize("lattice", ["square", "hex"])
def test_dither_grid_holds_its_mean(spark, lattice):
    """Scored on its mean, as one threshold is: within 0.02 of the image's."""
    w, h = 120, 50
    m, ramp = method("dither_grid"), rasters.ramp(spark, w, h).cache()
    strokes = m.run(ramp, w, h, m.defaults() | {"lattice": lattice}).select("img", "x1", "y1", "x2", "y2")
    drawn = render.rendered(strokes, ramp, w, h, 1.5, 4)
    means = [df.agg({"v": "avg"}).first()[0] for df in (ramp, drawn)]
    assert abs(means[0] - means[1]) < 0.02, means
