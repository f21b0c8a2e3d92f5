"""Queries over the laws of :mod:`plumbline.functions.maps`: targets, spacings, orientations, orders, frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import maps as L
from plumbline.functions import scalar as S
from plumbline.operators import geometry, raster
from plumbline.plans import fields, sql
from plumbline.plans.sql import q
from plumbline.plans.strokes import RINGS, _rings
from plumbline.sources import rasters
from plumbline.sources.rasters import LI_H, LI_W

PEN, PX_PER_CM = 1.5, 30.0
LO, HI = L.spacings(PEN, 2.0, 40.0)
BAND = L.stripe_band(PEN, LO, HI)
LEVELS, DARKEST = 5, 0.95
NET = (2 * math.sqrt(3), 0.69, 1.04)


def _quantised(df: DataFrame, keys: list[str], values: dict, scale: float = 1e5) -> DataFrame:
    return df.select(*keys, *[S.quantised(v, scale).alias(n) for n, v in values.items()])


def _q(values: dict[str, str], scale: str = "1e5") -> str:
    return ", ".join(f"{q(v, scale)} AS {n}" for n, v in values.items())


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a method aims at in each pixel: the value in the band that stripes reach, the staircase of crossed layers, the
    clamp to the darkest mark, the cut-off of a noise field; and the image turned to its negative and back."""
    v = F.col("v")
    made = {
        "stripes": L.into_band(v, BAND),
        "stairs": L.staircase(v, LEVELS, DARKEST),
        "marks": F.greatest(v, F.lit(0.6)),
        "noise": L.cutoff(v, PEN, 30.0),
    }
    li = rasters.lineitem_raster(spark, sf_dir)
    negative = rasters.inverted(li).select("img", "ix", "iy", F.col("v").alias("negative"))
    return _quantised(li.join(negative, ["img", "ix", "iy"]), ["img", "ix", "iy"], made | {"negative": F.col("negative")})


_LADDER = L.rungs(LEVELS, DARKEST)
_K = f"greatest(0, least({DARKEST}, (1 - v) * {DARKEST}::DOUBLE))"
_RUNG = f"floor((CASE {' '.join(f'WHEN k < {_LADDER[i + 1]!r}::DOUBLE THEN {i} + (k - {_LADDER[i]!r}::DOUBLE) / {_LADDER[i + 1] - _LADDER[i]!r}::DOUBLE' for i in range(LEVELS))} ELSE {LEVELS} END) + 0.5)::INT"
TARGET_SQL = f"""
WITH {sql.LI}, k AS (SELECT *, {_K} AS k FROM li), r AS (SELECT *, {_RUNG} AS rung FROM k)
SELECT img, ix, iy, {_q({"stripes": f"v * {BAND[1] - BAND[0]!r}::DOUBLE + {BAND[0]!r}::DOUBLE", "stairs": f"1 - [{', '.join(f'{x!r}::DOUBLE' for x in _LADDER)}][rung + 1]",
    "marks": "greatest(v, 0.6::DOUBLE)", "noise": f"CASE WHEN 1 - v < {L.ZERO_LINES * PEN / 30.0!r}::DOUBLE THEN 1 ELSE v END", "negative": "1 - v"})} FROM r"""


def spacing_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing of a net, density of its nodes, radius of packed circles and wavelength of a noise field, by pixel."""
    v = F.col("v")
    d = L.net_spacing(v, PEN, *NET, LO, HI)
    made = {"spacing": d, "density": L.density(d) * 1000, "radius": L.radius(v, 2.0, 9.0), "wavelength": L.wavelength(v, PEN, 4.0, 30.0)}
    return _quantised(rasters.lineitem_raster(spark, sf_dir), ["img", "ix", "iy"], made)


_C = NET[2] * NET[0] * PEN
_BAND = [1 - min(1.0, _C / (d + NET[1] * PEN)) for d in (LO, HI)]
SPACING_SQL = f"""
WITH {sql.LI}, d AS (SELECT *, greatest({LO}::DOUBLE, least({HI}::DOUBLE, {_C!r}::DOUBLE / greatest(1e-6, 1 - (greatest(0, least(1, v)) * {_BAND[1] - _BAND[0]!r}::DOUBLE + {_BAND[0]!r}::DOUBLE)) - {NET[1] * PEN!r}::DOUBLE)) AS d FROM li)
SELECT img, ix, iy, {_q({"spacing": "d", "density": f"{L.HEX_DENSITY}::DOUBLE / (d * d) * 1000", "radius": f"greatest(2, least(9, 2.0::DOUBLE / (1 - v * {1 - 2 / 9!r}::DOUBLE)))",
    "wavelength": f"CASE WHEN 1 - v > 1e-6 THEN greatest(4, least(30, {L.ZERO_LINES * PEN!r}::DOUBLE / (1 - v))) ELSE 30 END"})} FROM d"""


def orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of the structure tensor brought to six of a half turn and to the diagonals, and the share of rising
    diagonals, gated by the image's median energy (that of each seventh pixel)."""
    t = raster.structure_tensor(rasters.lineitem_raster(spark, sf_dir), 1.0, 1.0)
    theta = 0.5 * F.atan2(S.half_up(2e4 * F.col("t12")), S.half_up(1e4 * (F.col("t11") - F.col("t22")))) + math.pi / 2
    energy = F.col("t11") + F.col("t22")
    t = t.select("img", "ix", "iy", theta.alias("theta"), energy.alias("energy"), "coherence")
    seventh = t.where(f"(iy * {LI_W} + ix) % 7 = 0").groupBy("img").agg(F.sort_array(F.collect_list("energy")).alias("e"))
    median = seventh.select("img", F.get("e", F.floor(F.size("e") / 2).cast("int")).alias("median"))
    g = t.join(median, "img").withColumn("gate", L.gate(F.col("energy"), F.col("median"), F.col("coherence")))
    made = {"sixth": L.quantised_angle(F.col("theta") + 0.01, 6), "diagonal": L.diagonal(F.col("theta") + 0.01), "mix": L.diagonal_mix(F.col("theta"), F.col("gate"))}
    return _quantised(g, ["img", "ix", "iy"], made, 100.0)


_TENSOR = fields.TENSOR_SQL[: fields.TENSOR_SQL.rindex("SELECT img, ix, iy")]
ORIENTATION_SQL = f"""{_TENSOR.rstrip()},
o AS (SELECT img, ix, iy, 0.5 * atan2(floor(2e4::DOUBLE * t12 + 0.5), floor(1e4::DOUBLE * (t11 - t22) + 0.5)) + pi() / 2 AS theta, t11 + t22 AS energy,
 sqrt((t11 - t22) * (t11 - t22) + 4 * t12 * t12) / (t11 + t22 + 1e-12) AS coherence FROM t),
m AS (SELECT img, list_sort(list(energy)) AS e FROM o WHERE (iy * {LI_W} + ix) % 7 = 0 GROUP BY img),
gt AS (SELECT o.*, CASE WHEN e[len(e) // 2 + 1] > 0 THEN least(1, energy / e[len(e) // 2 + 1] / 2) ELSE 0 END AS s FROM o JOIN m USING (img))
SELECT img, ix, iy, {_q({"sixth": "floor((theta + 0.01) / (pi() / 6) + 0.5) * (pi() / 6)", "diagonal": "floor((theta + 0.01 - pi() / 4) / (pi() / 2) + 0.5) * (pi() / 2) + pi() / 4",
    "mix": "0.5 + 0.5 * sin(2 * theta) * greatest(0, least(1, coherence * (s * s * (3 - 2 * s))))"}, "100")} FROM gt"""

KINDS = ("circle", "square", "diamond", "angled")
TURN = 0.6


def placement_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each pixel from the middle by four shapes; its place when shapes are set from the middle outwards, and
    when the darkest pixels go first, ties by the pixel's number."""
    dx, dy = F.col("ix") + 1 - (LI_W + 1) / 2, F.col("iy") + 1 - (LI_H + 1) / 2
    li = rasters.lineitem_raster(spark, sf_dir).select("img", "ix", "iy", "v", *[S.quantised(L.distance(k, dx, dy, TURN), 1e4).alias(k) for k in KINDS])
    index = F.col("iy") * LI_W + F.col("ix")
    outwards, darkest = Window.partitionBy("img").orderBy("circle", index), Window.partitionBy("img").orderBy("v", index)
    return li.select("img", "ix", "iy", *KINDS, F.row_number().over(outwards).alias("outwards"), F.row_number().over(darkest).alias("darkest"))


_DX, _DY = f"(ix + 1 - {(LI_W + 1) / 2}::DOUBLE)", f"(iy + 1 - {(LI_H + 1) / 2}::DOUBLE)"
_CA, _SA = f"{math.cos(TURN)!r}::DOUBLE", f"{math.sin(TURN)!r}::DOUBLE"
PLACEMENT_SQL = f"""
WITH {sql.LI}, d AS (SELECT img, ix, iy, v, {_q({"circle": f"sqrt({_DX} * {_DX} + {_DY} * {_DY})", "square": f"greatest(abs({_DX}), abs({_DY}))", "diamond": f"abs({_DX}) + abs({_DY})",
    "angled": f"greatest(abs({_DX} * {_CA} - {_DY} * {_SA}), abs({_DX} * {_SA} + {_DY} * {_CA}))"}, "1e4")} FROM li)
SELECT img, ix, iy, circle, square, diamond, angled, row_number() OVER (PARTITION BY img ORDER BY circle, iy * {LI_W} + ix)::INT AS outwards,
 row_number() OVER (PARTITION BY img ORDER BY v, iy * {LI_W} + ix)::INT AS darkest FROM d"""


def disc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets within a radius for each region, from the middle outwards; ``start`` is the place where its distance's
    group begins."""
    r = rasters.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("key"), (F.col("r_regionkey") + 3).cast("int").alias("r"))
    span = F.sequence(-F.col("r"), F.col("r"))
    cell = r.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span)).withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).where("d2 <= r * r")
    order = Window.partitionBy("key").orderBy("d2", "dy", "dx")
    return cell.select("key", "dx", "dy", "d2", F.row_number().over(order).alias("place"), F.rank().over(Window.partitionBy("key").orderBy("d2")).alias("start"))


DISC_SQL = """
WITH c AS (SELECT r_regionkey::INT AS key, dx::INT AS dx, dy::INT AS dy, (dx * dx + dy * dy)::INT AS d2 FROM region, range(-20, 21) a(dx), range(-20, 21) b(dy)
 WHERE abs(dx) <= r_regionkey + 3 AND abs(dy) <= r_regionkey + 3 AND dx * dx + dy * dy <= (r_regionkey + 3) * (r_regionkey + 3))
SELECT key, dx, dy, d2, row_number() OVER (PARTITION BY key ORDER BY d2, dy, dx)::INT AS place, rank() OVER (PARTITION BY key ORDER BY d2)::INT AS start FROM c"""


def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each image's inked pixels that ask for more than a mark in every cell of side 2 can lay."""
    most = (2.0 * 0.6 + math.pi * 0.36 / 4) / 4
    k = 1 - F.col("v")
    live = rasters.lineitem_raster(spark, sf_dir).where(k > 0)
    return live.groupBy("img").agg(F.count("*").alias("live"), S.quantised(F.avg((k >= most).cast("double"))).alias("saturated"))


SATURATION_SQL = f"""
WITH {sql.LI} SELECT img, count(*) AS live, {q(f"avg(CASE WHEN 1 - v >= {(2.0 * 0.6 + math.pi * 0.36 / 4) / 4!r}::DOUBLE THEN 1 ELSE 0 END)")} AS saturated FROM li WHERE 1 - v > 0 GROUP BY img"""


def outline_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink of each polygon's outline: its rate for a unit of length, corners allowed for, and in all."""
    ring = _rings(spark, sf_dir)
    m = geometry.measures(ring, ["poly_id"]).join(ring.groupBy("poly_id").agg(F.count("*").alias("vertices")), "poly_id")
    rate = L.ink_rate(F.col("perimeter"), F.col("vertices"), 2.0)
    return _quantised(m, ["poly_id", "vertices"], {"rate": rate, "ink": rate * F.col("perimeter")}, 1e3)


RATE_SQL = f"""
WITH {RINGS}, m AS (SELECT poly_id, count(*) AS vertices, sum(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2))) AS p FROM edge GROUP BY poly_id),
r AS (SELECT *, 1.0::DOUBLE * greatest(0.1, 1 - CASE WHEN p > 0 THEN vertices * 2.0 / p ELSE 1 END) AS rate FROM m)
SELECT poly_id, vertices, {_q({"rate": "rate", "ink": "rate * p"}, "1e3")} FROM r"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in pixels, from 1 on, as centimetres and back, and as array places."""
    p = rasters.embedding_points(spark, sf_dir)
    cm = p.select("pid", "x", "y", *[geometry.to_cm(F.col(c), PX_PER_CM).alias(f"cm_{c}") for c in ("x", "y")])
    made = {f"cm_{c}": F.col(f"cm_{c}") for c in ("x", "y")} | {f"px_{c}": geometry.to_pixels(F.col(f"cm_{c}"), PX_PER_CM) for c in ("x", "y")} | {"column": S.half_up(F.col("x")) - 1}
    return _quantised(cm, ["pid"], made)


FRAME_SQL = f"WITH {sql.EMB} SELECT pid, {_q({'cm_x': '(x - 1) / 30.0::DOUBLE', 'cm_y': '(y - 1) / 30.0::DOUBLE', 'px_x': '(x - 1) / 30.0::DOUBLE * 30 + 1', 'px_y': '(y - 1) / 30.0::DOUBLE * 30 + 1', 'column': 'floor(x + 0.5) - 1'})} FROM emb"


def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster made white outside a triangle, and each image's mean there and in all."""
    li = rasters.lineitem_raster(spark, sf_dir)
    w = geometry.whitened(li, fields.TRIANGLE)
    return w.groupBy("img").agg(S.quantised(F.avg("v")).alias("mean"), F.sum((F.col("v") < 1).cast("int")).alias("inked"))


WHITEN_SQL = f"""
WITH {sql.LI}, w AS (SELECT img, CASE WHEN {sql.inside("(ix + 1)", "(iy + 1)", fields.TRIANGLE)} THEN v ELSE 1 END AS v FROM li)
SELECT img, {q("avg(v)")} AS mean, sum(CASE WHEN v < 1 THEN 1 ELSE 0 END)::BIGINT AS inked FROM w GROUP BY img"""


def ring_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each point to a triangle's nearest side."""
    d = geometry.ring_distance(F.col("x"), F.col("y"), fields.TRIANGLE)
    return _quantised(rasters.embedding_points(spark, sf_dir), ["pid"], {"d": d}, 1e4)


_SIDES = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for (a, b), (c, d) in zip(fields.TRIANGLE, fields.TRIANGLE[1:] + fields.TRIANGLE[:1], strict=True))
DISTANCE_SQL = f"""
WITH {sql.EMB}, side(a, b, c, d) AS (VALUES {_SIDES}),
t AS (SELECT *, greatest(0, least(1, ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) * (c - a) + (d - b) * (d - b)))) AS t FROM emb, side)
SELECT pid, {q("min(sqrt(pow(x - a - t * (c - a), 2) + pow(y - b - t * (d - b), 2)))", "1e4")} AS d FROM t GROUP BY pid"""


def half_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each polygon cut by the lines of a triangle: vertices, area and centroid of what is left, if anything is. A filter
    on the area would be pushed below the cuts and work them out again for itself."""
    page = [(-20.0, -30.0), (60.0, -25.0), (5.0, 55.0)]
    rings = _rings(spark, sf_dir).groupBy("poly_id").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("s"))
    ring = rings.select("poly_id", F.transform("s", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    m = geometry.ring_measures(geometry.cut_by(ring, page))
    return m.select("poly_id", F.col("vertices").cast("long").alias("vertices"), *[S.quantised(F.col(c), 1e3).alias(c) for c in ("area", "cx", "cy")])


def cut_sql(page: list[tuple[float, float]]) -> str:
    """``f``, the sides (poly_id, x, y, x2, y2, c) of what is left of ``poly``. One step for each line: a vertex inside
    stays, and a side that crosses the line gives its crossing."""
    steps, last = [], "p0"
    for i, ((px, py), (qx, qy)) in enumerate(zip(page, page[1:] + page[:1], strict=True)):
        side = lambda x, y: f"({qx - px}::DOUBLE * ({y} - {py}) - {qy - py}::DOUBLE * ({x} - {px}))"  # noqa: B023, E731
        steps.append(f"""e{i} AS (SELECT poly_id, k, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM {last} WINDOW w AS (PARTITION BY poly_id ORDER BY k)),
s{i} AS (SELECT *, {side("x", "y")} AS a, {side("x2", "y2")} AS b FROM e{i}),
p{i + 1} AS (SELECT poly_id, row_number() OVER (PARTITION BY poly_id ORDER BY k, o) AS k, x, y FROM (
 SELECT poly_id, k, 0 AS o, x, y FROM s{i} WHERE a >= 0
 UNION ALL SELECT poly_id, k, 1, x + a / (a - b) * (x2 - x), y + a / (a - b) * (y2 - y) FROM s{i} WHERE (a >= 0) <> (b >= 0)))""")
        last = f"p{i + 1}"
    return f"""p0 AS (SELECT poly_id, k, x, y FROM poly), {", ".join(steps)},
f AS (SELECT *, x * y2 - x2 * y AS c FROM (SELECT poly_id, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM {last} WINDOW w AS (PARTITION BY poly_id ORDER BY k)))"""


CUT_SQL = f"""WITH {RINGS}, {cut_sql([(-20.0, -30.0), (60.0, -25.0), (5.0, 55.0)])}
SELECT n.poly_id, count(c) AS vertices, {_q({"area": "coalesce(abs(sum(c)) / 2, 0)", "cx": "sum((x + x2) * c) / (3 * sum(c))", "cy": "sum((y + y2) * c) / (3 * sum(c))"}, "1e3")} FROM (SELECT DISTINCT poly_id FROM poly) n LEFT JOIN f USING (poly_id) GROUP BY n.poly_id"""


QUERIES = {
    "tone_targets_li": (targets, TARGET_SQL),
    "spacing_maps_li": (spacing_maps, SPACING_SQL),
    "orientation_helpers_li": (orientations, ORIENTATION_SQL),
    "placement_orders_li": (placement_orders, PLACEMENT_SQL),
    "disc_offsets_region": (disc_offsets, DISC_SQL),
    "saturation_li": (saturation, SATURATION_SQL),
    "outline_rates_customer": (outline_rates, RATE_SQL),
    "frames_emb": (frames, FRAME_SQL),
    "whitened_li": (whitened, WHITEN_SQL),
    "ring_distance_emb": (ring_distances, DISTANCE_SQL),
    "half_planes_customer": (half_planes, CUT_SQL),
}
