"""Queries over parts of a page and what is laid on carriers: bands, lattices, tiles, owed ink, waves, rebuilt rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import geometry, iterative, paths, raster, tiles, waves
from plumbline.plans import fields, sql
from plumbline.plans.fields import PAGE, TRIANGLE
from plumbline.plans.maps import cut_sql
from plumbline.plans.sql import q
from plumbline.plans.strokes import _P
from plumbline.sources import rasters
from plumbline.sources.rasters import LI_H, LI_W

ANGLE, SCALE, PEN, DOT, REACH, COUNT, FLAT = 0.4, 1.2, 0.7, 1.3, 1.5, 400.0, math.pi / 4
#: A scale that puts no simple fraction half way between two whole numbers.
UNEVEN = 99991.0
BOX = (1.0, 1.0, float(LI_W), float(LI_H))
_DARK = "(1 - greatest(0, least(1, v::DOUBLE)))"


def band_darkness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean darkness along the bands of a turned page."""
    k = tiles.band_darkness(rasters.lineitem_raster(spark, sf_dir), PAGE, ANGLE, SCALE, PEN)
    return k.select("img", "band", "m", S.quantised(F.col("k")).alias("k"))


_C, _S = math.cos(ANGLE), math.sin(ANGLE)
_U, _V = [x * _C + y * _S for x, y in PAGE], [y * _C - x * _S for x, y in PAGE]
_SPAN, _NV = max(_U) - min(_U), max(2, math.ceil(max(_V) - min(_V)) + 1)
BAND_SQL = f"""
WITH {sql.LI}, a AS (SELECT img, greatest(0.02, avg({_DARK})) AS kmean FROM li GROUP BY img),
b AS (SELECT img, greatest(2, floor({_SPAN!r}::DOUBLE / greatest({PEN}, least({_SPAN / 6!r}::DOUBLE, {SCALE * PEN!r}::DOUBLE / kmean)) + 0.5))::INT AS bands FROM a),
f AS (SELECT img, bands, {_SPAN!r}::DOUBLE / bands AS height, greatest(2, ceil({_SPAN!r}::DOUBLE / bands))::INT AS n FROM b),
g AS (SELECT *, unnest(range(bands)) AS band FROM f), h AS (SELECT *, unnest(range(n)) AS s FROM g), i AS (SELECT * FROM h, range({_NV}) r(m)),
p AS (SELECT img, band, m, n, {min(_U)!r}::DOUBLE + band * height + (s + 0.5) * height / n AS u, {min(_V)!r}::DOUBLE + m AS w FROM i),
o AS (SELECT img, band, m, n, (floor(u * {_C!r}::DOUBLE - w * {_S!r}::DOUBLE + 0.5) - 1)::INT AS ix, (floor(u * {_S!r}::DOUBLE + w * {_C!r}::DOUBLE + 0.5) - 1)::INT AS iy FROM p)
SELECT img, band::INT AS band, m::INT AS m, {q(f"sum({_DARK}) / max(n)")} AS k FROM o JOIN li USING (img, ix, iy) GROUP BY ALL"""


def lattice_darkness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the dots of both lattices stand, and the darkness that each is to draw."""
    li, out = rasters.lineitem_raster(spark, sf_dir), None
    for kind, hexagonal in (("square", False), ("hex", True)):
        k = tiles.lattice_darkness(li, LI_W, LI_H, DOT, hexagonal).join(tiles.lattice_cells(spark, LI_W, LI_H, DOT, hexagonal), "pid")
        part = k.select(F.lit(kind).alias("kind"), "img", "pid", *[S.quantised(F.col(c), UNEVEN).alias(c) for c in ("x", "y", "k")])
        out = part if out is None else out.unionByName(part)
    return out


def _lattice_sql(kind: str, hexagonal: bool) -> str:
    cols, rows, x0, y0, dx, dy = tiles.lattice(LI_W, LI_H, DOT, hexagonal)
    shift = "(CASE WHEN i % 2 = 1 THEN 0.5 ELSE 0 END)" if hexagonal else "0"
    sx, sy = LI_W / cols, LI_H / rows
    return f"""{kind}_w AS (SELECT img, X.x, Y.y, v, greatest(0, least(ix + 1, (X.x + 1) * {sx!r}::DOUBLE) - greatest(ix, X.x * {sx!r}::DOUBLE))
  * greatest(0, least(iy + 1, (Y.y + 1) * {sy!r}::DOUBLE) - greatest(iy, Y.y * {sy!r}::DOUBLE)) AS k FROM li, range({cols}) X(x), range({rows}) Y(y)),
{kind}_s AS (SELECT img, x AS ix, y AS iy, sum(v * k) / sum(k) AS v FROM {kind}_w WHERE k > 0 GROUP BY ALL),
{kind}_c AS (SELECT i * {cols} + j AS pid, i, j, least({cols - 1}, j + {shift})::DOUBLE AS fx, {x0!r}::DOUBLE + (j + {shift}) * {dx!r}::DOUBLE AS x, {y0!r}::DOUBLE + i * {dy!r}::DOUBLE AS y FROM range({rows}) r(i), range({cols}) c(j)),
{kind}_k AS (SELECT img, pid, x, y, 1 - sum(v * greatest(0, 1 - abs(ix - fx))) AS k FROM {kind}_c JOIN {kind}_s ON iy = i AND abs(ix - fx) < 1 GROUP BY ALL)"""


def _lattice_out(kind: str) -> str:
    return f"""SELECT '{kind}' AS kind, img, pid::BIGINT AS pid, {q("x", str(UNEVEN))} AS x, {q("y", str(UNEVEN))} AS y, {q("k", str(UNEVEN))} AS k FROM {kind}_k"""


LATTICE_SQL = f"WITH {sql.LI}, {_lattice_sql('square', False)}, {_lattice_sql('hex', True)} {_lattice_out('square')} UNION ALL {_lattice_out('hex')}"


def lattice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Darkness of each cell of the hexagonal lattice beside that of its neighbours."""
    cols, rows, *_ = tiles.lattice(LI_W, LI_H, DOT, True)
    links = tiles.lattice_links(tiles.lattice_cells(spark, LI_W, LI_H, DOT, True), cols, rows, True)
    k = tiles.lattice_darkness(rasters.lineitem_raster(spark, sf_dir), LI_W, LI_H, DOT, True)
    n = links.join(k.withColumnRenamed("pid", "near"), "near").groupBy("img", "pid").agg(F.count("*").alias("n"), F.avg("k").alias("around"))
    return n.select("img", "pid", "n", S.quantised(F.col("around"), UNEVEN).alias("around"))


LINK_SQL = f"""
WITH {sql.LI}, {_lattice_sql('hex', True)}, l AS (SELECT a.pid, b.pid AS near FROM hex_c a JOIN hex_c b ON (a.i = b.i AND abs(a.j - b.j) = 1) OR (abs(a.i - b.i) = 1 AND (a.j = b.j OR b.j - a.j = CASE WHEN a.i % 2 = 1 THEN 1 ELSE -1 END)))
SELECT img, l.pid::BIGINT AS pid, count(*) AS n, {q("avg(k)", str(UNEVEN))} AS around FROM l JOIN hex_k h ON h.pid = l.near GROUP BY ALL"""


def owed_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ink that falls to each vector's point, and what lies out of reach of all."""
    whole = rasters.whole_lineitem_raster(spark, sf_dir).select("ix", "iy", "v")
    o = tiles.owed(whole, rasters.embedding_points(spark, sf_dir), REACH, 2.0, LI_W, LI_H)
    return o.select("pid", "pixels", S.quantised(F.col("ink")).alias("ink"))


OWED_SQL = f"""
WITH {sql.LI_WHOLE}, {sql.EMB}, d AS (SELECT ix, iy, {_DARK} AS k, min({{'d2': (x - ix - 1) * (x - ix - 1) + (y - iy - 1) * (y - iy - 1), 'pid': pid}}) AS b FROM li, emb GROUP BY ix, iy, v)
SELECT CASE WHEN b.d2 <= {REACH * REACH} THEN b.pid END AS pid, count(*) AS pixels, {q("sum(k)")} AS ink FROM d WHERE k > 0 GROUP BY 1"""


def _tiles(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    sizes = rasters.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("key"), (3.3 + F.col("r_regionkey")).alias("side"))
    return tiles.tiles(kind, sizes, BOX)


def tile_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares and hexagons of five sizes over a page, cut down to it: corners, area and centroid of each, none
    of a tile that only touches the page."""
    both = _tiles(spark, sf_dir, "square").withColumn("kind", F.lit("square")).unionByName(_tiles(spark, sf_dir, "hex").withColumn("kind", F.lit("hex")))
    m = geometry.ring_measures(geometry.cut_by(both, PAGE))
    there = lambda c: F.when(F.col("area") > 1e-6, c)
    return m.select("kind", "key", "row", "col", there(F.col("vertices").cast("long")).alias("vertices"), *[there(S.quantised(F.col(c), 1e3)).alias(c) for c in ("area", "cx", "cy")])


_R = math.sqrt(2 / (3 * math.sqrt(3)))
_CORNERS = ", ".join(f"({k}, {math.cos(math.pi / 2 + k * math.pi / 3)!r}::DOUBLE, {math.sin(math.pi / 2 + k * math.pi / 3)!r}::DOUBLE)" for k in range(6))
TILES = f"""z AS (SELECT r_regionkey::BIGINT AS key, 3.3::DOUBLE + r_regionkey AS side FROM region),
sq AS (SELECT *, unnest(range(ceil({LI_W - 1} / side)::BIGINT)) AS col FROM (SELECT *, unnest(range(ceil({LI_H - 1} / side)::BIGINT)) AS row FROM z)),
h0 AS (SELECT *, unnest(range(ceil(({LI_H} + r - 1) / (1.5 * r))::BIGINT)) AS row FROM (SELECT *, side * {_R!r}::DOUBLE AS r, side * {_R!r}::DOUBLE * {math.sqrt(3)!r}::DOUBLE AS w FROM z)),
h1 AS (SELECT *, 1 - CASE WHEN row % 2 = 1 THEN w / 2 ELSE 0 END AS x0 FROM h0), h2 AS (SELECT *, unnest(range(ceil(({LI_W} + w / 2 - x0) / w)::BIGINT)) AS col FROM h1),
poly AS (SELECT {{'kind': 'square', 'key': key, 'row': row, 'col': col}} AS poly_id, k, 1 + col * side + cx * side AS x, 1 + row * side + cy * side AS y FROM sq, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) c(k, cx, cy)
 UNION ALL SELECT {{'kind': 'hex', 'key': key, 'row': row, 'col': col}}, k, x0 + col * w + r * cx, 1 + row * (1.5 * r) + r * cy FROM h2, (VALUES {_CORNERS}) c(k, cx, cy))"""
TILE_SQL = f"""WITH {TILES}, {cut_sql(PAGE)}, g AS (SELECT poly_id, count(*) AS vertices, abs(sum(c)) / 2 AS area, sum((x + x2) * c) AS sx, sum((y + y2) * c) AS sy, sum(c) AS sc FROM f GROUP BY poly_id HAVING abs(sum(c)) / 2 > 1e-6)
SELECT n.poly_id.kind AS kind, n.poly_id.key AS key, n.poly_id.row::INT AS row, n.poly_id.col::INT AS col, vertices, {q("area", "1e3")} AS area, {q("sx / (3 * sc)", "1e3")} AS cx, {q("sy / (3 * sc)", "1e3")} AS cy
FROM (SELECT DISTINCT poly_id FROM poly) n LEFT JOIN g USING (poly_id)"""


def tile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sides tiles of each size have between them, by how many share one, and how long they are."""
    out = None
    for kind in ("square", "hex"):
        e = tiles.tile_edges(_tiles(spark, sf_dir, kind), BOX).withColumn("kind", F.lit(kind))
        out = e if out is None else out.unionByName(e)
    length = lambda d: F.sqrt((F.col(f"b{d[0]}") - F.col(f"a{d[0]}")) * (F.col(f"b{d[0]}") - F.col(f"a{d[0]}")) + (F.col(f"b{d[1]}") - F.col(f"a{d[1]}")) * (F.col(f"b{d[1]}") - F.col(f"a{d[1]}")))
    return out.groupBy("kind", "key", "shared").agg(F.count("*").alias("sides"), S.quantised(F.sum(length("xy")) / 1e6, 1e2).alias("length"))


EDGE_SQL = f"""WITH {TILES}, u AS (SELECT poly_id, k, floor(x * 1e6::DOUBLE + 0.5)::BIGINT AS x, floor(y * 1e6::DOUBLE + 0.5)::BIGINT AS y FROM poly),
s AS (SELECT poly_id.kind AS kind, poly_id.key AS key, {{'x': x, 'y': y}} AS a, {{'x': coalesce(lead(x) OVER w, first(x) OVER w), 'y': coalesce(lead(y) OVER w, first(y) OVER w)}} AS b FROM u WINDOW w AS (PARTITION BY poly_id ORDER BY k)),
e AS (SELECT kind, key, least(a, b) AS a, greatest(a, b) AS b, count(*) AS shared FROM s WHERE a <> b
 AND NOT ((a.x = b.x AND a.x IN (1000000, {LI_W}000000)) OR (a.y = b.y AND a.y IN (1000000, {LI_H}000000))) GROUP BY ALL)
SELECT kind, key, shared, count(*) AS sides, {q("sum(sqrt(pow((b.x - a.x)::DOUBLE, 2) + pow((b.y - a.y)::DOUBLE, 2))) / 1e6::DOUBLE", "1e2")} AS length FROM e GROUP BY ALL"""


def perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tiles.perimeter(rasters.lineitem_raster(spark, sf_dir), BOX, LI_W, LI_H, COUNT)
    return p.select("img", "side", "i", S.quantised(F.col("x"), 1e4).alias("x"), S.quantised(F.col("y"), 1e4).alias("y"))


_CORNER = [(BOX[0], BOX[1]), (BOX[2], BOX[1]), (BOX[2], BOX[3]), (BOX[0], BOX[3])]
_SIDES = ", ".join(f"({i}, {ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE, {max(2, math.ceil(math.hypot(bx - ax, by - ay)))}, {math.hypot(bx - ax, by - ay)!r}::DOUBLE)"
    for i, ((ax, ay), (bx, by)) in enumerate(zip(_CORNER, _CORNER[1:] + _CORNER[:1], strict=True)))
PERIMETER_SQL = f"""
WITH {sql.LI}, t AS (SELECT img, sum({_DARK}) AS total FROM li GROUP BY img), sd(side, ax, ay, bx, b_y, steps, len) AS (VALUES {_SIDES}),
st AS (SELECT *, unnest(range(1, steps + 1)) AS k FROM sd),
px AS (SELECT *, greatest(0, least({LI_W - 1}, floor(ax + (bx - ax) * ((k - 0.5) / steps) + 0.5) - 1)) AS ix, greatest(0, least({LI_H - 1}, floor(ay + (b_y - ay) * ((k - 0.5) / steps) + 0.5) - 1)) AS iy FROM st),
d AS (SELECT px.*, li.img, len / steps / sqrt(1.1547::DOUBLE / greatest(1e-9, {_DARK} * {COUNT} / total)) AS d FROM px JOIN li USING (ix, iy) JOIN t ON t.img = li.img),
c AS (SELECT *, sum(d) OVER (PARTITION BY img, side ORDER BY k ROWS UNBOUNDED PRECEDING) AS p1, sum(d) OVER (PARTITION BY img, side) AS p FROM d),
g AS (SELECT *, coalesce(lag(p1) OVER (PARTITION BY img, side ORDER BY k), 0) AS p0, max(p1) OVER (PARTITION BY img, side) AS whole FROM c),
n AS (SELECT *, greatest(1, floor(whole + 0.5))::BIGINT AS n FROM g),
i AS (SELECT img, side, n, whole, unnest(range(n)) AS i FROM (SELECT DISTINCT img, side, n, whole FROM n)),
a AS (SELECT i.*, n.ax, n.ay, n.bx, n.b_y, (k - 1 + (i * i.whole / i.n - p0) / (p1 - p0)) / steps AS t FROM i JOIN n ON n.img = i.img AND n.side = i.side AND i * i.whole / i.n >= p0 AND i * i.whole / i.n < p1)
SELECT img, side, i::INT AS i, {q("ax + (bx - ax) * t", "1e4")} AS x, {q("ay + (b_y - ay) * t", "1e4")} AS y FROM a"""


def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tiles.blended(raster.structure_tensor(rasters.lineitem_raster(spark, sf_dir), 1.0, 1.0), FLAT)
    return b.select("img", "ix", "iy", S.quantised(F.col("cx"), 100.0).alias("cx"), S.quantised(F.col("cy"), 100.0).alias("cy"))


_FX, _FY = math.cos(2 * FLAT), math.sin(2 * FLAT)
_TENSOR = fields.TENSOR_SQL[: fields.TENSOR_SQL.rindex("SELECT img, ix, iy")]
BLEND_SQL = f"""{_TENSOR.rstrip()},
c AS (SELECT img, ix, iy, t11 - t22 AS a, 2 * t12 AS b, sqrt((t11 - t22) * (t11 - t22) + 4 * t12 * t12) AS spread, t11 + t22 AS trace FROM t),
m AS (SELECT img, ix, iy, {_FX!r}::DOUBLE * (1 - CASE WHEN trace > 0 THEN spread / trace ELSE 0 END) - CASE WHEN trace > 0 THEN a / trace ELSE 0 END AS bx,
 {_FY!r}::DOUBLE * (1 - CASE WHEN trace > 0 THEN spread / trace ELSE 0 END) - CASE WHEN trace > 0 THEN b / trace ELSE 0 END AS b_y FROM c)
SELECT img, ix, iy, {q("bx / sqrt(bx * bx + b_y * b_y)", "100")} AS cx, {q("b_y / sqrt(bx * bx + b_y * b_y)", "100")} AS cy FROM m"""


def modulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's path as the carrier of three waves, longer where values are high."""
    path = rasters.user_paths(spark, sf_dir)
    carrier = waves.phases(path.join(paths.normals(path), ["path_id", "seq"]), F.lit(2 * math.pi) / (20 + F.abs("y") / 5)).withColumn("amp", 2.0 + F.col("seq") % 3)
    out = None
    for shape in waves.SHAPES:
        made = waves.modulated(carrier, shape).withColumn("shape", F.lit(shape))
        out = made if out is None else out.unionByName(made)
    return out.select("shape", "path_id", F.col("seq").cast("long").alias("seq"), "part", S.quantised(F.col("x"), 1e2).alias("x"), S.quantised(F.col("y"), 1e2).alias("y"))


_HERE = ("x", "y", "nx", "ny", "amp", "phi")
_AT = ", ".join(f"{c}0 + t * ({c} - {c}0) AS {c}" for c in ("x", "y", "nx", "ny", "amp"))
#: From ``s``, a carrier with its steps of phase, to ``r``, the three waves on it.
WAVE_CTES = f"""f AS (SELECT *, sum(step) OVER (PARTITION BY path_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS phi FROM s),
l AS (SELECT *, {", ".join(f"lag({c}) OVER w AS {c}0" for c in _HERE)} FROM f WINDOW w AS {_P}),
k AS (SELECT *, floor(phi / pi())::BIGINT AS last, unnest(range(floor(phi0 / pi())::BIGINT + 1, floor(phi / pi())::BIGINT + 1)) AS k FROM l WHERE phi0 IS NOT NULL),
c AS (SELECT path_id, seq, k, last, {_AT} FROM (SELECT *, (k * pi() - phi0) / (phi - phi0) AS t FROM k)),
e AS (SELECT *, sqrt(nx * nx + ny * ny) AS size, CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END AS e FROM c),
r AS (SELECT shape, path_id, seq, (2 * (k - last) - 2 + second)::INT AS part, x + nx / size * amp * e * (1 - 2 * second) AS x, y + ny / size * amp * e * (1 - 2 * second) AS y FROM e, (VALUES ('sawtooth', 0), ('square', 0), ('square', 1)) h(shape, second)
 UNION ALL SELECT shape, path_id, seq, 0, x + nx * amp * v, y + ny * amp * v FROM (SELECT *, CASE shape WHEN 'sine' THEN sin(phi) WHEN 'square' THEN CASE WHEN sin(phi) >= 0 THEN 1 ELSE -1 END ELSE 2 / pi() * asin(sin(phi - pi() / 2)) END AS v
  FROM f, (VALUES ('sine'), ('sawtooth'), ('square')) h(shape)))"""
WAVE_SQL = f"""
WITH {sql.PATH}, d AS (SELECT *, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM path WINDOW w AS {_P}),
n AS (SELECT path_id, seq, x, y, -dy / sqrt(dx * dx + dy * dy) AS nx, dx / sqrt(dx * dx + dy * dy) AS ny, 2.0::DOUBLE + seq % 3 AS amp, {2 * math.pi!r}::DOUBLE / (20 + abs(y) / 5) AS rate FROM d WHERE dx * dx + dy * dy > 0),
s AS (SELECT *, coalesce((rate + lag(rate) OVER w) / 2 * sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS step FROM n WINDOW w AS {_P}),
{WAVE_CTES}
SELECT shape, path_id, seq, part, {q("x", "1e2")} AS x, {q("y", "1e2")} AS y FROM r"""


def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's points as a row of a lattice, drawn through those that lie outside a triangle."""
    e = rasters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("label").cast("long").alias("row_id"))
    lattice = e.withColumn("seq", F.row_number().over(Window.partitionBy("row_id").orderBy("pid")))
    left = rasters.embedding_points(spark, sf_dir).where(~geometry.inside(F.col("x"), F.col("y"), TRIANGLE))
    r = waves.rebuilt(lattice, left)
    return r.select("row_id", F.col("run").cast("long").alias("run"), F.col("seq").cast("long").alias("seq"), S.quantised(F.col("x"), 1e4).alias("x"), S.quantised(F.col("y"), 1e4).alias("y"))


REBUILT_SQL = f"""
WITH {sql.EMB}, l AS (SELECT vec_id AS pid, label::BIGINT AS row_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS seq FROM embeddings),
k AS (SELECT row_id, seq, x, y, seq - row_number() OVER (PARTITION BY row_id ORDER BY seq) AS island FROM l JOIN emb USING (pid) WHERE NOT {sql.inside("x", "y", TRIANGLE)}),
s AS (SELECT *, count(*) OVER (PARTITION BY row_id, island) AS size FROM k)
SELECT row_id, dense_rank() OVER (PARTITION BY row_id ORDER BY island) AS run, seq, {q("x", "1e4")} AS x, {q("y", "1e4")} AS y FROM s WHERE size > 1"""


def child_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points as a tree of three children a node, in the order in which a walk round it meets them."""
    tree = rasters.embedding_points(spark, sf_dir).withColumn("parent", F.when(F.col("pid") > 0, F.floor((F.col("pid") - 1) / 3)))
    return waves.child_order(tree).select("pid", "parent", F.col("rank").cast("long").alias("rank"), S.quantised(F.col("turn"), 1e5).alias("turn"))


CHILD_SQL = f"""
WITH {sql.EMB}, t AS (SELECT *, CASE WHEN pid > 0 THEN floor((pid - 1) / 3)::BIGINT END AS parent FROM emb),
b AS (SELECT t.pid, t.parent, atan2(t.y - p.y, t.x - p.x) - CASE WHEN g.pid IS NULL THEN 0 ELSE atan2(g.y - p.y, g.x - p.x) END AS a FROM t JOIN t p ON p.pid = t.parent LEFT JOIN t g ON g.pid = p.parent),
w AS (SELECT pid, parent, a - 2 * pi() * floor(a / (2 * pi())) AS turn FROM b)
SELECT pid, parent, row_number() OVER (PARTITION BY parent ORDER BY turn, pid) AS rank, {q("turn", "1e5")} AS turn FROM w"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts linked each to the next of the same brand and size: the component of each part that has a link."""
    order = Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")
    links = rasters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("x"), F.lead("p_partkey").over(order).alias("y")).where("y is not null")
    return iterative.components(links)


COMPONENT_SQL = """
SELECT p_partkey AS node, component FROM (SELECT p_partkey, min(p_partkey) OVER w AS component, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand, p_size)) WHERE n > 1"""


QUERIES = {
    "band_darkness_li": (band_darkness, BAND_SQL),
    "lattice_darkness_li": (lattice_darkness, LATTICE_SQL),
    "lattice_links_li": (lattice_links, LINK_SQL),
    "owed_ink_emb": (owed_ink, OWED_SQL),
    "tile_regions_region": (tile_regions, TILE_SQL),
    "tile_edges_region": (tile_edges, EDGE_SQL),
    "perimeter_points_li": (perimeter, PERIMETER_SQL),
    "blended_field_li": (blended, BLEND_SQL),
    "wave_on_carrier_path": (modulated, WAVE_SQL),
    "rebuilt_rows_emb": (rebuilt, REBUILT_SQL),
    "child_order_emb": (child_order, CHILD_SQL),
    "components_part": (components, COMPONENT_SQL),
}
