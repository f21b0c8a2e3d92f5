"""Queries over row-local functions: draws, ladders, coverage laws, orders of cells, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.plans import sql
from plumbline.plans.sql import q
from plumbline.sources import rasters

PEN = 1.5


def rng_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return rows.select("o_orderkey", S.quantised(S.draw(F.col("o_custkey"), F.col("o_orderkey")), 4294967296.0).alias("draw"))


RNG_SQL = """
WITH a AS (SELECT o_orderkey, (o_custkey + (o_orderkey + 2) * 1831565813) % 4294967296 AS a FROM orders),
t AS (SELECT o_orderkey, ((xor(a, a >> 15)::HUGEINT * (a | 1)::HUGEINT) % 4294967296)::BIGINT AS t FROM a),
u AS (SELECT o_orderkey, xor(t, (t + ((xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT) % 4294967296)::BIGINT) % 4294967296) AS t FROM t)
SELECT o_orderkey, xor(t, t >> 14) AS draw FROM u"""


def tone_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster, v = rasters.lineitem_raster(spark, sf_dir), F.col("v")
    lo, hi = 2 * PEN, 20 * PEN
    d = S.harmonic_spacing(v, lo, hi)
    return raster.select(
        "img",
        "ix",
        "iy",
        S.quantised(d).alias("spacing"),
        S.quantised(S.harmonic_rate(v, lo, hi)).alias("rate"),
        S.quantised(S.stadium_area(d, PEN)).alias("stroke"),
        S.quantised(S.ring_coverage(d, PEN, 0.78, 5.0)).alias("rings"),
        S.quantised(S.net_coverage(d, PEN, 1.8612, 0.69, 1.03)).alias("net"),
        S.quantised(S.mark_fraction(1 - v, 0.4, 0.1)).alias("marks"),
        S.quantised(v * 0.75 + 0.2).alias("affine"),
    )


_D = f"({2 * PEN} / (1 - v * (1 - {2 * PEN} / {20 * PEN}::DOUBLE)))"
LADDERS_SQL = f"""
WITH {sql.LI}
SELECT img, ix, iy, {q(_D)} AS spacing, {q(f"1 / {2 * PEN}::DOUBLE + v * (1 / {20 * PEN}::DOUBLE - 1 / {2 * PEN}::DOUBLE)")} AS rate,
 {q(f"{_D} * {PEN} + pi() * {PEN * PEN} / 4")} AS stroke,
 {q(f"greatest(0, least(1, {2 * 0.78 * PEN} / {_D} * greatest(0, 1 - 10 / (3 * pi()) * sqrt({PEN} / {_D}))))")} AS rings,
 {q(f"least(1, {1.03 * 1.8612 * PEN} / ({_D} + {0.69 * PEN}))")} AS net,
 {q("(0.5 - sqrt(0.25 - 0.4 * greatest(0, least(0.4, 1 - v)))) / 0.2")} AS marks, {q("v * 0.75 + 0.2")} AS affine FROM li"""


def wave_coverages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = rasters.table(spark, sf_dir, "part").select("p_partkey", (1 + F.col("p_size") / 5.0).alias("swing"), (3 + F.pmod("p_partkey", F.lit(7))).cast("double").alias("length"))
    made = [S.quantised(S.wave_coverage(shape, PEN, 12.0, F.col("swing"), F.col("length"))).alias(shape) for shape in ("square", "sawtooth", "sine")]
    return parts.select("p_partkey", *made)


WAVE_SQL = f"""
WITH p AS (SELECT p_partkey, 1 + p_size / 5.0::DOUBLE AS a, (3 + p_partkey % 7)::DOUBLE AS l FROM part),
arc AS (SELECT p_partkey, 2 / pi() * (pi() / 2 / 64 / 3) * sum(CASE WHEN i IN (0, 64) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * sqrt(1 + pow(pi() * a / l, 2) * pow(cos(i * (pi() / 2 / 64)), 2))) AS f FROM p, range(65) r(i) GROUP BY p_partkey)
SELECT p_partkey, {q(f"greatest(0, least(1, {PEN} * (2 * a + l) / (12 * l) - {PEN * PEN} * (4 - pi()) / (48 * l)))")} AS square,
 {q(f"greatest(0, least(1, {PEN} * (4 * l * sqrt(4 * a * a + l * l) + {PEN} * l * (pi() - 2 * atan(l / (2 * a))) - {4 * PEN} * a) / (48 * l * l)))")} AS sawtooth,
 {q(f"greatest(0, least(1, greatest({PEN} / 12, {PEN} / 12 * f - 2 * 0.0278 * {PEN * PEN} * pow(greatest(0, pi() * pi() * a * {PEN} / (l * l) - 1), 1.35) / (12 * l))))")} AS sine
FROM p JOIN arc USING (p_partkey)"""


def cell_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered-dither rank, bit-reversed row and Hilbert place of each customer's cell in a grid of side 32."""
    x, y = F.pmod("c_custkey", F.lit(32)).cast("int"), F.pmod(F.floor(F.col("c_custkey") / 32), F.lit(32)).cast("int")
    c = rasters.table(spark, sf_dir, "customer").select("c_custkey", x.alias("x"), y.alias("y"))
    return c.select("c_custkey", S.bayer_rank(F.col("x"), F.col("y"), 5).alias("bayer"), S.reversed_bits(F.col("y"), 5).alias("reversed"), S.hilbert_index(32, F.col("x"), F.col("y")).alias("hilbert"))


_XB, _YB = "((x >> {b}) & 1)", "((y >> {b}) & 1)"
ORDERS_SQL = f"""
WITH RECURSIVE c AS (SELECT c_custkey, c_custkey % 32 AS x, (c_custkey // 32) % 32 AS y FROM customer),
h AS (SELECT c_custkey, x AS px, y AS py, 0::BIGINT AS d, 16::BIGINT AS s FROM c UNION ALL
 SELECT c_custkey,
  CASE WHEN (py & s) > 0 THEN px WHEN (px & s) > 0 THEN s - 1 - py ELSE py END,
  CASE WHEN (py & s) > 0 THEN py WHEN (px & s) > 0 THEN s - 1 - px ELSE px END,
  d + s * s * CASE WHEN (px & s) > 0 AND (py & s) > 0 THEN 2 WHEN (px & s) > 0 THEN 3 WHEN (py & s) > 0 THEN 1 ELSE 0 END, s // 2 FROM h WHERE s > 0)
SELECT c.c_custkey, ({" + ".join(f"(2 * xor({_XB.format(b=b)}, {_YB.format(b=b)}) + {_YB.format(b=b)}) * {4 ** (4 - b)}" for b in range(5))})::INT AS bayer,
 ({" + ".join(f"{_YB.format(b=b)} * {2 ** (4 - b)}" for b in range(5))})::INT AS reversed, h.d AS hilbert
FROM c JOIN h ON h.c_custkey = c.c_custkey AND h.s = 0"""


def formula_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four kinds of pictures from formulas, in a size of its own for each supplier."""
    sizes = rasters.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("img"), (9 + F.col("s_suppkey") % 13).cast("int").alias("w"), (7 + F.col("s_nationkey") % 5).cast("int").alias("h")
    )
    out = [rasters.painted(sizes, k).select(F.lit(k).alias("kind"), "img", "ix", "iy", S.quantised(F.col("v"), 1e4).alias("v")) for k in ("ramp", "radial", "rings", "sphere")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


SOURCES_SQL = f"""
WITH s AS (SELECT s_suppkey AS img, (9 + s_suppkey % 13)::INT AS w, (7 + s_nationkey % 5)::INT AS h FROM supplier),
p AS (SELECT img, w, h, c % w AS ix, c // w AS iy FROM (SELECT *, unnest(range(w * h))::INT AS c FROM s)),
n AS (SELECT *, ix / (w - 1)::DOUBLE * 2 - 1 AS x, iy / (h - 1)::DOUBLE * 2 - 1 AS y FROM p), r AS (SELECT *, sqrt(x * x + y * y) AS r FROM n),
z AS (SELECT *, sqrt(greatest(0, 0.72::DOUBLE * 0.72::DOUBLE - r * r)) AS z FROM r),
k AS (SELECT img, ix, iy, ix / (w - 1)::DOUBLE AS ramp, least(1, sqrt((ix - (w - 1) / 2) ^ 2 + (iy - (h - 1) / 2) ^ 2) / sqrt(((w - 1) / 2) ^ 2 + ((h - 1) / 2) ^ 2)) AS radial,
  greatest(0, least(1, 0.5 + 0.45 * cos(r * 18) * exp(-r * 0.8))) AS rings,
  greatest(0, least(1, CASE WHEN r < 0.72 THEN greatest(0.02, least(1, 0.12 + 0.95 * greatest(0, (-0.45 * x - 0.55 * y + 0.7 * z) / sqrt(x * x + y * y + z * z))))
    ELSE 0.55 + 0.4 * (iy / (h - 1)::DOUBLE) - 0.12 * exp(-12 * (r - 0.72) * (r - 0.72)) END)) AS sphere FROM z)
SELECT kind, img, ix, iy, {q("v::FLOAT", "1e4")} AS v FROM (UNPIVOT (SELECT img, ix, iy, ramp::DOUBLE AS ramp, radial::DOUBLE AS radial, rings::DOUBLE AS rings, sphere::DOUBLE AS sphere FROM k) ON ramp, radial, rings, sphere INTO NAME kind VALUE v)"""


def _rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return rasters.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("img"), F.pmod(k, F.lit(97)).cast("int").alias("ix"), F.floor(k / 97).cast("int").alias("iy"),
        *[F.pmod(F.col("o_custkey") * m, F.lit(256)).cast("int").alias(n) for n, m in (("r", 7), ("g", 13), ("b", 29))],
    )


def colour_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = _rgb(spark, sf_dir)
    planes = rasters.colour(rgb).unionByName(rasters.grey(rgb).select("img", "ix", "iy", F.lit("grey").alias("channel"), "v"))
    return planes.select("img", "ix", "iy", "channel", S.quantised(F.col("v"), 1e4).alias("v"))


COLOUR_SQL = f"""
WITH o AS (SELECT o_orderstatus AS img, (o_orderkey % 97)::INT AS ix, (o_orderkey // 97)::INT AS iy,
  1 - (o_custkey * 7 % 256) / 255.0::DOUBLE AS c, 1 - (o_custkey * 13 % 256) / 255.0::DOUBLE AS m, 1 - (o_custkey * 29 % 256) / 255.0::DOUBLE AS y FROM orders),
p AS (SELECT *, least(c, m, y) AS k FROM o)
SELECT img, ix, iy, channel, {q("v::FLOAT", "1e4")} AS v FROM (
 SELECT img, ix, iy, 'c' AS channel, 1 - (c - k) AS v FROM p UNION ALL SELECT img, ix, iy, 'm', 1 - (m - k) FROM p
 UNION ALL SELECT img, ix, iy, 'y', 1 - (y - k) FROM p UNION ALL SELECT img, ix, iy, 'k', 1 - k FROM p
 UNION ALL SELECT img, ix, iy, 'grey', 0.2989 * (1 - c) + 0.587 * (1 - m) + 0.114 * (1 - y) FROM p)"""


def file_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as safe file stems: other signs as dashes, none at the ends, 64 characters at most."""
    stem = F.regexp_replace(F.regexp_replace(F.col("p_name"), "[^A-Za-z0-9_]+", "-"), "^-+|-+$", "")
    return rasters.table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.nullif(F.substring(stem, 1, 64), F.lit("")), F.lit("drawing")).alias("stem"))


STEM_SQL = """SELECT p_partkey, coalesce(nullif(substr(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64), ''), 'drawing') AS stem FROM part"""


def lattices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a square lattice, a hexagonal one and a sunflower spiral of equal density in a disc, for each region's
    pitch."""
    import math

    golden = math.pi * (3 - 5**0.5)
    r = rasters.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("key"), (F.col("r_regionkey") + 4).cast("double").alias("d"))
    radius = 60.0
    reach = F.ceil(radius / F.col("d") * 1.2).cast("int") + 1
    cell = r.withColumn("i", F.explode(F.sequence(-reach, reach))).withColumn("j", F.explode(F.sequence(-reach, reach)))
    a = F.col("d") * math.sqrt(2 / math.sqrt(3))
    square = cell.select("key", F.lit("square").alias("kind"), (F.col("i") * F.col("d")).alias("x"), (F.col("j") * F.col("d")).alias("y"))
    hexes = cell.select("key", F.lit("hex").alias("kind"), ((F.col("i") + F.when(F.col("j") % 2 != 0, 0.5).otherwise(0.0)) * a).alias("x"), (F.col("j") * a * (math.sqrt(3) / 2)).alias("y"))
    n = F.floor(math.pi * radius * radius / (F.col("d") * F.col("d"))).cast("int")
    spiral = r.withColumn("n", F.explode(F.sequence(F.lit(0), n)))
    rho = F.col("d") / math.sqrt(math.pi) * F.sqrt(F.col("n") + 0.5)
    spiral = spiral.select("key", F.lit("spiral").alias("kind"), (rho * F.cos(F.col("n") * golden)).alias("x"), (rho * F.sin(F.col("n") * golden)).alias("y"))
    points = square.unionByName(hexes).unionByName(spiral).where(F.col("x") * F.col("x") + F.col("y") * F.col("y") <= radius * radius - 1e-6)
    return points.select("key", "kind", S.quantised(F.col("x"), 1e4).alias("x"), S.quantised(F.col("y"), 1e4).alias("y"))


LATTICE_SQL = f"""
WITH r AS (SELECT r_regionkey::INT AS key, (r_regionkey + 4)::DOUBLE AS d FROM region),
c AS (SELECT key, d, d * sqrt(2 / sqrt(3)) AS a, i, j FROM r, range(-25, 26) a(i), range(-25, 26) b(j)),
p AS (SELECT key, 'square' AS kind, i * d AS x, j * d AS y FROM c
 UNION ALL SELECT key, 'hex', (i + CASE WHEN j % 2 <> 0 THEN 0.5 ELSE 0 END) * a, j * a * (sqrt(3) / 2) FROM c
 UNION ALL SELECT key, 'spiral', d / sqrt(pi()) * sqrt(n + 0.5) * cos(n * (pi() * (3 - sqrt(5)))), d / sqrt(pi()) * sqrt(n + 0.5) * sin(n * (pi() * (3 - sqrt(5))))
  FROM r, range(0, 1000) n(n) WHERE n <= floor(pi() * 3600 / (d * d)))
SELECT key, kind, {q("x", "1e4")} AS x, {q("y", "1e4")} AS y FROM p WHERE x * x + y * y <= 3600 - 1e-6"""


QUERIES = {
    "rng_draws": (rng_draws, RNG_SQL),
    "tone_ladders_li": (tone_ladders, LADDERS_SQL),
    "wave_coverage_part": (wave_coverages, WAVE_SQL),
    "cell_orders_customer": (cell_orders, ORDERS_SQL),
    "source_formulas_supplier": (formula_sources, SOURCES_SQL),
    "cmyk_planes_orders": (colour_planes, COLOUR_SQL),
    "file_stems_part": (file_stems, STEM_SQL),
    "lattices_region": (lattices, LATTICE_SQL),
}
