"""Queries over lines that split and merge between bands: each supplier's drawing, and how well it holds the page's darkness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import splitting
from plumbline.plans import sql
from plumbline.plans.fields import PAGE
from plumbline.plans.parts import _C, _NV, _S, _U, _V, ANGLE, BAND_SQL, PEN, SCALE
from plumbline.plans.sql import q
from plumbline.sources import rasters


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of a line between two bands."""
    made = splitting.split_merge(rasters.supplier_raster(spark, sf_dir), PAGE, ANGLE, SCALE, PEN)
    return made.select("img", "band", "i", "j", *[S.quantised(F.col(c), 1e3).alias(c) for c in ("x1", "y1", "x2", "y2")])


def _walk(out: str, a: str, b: str, source: str, keep: str) -> str:
    """Two ascending lists matched step by step: on in both, or in the one whose next entry is nearer."""
    d = lambda x, y: f"abs({a}[{x}] - {b}[{y}])"
    more_i, more_j = f"i + 1 < len({a})", f"j + 1 < len({b})"
    both, only_i, only_j = d("i + 2", "j + 2"), d("i + 2", "j + 1"), d("i + 1", "j + 2")
    diagonal = f"({more_i} AND {more_j} AND {both} <= {only_i} AND {both} <= {only_j})"
    step = f"CASE WHEN {diagonal} THEN 2 WHEN {more_i} AND (NOT {more_j} OR {only_i} <= {only_j}) THEN 1 ELSE 0 END"
    return f"""{out}({keep}, i, j, again) AS (SELECT {keep}, 0, 0, false FROM {source} WHERE len({a}) > 0 AND len({b}) > 0
 UNION ALL SELECT {keep}, i + (s > 0)::INT, j + (s <> 1)::INT, s = 0 FROM (SELECT *, {step} AS s FROM {out} WHERE {more_i} OR {more_j}))"""


def _crossed(out: str, source: str) -> str:
    return f"""{out}_p AS (SELECT *, lead(p) OVER w AS q, first(p) OVER w AS p0 FROM (SELECT img, band, m, sum(floor(k * {splitting.GRAIN!r}::DOUBLE + 0.5)::BIGINT) OVER (PARTITION BY img, band ORDER BY m ROWS UNBOUNDED PRECEDING)::DOUBLE / {splitting.GRAIN * PEN!r}::DOUBLE AS p FROM {source}) WINDOW w AS (PARTITION BY img, band ORDER BY m)),
{out} AS MATERIALIZED (SELECT img, band, list({min(_V)!r}::DOUBLE + m + (k - p) / (q - p) ORDER BY m, k) AS vs
 FROM (SELECT *, unnest(range(greatest(floor(p) + 1, ceil(p0 + {splitting.PAST!r}::DOUBLE))::BIGINT, floor(q)::BIGINT + 1)) AS k FROM {out}_p WHERE q IS NOT NULL) GROUP BY img, band)"""


_FRAMES = BAND_SQL.replace(sql.LI, sql.SUPPLIER_LI).split("\nSELECT", 1)[0].replace("WITH ", "WITH RECURSIVE ", 1)
_DARK = BAND_SQL.rsplit("sum(", 1)[1].split(") / max(n)", 1)[0]
_V_AT = f"({min(_V)!r}::DOUBLE + m)"
LINES_SQL = f"""{_FRAMES},
kd AS MATERIALIZED (SELECT img, band, m, coalesce(k, 0) AS k, height, bands FROM (SELECT f.img, f.height, f.bands, b.band, r.m FROM f, range(f.bands) b(band), range({_NV}) r(m))
  LEFT JOIN (SELECT img, band, m, sum({_DARK}) / max(n) AS k FROM o JOIN li USING (img, ix, iy) GROUP BY ALL) USING (img, band, m)),
{_crossed("c0", "kd")},
pr AS (SELECT img, band, height, coalesce(c.vs, []::DOUBLE[]) AS a, CASE WHEN band = bands - 1 THEN coalesce(c.vs, []::DOUBLE[]) ELSE coalesce(d.vs, []::DOUBLE[]) END AS b
  FROM (SELECT DISTINCT img, band, height, bands FROM kd) LEFT JOIN c0 c USING (img, band) LEFT JOIN (SELECT img, band - 1 AS band, vs FROM c0) d USING (img, band)),
{_walk("wk", "a", "b", "pr", "img, band, height, a, b")},
st AS MATERIALIZED (SELECT img, band, list(a[i + 1] ORDER BY i, j) AS sv, list(least({splitting.STEEPEST} * height, abs(b[j + 1] - a[i + 1])) ORDER BY i, j) AS ss FROM wk GROUP BY ALL),
jj AS (SELECT kd.*, sv, ss, len(list_filter(sv[2:], lambda x: x < {_V_AT})) AS n FROM kd LEFT JOIN st USING (img, band)),
sl AS (SELECT img, band, m, k, height, CASE WHEN sv IS NULL THEN NULL WHEN {_V_AT} <= sv[1] THEN ss[1] WHEN n + 1 >= len(sv) THEN ss[len(ss)]
  ELSE ss[n + 1] + (ss[n + 2] - ss[n + 1]) * ({_V_AT} - sv[n + 1]) / greatest(1e-9, sv[n + 2] - sv[n + 1]) END AS s FROM jj),
k2 AS (SELECT img, band, m, k * CASE WHEN s IS NULL THEN 1 ELSE height / sqrt(height * height + s * s) END AS k FROM sl),
{_crossed("c1", "k2")},
p2 AS (SELECT c.img, c.band, f.height, f.bands, c.vs AS a, d.vs AS b FROM c1 c JOIN c1 d ON d.img = c.img AND d.band = c.band + 1 JOIN f ON f.img = c.img),
{_walk("w2", "a", "b", "p2", "img, band, height, bands, a, b")},
uv AS (SELECT img, band, i, j, {min(_U)!r}::DOUBLE + CASE WHEN band = 0 THEN 0 ELSE band + 0.5 END * height AS u1, a[i + 1] AS v1,
  {min(_U)!r}::DOUBLE + CASE WHEN band = bands - 2 THEN bands ELSE band + 1.5 END * height AS u2, b[j + 1] AS v2 FROM w2)
SELECT img, band::INT AS band, i, j, {q(f"u1 * {_C!r}::DOUBLE - v1 * {_S!r}::DOUBLE", "1e3")} AS x1, {q(f"u1 * {_S!r}::DOUBLE + v1 * {_C!r}::DOUBLE", "1e3")} AS y1,
 {q(f"u2 * {_C!r}::DOUBLE - v2 * {_S!r}::DOUBLE", "1e3")} AS x2, {q(f"u2 * {_S!r}::DOUBLE + v2 * {_C!r}::DOUBLE", "1e3")} AS y2 FROM uv"""


QUERIES = {"split_merge_lines_supplier": (lines, LINES_SQL)}
