"""DuckDB counterparts of the derived inputs and of the filters, as pieces of ``WITH`` clauses."""

from __future__ import annotations

from plumbline.operators.raster import gaussian
from plumbline.sources.rasters import EV_H, EV_W, LI_H, LI_W


def q(expression: str, scale: str = "1e6") -> str:
    """Quantised like :func:`plumbline.functions.scalar.quantised`."""
    return f"CAST(floor(({expression})::DOUBLE * {scale} + 0.5) AS BIGINT)"


def counted(name: str, rows: str, w: int, h: int) -> str:
    return f"""{name}_n AS (SELECT img, ix, iy, count(*) AS n FROM ({rows}) WHERE ix BETWEEN 0 AND {w - 1} AND iy BETWEEN 0 AND {h - 1} GROUP BY ALL),
{name}_m AS (SELECT img, max(n) AS most FROM {name}_n GROUP BY img),
{name} AS (SELECT m.img, x.ix::INT AS ix, y.iy::INT AS iy, 1 - coalesce(n.n, 0) / m.most::DOUBLE AS v
  FROM {name}_m m CROSS JOIN range({w}) x(ix) CROSS JOIN range({h}) y(iy) LEFT JOIN {name}_n n ON n.img = m.img AND n.ix = x.ix AND n.iy = y.iy)"""


LI = counted("li", "SELECT l_returnflag AS img, CAST(l_quantity AS INT) - 1 AS ix, CAST(floor(l_discount * 100 + 0.5) AS INT) AS iy FROM lineitem", LI_W, LI_H)
LI_WHOLE = LI.replace("l_returnflag AS img", "'all' AS img")
SUPPLIER_LI = LI.replace("l_returnflag AS img", "l_suppkey AS img")
EV = counted("ev", "SELECT event_type AS img, hour(ts) AS ix, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS iy FROM events", EV_W, EV_H)
EMB = f"""emb AS (SELECT vec_id AS pid, 1 + (tanh(embedding[1]::DOUBLE) + 1) / 2 * {LI_W - 1} AS x,
  1 + (tanh(embedding[2]::DOUBLE) + 1) / 2 * {LI_H - 1} AS y FROM embeddings)"""
PATH = """path AS (SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
  floor(epoch(ts) - 1704067200) / 3600.0::DOUBLE AS x, value AS y FROM events)"""
LENGTH = """len AS (SELECT *, sum(step) OVER (PARTITION BY path_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS step
  FROM path WINDOW w AS (PARTITION BY path_id ORDER BY seq)))"""


def ramp(w: int, h: int) -> str:
    return f"ramp AS (SELECT 'ramp' AS img, x.ix::INT AS ix, y.iy::INT AS iy, (x.ix / {w - 1}.0::DOUBLE)::FLOAT AS v FROM range({w}) x(ix), range({h}) y(iy))"


def blur(out: str, source: str, size: int, sigma: float, w: int, h: int) -> str:
    """Two passes of a Gaussian over the raster ``source``, edges repeated, stored as 32-bit floats after each."""
    taps = gaussian(size, sigma)
    half = len(taps) // 2
    values = ", ".join(f"({i - half}, {t!r}::DOUBLE)" for i, t in enumerate(taps))
    return f"""{out}_t(d, k) AS (VALUES {values}),
{out}_x AS (SELECT p.img, p.ix, p.iy, CAST(sum(n.v::DOUBLE * t.k) AS FLOAT) AS v FROM {source} p CROSS JOIN {out}_t t
  JOIN {source} n ON n.img = p.img AND n.iy = p.iy AND n.ix = greatest(0, least({w - 1}, p.ix + t.d)) GROUP BY ALL),
{out} AS (SELECT p.img, p.ix, p.iy, CAST(sum(n.v::DOUBLE * t.k) AS FLOAT) AS v FROM {out}_x p CROSS JOIN {out}_t t
  JOIN {out}_x n ON n.img = p.img AND n.ix = p.ix AND n.iy = greatest(0, least({h - 1}, p.iy + t.d)) GROUP BY ALL)"""


def inside(x: str, y: str, ring: list[tuple[float, float]]) -> str:
    odd, on = [], []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        dx, dy = x2 - x1, y2 - y1
        n = dx * dx + dy * dy
        t = f"greatest(0, least(1, (({x} - {x1}) * {dx} + ({y} - {y1}) * {dy}) / {n}::DOUBLE))"
        on.append(f"(pow({x} - {x1} - {t} * {dx}, 2) + pow({y} - {y1} - {t} * {dy}, 2) <= 1e-18)")
        if dy:
            odd.append(f"(CASE WHEN (({y1} > {y}) <> ({y2} > {y})) AND {x} < ({y} - {y1}) * ({dx}::DOUBLE / {dy}) + {x1} THEN 1 ELSE 0 END)")
    return f"(({' OR '.join(on)}) OR ({' + '.join(odd)}) % 2 = 1)"
