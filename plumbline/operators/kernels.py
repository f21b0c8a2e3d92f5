"""Order-dependent steps, one image, layer or path at a time: a group's rows are bounded by one drawing, and Spark
spreads the groups. Each kernel is a short loop over arrays; everything around it is joins and windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Paths of several layers that are put in order side by side, and steps after which those visited are left behind.
SIDE_BY_SIDE, STEPS = 1 << 15, 32


def nearest_first(layer: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in the order of visits, layer after layer; whether each is reversed) of paths from ``a`` to ``b``, whose layers
    (numbers) follow each other. Every layer goes one step at a time, all beside each other."""
    first = np.flatnonzero(np.diff(layer, prepend=-1))
    size = np.diff(np.append(first, len(layer)))
    most = int(size.max())
    left = first[:, None] + np.arange(most)
    shut = np.arange(most) >= size[:, None]
    left[shut] = 0
    ends = [p[left, c] for p in (a, b) for c in (0, 1)]
    x, y = np.zeros((2, len(first), 1))
    rows, out = np.arange(len(first)), np.zeros((2, len(first), most), np.int64)
    for k in range(most):
        if k % STEPS == 0 and k:
            keep = np.argsort(shut, axis=1, kind="stable")[:, : most - k]
            left, shut, *ends = (np.take_along_axis(v, keep, 1) for v in (left, shut, *ends))
        ax, ay, bx, by = ends
        da, db = (ax - x) ** 2 + (ay - y) ** 2, (bx - x) ** 2 + (by - y) ** 2
        i = np.where(shut, np.inf, np.minimum(da, db)).argmin(1)
        turn = db[rows, i] < da[rows, i]
        out[0, :, k], out[1, :, k] = left[rows, i], turn
        # A layer that is through stays where it is.
        on = k < size
        x, y = (np.where(on, np.where(turn, p[rows, i], q[rows, i]), 0.0)[:, None] for p, q in ((ax, bx), (ay, by)))
        shut[rows, i] = True
    made = np.arange(most) < size[:, None]
    return out[0][made], out[1][made].astype(bool)


def visiting_order(ends: DataFrame, by: str, parts: int | None = None) -> DataFrame:
    """Order of each layer's paths (path_id, ax, ay, bx, by_) by the nearest end from where the pen is, starting at the
    origin; a path is reversed where its far end is the nearer one."""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        layer = pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
        at, turned = nearest_first(layer, pdf[["ax", "ay"]].to_numpy(), pdf[["bx", "by_"]].to_numpy())
        place = np.arange(len(pdf)) - np.searchsorted(layer, layer)
        return pd.DataFrame({by: pdf[by].to_numpy(), "path_id": pdf["path_id"].to_numpy()[at], "place": place, "reversed": turned})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < SIDE_BY_SIDE:
                continue
            rows = pd.concat(held, ignore_index=True)
            # The last layer may go on in the next batch.
            end = rows[by].iloc[-1]
            last = rows[by].isna() if pd.isna(end) else rows[by] == end
            if not last.all():
                yield whole(rows[~last])
            held = [rows[last]]
        if held and sum(map(len, held)):
            yield whole(pd.concat(held, ignore_index=True))

    rows = ends.select(by, "path_id", "ax", "ay", "bx", "by_")
    # A layer's rows lie together and in order, those of many layers in one task.
    lying = (rows.repartition(parts, by) if parts else rows.repartition(by)).sortWithinPartitions(by, F.col("path_id").asc_nulls_last())
    return lying.mapInPandas(solve, f"{by} string, path_id long, place long, reversed boolean")


def packed_circles(raster: DataFrame, least: float, most: float) -> DataFrame:
    """(img, x, y, r): circles that don't overlap, larger where the image is lighter; in order of falling radius, each
    pixel takes a circle if there is room."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = (least + (most - least) * pdf["v"].clip(0, 1)).to_numpy()
        x, y = pdf["ix"].to_numpy() + 1.0, pdf["iy"].to_numpy() + 1.0
        got = np.zeros((0, 3))
        for i in np.lexsort((pdf["ix"], pdf["iy"], -r)):
            if not len(got) or (((got[:, 0] - x[i]) ** 2 + (got[:, 1] - y[i]) ** 2) >= (got[:, 2] + r[i]) ** 2).all():
                got = np.vstack([got, [x[i], y[i], r[i]]])
        return pd.DataFrame({"img": pdf["img"].iloc[0], "x": got[:, 0], "y": got[:, 1], "r": got[:, 2]})

    return raster.select("img", "ix", "iy", F.col("v").cast("double").alias("v")).groupBy("img").applyInPandas(solve, "img string, x double, y double, r double")


def spread_error(raster: DataFrame) -> DataFrame:
    """(img, ix, iy, dot): error diffusion in two axes; what a cell's dot over- or undershoots goes in equal parts to
    the neighbours that a serpentine walk hasn't visited."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = pdf["iy"].max() + 1, pdf["ix"].max() + 1
        owed = np.zeros((h, w))
        owed[pdf["iy"], pdf["ix"]] = 1 - pdf["v"]
        dots, seen = np.zeros((h, w), int), np.zeros((h, w), bool)
        for iy in range(h):
            for ix in range(w) if iy % 2 == 0 else range(w - 1, -1, -1):
                dots[iy, ix] = owed[iy, ix] >= 0.5
                seen[iy, ix] = True
                to = [(iy + dy, ix + dx) for dx, dy in ((1, 0), (-1, 0), (0, 1)) if 0 <= iy + dy < h and 0 <= ix + dx < w and not seen[iy + dy, ix + dx]]
                for t in to:
                    owed[t] += (owed[iy, ix] - dots[iy, ix]) / len(to)
        iy, ix = np.mgrid[:h, :w]
        return pd.DataFrame({"img": pdf["img"].iloc[0], "ix": ix.ravel(), "iy": iy.ravel(), "dot": dots.ravel()})

    return raster.select("img", "ix", "iy", F.col("v").cast("double").alias("v")).groupBy("img").applyInPandas(solve, "img string, ix int, iy int, dot int")


def dashes(demand: DataFrame, pen: float, length: float, step: float) -> DataFrame:
    """(img, line, a, b): dashes along carriers so that the ink laid follows the ink owed (img, line, k, owed) at
    each step. A dash costs its length and round caps; what is owed at a line's end goes on to the next line."""
    price = length * pen + np.pi * pen * pen / 4

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        due, out = 0.0, []
        for line, part in pdf.sort_values(["line", "k"]).groupby("line", sort=True):
            free = -np.inf
            for k, owed in zip(part["k"], part["owed"], strict=True):
                due += owed
                if due >= price and k * step >= free:
                    out.append((line, k * step, k * step + length))
                    due, free = due - price, k * step + length
            due = min(due, price)
        return pd.DataFrame(out, columns=["line", "a", "b"]).assign(img=pdf["img"].iloc[0])[["img", "line", "a", "b"]].astype({"line": "int32", "a": float, "b": float})

    return demand.select("img", "line", "k", "owed").groupBy("img").applyInPandas(solve, "img string, line int, a double, b double")


def _mesh(p: np.ndarray) -> np.ndarray:
    """(triangles, 3): the Delaunay mesh of points whose last three are the corners of a triangle around all others, which come
    in one at a time: the triangles whose circles hold a point go, and the hole's border is joined to it.

    The hole is found from the triangle that the point lies in, and that one by a walk from a point near by, so that a point
    costs about the same however many there are."""
    if not np.isfinite(p).all():
        return np.zeros((0, 3), int)
    n, xy = len(p) - 3, p.tolist()
    # Corners of each triangle, anticlockwise, and the triangles across the sides opposite to them.
    tri, near, of = [(n, n + 1, n + 2)], [[-1, -1, -1]], [0] * (n + 3)
    low, span = p[:n].min(0).tolist(), float(max(np.ptp(p[:n], axis=0).max(), 1e-300))
    side, grid, last = 1, {}, 0

    def bucket(k: int) -> tuple[int, int]:
        return int((xy[k][0] - low[0]) / span * side), int((xy[k][1] - low[1]) / span * side)

    def holds(t: int, x: float, y: float) -> bool:
        (ax, ay), (bx, by), (cx, cy) = (xy[k] for k in tri[t])
        ax, ay, bx, by, cx, cy = ax - x, ay - y, bx - x, by - y, cx - x, cy - y
        return (ax * ax + ay * ay) * (bx * cy - by * cx) - (bx * bx + by * by) * (ax * cy - ay * cx) + (cx * cx + cy * cy) * (ax * by - ay * bx) > 0

    def found(t: int, x: float, y: float) -> int:
        for _ in range(len(tri)):
            for k in range(3):
                (ux, uy), (vx, vy) = xy[tri[t][(k + 1) % 3]], xy[tri[t][(k + 2) % 3]]
                if (vx - ux) * (y - uy) - (vy - uy) * (x - ux) < 0 and near[t][k] >= 0:
                    t = near[t][k]
                    break
            else:
                break
        return t if holds(t, x, y) else next((k for k in range(len(tri)) if holds(k, x, y)), -1)

    def bordered(hole: set[int]) -> list[tuple[int, int, int]]:
        sides = ((tri[t][(k + 1) % 3], tri[t][(k + 2) % 3], near[t][k]) for t in hole for k in range(3))
        return [(u, v, o) for u, v, o in sides if o not in hole]

    for i in range(n):
        if i > 2 * side * side:
            side *= 2
            grid = {bucket(k): k for k in range(i)}
        x, y = xy[i]
        first = found(of[grid.get(bucket(i), last)], x, y)
        if first < 0:
            continue
        hole, todo = {first}, [first]
        while todo:
            for o in near[todo.pop()]:
                if o >= 0 and o not in hole and holds(o, x, y):
                    hole.add(o)
                    todo.append(o)
        ring = bordered(hole)
        if len(ring) != len(hole) + 2 or len({u for u, _, _ in ring}) < len(ring):
            # Rounding has torn the hole: the triangle that holds the point is cut alone.
            hole = {first}
            ring = bordered(hole)
        free, made = sorted(hole), {}
        while len(free) < len(ring):
            free.append(len(tri))
            tri.append((0, 0, 0))
            near.append([-1, -1, -1])
        for (u, v, o), t in zip(ring, free, strict=True):
            made[u] = t
            if o >= 0:
                # The triangle outside has the side the other way round.
                near[o][next(k for k in range(3) if tri[o][(k + 1) % 3] == v and tri[o][(k + 2) % 3] == u)] = t
            tri[t], near[t] = (u, v, i), [-1, -1, o]
            of[u] = of[i] = t
        for u, v, _ in ring:
            near[made[u]][0], near[made[v]][1] = made[v], made[u]
        grid[bucket(i)] = last = i
    return np.array(tri)


def triangles(points: DataFrame) -> DataFrame:
    """(key, a, b, c): Delaunay triangulation of each key's points (key, pid, x, y), which come in by their ids."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid").drop_duplicates(["x", "y"])
        p = pdf[["x", "y"]].to_numpy(float)
        n, mid = len(p), p.mean(0)
        far = 1e3 * max(1.0, np.ptp(p, axis=0).max())
        tri = _mesh(np.vstack([p, mid + far * np.array([[-2, -1], [2, -1], [0, 2]])]))
        tri = tri[(tri < n).all(1)]
        ids = pdf["pid"].to_numpy()[np.sort(tri, 1)] if len(tri) else np.zeros((0, 3), int)
        return pd.DataFrame(ids, columns=["a", "b", "c"]).assign(key=pdf["key"].iloc[0])[["key", "a", "b", "c"]]

    return points.select("key", "pid", "x", "y").groupBy("key").applyInPandas(solve, "key long, a long, b long, c long")


def scattered(raster: DataFrame, count: int, tries: int = 10, seed: int = 7) -> DataFrame:
    """(img, k, x, y): ``count`` points drawn by ink, each the one of ``tries`` draws that is farthest from those before
    in units of the local spacing; any first part of them is spread out as well."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["iy", "ix"])
        m = (1 - pdf["v"]).clip(0).to_numpy()
        if m.sum() <= 0:
            return pd.DataFrame({"img": [], "k": [], "x": [], "y": []}).astype({"img": str, "k": "int32"})
        rng, total = np.random.default_rng(seed), np.cumsum(m)
        x, y, got = pdf["ix"].to_numpy() + 0.5, pdf["iy"].to_numpy() + 0.5, np.zeros((0, 2))
        for _ in range(count):
            i = np.searchsorted(total, rng.random(tries) * total[-1], "right").clip(max=len(m) - 1)
            at = np.column_stack([x[i], y[i]]) + rng.random((tries, 2))
            gap = ((at[:, None] - got[None]) ** 2).sum(2).min(1) * m[i] if len(got) else m[i]
            got = np.vstack([got, at[int(gap.argmax())]])
        return pd.DataFrame({"img": pdf["img"].iloc[0], "k": np.arange(count, dtype="int32"), "x": got[:, 0], "y": got[:, 1]})

    return raster.select("img", "ix", "iy", F.col("v").cast("double").alias("v")).groupBy("img").applyInPandas(solve, "img string, k int, x double, y double")
