"""Which cells of a dot lattice to draw: one threshold for a whole image, and swaps that better the arrangement.

A drawn dot inks its own cell and a share of each undrawn neighbour, so that drawing cells from the darkest on, each adds
one, its share on the neighbours still undrawn, less what the drawn ones had already laid on it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import draw
from plumbline.operators.rounds import materialise, release, spread

#: Equal cells are put in order by a draw of at most half this size.
JITTER = 1e-6
#: Bits of the darkness' code, bits that a round of the search settles, and cells that are put in order at once.
BITS, ROUND_BITS, FEW = 48, 12, 4096
#: Columns that tell tiles apart.
TILE = ["ti", "tj", "img"]


def coded(cells: DataFrame, seed: int) -> DataFrame:
    """``cells`` with ``code``: ascending from the darkest cell to the lightest."""
    key = F.col("k") + (draw(seed, F.col("pid")) - 0.5) * JITTER
    return cells.withColumn("code", F.floor((1 + JITTER - key) * float(1 << (BITS - 1))).cast("long"))


def gains(cells: DataFrame, links: DataFrame, share: float) -> DataFrame:
    """``cells`` with ``gain``, the ink that each adds when all darker ones are drawn. They are read several times, and so are
    better written down; tasks grow in number with the links to be met."""
    met = cells.count() * links.groupBy("pid").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    asked = spread(cells.select("img", "pid", "code").join(links, "pid"), met, "img", "near")
    near = spread(cells.select("img", F.col("pid").alias("near"), F.col("code").alias("ncode")), met, "img", "near")
    darker = (F.col("ncode") < F.col("code")) | ((F.col("ncode") == F.col("code")) & (F.col("near") < F.col("pid")))
    spill = spread(asked.join(near, ["img", "near"]).select("img", "pid", F.when(darker, -share).otherwise(share).alias("s")), met, "img", "pid").groupBy("img", "pid").agg(F.sum("s").alias("spill"))
    return spread(cells, met, "img", "pid").join(spill, ["img", "pid"], "left").withColumn("gain", 1 + F.coalesce("spill", F.lit(0.0))).drop("spill")


def threshold(cells: DataFrame, links: DataFrame, extra: float, degree: int, seed: int = 1) -> DataFrame:
    """(img, pid, k, drawn): the darkest cells of each image, as many as lay down the ink that all cells ask for.

    The place where the ink reaches that is searched digit by digit of the darkness: each round adds up the gains of one
    image's open digit range in at most 4096 sums, until a range holds few cells; only those are put in order.
    """
    dark = materialise(coded(cells, seed))
    made = materialise(gains(dark, links, extra / degree))
    release(dark)
    state = materialise(made.groupBy("img").agg(F.sum("k").alias("want"), F.count("*").alias("n")).select("img", "want", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("at"), "n"))
    left = BITS
    while left > 0 and (state.agg(F.max("n")).first()[0] or 0) > FEW:
        shift = left - ROUND_BITS
        digit = F.shiftright("code", shift)
        open_ = made.join(state, "img").where(F.shiftright("code", left) == F.col("at"))
        sums = open_.groupBy("img", "want", "base", digit.alias("digit")).agg(F.sum("gain").alias("g"), F.count("*").alias("cells"))
        run = F.col("base") + F.sum("g").over(Window.partitionBy("img").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        found = sums.withColumn("run", run).groupBy("img", "want").agg(
            F.min(F.when(F.col("run") >= F.col("want"), F.struct("digit", (F.col("run") - F.col("g")).alias("base"), "cells"))).alias("hit"),
            F.max(F.struct("digit", (F.col("run") - F.col("g")).alias("base"), "cells")).alias("last"),
        )
        hit = F.coalesce("hit", "last")  # all cells together may lay less than is asked
        after = materialise(found.withColumn("h", hit).select("img", "want", F.col("h.base").alias("base"), F.col("h.digit").alias("at"), F.col("h.cells").alias("n")))
        release(state)
        state, left = after, shift
    order = Window.partitionBy("img").orderBy("code", "pid").rowsBetween(Window.unboundedPreceding, 0)
    placed = spread(made, made.count(), "img")
    last = placed.join(state, "img").where(F.shiftright("code", left) == F.col("at")).withColumn("run", F.col("base") + F.sum("gain").over(order))
    # Of the two patterns around the wanted ink the nearer one.
    with_it, without = F.abs(F.col("run") - F.col("want")), F.abs(F.col("run") - F.col("gain") - F.col("want"))
    taken = (F.col("run") < F.col("want")) | ((F.col("run") - F.col("gain") < F.col("want")) & (with_it < without))
    cut = last.where(taken).groupBy("img").agg(F.max(F.struct("code", "pid")).alias("cut"))
    # Where not one of the last range is drawn, what lies before it is.
    cut = state.select("img", F.col("at").alias("range")).join(cut, "img", "left")
    before = F.shiftright("code", left) < F.col("range")
    drawn = before | F.coalesce(F.struct("code", "pid") <= F.col("cut"), F.lit(False))
    return placed.join(cut, "img").select("img", "pid", "k", drawn.cast("int").alias("drawn"))


def seeded(cells: DataFrame, extra: float, seed: int = 1) -> DataFrame:
    """(img, pid, k, drawn): cells drawn at random, with a chance that allows for ink on the neighbours' cells."""
    p = ((1 + extra) - F.sqrt((1 + extra) * (1 + extra) - 4 * extra * F.col("k"))) / (2 * extra)
    return cells.select("img", "pid", "k", (draw(seed, F.col("pid")) < p).cast("int").alias("drawn"))


def inked(pattern: DataFrame, links: DataFrame, extra: float, degree: int) -> DataFrame:
    """``pattern`` (img, pid, drawn) with ``ink``: one for a drawn cell, its drawn neighbours' shares for any other."""
    near = pattern.where("drawn = 1").select("img", F.col("pid").alias("near")).join(links, "near").groupBy("img", "pid").agg(F.count("*").alias("n"))
    ink = F.when(F.col("drawn") == 1, 1.0).otherwise(F.coalesce("n", F.lit(0)) * (extra / degree))
    return pattern.join(near, ["img", "pid"], "left").withColumn("ink", ink).drop("n")


class Kernel:
    """The blur through which swaps see the drawing: separable, edges repeated, ``reach`` cells to each side."""

    def __init__(self, scale: float):
        self.reach = min(8, max(1, int(np.floor(2.5 * scale + 0.5))))
        taps = np.exp(-np.arange(-self.reach, self.reach + 1) ** 2 / scale**2)
        self.taps = taps / taps.sum()

    def matrix(self, first: int, n: int, size: int) -> np.ndarray:
        """Blurs ``n`` cells of an axis from ``first`` on, of ``size`` in all; what lies beyond those at hand is left out."""
        out = np.zeros((n, n))
        for k, t in zip(range(-self.reach, self.reach + 1), self.taps, strict=True):
            to = np.clip(np.arange(first, first + n) + k, 0, size - 1) - first
            ok = (to >= 0) & (to < n)
            out[np.flatnonzero(ok), to[ok]] += t
        return out


def spill(drawn: np.ndarray, first_row: int, share: float, hexagonal: bool) -> np.ndarray:
    """Ink of each cell of a piece of a lattice, or of many, whose first row is number ``first_row``."""
    p = np.pad(drawn.astype(float), [(0, 0)] * (drawn.ndim - 2) + [(1, 1), (1, 1)])
    near = p[..., 1:-1, :-2] + p[..., 1:-1, 2:] + p[..., :-2, 1:-1] + p[..., 2:, 1:-1]
    if hexagonal:
        odd = ((np.arange(drawn.shape[-2]) + first_row) % 2 == 1)[:, None]
        near += np.where(odd, p[..., :-2, 2:] + p[..., 2:, 2:], p[..., :-2, :-2] + p[..., 2:, :-2])
    return np.where(drawn > 0, 1.0, near * share)


def alike_swaps(drawn: np.ndarray, want: np.ndarray, draws: np.ndarray, own: np.ndarray, free: np.ndarray, blurred: Callable[[np.ndarray], np.ndarray], inked: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``drawn`` after the swaps of tiles that lie alike, side by side; ``draws`` (tile, try, 2). A tile stops when it has
    nothing to swap."""
    n, size = len(drawn), drawn[0].size
    drawn, target = drawn.copy(), blurred(want)
    gap = target - blurred(inked(drawn))
    error = np.abs(gap[:, own]).sum(1)
    live = np.arange(n)
    for k in range(draws.shape[1]):
        g, d, u = gap[live], drawn[live], draws[live, k]
        c = np.stack([np.where(free & (sign * g > 0) & (d == was), g * g, 0).reshape(len(live), size).cumsum(1) for sign, was in ((1, 0), (-1, 1))], 1)
        some = (c[:, :, -1] > 0).all(1)
        live, c, u, trial = live[some], c[some], u[some], d[some]
        if not len(live):
            break
        at = np.minimum((c <= (u * c[:, :, -1])[:, :, None]).sum(2), size - 1)
        flat = trial.reshape(len(live), size)
        flat[np.arange(len(live)), at[:, 0]], flat[np.arange(len(live)), at[:, 1]] = 1, 0
        new = target[live] - blurred(inked(trial))
        e = np.abs(new[:, own]).sum(1)
        better = e < error[live] - 1e-12
        moved = live[better]
        drawn[moved], gap[moved], error[moved] = trial[better], new[better], e[better]
    return drawn


def tile_swaps(cols: int, rows: int, share: float, hexagonal: bool, kernel: Kernel, tries: int, seed: int, shift: tuple[int, int], side: int, number: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Swaps of the tiles of a task, whose rows follow each other. Only cells whose effect stays inside the tile move, so that
    tiles don't disturb each other, and a swap is kept only if it brings the blurred drawing nearer to the blurred target.
    The tiles of a batch that lie alike are worked side by side."""
    reach = kernel.reach + 1
    inner = lambda x, a, size: ((x >= a + reach) | (a <= 0)) & ((x < a + side - reach) | (a + side >= size))

    def whole(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.reset_index(drop=True)
        tile = cells.groupby(TILE, sort=False, dropna=False).ngroup().to_numpy()
        first = np.flatnonzero(np.diff(tile, prepend=-1))
        i, j, was, k = (cells[c].to_numpy() for c in ("i", "j", "drawn", "k"))
        ti, tj = (cells[c].to_numpy()[first] for c in ("ti", "tj"))
        box = np.stack([ti, tj, np.minimum.reduceat(i, first), np.maximum.reduceat(i, first), np.minimum.reduceat(j, first), np.maximum.reduceat(j, first)], 1)
        names = list(zip(cells["img"].iloc[first].tolist(), ti.tolist(), tj.tolist(), strict=True))
        kinds, kind = np.unique(box, axis=0, return_inverse=True)
        kind, place = kind.ravel(), np.empty(len(first), np.int64)
        made, kept = was.copy(), np.zeros(len(cells), bool)
        for x, (a, b, i0, i1, j0, j1) in enumerate(kinds.tolist()):
            of = np.flatnonzero(kind == x)
            place[of] = np.arange(len(of))
            row = np.flatnonzero(kind[tile] == x)
            at = (place[tile[row]], i[row] - i0, j[row] - j0)
            shape = (len(of), i1 - i0 + 1, j1 - j0 + 1)
            drawn, want = np.zeros(shape), np.zeros(shape)
            drawn[at], want[at] = was[row], k[row]
            down, across = kernel.matrix(i0, shape[1], rows), kernel.matrix(j0, shape[2], cols).T
            lo = [t * side - s for t, s in zip((a, b), shift, strict=True)]
            ii, jj = np.arange(shape[1])[:, None] + i0, np.arange(shape[2])[None, :] + j0
            own = (ii >= lo[0]) & (ii < lo[0] + side) & (jj >= lo[1]) & (jj < lo[1] + side)
            free = own & inner(ii, lo[0], rows) & inner(jj, lo[1], cols)
            draws = np.stack([np.random.default_rng([seed, zlib.crc32(repr((*names[t], number)).encode())]).random((tries, 2)) for t in of.tolist()])
            done = alike_swaps(drawn, want, draws, own, free, lambda p: down @ (p @ across), lambda d: spill(d, i0, share, hexagonal))  # noqa: B023
            made[row], kept[row] = done[at], own[at[1:]]
        cells["drawn"] = made.astype(np.int32)
        return cells.loc[kept, ["img", "pid", "i", "j", "k", "drawn"]]

    def of_tile(cells: pd.DataFrame, one: pd.DataFrame) -> np.ndarray:
        return np.logical_and.reduce([cells[c].isna() if one[c].isna().all() else cells[c] == one[c].iloc[0] for c in TILE])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            # The last tile may go on in the next batch.
            end = batch[TILE].iloc[-1:]
            last = of_tile(batch, end)
            if last.all() and (not held or of_tile(held[-1].iloc[-1:], end).all()):
                held.append(batch)
                continue
            if len(ready := pd.concat([*held, batch[~last]])):
                yield whole(ready)
            held = [batch[last]]
        if held:
            yield whole(pd.concat(held))

    return run


def swapped(pattern: DataFrame, cols: int, rows: int, extra: float, hexagonal: bool, rounds: int = 4, tries: int = 100, seed: int = 1, scale: float = 1.0, side: int = 32) -> DataFrame:
    """(img, pid, i, j, k, drawn): ``pattern`` (img, pid, k, drawn) with as many dots, better placed.

    The lattice is cut into tiles, which each see a rim of the neighbours' cells; in every round they are cut anew, half a
    tile further, so that a cell near one round's border is inside another's tile. A tile is one task's work, of bounded size.
    """
    kernel, share = Kernel(scale), extra / (6 if hexagonal else 4)
    rim = kernel.reach + 1
    kind = dict(pattern.dtypes)["img"]
    session = pattern.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    i, j = F.floor(F.col("pid") / cols).cast("int"), (F.col("pid") % cols).cast("int")
    state = materialise(pattern.select("img", "pid", i.alias("i"), j.alias("j"), F.col("k").cast("double").alias("k"), F.col("drawn").cast("int").alias("drawn")))
    for r in range(rounds):
        shift = (r // 2 % 2 * side // 2, r % 2 * side // 2)

        def seen(c: str, s: int) -> Column:
            tile = lambda x: F.floor((x + s) / side).cast("int")
            return F.array_distinct(F.array(tile(F.col(c) - rim), tile(F.col(c)), tile(F.col(c) + rim)))

        dealt = state.withColumn("ti", F.explode(seen("i", shift[0]))).withColumn("tj", F.explode(seen("j", shift[1])))
        swaps = tile_swaps(cols, rows, share, hexagonal, kernel, tries, seed, shift, side, r)
        # A given number of partitions: the rows are few for the work on them, and would be put together by their size.
        after = dealt.repartition(parts, *TILE).sortWithinPartitions(*TILE).mapInPandas(swaps, f"img {kind}, pid long, i int, j int, k double, drawn int")
        after = materialise(after)
        release(state)
        state = after
    return state
