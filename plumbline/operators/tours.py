"""Closed tours made shorter: turned stretches and moved points, within windows of the tour that shift from round to round.

A window is a bounded number of stops in a row; its first and last stay where they are, so that windows don't disturb each
other and no round can lengthen a tour. After each round the tour is counted from half a window further on, and stops near
one round's borders come to lie in the middle of the next one's windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.rounds import materialise, release

#: Stops of a window, and of a moved stretch at most.
WIDTH, STRETCH = 64, 3


def best_turn(d: np.ndarray) -> tuple[float, int, int]:
    """(gain, i, j) of the best turn of the stops i to j of a path with distances ``d``; its ends stay."""
    m = len(d)
    i, j = np.triu_indices(m - 2, 1)
    i, j = i + 1, j + 1
    gain = d[i - 1, i] + d[j, j + 1] - d[i - 1, j] - d[i, j + 1]
    k = int(gain.argmax()) if len(gain) else 0
    return (float(gain[k]), int(i[k]), int(j[k])) if len(gain) else (0.0, 0, 0)


def best_move(d: np.ndarray, length: int) -> tuple[float, int, int, bool]:
    """(gain, i, k, turned) of the best move of the stops i to i + length - 1 to behind stop k, one of the others."""
    m = len(d)
    i, k = np.meshgrid(np.arange(1, m - length), np.arange(m - 1), indexing="ij")
    ok = (k < i - 1) | (k >= i + length)
    i, k = i[ok], k[ok]
    if not len(i):
        return 0.0, 0, 0, False
    last = i + length - 1
    saved = d[i - 1, i] + d[last, last + 1] - d[i - 1, last + 1] + d[k, k + 1]
    gains = np.stack([saved - d[k, i] - d[last, k + 1], saved - d[k, last] - d[i, k + 1]])
    turned, at = np.unravel_index(int(gains.argmax()), gains.shape)
    return float(gains[turned, at]), int(i[at]), int(k[at]), bool(turned)


def better(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The stops of a path in a better order: the best turn or move is made, until none gains."""
    order = np.arange(len(x))
    if len(order) < 4:
        return order
    whole = np.hypot(x[:, None] - x, y[:, None] - y)
    while True:
        d = whole[np.ix_(order, order)]
        turn = best_turn(d)
        moves = [(*best_move(d, n), n) for n in range(1, min(STRETCH, len(order) - 3) + 1)]
        move = max(moves, key=lambda m: m[0])
        if max(turn[0], move[0]) <= 1e-9:
            return order
        if turn[0] >= move[0]:
            _, i, j = turn
            order[i : j + 1] = order[i : j + 1][::-1].copy()
        else:
            _, i, k, turned, n = move
            held = order[i : i + n][::-1] if turned else order[i : i + n]
            rest = np.delete(order, np.arange(i, i + n))
            order = np.insert(rest, (k if k < i else k - n) + 1, held)


def improved(tours: DataFrame, by: list[str], rounds: int = 4, width: int = WIDTH) -> DataFrame:
    """``tours`` (by, seq, pid, x, y; ``seq`` from 0 without gaps) with the stops of each in a better order, and counted from
    another one on."""
    kinds = dict(tours.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "n long", f"seq long, pid {kinds['pid']}, x double, y double"])

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("seq", ignore_index=True)
        order = better(cells["x"].to_numpy(), cells["y"].to_numpy())
        out = cells.iloc[order].reset_index(drop=True)
        out["seq"] = cells["seq"]
        return out[[*by, "n", "seq", "pid", "x", "y"]]

    sizes = tours.groupBy(*by).agg(F.count("*").alias("n"))
    state = materialise(tours.join(sizes, by).select(*by, "n", F.col("seq").cast("long").alias("seq"), "pid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    for _ in range(rounds):
        turned = F.pmod(F.col("seq") + width // 2, F.col("n"))
        dealt = state.withColumn("seq", turned).withColumn("_window", F.floor(F.col("seq") / width))
        after = materialise(dealt.groupBy(*by, "_window").applyInPandas(run, schema))
        release(state)
        state = after
    return state.drop("n")


def lengths(tours: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, length) of closed tours. A stop's length to the next one needs just that one, not the tour in one place."""
    sizes = tours.groupBy(*by).agg(F.count("*").alias("n"))
    t = tours.join(sizes, by)
    after = t.select(*by, F.pmod(F.col("seq") - 1, F.col("n")).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    step = F.sqrt((F.col("x2") - F.col("x")) * (F.col("x2") - F.col("x")) + (F.col("y2") - F.col("y")) * (F.col("y2") - F.col("y")))
    return t.join(after, [*by, "seq"]).groupBy(*by).agg(F.count("*").alias("n"), F.sum(step).alias("length"))
