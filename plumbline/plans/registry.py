"""Drawing methods and their parameters: look-up, defaults, bounds, and what varies from ink to ink. All of it is
metadata, held and checked on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import dither, paths, quadtree, splitting, subdivision, tiles
from plumbline.plans import crosshatch, hatching

#: Turns of the four inks, in parts of a screen's period.
ROSETTE = {"c": 1 / 12, "m": 5 / 12, "y": 0.0, "k": 1 / 4}
Bound = float | Callable[[Mapping[str, float]], float]


@dataclass(frozen=True)
class Param:
    key: str
    default: float | str
    low: Bound | None = None
    high: Bound | None = None
    options: tuple[str, ...] = ()

    def bounds(self, settings: Mapping[str, float]) -> tuple[float | None, float | None]:
        """Least and largest value under these settings."""
        low, high = (b(settings) if callable(b) else b for b in (self.low, self.high))
        return low, high

    def checked(self, value: object, settings: Mapping[str, float]) -> float | str:
        """``value`` within its bounds; the default where it isn't one of the options or not a finite number."""
        if self.options:
            return value if value in self.options else self.default
        try:
            number = float(value)
        except (TypeError, ValueError):
            return self.default
        if not math.isfinite(number):
            return self.default
        low, high = self.bounds(settings)
        return max(low if low is not None else number, min(high if high is not None else number, number))


@dataclass(frozen=True)
class Method:
    """``run`` takes a raster, its width and height and the parameters, and gives strokes as (img, ..., x1, y1, x2, y2)."""

    id: str
    label: str
    run: Callable[[DataFrame, int, int, Mapping[str, float]], DataFrame]
    params: tuple[Param, ...] = ()
    rotation: str | None = None
    period: float = 180.0
    seeds: tuple[str, ...] = field(default=())

    def defaults(self) -> dict[str, float | str]:
        return {p.key: p.default for p in self.params}

    def variation(self) -> str | None:
        """What tells one ink's drawing from another's: an angle before a seed."""
        return self.rotation or next(iter(self.seeds), None)

    def for_channel(self, params: Mapping[str, float], channel: str) -> dict[str, float]:
        """Parameters of one ink: its angle turned by its part of the period, or its seed moved on."""
        out = dict(params)
        if self.rotation:
            out[self.rotation] = (params[self.rotation] + ROSETTE[channel] * self.period) % self.period
        elif self.seeds:
            out[self.seeds[0]] = params[self.seeds[0]] + list(ROSETTE).index(channel)
        return out


def _hatch(target: DataFrame, w: int, h: int, params: Mapping[str, float]) -> DataFrame:
    layout = hatching.Layout(w, h, params["pen"], math.radians(params["angle"]))
    return hatching.hatched(target, layout, 1 << max(1, math.ceil(math.log2(params["levels"]))))


def _page(w: int, h: int) -> list[tuple[float, float]]:
    return [(1.0, 1.0), (float(w), 1.0), (float(w), float(h)), (1.0, float(h))]


def _crosshatch(target: DataFrame, w: int, h: int, params: Mapping[str, float]) -> DataFrame:
    layers = crosshatch.Layers(w, h, params["pen"], round(params["levels"]), params["darkest"])
    return crosshatch.crosshatched(target, layers, _page(w, h))


def _split_merge(target: DataFrame, w: int, h: int, params: Mapping[str, float]) -> DataFrame:
    return splitting.split_merge(target, _page(w, h), math.radians(params["angle"]), params["scale"], params["pen"], params["splits"] == "yes")


def _subdivide(target: DataFrame, w: int, h: int, params: Mapping[str, float]) -> DataFrame:
    return subdivision.cut_up(target, _page(w, h), params["pen"], w, round(params["rounds"]))[0]


def _crosses(target: DataFrame, w: int, h: int, params: Mapping[str, float]) -> DataFrame:
    return quadtree.crossed(target, w, h, params["pen"], round(params["depth"]))[0]


def dots(target: DataFrame, w: int, h: int, params: Mapping[str, float]) -> DataFrame:
    """(img, pid, x, y, r): the dots of a lattice that are drawn."""
    radius, hexagonal, seed = max(params["pen"], params["dot"] * params["pen"]) / 2, params["lattice"] == "hex", round(params["seed"])
    cols, rows, _, _, dx, dy = tiles.lattice(w, h, radius, hexagonal)
    at = tiles.lattice_cells(target.sparkSession, w, h, radius, hexagonal)
    cells, extra = tiles.lattice_darkness(target, w, h, radius, hexagonal), math.pi * radius * radius / (dx * dy) - 1
    if params["mode"] == "threshold":
        drawn = dither.threshold(cells, tiles.lattice_links(at, cols, rows, hexagonal), extra, 6 if hexagonal else 4, seed)
    else:
        drawn = dither.seeded(cells, extra, seed)
        if params["mode"] == "swaps":
            drawn = dither.swapped(drawn, cols, rows, extra, hexagonal, tries=round(params["tries"]), seed=seed, scale=params["blur"])
    return drawn.where("drawn = 1").select("img", "pid").join(at, "pid").select("img", "pid", "x", "y", F.lit(radius).alias("r"))


def _dither(target: DataFrame, w: int, h: int, params: Mapping[str, float]) -> DataFrame:
    """Each dot as one stroke, cut into its straight parts."""
    points = paths.dot_strokes(dots(target, w, h, params).select(F.struct("img", "pid").alias("path_id"), "x", "y", "r"), params["pen"])
    order = Window.partitionBy("path_id").orderBy("seq")
    after = lambda c: F.coalesce(F.lead(c).over(order), F.when(F.col("seq") == 0, F.col(c)))
    parts = points.select("path_id.img", "path_id.pid", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), after("x").alias("x2"), after("y").alias("y2"))
    return parts.where("x2 is not null")


PEN = Param("pen", 1.5, 0.1, lambda s: s.get("width", 50.0) / 4)
METHODS = (
    Method("parallel_hatching", "Parallel hatching", _hatch, (Param("angle", 26.0, 0.0, 180.0), Param("levels", 8.0, 2.0, 64.0), PEN), rotation="angle"),
    Method("crosshatching", "Crosshatching", _crosshatch, (Param("levels", 5.0, 2.0, 12.0), Param("darkest", 0.95, 0.5, 0.99), PEN)),
    Method(
        "split_merge",
        "Splitting and merging lines",
        _split_merge,
        (Param("angle", 90.0, 0.0, 180.0), Param("scale", 1.0, 0.25, 4.0), Param("splits", "yes", options=("yes", "no")), PEN),
        rotation="angle",
    ),
    Method(
        "dither_grid",
        "Dither grid",
        _dither,
        (
            Param("mode", "threshold", options=("threshold", "random", "swaps")),
            Param("lattice", "hex", options=("square", "hex")),
            Param("dot", 3.0, 1.0, 12.0),
            Param("tries", 100.0, 1.0, 2000.0),
            Param("blur", 3.0, 1.0, 6.0),
            Param("seed", 1.0, 1.0, 2.0**31),
            PEN,
        ),
        seeds=("seed",),
    ),
    Method("polygon_subdivision", "Polygon subdivision", _subdivide, (Param("rounds", 13.0, 1.0, 20.0), PEN)),
    Method("quad_crosses", "Quadtree crosses", _crosses, (Param("depth", 9.0, 1.0, 12.0), PEN)),
)


def method(name: str) -> Method:
    """The method of that name; the first one for a name that isn't known."""
    return next((m for m in METHODS if m.id == name), METHODS[0])
