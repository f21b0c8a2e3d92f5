"""Laws that turn a pixel's value into what a method draws there: limits, targets, spacings, densities, orientations,
distances. Numbers that hold for a whole drawing are plain Python; everything for a pixel is a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.scalar import clamp, half_up

#: Rasters and renderings hold at most so many pixels.
MOST_PIXELS, MOST_SAMPLES = 16_000_000, 12_000_000
#: Points of a hexagonal lattice of spacing 1 in a unit of area.
HEX_DENSITY = 1.1547
#: Wavelength times darkness over pen width, for the zero lines of a noise field.
ZERO_LINES = 2.2214


def raster_size(w: int, h: int, px_per_cm: float, width_cm: float) -> tuple[int, int, float]:
    """(columns, rows, pixels per centimetre) of a drawing ``width_cm`` wide: shrunk by the root of the excess where it
    would hold more than ``MOST_PIXELS``."""
    nx = max(2, math.floor(px_per_cm * width_cm + 0.5))
    ny = max(2, math.floor(h * nx / w + 0.5))
    if nx * ny > MOST_PIXELS:
        k = math.sqrt(MOST_PIXELS / (nx * ny))
        nx, ny = max(2, math.floor(nx * k + 0.5)), max(2, math.floor(ny * k + 0.5))
    return nx, ny, nx / width_cm


def floors(pen: float) -> tuple[float, float]:
    """Least spacing of strokes that don't merge, and the scale of detail not worth a point."""
    return 1.1 * pen, pen / 2


def samples_a_side(w: int, h: int, most: int = 3) -> int:
    """Samples along a pixel's side that stay within ``MOST_SAMPLES``."""
    return next((s for s in range(most, 1, -1) if w * h * s * s <= MOST_SAMPLES), 1)


def working_scale(pen: float, w: int, h: int, budget: int) -> float:
    """Cells of a pen's width, or as many as the budget of points lets through."""
    return 1 / pen if w * h / (pen * pen) <= budget else math.sqrt(budget / (w * h))


def spacings(pen: float, least: float, most: float) -> tuple[float, float]:
    """Least and largest spacing from multiples of the pen: no closer than the pen, and half as wide again at least."""
    lo = max(pen, least * pen)
    return lo, max(1.5 * lo, most * pen)


def stripe_band(pen: float, lo: float, hi: float) -> tuple[float, float]:
    """Darkest and lightest value that stripes of these spacings reach."""
    return max(0.0, 1 - pen / lo), max(0.0, 1 - pen / hi)


def most_orthogonal(angles: list[float]) -> list[float]:
    """The angles in an order in which each is as far from all before it as can be; the first stays first."""
    left, out = list(range(1, len(angles))), angles[:1]
    while left:
        best = max(left, key=lambda i: (min(abs(math.sin(angles[i] - a)) for a in out), -i))
        left.remove(best)
        out.append(angles[best])
    return out


def into_band(v: Column, band: tuple[float, float]) -> Column:
    return v * (band[1] - band[0]) + band[0]


def net_spacing(v: Column, pen: float, length: float, overlap: float, kappa: float, lo: float, hi: float) -> Column:
    """Spacing of a net whose coverage is that of the value brought into the band that ``lo`` and ``hi`` reach."""
    reach = lambda d: 1 - min(1.0, kappa * length * pen / (d + overlap * pen))
    dark = F.greatest(F.lit(1e-6), 1 - into_band(clamp(v, 0.0, 1.0), (reach(lo), reach(hi))))
    return clamp(kappa * length * pen / dark - overlap * pen, lo, hi)


def density(spacing: Column) -> Column:
    return HEX_DENSITY / (spacing * spacing)


def radius(v: Column, lo: float, hi: float) -> Column:
    """Radius whose inverse falls evenly with the value."""
    return clamp(lo / (1 - clamp(v, 0.0, 1.0) * (1 - lo / hi)), lo, hi)


def wavelength(v: Column, pen: float, lo: float, hi: float) -> Column:
    dark = 1 - clamp(v, 0.0, 1.0)
    return F.when(dark > 1e-6, clamp(ZERO_LINES * pen / dark, lo, hi)).otherwise(float(hi))


def cutoff(v: Column, pen: float, hi: float) -> Column:
    """A noise field's target: what is lighter than its longest wave can draw is left white."""
    return F.when(1 - v < ZERO_LINES * pen / hi, 1.0).otherwise(v)


def rungs(levels: int, darkest: float) -> list[float]:
    """Darkness of 0, 1, ... layers of strokes laid over each other, each as dense as the others."""
    return [1 - (1 - darkest) ** (i / levels) for i in range(levels + 1)]


def rung_of(v: Column, levels: int, darkest: float) -> Column:
    """The rung nearest to a value's darkness, by position between the rungs around it."""
    k = clamp((1 - v) * darkest, 0.0, darkest)
    ladder = rungs(levels, darkest)
    at = F.lit(float(levels))
    for i in reversed(range(levels)):
        at = F.when(k < ladder[i + 1], i + (k - ladder[i]) / (ladder[i + 1] - ladder[i])).otherwise(at)
    return half_up(at).cast("int")


def staircase(v: Column, levels: int, darkest: float) -> Column:
    return 1 - F.element_at(F.array(*[F.lit(r) for r in rungs(levels, darkest)]), rung_of(v, levels, darkest) + 1)


def quantised_angle(theta: Column, n: int) -> Column:
    """The nearest of ``n`` directions of a half turn."""
    return half_up(theta / (math.pi / n)) * (math.pi / n)


def diagonal(theta: Column) -> Column:
    """The nearest of the four diagonal directions."""
    return half_up((theta - math.pi / 4) / (math.pi / 2)) * (math.pi / 2) + math.pi / 4


def gate(energy: Column, median: Column, coherence: Column) -> Column:
    """How far a direction counts: its coherence times a smooth step of its energy up to twice the median."""
    e = F.when(median > 0, F.least(F.lit(1.0), energy / median / 2)).otherwise(0.0)
    return coherence * (e * e * (3 - 2 * e))


def diagonal_mix(theta: Column, gated: Column) -> Column:
    """Share of rising diagonals for a direction: a half where none counts."""
    return 0.5 + 0.5 * F.sin(2 * theta) * clamp(gated, 0.0, 1.0)


def ink_rate(perimeter: Column, vertices: Column, pen: float) -> Column:
    """Ink for a unit of a polygon's outline, of which each side of the line gets half, less what corners share."""
    shared = F.when(perimeter > 0, vertices * pen / perimeter).otherwise(1.0)
    return pen / 2 * F.greatest(F.lit(0.1), 1 - shared)


def distance(kind: str, dx: Column, dy: Column, angle: float = 0.0) -> Column:
    """Distance by the shape that is round about a point: ``square``, ``diamond``, ``angled`` square, or circle."""
    if kind == "square":
        return F.greatest(F.abs(dx), F.abs(dy))
    if kind == "diamond":
        return F.abs(dx) + F.abs(dy)
    if kind == "angled":
        c, s = math.cos(angle), math.sin(angle)
        return F.greatest(F.abs(dx * c - dy * s), F.abs(dx * s + dy * c))
    return F.sqrt(dx * dx + dy * dy)


def sawtooth_ratio(pen: float, height: float, swing: float, length: float) -> float:
    """Coverage of a sawtooth in a strip, as :func:`plumbline.functions.scalar.wave_coverage` has it, for numbers."""
    arm = 4 * length * math.sqrt(4 * swing * swing + length * length)
    corner = pen * length * (math.pi - 2 * math.atan(length / (2 * swing))) - 4 * pen * swing
    return max(0.0, min(1.0, pen * (arm + corner) / (4 * height * length * length)))
