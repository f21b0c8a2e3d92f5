"""Column functions: rounding, seeded draws, tone ladders and coverage laws, orderings of cells.

All are pure expressions of their arguments, so they run inside whole-stage code or the scan that feeds it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def half_up(x: Column) -> Column:
    """Rounding to the nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5)


def quantised(x: Column, scale: float = 1e6) -> Column:
    """``x`` in units of ``1 / scale``, as a long; null stays null."""
    return half_up(x.cast("double") * scale).cast("long")


def clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lit(lo), F.least(lit(hi), x))


def product32(a: Column, b: Column) -> Column:
    """Low 32 bits of the product of two 32-bit values held as longs, without overflow."""
    high = F.shiftright(a, 16) * b
    return ((a.bitwiseAND(65535)) * b + (high.bitwiseAND(65535)) * 65536).bitwiseAND(4294967295)


def draw(seed: Column | int, n: Column) -> Column:
    """Draw ``n`` (from 0) of the seeded generator, in [0, 1): a counter put through two multiply-xor rounds."""
    seed = F.lit(seed).cast("long") if isinstance(seed, int) else seed.cast("long")
    a = (seed + (n.cast("long") + 2) * 0x6D2B79F5).bitwiseAND(4294967295)
    t = product32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    u = product32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))
    t = t.bitwiseXOR((t + u).bitwiseAND(4294967295))
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)


def harmonic_spacing(v: Column, lo: float, hi: float) -> Column:
    """The spacing whose inverse runs linearly from ``1 / lo`` at 0 to ``1 / hi`` at 1."""
    return F.lit(float(lo)) / (F.lit(1.0) - v * (1 - lo / hi))


def harmonic_rate(v: Column, lo: float, hi: float) -> Column:
    """The same ladder as lines per unit of length."""
    return F.lit(1 / lo) + v * (1 / hi - 1 / lo)


def stadium_area(d: Column, w: float) -> Column:
    """Ink of a stroke of length ``d`` with round caps."""
    return d * w + PI * w * w / 4


def ring_coverage(r: Column, w: float, packing: float, tangencies: float) -> Column:
    """Coverage of packed circles of radius ``r`` drawn as outlines of width ``w``."""
    kept = F.greatest(F.lit(0.0), F.lit(1.0) - (2 * tangencies / (3 * PI)) * F.sqrt(F.lit(w) / r))
    return F.when(r > 0, clamp(F.lit(2 * packing * w) / r * kept, 0.0, 1.0)).otherwise(1.0)


def net_coverage(d: Column, w: float, length: float, overlap: float, kappa: float) -> Column:
    """Coverage of a network of spacing ``d`` whose edges are ``length`` long in units of the lattice's."""
    return F.least(F.lit(1.0), F.lit(kappa * length * w) / (d + overlap * w))


def sine_arc_factor(k: Column, intervals: int = 64) -> Column:
    """Mean length of a sine's arc to its base, by Simpson's rule over a quarter wave."""
    h = PI / 2 / intervals

    def term(i: Column) -> Column:
        weight = F.when((i == 0) | (i == intervals), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return weight * F.sqrt(1 + k * k * F.pow(F.cos(i * h), F.lit(2.0)))

    total = F.aggregate(F.sequence(F.lit(0), F.lit(intervals)), F.lit(0.0), lambda s, i: s + term(i))
    return total * (2 / PI) * (h / 3)


def wave_coverage(shape: str, w: float, height: float, swing: Column, length: Column) -> Column:
    """Coverage of one period of a wave drawn with pen ``w`` in a strip of ``height``; ``swing`` is peak to peak."""
    flat = min(1.0, w / height)
    if shape == "square":
        ratio = w * (2 * swing + length) / (height * length) - w * w * (4 - PI) / (4 * height * length)
    elif shape == "sine":
        tight = length * length / (PI * PI * swing * w)
        # Area counted twice where a peak is narrower than the pen; a fitted law.
        excess = 0.0278 * w * w * F.pow(F.greatest(F.lit(0.0), 1 / tight - 1), F.lit(1.35))
        ratio = F.greatest(F.lit(flat), (w / height) * sine_arc_factor(PI * swing / length) - 2 * excess / (height * length))
    else:
        arm = 4 * length * F.sqrt(4 * swing * swing + length * length)
        corner = w * length * (PI - 2 * F.atan(length / (2 * swing))) - 4 * w * swing
        ratio = w * (arm + corner) / (4 * height * length * length)
    return F.when(~(length > 0), 1.0).when(~(swing > 0), flat).otherwise(clamp(ratio, 0.0, 1.0))


def mark_fraction(k: Column, bar: float, cap: float) -> Column:
    """Share of cells to mark for darkness ``k`` when a mark inks ``bar`` and two neighbours share ``cap``."""
    k = clamp(k, 0.0, bar)
    return (bar + cap - F.sqrt((bar + cap) * (bar + cap) - 4 * cap * k)) / (2 * cap)


def bayer_rank(x: Column, y: Column, bits: int) -> Column:
    """Rank of a cell in the ordered-dither matrix of side ``2**bits``."""
    out = F.lit(0)
    for b in range(bits):
        xb, yb = F.shiftright(x, b) % 2, F.shiftright(y, b) % 2
        out = out + (2 * ((xb + yb) % 2) + yb) * 4 ** (bits - 1 - b)
    return out.cast("int")


def reversed_bits(i: Column, bits: int) -> Column:
    out = F.lit(0)
    for b in range(bits):
        out = out + (F.shiftright(i, b) % 2) * 2 ** (bits - 1 - b)
    return out.cast("int")


def hilbert_index(side: int, x: Column, y: Column) -> Column:
    """Place of a cell along the Hilbert curve of ``side``, a power of two: one quadrant for each bit, each turned so
    that the curve goes on from the one before."""
    state = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    halves = F.array(*[F.lit(1 << b).cast("long") for b in reversed(range(side.bit_length() - 1))])

    def step(s: Column, half: Column) -> Column:
        right, low = s["x"].bitwiseAND(half) > 0, s["y"].bitwiseAND(half) > 0
        quadrant = F.when(right & low, 2).when(right, 3).when(low, 1).otherwise(0)
        mirrored = ~low & right
        nx, ny = F.when(mirrored, half - 1 - s["x"]).otherwise(s["x"]), F.when(mirrored, half - 1 - s["y"]).otherwise(s["y"])
        return F.struct(
            F.when(low, nx).otherwise(ny).alias("x"), F.when(low, ny).otherwise(nx).alias("y"), (s["d"] + half * half * quadrant).alias("d")
        )

    return F.aggregate(halves, state, step, lambda s: s["d"])
