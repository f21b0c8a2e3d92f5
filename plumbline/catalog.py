"""Registry of the queries over the reference's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import cells, contours, crosses, crosshatch, dithering, drawings, fields, hatching, maps, marks, parts, runs, splitting, strokes, tone, touring, wiggly
from plumbline.streaming import jobs

FLAGSHIP = "tone_bands_hatching"
MODULES = (tone, maps, fields, contours, dithering, cells, touring, splitting, crosses, strokes, hatching, crosshatch, runs, parts, wiggly, marks, drawings, jobs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, (_, text) in m.QUERIES.items() if text}
