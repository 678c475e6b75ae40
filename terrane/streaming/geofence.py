"""Streams of points against tables of geometries.

All st_* functions work on streams unchanged, since they keep no state.  A stream joins a table by the same cells as a batch
does, and time windows count what enters each geometry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import spatial_join


def matches(stream: DataFrame, fences: DataFrame, point: str, boundary: str, predicate: str = "within", distance: float | None = None) -> DataFrame:
    """The stream's points with the fences that each satisfies ``predicate`` with, as they come."""
    return spatial_join(stream, fences, point, boundary, predicate, distance=distance)


def visits(stream: DataFrame, fences: DataFrame, point: str, boundary: str, time: str, key: str, window: str = "10 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window, key, visits): points within each fence in event-time windows; points later than ``late`` are left out."""
    found = matches(stream.withWatermark(time, late), fences, point, boundary)
    return found.groupBy(F.window(time, window, slide or window), key).agg(F.count("*").alias("visits"))
