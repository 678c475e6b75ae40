"""Geometry tables on Parquet with data skipping by bounding boxes.

Tables carry the box of their geometry in four plain columns and lie in Z-order of its centre, so that files, row groups and
pages hold few places each.  A constant predicate is preceded by comparisons of these columns, which Spark pushes into the
scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import spatial as S
from terrane.functions.jvm import bridge

BOX = ("xmin", "ymin", "xmax", "ymax")
#: Predicates that need the boxes to meet; st_disjoint is not among them.
PRUNING = ("intersects", "contains", "within", "covers", "coveredby", "containsproperly", "overlaps", "crosses", "touches", "equals", "dwithin")


def with_bbox(df: DataFrame, geometry: str) -> DataFrame:
    """Adds xmin, ymin, xmax and ymax (null for null and empty geometries)."""
    df = df.withColumn("_e", S.bounds(F.col(geometry)))
    return df.withColumns({c: F.col("_e")[c] for c in BOX}).drop("_e")


def _spread(v: Column) -> Column:
    """The low 16 bits of an integer, with a zero bit after each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def z_order(x: Column, y: Column, extent: tuple[float, float, float, float]) -> Column:
    """Place on the Z curve over ``extent`` in 65,536 steps a side; null coordinates come first."""
    scale = lambda v, lo, hi: F.greatest(F.least(F.floor((v - lo) / (max(hi - lo, 1e-300)) * 65535), F.lit(65535)), F.lit(0)).cast("long")
    return _spread(scale(x, extent[0], extent[2])).bitwiseOR(F.shiftleft(_spread(scale(y, extent[1], extent[3])), 1))


def write_geo(df: DataFrame, path: str, geometry: str, mode: str = "error", files: int | None = None) -> None:
    """Write ``df`` with its boxes, in Z-order over its extent."""
    df = with_bbox(df, geometry)
    e = df.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    extent = tuple(v if v is not None else 0.0 for v in e)
    df = df.withColumn("_z", z_order((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2, extent))
    df = df.repartitionByRange(files, "_z") if files else df.repartitionByRange("_z")
    df.sortWithinPartitions("_z").drop("_z").write.mode(mode).parquet(path)


def read_geo(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def near_box(xmin: float, ymin: float, xmax: float, ymax: float, distance: float = 0.0) -> Column:
    """Condition on the four columns: the box comes within ``distance`` (per axis) of this one."""
    return (F.col("xmin") <= xmax + distance) & (F.col("xmax") >= xmin - distance) & (F.col("ymin") <= ymax + distance) & (F.col("ymax") >= ymin - distance)


def where_spatial(df: DataFrame, predicate: str, geometry: str, constant: str | DataFrame, distance: float | None = None) -> DataFrame:
    """Rows whose geometry satisfies ``predicate`` with a constant: WKT, or a table of one row and one geometry column.

    WKT is evaluated once, here, into bytes, and its box prunes where ``df`` has box columns.  A table is evaluated when the
    query runs; without a row, or with a null, nothing satisfies it.  Large constants are parsed and prepared once a task.
    """
    if predicate not in PRUNING:
        raise ValueError(f"{predicate!r} does not prune; use the function")
    if isinstance(constant, DataFrame):
        return df.where(S.kernel("stored", predicate, F.col(geometry), constant.scalar(), float(distance or 0.0)))
    build = bridge(df.sparkSession).build
    box = build.box(constant)
    if box is None:
        return df.where(F.lit(False))
    if set(BOX) <= set(df.columns):
        df = df.where(near_box(*map(float, box.split()), distance or 0.0))
    return df.where(S.kernel("stored", predicate, F.col(geometry), F.lit(bytes(build.geometry(constant))), float(distance or 0.0)))
