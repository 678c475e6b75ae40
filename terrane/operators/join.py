"""Spatial joins and nearest neighbours.

A spatial join is an ordinary join on a spatial predicate, in SQL or here; the optimizer rule of ``SpatialJoins.java`` plans it.
A side whose estimated size is under ``SMALL`` becomes a tree of boxes that the tasks of a machine share, and the other side
looks its matches up, without a shuffle.  Otherwise the join becomes an equi-join on cells of a hierarchical grid:

Every geometry has a level: the smallest cell size (a power of four) not under the longer side of its box.  At its own level or
a coarser one it touches at most four cells.  A pair meets at the coarser of its two levels, in the cell of the lower left
corner of the boxes' intersection, hence once; so there are no duplicates to remove, no cell size to tune, and no giant that
covers thousands of cells.  The key also says which of the two is at home on the level, so that small geometries never meet
each other in the large cells where they look for giants.  Which levels a side lives on is a subquery of the same query.  Spark
shuffles this join, and splits skewed cells.  After it come the test of boxes, the caller's own condition, and the exact predicate.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import spatial as S
from terrane.functions.jvm import DEALT, bridge

PREDICATES = ("intersects", "contains", "within", "covers", "coveredby", "containsproperly", "overlaps", "crosses", "touches", "equals", "dwithin", "bbox")


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    left_geometry: str,
    right_geometry: str,
    predicate: str = "intersects",
    how: str = "inner",
    distance: float | Column | None = None,
    residual: Callable[[], Column] | Column | None = None,
    left_key: list[str] | None = None,
) -> DataFrame:
    """Pairs of rows whose geometries satisfy ``predicate`` (left to right, as in st_within(left, right)).

    ``how``: inner, left, left_semi or left_anti; all but inner need ``left_key``, columns that identify a row of ``left``,
    where ``right`` is no small table or there is a residual.  ``distance`` (for dwithin) is a number or a column of ``left``.
    ``residual`` is a further condition over both sides' columns.  ``left`` may be a stream; each of its batches is joined
    with ``right`` as it was when the query was made.  Columns that both sides have get the suffix ``_right`` on the right.
    Null and empty geometries match nothing.  st_disjoint is no join predicate: its matches do not touch.
    """
    if predicate not in PREDICATES:
        raise ValueError(f"no join predicate {predicate!r}; there are {', '.join(PREDICATES)}")
    if (predicate == "dwithin") != (distance is not None):
        raise ValueError("dwithin, and only it, takes a distance")
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no spatial join {how!r}")
    b = bridge(left.sparkSession)
    if how != "inner" and (residual is not None or not b.small(right)):
        return _outer(left, right, left_geometry, right_geometry, predicate, how, distance, residual, left_key)
    for c in right.columns:
        if c in left.columns:
            right = right.withColumnRenamed(c, f"{c}_right")
            right_geometry = f"{c}_right" if c == right_geometry else right_geometry
    reach = [] if distance is None else [distance if isinstance(distance, Column) else float(distance)]
    on = S.kernel("st_intersects_extent" if predicate == "bbox" else f"st_{predicate}", F.col(left_geometry), F.col(right_geometry), *reach)
    if residual is not None:
        on = on & (residual() if callable(residual) else residual)
    return left.join(right, on, how)


def _outer(left, right, left_geometry, right_geometry, predicate, how, distance, residual, left_key) -> DataFrame:
    if not left_key:
        raise ValueError(f"a {how} spatial join with a large table or a residual needs left_key")
    matched = spatial_join(left, right, left_geometry, right_geometry, predicate, "inner", distance, residual)
    if how != "left":
        return left.join(matched.select(*left_key), left_key, how)
    rest = matched.columns[len(left.columns) :]
    keys = [f"_k{i}" for i in range(len(left_key))]
    matched = matched.select(*(F.col(k).alias(n) for k, n in zip(left_key, keys)), *rest)
    on = [left[k].eqNullSafe(matched[n]) for k, n in zip(left_key, keys)]
    return left.join(matched, on, "left").drop(*keys)


def deal(df: DataFrame, column: str) -> DataFrame:
    """A small table (by the optimizer's estimate), which may lie in one row group, dealt over all cores; a large one as it is."""
    if df.isStreaming or bridge(df.sparkSession).estimate(df) > DEALT:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, column)


def knn_join(left: DataFrame, right: DataFrame, left_geometry: str, right_geometry: str, left_key: str, right_key: str, k: int, depth: int = 12, small: bool | None = None) -> DataFrame:
    """The k rows of ``right`` nearest to each row of ``left``: left_key, right_key, distance, rank (from 1).

    Exact; ties go to the smaller right_key.  Null and empty geometries have no neighbours and are none.

    Where ``right`` is small (by the optimizer's estimate of its size, unless the caller says), it becomes an index that the
    tasks of a machine share.  Otherwise rows of ``right`` are counted in a quadtree of ``depth`` levels; the smallest cell
    around a left row that holds k of them bounds the distance of its k-th neighbour, and a distance join with that bound
    finds all candidates, so that no side has to fit into memory.
    """
    if bridge(left.sparkSession).small(right) if small is None else small:
        return _indexed(left, right, left_geometry, right_geometry, left_key, right_key, k)
    return _quadtree(left, right, left_geometry, right_geometry, left_key, right_key, k, depth)


def _indexed(left, right, left_geometry, right_geometry, left_key, right_key, k) -> DataFrame:
    g = F.col(right_geometry).cast("binary")
    rows = right.where(g.isNotNull() & S.bounds(g).isNotNull()).select(F.struct(F.col(right_key).alias("k"), g.alias("g")).alias("r"))
    rows = rows.agg(F.array_sort(F.collect_list("r")).alias("r"))
    found = S.kernel("nearest", F.col(left_geometry), rows.scalar(), 1, k)
    left = deal(left.select(left_key, left_geometry), left_geometry)
    near = left.select(F.col(left_key), F.posexplode(found).alias("_at", "_n"))
    keys = rows.select(F.transform("r", lambda r: r["k"])).scalar()
    return near.select(left_key, F.element_at(keys, (F.col("_n")["idx"] + 1).cast("int")).alias(right_key), F.col("_n")["distance"].alias("distance"), (F.col("_at") + 1).alias("rank"))


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def _boxed(df: DataFrame, geometry: str, side: str) -> DataFrame:
    """Adds the box of the geometry; rows without a box go."""
    df = df.withColumn("_e", S.bounds(F.col(geometry))).where(F.col("_e").isNotNull())
    return df.withColumns({f"_{side}{n}": F.col("_e")[c] for n, c in (("x0", "xmin"), ("y0", "ymin"), ("x1", "xmax"), ("y1", "ymax"))}).drop("_e")


def _quadtree(left, right, left_geometry, right_geometry, left_key, right_key, k, depth) -> DataFrame:
    lg, rg = left.select(F.col(left_key).alias("_lk"), F.col(left_geometry).alias("_lg")), right.select(F.col(right_key).alias("_rk"), F.col(right_geometry).alias("_rg"))
    r = _boxed(rg, "_rg", "b")
    whole = r.agg(F.min("_bx0").alias("x0"), F.min("_by0").alias("y0"), F.max("_bx1").alias("x1"), F.max("_by1").alias("y1")).first()
    if whole["x0"] is None or k <= 0:
        return lg.join(rg.limit(0), F.lit(False)).select(F.col("_lk").alias(left_key), F.col("_rk").alias(right_key), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    top = math.ceil(math.log2(max(whole["x1"] - whole["x0"], whole["y1"] - whole["y0"], 2.0**-30))) + 1
    levels = F.array(*(F.lit(v) for v in range(top - depth, top + 1)))
    cx, cy = (F.col("_bx0") + F.col("_bx1")) / 2, (F.col("_by0") + F.col("_by1")) / 2
    half = F.sqrt(F.pow(F.col("_bx1") - F.col("_bx0"), 2) + F.pow(F.col("_by1") - F.col("_by0"), 2)) / 2
    cells = r.select(cx.alias("x"), cy.alias("y"), half.alias("half"), F.explode(levels).alias("_l"))
    cells = cells.groupBy("_l", _cell(F.col("x"), F.col("_l")).alias("_cx"), _cell(F.col("y"), F.col("_l")).alias("_cy")).agg(F.count("*").alias("n"), F.max("half").alias("half")).where(F.col("n") >= k)
    a = _boxed(lg, "_lg", "a")
    ax, ay = (F.col("_ax0") + F.col("_ax1")) / 2, (F.col("_ay0") + F.col("_ay1")) / 2
    own = F.sqrt(F.pow(F.col("_ax1") - F.col("_ax0"), 2) + F.pow(F.col("_ay1") - F.col("_ay0"), 2)) / 2
    looks = a.select("_lk", ax.alias("x"), ay.alias("y"), own.alias("own"), F.explode(levels).alias("_l"))
    looks = looks.withColumns({"_cx": _cell(F.col("x"), F.col("_l")), "_cy": _cell(F.col("y"), F.col("_l"))})
    bound = F.col("own") + F.col("half") + F.pow(F.lit(2.0), F.col("_l")) * math.sqrt(2)
    near = looks.join(cells, ["_l", "_cx", "_cy"]).groupBy("_lk").agg(F.min(bound).alias("_near"))
    far = F.sqrt(F.pow(F.greatest(F.abs(F.col("_ax1") - whole["x0"]), F.abs(F.lit(whole["x1"]) - F.col("_ax0"))), 2) + F.pow(F.greatest(F.abs(F.col("_ay1") - whole["y0"]), F.abs(F.lit(whole["y1"]) - F.col("_ay0"))), 2))
    reach = a.select("_lk", "_lg", far.alias("_far")).join(near.withColumnRenamed("_lk", "_nk"), F.col("_lk") == F.col("_nk"), "left")
    reach = reach.select("_lk", "_lg", (F.coalesce("_near", "_far") * (1 + 1e-9)).alias("_reach"))
    pairs = spatial_join(reach, rg, "_lg", "_rg", "dwithin", distance=F.col("_reach"))
    pairs = pairs.select("_lk", "_rk", S.st_distance(F.col("_lg"), F.col("_rg")).alias("distance"))
    w = Window.partitionBy("_lk").orderBy("distance", "_rk")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("_lk").alias(left_key), F.col("_rk").alias(right_key), "distance", "rank")
