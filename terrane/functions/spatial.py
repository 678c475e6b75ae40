"""The st_* functions as Column functions, and their names in SQL.

Geometry columns are EWKB in ``binary``.  Every function answers null where an argument is null (st_knn: an empty array for
a null query); arguments of the wrong geometry type, indices out of range and malformed input raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from terrane.functions.jvm import bridge

#: name → (kinds of the arguments, kind of the result); the letters are in Build.java
SIGNATURES: dict[str, tuple[str, str]] = {
    # text, bytes and nested arrays
    "st_geomfromtext": ("s", "g"), "st_geomfromwkb": ("g", "g"), "st_geomfromgeojson": ("s", "g"), "st_astext": ("g", "s"), "st_asewkt": ("g", "s"),
    "st_geomfromchpoint": ("p", "g"), "st_geomfromchlinestring": ("l", "g"), "st_geomfromchpolygon": ("r", "g"),
    "st_geomfromchmultilinestring": ("r", "g"), "st_geomfromchmultipolygon": ("m", "g"),
    # accessors and measures
    "st_x": ("g", "d"), "st_y": ("g", "d"), "st_z": ("g", "d"), "st_srid": ("g", "i"), "st_npoints": ("g", "i"), "st_numpoints": ("g", "i"),
    "st_numgeometries": ("g", "i"), "st_numinteriorrings": ("g", "i"), "st_nrings": ("g", "i"), "st_dimension": ("g", "i"), "st_geometrytype": ("g", "s"),
    "st_area": ("g", "d"), "st_length": ("g", "d"), "st_perimeter": ("g", "d"), "st_centroid": ("g", "g"), "st_interiorpoint": ("g", "g"),
    "st_isvalid": ("g", "b"), "st_isvalidreason": ("g", "s"), "st_isempty": ("g", "b"), "st_issimple": ("g", "b"), "st_isring": ("g", "b"),
    "st_distance": ("gg", "d"), "st_hausdorffdistance": ("gg", "d"), "st_hausdorffdistance_densify": ("ggd", "d"),
    "st_frechetdistance": ("gg", "d"), "st_frechetdistance_densify": ("ggd", "d"),
    # constructors, editors and derived geometries
    "st_makepoint": ("dd", "g"), "st_makepoint3d": ("ddd", "g"), "st_makeline": ("gg", "g"), "st_makepolygon": ("g", "g"), "st_makebox2d": ("gg", "g"),
    "st_envelope": ("g", "g"), "st_extent": ("g", "g"), "st_expand": ("gd", "g"), "st_collect": ("gg", "g"), "st_startpoint": ("g", "g"),
    "st_endpoint": ("g", "g"), "st_pointn": ("gi", "g"), "st_geometryn": ("gi", "g"), "st_exteriorring": ("g", "g"), "st_interiorringn": ("gi", "g"),
    "st_addpoint": ("ggi", "g"), "st_removepoint": ("gi", "g"), "st_setpoint": ("gig", "g"), "st_reverse": ("g", "g"), "st_normalize": ("g", "g"),
    "st_boundary": ("g", "g"), "st_convexhull": ("g", "g"), "st_minimumboundingcircle": ("g", "g"), "st_closestpoint": ("gg", "g"),
    "st_shortestline": ("gg", "g"), "st_snap": ("ggd", "g"), "st_sharedpaths": ("gg", "g"), "st_offsetcurve": ("gd", "g"), "st_linmerge": ("g", "g"),
    "st_polygonize": ("g", "g"), "st_node": ("g", "g"), "st_delaunaytriangles": ("gdi", "g"), "st_voronoidiagram": ("gdi", "g"), "st_symdifference": ("gg", "g"),
    # predicates and relations
    "st_intersects": ("gg", "b"), "st_contains": ("gg", "b"), "st_within": ("gg", "b"), "st_covers": ("gg", "b"), "st_coveredby": ("gg", "b"),
    "st_containsproperly": ("gg", "b"), "st_overlaps": ("gg", "b"), "st_crosses": ("gg", "b"), "st_touches": ("gg", "b"), "st_disjoint": ("gg", "b"),
    "st_equals": ("gg", "b"), "st_dwithin": ("ggd", "b"), "st_intersects_extent": ("gg", "b"), "st_relate": ("gg", "s"), "st_relate_pattern": ("ggs", "b"),
    # processing, overlay and transforms
    "st_buffer": ("gd", "g"), "st_buffer_params": ("gds", "g"), "st_simplify": ("gd", "g"), "st_segmentize": ("gd", "g"), "st_subdivide": ("gi", "g"),
    "st_makevalid": ("g", "g"), "st_union": ("gg", "g"), "st_intersection": ("gg", "g"), "st_difference": ("gg", "g"), "st_unaryunion": ("g", "g"),
    "st_clusterintersecting": ("g", "g"), "st_translate": ("gdd", "g"), "st_scale": ("gdd", "g"), "st_setsrid": ("gi", "g"),
    "st_transform": ("gi", "g"), "st_transform_proj": ("gs", "g"),
    # nearest neighbours and diagnostics
    "st_knn": ("gai", "k"), "geos_log_test": ("is", "i"), "geos_test_exception": ("s", "i"),
    "geos_bench_wkb_parse": ("w", "b"), "geos_bench_envelope": ("g", "b"),
}
VERSION = "3.12.0"

_INTERNAL = {"bounds": ("g", "e"), "st_makebox": ("dddd", "g"), "collect_array": ("a", "g"), "makeline_array": ("a", "g"), "stored": ("swwd", "b"), "nearest": ("gnii", "k")}


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def kernel(name: str, *args, alias: str | None = None) -> Column:
    """Column of a kernel; plain values become literals (column names are not looked up: pass columns)."""
    kinds, out = SIGNATURES.get(name) or _INTERNAL[name]
    if len(args) != len(kinds):
        raise TypeError(f"{name} takes {len(kinds)} arguments, not {len(args)}")
    return bridge().column(name, kinds, out, [_column(a) for a in args], alias)


def _function(name: str):
    def call(*args) -> Column:
        return kernel(name, *args, alias=name)

    call.__name__ = call.__qualname__ = name
    call.__doc__ = f"{name}({', '.join(SIGNATURES[name][0])}) over columns or plain values."
    return call


globals().update({name: _function(name) for name in SIGNATURES if name != "st_knn"})


def st_knn(query, candidates, k) -> Column:
    """The k candidates nearest to the query as an array of (idx from 0, distance), by distance and then by index.

    Empty candidates are skipped; a null query gives an empty array.
    """
    found = kernel("st_knn", query, candidates, k)
    return F.when(_column(query).isNull(), F.array().cast("array<struct<idx:bigint,distance:double>>")).otherwise(found).alias("st_knn")


def geos_version() -> Column:
    """Version of the geometry semantics."""
    return F.lit(VERSION).alias("geos_version")


def geos_bench_noop(*_) -> Column:
    """True, whatever the arguments: measures what a call costs."""
    return F.lit(True).alias("geos_bench_noop")


geos_bench_noop_rb = geos_bench_noop


def geos_bench_intersects_nobbox(a, b) -> Column:
    """st_intersects without a test of boxes before it."""
    return kernel("st_intersects", a, b).alias("geos_bench_intersects_nobbox")


def bounds(geometry) -> Column:
    """(xmin, ymin, xmax, ymax); null for a null or empty geometry."""
    return kernel("bounds", geometry)


def box(xmin, ymin, xmax, ymax) -> Column:
    return kernel("st_makebox", xmin, ymin, xmax, ymax)


# ---- aggregates


def st_collect_agg(geometry) -> Column:
    """GEOMETRYCOLLECTION of a group, not dissolved; nulls are skipped, an empty group gives an empty collection."""
    return kernel("collect_array", F.collect_list(geometry), alias="st_collect_agg")


def st_union_agg(geometry) -> Column:
    """Dissolved union of a group, merged before and after the shuffle; invalid polygons raise an error."""
    return bridge().merge(False, _column(geometry)).alias("st_union_agg")


def st_convexhull_agg(geometry) -> Column:
    """Convex hull of a group, merged before and after the shuffle."""
    return bridge().merge(True, _column(geometry)).alias("st_convexhull_agg")


def st_extent_agg(geometry) -> Column:
    """Bounding box of a group: four minima and maxima, combined before the shuffle."""
    e = bounds(geometry)
    return kernel("st_makebox", F.min(e["xmin"]), F.min(e["ymin"]), F.max(e["xmax"]), F.max(e["ymax"]), alias="st_extent_agg")


def st_makeline_agg(geometry, order=None) -> Column:
    """LINESTRING of all vertices of a group in the order of ``order`` (without it, in the order of arrival, which Spark
    fixes only within one partition)."""
    if order is None:
        return kernel("makeline_array", F.collect_list(geometry), alias="st_makeline_agg")
    sorted_ = F.array_sort(F.collect_list(F.struct(_column(order).alias("o"), _column(geometry).alias("g"))))
    return kernel("makeline_array", F.transform(sorted_, lambda s: s["g"]), alias="st_makeline_agg")


AGGREGATES = {"st_collect_agg": "collect_array", "st_makeline_agg": "makeline_array"}
MERGED = {"st_union_agg": False, "st_convexhull_agg": True}


# ---- SQL names


class _Builder:
    """A Scala function from argument expressions to an expression, called while a query is analysed."""

    def __init__(self, make, n: int | None, name: str):
        self.make, self.n, self.name = make, n, name

    def apply(self, children):
        args = [children.apply(i) for i in range(children.size())]
        if self.n is not None and len(args) != self.n:
            raise ValueError(f"{self.name} takes {self.n} arguments, not {len(args)}")
        return self.make(args)

    class Java:
        implements = ["scala.Function1"]


def register(spark: SparkSession) -> list[str]:
    """Register all functions and aggregates under their SQL names for this session; gives the names.

    Joins on spatial predicates in SQL text are then planned like :func:`terrane.operators.spatial_join`.
    Spark's own functions of the same names (st_geomfromwkb, st_srid, st_setsrid) are hidden by them in this session.
    """
    from pyspark.java_gateway import ensure_callback_server_started

    b, gateway = bridge(spark), spark.sparkContext._gateway
    ensure_callback_server_started(gateway)
    registry = spark._jsparkSession.sessionState().functionRegistry()
    held = spark.sparkContext._terrane_builders = getattr(spark.sparkContext, "_terrane_builders", [])

    def put(name, make, n=None):
        builder = _Builder(make, n, name)
        held.append(builder)
        registry.createOrReplaceTempFunction(name, builder, "scala_udf")

    for name, (kinds, out) in SIGNATURES.items():
        put(name, lambda args, name=name, kinds=kinds, out=out: b.call(name, kinds, out, args), len(kinds))
    jvm = spark.sparkContext._jvm
    exprs = jvm.org.apache.spark.sql.catalyst.expressions

    def knn(args):
        nothing = b.build.cast(exprs.CreateArray(b.seq([]), False), "k")
        return exprs.If(exprs.IsNull(args[0]), nothing, b.call("st_knn", *SIGNATURES["st_knn"], args))

    put("st_knn", knn, 3)
    aggregate = jvm.org.apache.spark.sql.catalyst.expressions.aggregate

    def collected(args, kernel):
        return b.call(kernel, "a", "g", [aggregate.CollectList(args[0]).toAggregateExpression()])

    for name, kernel_name in AGGREGATES.items():
        put(name, lambda args, kernel_name=kernel_name: collected(args, kernel_name), 1)

    for name, hull in MERGED.items():
        spark._jsparkSession.udf().register(name, b.merger(hull))

    def extent(args):
        field = jvm.org.apache.spark.sql.catalyst.expressions.GetStructField
        e = b.call("bounds", "g", "e", [args[0]])
        pick = lambda i, f: f(field(e, i, jvm.scala.Option.empty())).toAggregateExpression()
        sides = [pick(0, aggregate.Min), pick(1, aggregate.Min), pick(2, aggregate.Max), pick(3, aggregate.Max)]
        return b.call("st_makebox", "dddd", "g", sides)

    put("st_extent_agg", extent, 1)
    literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal
    put("geos_version", lambda args: literal.create(VERSION, b.build.type("s")), 0)
    put("geos_bench_noop", lambda args: literal.create(True, b.build.type("b")))
    put("geos_bench_noop_rb", lambda args: literal.create(True, b.build.type("b")))
    put("geos_bench_intersects_nobbox", lambda args: b.call("st_intersects", "gg", "b", args), 2)
    return [*SIGNATURES, *AGGREGATES, *MERGED, "st_extent_agg", "geos_version", "geos_bench_noop", "geos_bench_noop_rb", "geos_bench_intersects_nobbox"]
