"""Every spatial function over the driver's tables, beside closed forms in SQL.

Boxes and points have integer or dyadic coordinates, so measures are exact.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import spatial as S
from terrane.operators import spatial_join
from terrane.plans.trips import BUILDING_SQL, TRIP_SQL, ZONE_SQL, building, trip, zone

c = F.col
_PART_SQL = "WITH p AS (SELECT p_partkey AS k, ((p_partkey * 3571) % 6361)::INT AS x, ((p_partkey * 15485863) % 6353)::INT AS y, (1 + p_partkey % 8)::INT AS w, (1 + p_partkey % 5)::INT AS h FROM part) "


def _parts(spark, sf_dir):
    """k, x, y, w, h; b: box of w x h at (x, y); s: that box moved by (1, 1); o: box with a square hole; l: line of 3 vertices."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey AS k",
        "cast((p_partkey * 3571) % 6361 AS int) AS x",
        "cast((p_partkey * 15485863) % 6353 AS int) AS y",
        "cast(1 + p_partkey % 8 AS int) AS w",
        "cast(1 + p_partkey % 5 AS int) AS h",
    )
    x, y, w, h = c("x"), c("y"), c("w"), c("h")
    text = lambda *parts: F.concat(*(F.lit(t) if isinstance(t, str) else t.cast("string") for t in parts))
    hole = S.st_geomfromtext(text("POLYGON ((", x, " ", y, ", ", x + 10, " ", y, ", ", x + 10, " ", y + 10, ", ", x, " ", y + 10, ", ", x, " ", y, "), (", x + 2, " ", y + 2, ", ", x + 4, " ", y + 2, ", ", x + 4, " ", y + 4, ", ", x + 2, " ", y + 4, ", ", x + 2, " ", y + 2, "))"))
    line = S.st_geomfromtext(text("LINESTRING (", x, " ", y, ", ", x + w, " ", y, ", ", x + w, " ", y + h, ")"))
    return p.withColumns({"b": S.box(x, y, x + w, y + h), "s": S.box(x + 1, y + 1, x + w + 1, y + h + 1), "o": hole, "l": line, "p": S.st_makepoint(x, y)})


def _xy(g):
    return [S.st_x(g), S.st_y(g)]


def fn_io(spark, sf_dir):
    p = _parts(spark, sf_dir)
    point = F.concat(F.lit("POINT ("), c("x"), F.lit(" "), c("y"), F.lit(")"))
    xy = lambda dx, dy: F.struct((c("x") + dx).cast("double").alias("x"), (c("y") + dy).cast("double").alias("y"))
    ring = lambda d: F.array(xy(d, d), xy(d + 1, d), xy(d + 1, d + 1), xy(d, d + 1), xy(d, d))
    return p.select(
        "k",
        S.st_astext(S.st_geomfromtext(point)).alias("text"),
        S.st_asewkt(S.st_setsrid(c("p"), 4326)).alias("ewkt"),
        S.st_srid(S.st_geomfromtext(F.concat(F.lit("SRID=32;"), point))).alias("srid"),
        S.st_astext(S.st_geomfromwkb(c("p"))).alias("wkb"),
        S.st_astext(S.st_geomfromgeojson(F.concat(F.lit('{"type":"Point","coordinates":['), c("x"), F.lit(","), c("y"), F.lit("]}")))).alias("json"),
        S.st_astext(S.st_geomfromchpoint(xy(0, 0))).alias("native_point"),
        S.st_length(S.st_geomfromchlinestring(F.array(xy(0, 0), xy(3, 4)))).alias("native_line"),
        S.st_area(S.st_geomfromchpolygon(F.array(ring(0)))).alias("native_polygon"),
        S.st_numgeometries(S.st_geomfromchmultilinestring(F.array(ring(0), ring(5)))).alias("native_lines"),
        S.st_area(S.st_geomfromchmultipolygon(F.array(F.array(ring(0)), F.array(ring(5))))).alias("native_polygons"),
        S.geos_version().like("3.%").alias("version"),
    )


_IO_SQL = _PART_SQL + """SELECT k, 'POINT (' || x || ' ' || y || ')' AS text, 'SRID=4326;POINT (' || x || ' ' || y || ')' AS ewkt, 32::INT AS srid,
'POINT (' || x || ' ' || y || ')' AS wkb, 'POINT (' || x || ' ' || y || ')' AS json, 'POINT (' || x || ' ' || y || ')' AS native_point,
5.0::DOUBLE AS native_line, 1.0::DOUBLE AS native_polygon, 2::INT AS native_lines, 2.0::DOUBLE AS native_polygons, true AS version FROM p"""


def fn_accessors(spark, sf_dir):
    b, o, line = c("b"), c("o"), c("l")
    return _parts(spark, sf_dir).select(
        "k", S.st_x(c("p")).alias("x"), S.st_y(c("p")).alias("y"), S.st_z(S.st_makepoint3d(c("x"), c("y"), c("w"))).alias("z"), S.st_srid(b).alias("srid"),
        S.st_npoints(o).alias("npoints"), S.st_numpoints(line).alias("numpoints"), S.st_numgeometries(b).alias("numgeometries"), S.st_numinteriorrings(o).alias("holes"),
        S.st_nrings(o).alias("rings"), S.st_dimension(line).alias("dimension"), S.st_geometrytype(b).alias("type"), S.st_area(o).alias("area"), S.st_length(line).alias("length"),
        S.st_perimeter(b).alias("perimeter"), S.st_x(S.st_centroid(b)).alias("cx"), S.st_y(S.st_centroid(b)).alias("cy"), S.st_within(S.st_interiorpoint(o), o).alias("inside"),
        S.st_isvalid(b).alias("valid"), S.st_isvalidreason(b).alias("reason"), S.st_isempty(b).alias("empty"), S.st_issimple(line).alias("simple"),
        S.st_isring(S.st_exteriorring(b)).alias("ring"), S.st_isring(b).alias("no_ring"),
    )


_ACCESSORS_SQL = _PART_SQL + """SELECT k, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS z, 0::INT AS srid, 10::INT AS npoints, 3::INT AS numpoints, 1::INT AS numgeometries, 1::INT AS holes,
2::INT AS rings, 1::INT AS dimension, 'ST_Polygon' AS type, 96.0::DOUBLE AS area, (w + h)::DOUBLE AS length, (2 * (w + h))::DOUBLE AS perimeter,
x + w / 2.0::DOUBLE AS cx, y + h / 2.0::DOUBLE AS cy, true AS inside, true AS valid, 'Valid Geometry' AS reason, false AS empty, true AS simple, true AS ring, false AS no_ring FROM p"""


def fn_distances(spark, sf_dir):
    low = S.st_makeline(c("p"), S.st_makepoint(c("x") + c("w"), c("y")))
    high = S.st_makeline(S.st_makepoint(c("x"), c("y") + c("h")), S.st_makepoint(c("x") + c("w"), c("y") + c("h")))
    away = S.st_makepoint(c("x") + c("w") + 3, c("y") + c("h") + 4)
    return _parts(spark, sf_dir).select(
        "k", S.st_distance(c("b"), away).alias("distance"), S.st_distance(c("b"), c("p")).alias("none"), S.st_hausdorffdistance(low, high).alias("hausdorff"),
        S.st_hausdorffdistance_densify(low, high, 0.5).alias("hausdorff_densify"), S.st_frechetdistance(low, high).alias("frechet"),
        S.st_frechetdistance_densify(low, high, 0.5).alias("frechet_densify"), S.st_dwithin(c("b"), away, 5.0).alias("near"), S.st_dwithin(c("b"), away, 4.9).alias("far"),
        S.st_length(S.st_shortestline(c("b"), away)).alias("shortest"), S.st_x(S.st_closestpoint(c("b"), away)).alias("closest_x"),
    )


_DISTANCES_SQL = _PART_SQL + """SELECT k, 5.0::DOUBLE AS distance, 0.0::DOUBLE AS none, h::DOUBLE AS hausdorff, h::DOUBLE AS hausdorff_densify, h::DOUBLE AS frechet, h::DOUBLE AS frechet_densify,
true AS near, false AS far, 5.0::DOUBLE AS shortest, (x + w)::DOUBLE AS closest_x FROM p"""


def fn_constructors(spark, sf_dir):
    b, o, line, p = c("b"), c("o"), c("l"), c("p")
    far = S.st_makepoint(c("x") + 20, c("y"))
    text = lambda g: S.st_astext(g)
    cross = S.st_collect(S.st_makeline(p, S.st_makepoint(c("x") + 2, c("y") + 2)), S.st_makeline(S.st_makepoint(c("x"), c("y") + 2), S.st_makepoint(c("x") + 2, c("y"))))
    return _parts(spark, sf_dir).select(
        "k", text(S.st_makeline(p, far)).alias("makeline"), S.st_area(S.st_makepolygon(S.st_exteriorring(o))).alias("makepolygon"),
        S.st_area(S.st_makebox2d(p, S.st_makepoint(c("x") + c("w"), c("y") + c("h")))).alias("makebox2d"), text(S.st_envelope(line)).alias("envelope"),
        S.st_area(S.st_extent(line)).alias("extent"), S.st_area(S.st_expand(b, 1.0)).alias("expand"), S.st_numgeometries(S.st_collect(b, p)).alias("collect"),
        text(S.st_startpoint(line)).alias("startpoint"), text(S.st_endpoint(line)).alias("endpoint"), text(S.st_pointn(line, 2)).alias("pointn"),
        text(S.st_geometryn(S.st_collect(b, p), 2)).alias("geometryn"), S.st_length(S.st_exteriorring(o)).alias("exteriorring"), S.st_length(S.st_interiorringn(o, 1)).alias("interiorringn"),
        text(S.st_addpoint(line, far, -1)).alias("addpoint"), text(S.st_removepoint(line, 1)).alias("removepoint"), text(S.st_setpoint(line, 0, far)).alias("setpoint"),
        text(S.st_startpoint(S.st_reverse(line))).alias("reverse"), S.st_equals(S.st_normalize(b), b).alias("normalize"), S.st_length(S.st_boundary(o)).alias("boundary"),
        S.st_area(S.st_convexhull(line)).alias("convexhull"), S.st_covers(S.st_expand(S.st_minimumboundingcircle(b), 0.001), b).alias("circle"),
        text(S.st_snap(p, S.st_makepoint(c("x") + 0.25, c("y")), 0.5)).alias("snap"), S.st_length(S.st_geometryn(S.st_sharedpaths(line, S.st_reverse(line)), 2)).alias("sharedpaths"),
        S.st_length(S.st_offsetcurve(S.st_makeline(p, far), 1.0)).alias("offsetcurve"), S.st_numgeometries(S.st_linmerge(S.st_collect(S.st_makeline(p, far), line))).alias("linmerge"),
        S.st_area(S.st_polygonize(S.st_boundary(b))).alias("polygonize"), S.st_numgeometries(S.st_node(cross)).alias("node"), S.st_area(S.st_delaunaytriangles(b, 0.0, 0)).alias("delaunay"),
        S.st_numgeometries(S.st_delaunaytriangles(b, 0.0, 1)).alias("delaunay_edges"), S.st_numgeometries(S.st_voronoidiagram(b, 0.0, 0)).alias("voronoi"),
    )


_CONSTRUCTORS_SQL = _PART_SQL + """SELECT k, 'LINESTRING (' || x || ' ' || y || ', ' || (x + 20) || ' ' || y || ')' AS makeline, 100.0::DOUBLE AS makepolygon, (w * h)::DOUBLE AS makebox2d,
'POLYGON ((' || x || ' ' || y || ', ' || (x + w) || ' ' || y || ', ' || (x + w) || ' ' || (y + h) || ', ' || x || ' ' || (y + h) || ', ' || x || ' ' || y || '))' AS envelope,
(w * h)::DOUBLE AS extent, ((w + 2) * (h + 2))::DOUBLE AS expand, 2::INT AS collect, 'POINT (' || x || ' ' || y || ')' AS startpoint,
'POINT (' || (x + w) || ' ' || (y + h) || ')' AS endpoint, 'POINT (' || (x + w) || ' ' || y || ')' AS pointn, 'POINT (' || x || ' ' || y || ')' AS geometryn,
40.0::DOUBLE AS exteriorring, 8.0::DOUBLE AS interiorringn,
'LINESTRING (' || x || ' ' || y || ', ' || (x + w) || ' ' || y || ', ' || (x + w) || ' ' || (y + h) || ', ' || (x + 20) || ' ' || y || ')' AS addpoint,
'LINESTRING (' || x || ' ' || y || ', ' || (x + w) || ' ' || (y + h) || ')' AS removepoint,
'LINESTRING (' || (x + 20) || ' ' || y || ', ' || (x + w) || ' ' || y || ', ' || (x + w) || ' ' || (y + h) || ')' AS setpoint,
'POINT (' || (x + w) || ' ' || (y + h) || ')' AS reverse, true AS normalize, 48.0::DOUBLE AS boundary, w * h / 2.0::DOUBLE AS convexhull, true AS circle,
'POINT (' || x || '.25 ' || y || ')' AS snap, (w + h)::DOUBLE AS sharedpaths, 20.0::DOUBLE AS offsetcurve, 1::INT AS linmerge, (w * h)::DOUBLE AS polygonize,
4::INT AS node, (w * h)::DOUBLE AS delaunay, 5::INT AS delaunay_edges, 4::INT AS voronoi FROM p"""


def fn_predicates(spark, sf_dir):
    b, s, p, o = c("b"), c("s"), c("p"), c("o")
    beside = S.box(c("x") + c("w"), c("y"), c("x") + c("w") + 1, c("y") + c("h"))
    inner = S.box(c("x") + 0.25, c("y") + 0.25, c("x") + 0.5, c("y") + 0.5)
    across = S.st_makeline(S.st_makepoint(c("x") - 1, c("y") + 0.5), S.st_makepoint(c("x") + c("w") + 1, c("y") + 0.5))
    return _parts(spark, sf_dir).select(
        "k", S.st_intersects(b, s).alias("intersects"), S.st_intersects(b, p).alias("intersects_corner"), S.st_contains(b, p).alias("contains_corner"), S.st_contains(b, inner).alias("contains"),
        S.st_within(inner, b).alias("within"), S.st_within(p, b).alias("within_corner"), S.st_covers(b, p).alias("covers_corner"), S.st_coveredby(p, b).alias("coveredby_corner"),
        S.st_containsproperly(b, inner).alias("properly"), S.st_containsproperly(b, b).alias("properly_self"), S.st_overlaps(b, s).alias("overlaps"), S.st_crosses(across, b).alias("crosses"),
        S.st_touches(b, beside).alias("touches"), S.st_disjoint(b, S.st_translate(b, 100.0, 0.0)).alias("disjoint"), S.st_equals(b, S.st_reverse(b)).alias("equals"), S.st_equals(b, s).alias("equals_moved"),
        S.st_intersects_extent(o, inner).alias("extent"), S.st_intersects_extent(b, S.st_translate(b, 100.0, 0.0)).alias("extent_far"), S.st_relate(p, p).alias("relate"),
        S.st_relate_pattern(b, inner, "T*****FF*").alias("pattern"), S.geos_bench_intersects_nobbox(b, s).alias("nobbox"), S.geos_bench_wkb_parse(b).alias("parse"),
        S.geos_bench_envelope(b).alias("has_envelope"), S.geos_bench_noop(b).alias("noop"),
    )


_PREDICATES_SQL = _PART_SQL + """SELECT k, true AS intersects, true AS intersects_corner, false AS contains_corner, true AS contains, true AS within, false AS within_corner,
true AS covers_corner, true AS coveredby_corner, true AS properly, false AS properly_self, w > 1 AND h > 1 AS overlaps, true AS crosses, true AS touches, true AS disjoint,
true AS equals, false AS equals_moved, true AS extent, false AS extent_far, '0FFFFFFF2' AS relate, true AS pattern, true AS nobbox, true AS parse, true AS has_envelope, true AS noop FROM p"""


def fn_overlay(spark, sf_dir):
    b, s = c("b"), c("s")
    area = lambda g: F.round(S.st_area(g), 6)
    return _parts(spark, sf_dir).select(
        "k", area(S.st_union(b, s)).alias("union"), area(S.st_intersection(b, s)).alias("intersection"), area(S.st_difference(b, s)).alias("difference"),
        area(S.st_symdifference(b, s)).alias("symdifference"), area(S.st_unaryunion(S.st_collect(b, s))).alias("unaryunion"), area(S.st_collect(b, s)).alias("collected"),
        S.st_numgeometries(S.st_clusterintersecting(S.st_collect(b, s))).alias("one_cluster"), S.st_numgeometries(S.st_clusterintersecting(S.st_collect(b, S.st_translate(b, 100.0, 0.0)))).alias("two_clusters"),
    )


_OVERLAY_SQL = _PART_SQL + """, a AS (SELECT k, w * h AS one, (w - 1) * (h - 1) AS lap FROM p)
SELECT k, (2 * one - lap)::DOUBLE AS "union", lap::DOUBLE AS intersection, (one - lap)::DOUBLE AS difference, (2 * (one - lap))::DOUBLE AS symdifference,
(2 * one - lap)::DOUBLE AS unaryunion, (2 * one)::DOUBLE AS collected, 1::INT AS one_cluster, 2::INT AS two_clusters FROM a"""


def fn_processing(spark, sf_dir):
    b, line = c("b"), c("l")
    return _parts(spark, sf_dir).select(
        "k", F.round(S.st_area(S.st_buffer(c("p"), 1.0)), 4).alias("buffer"), F.round(S.st_area(S.st_buffer_params(b, 1.0, "join=mitre endcap=square quad_segs=4")), 6).alias("mitred"),
        S.st_npoints(S.st_segmentize(S.st_makeline(c("p"), S.st_makepoint(c("x") + 8, c("y"))), 1.0)).alias("segmentize"),
        S.st_npoints(S.st_simplify(S.st_segmentize(b, 0.5), 0.1)).alias("simplify"), F.round(S.st_area(S.st_subdivide(S.st_segmentize(b, 0.5), 8)), 6).alias("subdivide"),
        S.st_numgeometries(S.st_subdivide(b, 5)).alias("whole"),
        S.st_isvalid(S.st_makevalid(S.st_geomfromtext("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))"))).alias("makevalid"), S.st_astext(S.st_translate(c("p"), 3.0, 4.0)).alias("translate"),
        S.st_astext(S.st_scale(c("p"), 2.0, 3.0)).alias("scale"), S.st_srid(S.st_setsrid(line, 3857)).alias("setsrid"),
    )


_PROCESSING_SQL = _PART_SQL + """SELECT k, 3.1214::DOUBLE AS buffer, ((w + 2) * (h + 2))::DOUBLE AS mitred, 9::INT AS segmentize, 5::INT AS simplify, (w * h)::DOUBLE AS subdivide, 1::INT AS whole, true AS makevalid,
'POINT (' || (x + 3) || ' ' || (y + 4) || ')' AS translate, 'POINT (' || (2 * x) || ' ' || (3 * y) || ')' AS scale, 3857::INT AS setsrid FROM p"""


def fn_aggregates(spark, sf_dir):
    p = _parts(spark, sf_dir).withColumn("g", (c("k") % 7).cast("long"))
    return p.groupBy("g").agg(
        S.st_area(S.st_extent_agg(c("b"))).alias("extent"), S.st_numgeometries(S.st_collect_agg(c("p"))).alias("collect"), S.st_npoints(S.st_makeline_agg(c("p"), c("k"))).alias("makeline"),
        F.round(S.st_area(S.st_union_agg(S.box(c("k") * 2, 0, c("k") * 2 + 1, c("w")))), 6).alias("union"),
        S.st_area(S.st_convexhull_agg(S.st_makepoint(c("k") % 3, F.floor(c("k") / 3) % 3))).alias("hull"),
    )


_AGGREGATES_SQL = _PART_SQL + """SELECT (k % 7)::BIGINT AS g, (max(x + w) - min(x))::DOUBLE * (max(y + h) - min(y))::DOUBLE AS extent, count(*)::INT AS collect, count(*)::INT AS makeline, sum(w)::DOUBLE AS "union", 4.0::DOUBLE AS hull FROM p GROUP BY 1"""


def fn_knn(spark, sf_dir):
    """The three zones nearest to each trip's start, by distance and then by index (the zone's key)."""
    zones = zone(spark, sf_dir).agg(F.transform(F.array_sort(F.collect_list(F.struct("z_zonekey", "z_boundary"))), lambda s: s["z_boundary"]).alias("zones")).scalar()
    near = trip(spark, sf_dir).select("t_tripkey", F.posexplode(S.st_knn(c("t_pickuploc"), zones, 3)).alias("pos", "n"))
    return near.select("t_tripkey", "pos", c("n.idx").alias("idx"), F.round("n.distance", 9).alias("distance"))


_KNN_SQL = f"""WITH {TRIP_SQL}, {ZONE_SQL}, d AS (SELECT t_tripkey, z_zonekey, sqrt(pow(greatest(z.x0 - px, 0, px - z.x1), 2) + pow(greatest(z.y0 - py, 0, py - z.y1), 2)) AS d FROM trip, zone z),
n AS (SELECT *, row_number() OVER (PARTITION BY t_tripkey ORDER BY d, z_zonekey) AS r FROM d)
SELECT t_tripkey, (r - 1)::INT AS pos, z_zonekey AS idx, round(d, 9) AS distance FROM n WHERE r <= 3"""


def _join(predicate, how="inner", **more):
    def run(spark, sf_dir):
        t, z = trip(spark, sf_dir), zone(spark, sf_dir)
        out = spatial_join(t, z, "t_pickuploc", "z_boundary", predicate, how, left_key=["t_tripkey"], **more)
        return out.select("t_tripkey", *(["z_zonekey"] if how in ("inner", "left") else []))

    return run


_STRICT = "px > z.x0 AND px < z.x1 AND py > z.y0 AND py < z.y1"
_CLOSED = "px >= z.x0 AND px <= z.x1 AND py >= z.y0 AND py <= z.y1"
_JOIN = f"WITH {TRIP_SQL}, {ZONE_SQL} SELECT t_tripkey"


def join_overlapping_buildings(spark, sf_dir):
    """Polygon with polygon: overlaps and touches of building pairs."""
    b = building(spark, sf_dir)
    one, two = b.select(c("b_buildingkey").alias("i"), c("b_boundary").alias("g")), b.select(c("b_buildingkey").alias("j"), c("b_boundary").alias("f"))
    return spatial_join(one, two, "g", "f", "overlaps", residual=F.expr("i < j")).select("i", "j")


QUERIES = {
    "fn_io": fn_io, "fn_accessors": fn_accessors, "fn_distances": fn_distances, "fn_constructors": fn_constructors, "fn_predicates": fn_predicates,
    "fn_overlay": fn_overlay, "fn_processing": fn_processing, "fn_aggregates": fn_aggregates, "fn_knn": fn_knn,
    "join_within": _join("within"), "join_covered": _join("coveredby"), "join_intersects": _join("intersects"), "join_bbox": _join("bbox"),
    "join_left": _join("within", "left"), "join_semi": _join("within", "left_semi"), "join_anti": _join("within", "left_anti"), "join_distance": _join("dwithin", distance=2.0),
    "join_overlaps": join_overlapping_buildings,
}

SQL = {
    "fn_io": _IO_SQL, "fn_accessors": _ACCESSORS_SQL, "fn_distances": _DISTANCES_SQL, "fn_constructors": _CONSTRUCTORS_SQL, "fn_predicates": _PREDICATES_SQL,
    "fn_overlay": _OVERLAY_SQL, "fn_processing": _PROCESSING_SQL, "fn_aggregates": _AGGREGATES_SQL, "fn_knn": _KNN_SQL,
    "join_within": f"{_JOIN}, z_zonekey FROM trip JOIN zone z ON {_STRICT}", "join_covered": f"{_JOIN}, z_zonekey FROM trip JOIN zone z ON {_CLOSED}",
    "join_intersects": f"{_JOIN}, z_zonekey FROM trip JOIN zone z ON {_CLOSED}", "join_bbox": f"{_JOIN}, z_zonekey FROM trip JOIN zone z ON {_CLOSED}",
    "join_left": f"{_JOIN}, z_zonekey FROM trip LEFT JOIN zone z ON {_STRICT}", "join_semi": f"{_JOIN} FROM trip SEMI JOIN zone z ON {_STRICT}",
    "join_anti": f"{_JOIN} FROM trip ANTI JOIN zone z ON {_STRICT}",
    "join_distance": f"{_JOIN}, z_zonekey FROM trip JOIN zone z ON pow(greatest(z.x0 - px, 0, px - z.x1), 2) + pow(greatest(z.y0 - py, 0, py - z.y1), 2) <= 4",
    "join_overlaps": f"WITH {BUILDING_SQL} SELECT a.b_buildingkey AS i, b.b_buildingkey AS j FROM building a JOIN building b ON a.b_buildingkey < b.b_buildingkey AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 WHERE NOT (a.x0 <= b.x0 AND a.x1 >= b.x1 AND a.y0 <= b.y0 AND a.y1 >= b.y1) AND NOT (b.x0 <= a.x0 AND b.x1 >= a.x1 AND b.y0 <= a.y0 AND b.y1 >= a.y1)",
}
