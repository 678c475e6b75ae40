import math

import pytest
from pyspark.sql import functions as F

from terrane.functions import spatial as S

SQUARE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"
HOLED = "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"
BOWTIE = "POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))"


@pytest.fixture(scope="module")
def sql(spark):
    S.register(spark)
    return lambda text: spark.sql(f"SELECT {text} AS v").first()["v"]


def g(wkt):
    return f"st_geomfromtext('{wkt}')"


CASES = [
    ("geos_version() LIKE '3.%'", True),
    ("st_astext(st_makepoint(7.5, -2))", "POINT (7.5 -2)"),
    (f"st_asewkt({g('SRID=27700;POINT (5 6)')})", "SRID=27700;POINT (5 6)"),
    (f"st_asewkt({g('SRID=-1;POINT (5 6)')})", "SRID=-1;POINT (5 6)"),
    (f"st_srid({g('POINT (5 6)')})", 0),
    ("st_z(st_makepoint3d(1, 2, 3))", 3.0),
    ("st_astext(st_makepoint3d(1, 2, 3))", "POINT Z (1 2 3)"),
    (f"st_numpoints({g('LINESTRING (0 0, 1 1, 5 5)')})", 3),
    (f"st_npoints({g(HOLED)})", 10),
    (f"st_nrings({g(HOLED)})", 2),
    (f"st_nrings({g('POLYGON EMPTY')})", 1),
    (f"st_numinteriorrings({g(HOLED)})", 1),
    (f"st_area({g(HOLED)})", 80.0),
    (f"st_area({g('LINESTRING (0 0, 6 8)')})", 0.0),
    (f"st_length({g(SQUARE)})", 16.0),
    (f"st_perimeter({g('LINESTRING (0 0, 6 8)')})", 10.0),
    (f"st_geometrytype({g('MULTIPOINT ((0 0), (1 1))')})", "ST_MultiPoint"),
    (f"st_isring({g('POINT (0 0)')})", False),
    (f"st_isvalid({g(BOWTIE)})", False),
    (f"st_isvalidreason({g(SQUARE)})", "Valid Geometry"),
    (f"st_isempty({g('GEOMETRYCOLLECTION EMPTY')})", True),
    (f"st_astext(st_envelope({g('LINESTRING (3 1, 1 5)')}))", "POLYGON ((1 1, 3 1, 3 5, 1 5, 1 1))"),
    (f"st_astext(st_makebox2d({g('POINT (3 3)')}, {g('POINT (1 1)')}))", "POLYGON ((1 1, 3 1, 3 3, 1 3, 1 1))"),
    (f"st_astext(st_exteriorring({g(SQUARE)}))", "LINESTRING (0 0, 4 0, 4 4, 0 4, 0 0)"),
    (f"st_geometrytype(st_exteriorring({g(SQUARE)}))", "ST_LineString"),
    (f"st_astext(st_boundary({g(SQUARE)}))", "LINESTRING (0 0, 4 0, 4 4, 0 4, 0 0)"),
    (f"st_astext(st_addpoint({g('LINESTRING (0 0, 2 0)')}, {g('POINT (1 1)')}, 1))", "LINESTRING (0 0, 1 1, 2 0)"),
    (f"st_astext(st_addpoint({g('LINESTRING (0 0, 2 0)')}, {g('POINT (1 1)')}, 99))", "LINESTRING (0 0, 2 0, 1 1)"),
    (f"st_within({g('POINT (0 2)')}, {g(SQUARE)})", False),
    (f"st_covers({g(SQUARE)}, {g('POINT (0 2)')})", True),
    (f"st_contains({g(SQUARE)}, {g('POINT (2 2)')})", True),
    (f"st_containsproperly({g(SQUARE)}, {g('POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))')})", False),
    (f"st_equals({g('POINT EMPTY')}, {g('POINT EMPTY')})", False),
    (f"st_dwithin({g('POINT (0 0)')}, {g('POINT (6 8)')}, 10)", True),
    (f"st_dwithin({g('POINT (0 0)')}, {g('POINT (6 8)')}, double('infinity'))", True),
    (f"st_dwithin({g('POINT (0 0)')}, {g('POINT EMPTY')}, 10)", False),
    (f"st_intersects_extent({g('LINESTRING (0 0, 4 4)')}, {g('POINT (3 1)')})", True),
    (f"st_intersects_extent({g('POINT EMPTY')}, {g(SQUARE)})", False),
    (f"st_relate_pattern({g(SQUARE)}, {g('POINT (2 2)')}, 'T*****FF*')", True),
    (f"st_numgeometries(st_linmerge({g('MULTILINESTRING ((0 0, 1 0), (1 0, 2 0))')}))", 1),
    (f"st_geometrytype(st_linmerge({g('MULTILINESTRING ((0 0, 1 0), (1 0, 2 0))')}))", "ST_GeometryCollection"),
    (f"st_numgeometries(st_clusterintersecting({g('GEOMETRYCOLLECTION (POINT (0 0), LINESTRING (0 0, 1 1), LINESTRING (1 1, 2 2), POINT (9 9))')}))", 2),
    (f"round(st_area(st_buffer_params({g('LINESTRING (0 0, 10 0)')}, 1, 'endcap=flat')), 6)", 20.0),
    (f"round(st_area(st_buffer_params({g('LINESTRING (0 0, 10 0)')}, 1, 'endcap=square nonsense=1')), 6)", 24.0),
    (f"st_isvalid(st_makevalid({g(BOWTIE)}))", True),
    (f"st_area(st_buffer({g(SQUARE)}, -1))", 4.0),
    (f"st_astext(st_scale({g('LINESTRING (1 1, 2 2)')}, 2, 10))", "LINESTRING (2 10, 4 20)"),
    ("st_astext(st_geomfromgeojson('{\"type\":\"Polygon\",\"coordinates\":[[[0,0],[1,0],[1,1],[0,0]]]}'))", "POLYGON ((0 0, 1 0, 1 1, 0 0))"),
    ("st_astext(st_geomfromgeojson('{\"type\":\"MultiPoint\",\"coordinates\":[[0,0],[1,2]]}'))", "MULTIPOINT ((0 0), (1 2))"),
    ("size(st_knn(st_makepoint(0, 0), array(), 3))", 0),
    ("st_knn(st_makepoint(0, 0), array(st_makepoint(2, 0), st_makepoint(1, 0), st_makepoint(2, 0)), 2).idx", [1, 0]),
    ("st_knn(st_makepoint(0, 0), array(st_makepoint(2, 0)), 5).distance", [2.0]),
    ("st_knn(NULL, array(st_makepoint(1, 1)), 1)", []),
    ("size(st_knn(st_makepoint(0, 0), array(st_makepoint(1, 1)), 0))", 0),
    ("st_area(NULL)", None),
    (f"st_intersects(NULL, {g(SQUARE)})", None),
]


@pytest.mark.parametrize("text,expected", CASES, ids=[c[0][:60] for c in CASES])
def test_sql(sql, text, expected):
    assert sql(text) == expected


ERRORS = [
    "st_x(st_geomfromtext('LINESTRING (0 0, 1 1)'))",
    "st_x(st_geomfromtext('POINT EMPTY'))",
    "st_numpoints(st_geomfromtext('POINT (0 0)'))",
    "st_pointn(st_geomfromtext('LINESTRING (0 0, 1 1)'), 0)",
    "st_geometryn(st_geomfromtext('POINT (0 0)'), 2)",
    "st_removepoint(st_geomfromtext('LINESTRING (0 0, 1 1)'), 2)",
    "st_makepolygon(st_geomfromtext('LINESTRING (0 0, 1 1, 1 0)'))",
    "st_startpoint(st_geomfromtext('LINESTRING EMPTY'))",
    "st_geomfromtext('POINT 1 2')",
    "st_geomfromtext('srid=4326;POINT (1 2)')",
    "st_geomfromtext('SRID=99999999999;POINT (1 2)')",
    "st_area(X'0101')",
    "st_transform(st_makepoint(0, 0), 4326)",
    "st_transform_proj(st_makepoint(0, 0), 'x')",
    "st_setsrid(st_makepoint(0, 0), -5)",
    "geos_test_exception('told')",
]


@pytest.mark.parametrize("text", ERRORS)
def test_errors(sql, text):
    with pytest.raises(Exception):
        sql(text)


def test_aggregates_in_sql(spark, sql):
    spark.sql("SELECT st_makepoint(col1, col2) AS p FROM VALUES (0D, 0D), (4D, 0D), (0D, 3D), (NULL, 1D)").createOrReplaceTempView("pts")
    r = spark.sql("SELECT st_area(st_extent_agg(p)) e, st_area(st_convexhull_agg(p)) h, st_numgeometries(st_collect_agg(p)) n FROM pts").first()
    assert (r["e"], r["h"], r["n"]) == (12.0, 6.0, 3)
    with pytest.raises(Exception):
        spark.sql(f"SELECT st_union_agg(st_geomfromtext('{BOWTIE}'))").collect()


def test_merged_aggregates_of_many_rows(spark):
    """More rows than a state holds, over several partitions: states shrink and merge on the way."""
    grid = spark.range(6000).repartition(5).select((F.col("id") % 80).alias("x"), F.floor(F.col("id") / 80).alias("y"), (F.col("id") % 2).alias("k"))
    r = grid.groupBy("k").agg(S.st_area(S.st_convexhull_agg(S.st_makepoint(F.col("x"), F.col("y")))).alias("hull"), S.st_area(S.st_union_agg(S.box(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1))).alias("union"))
    assert sorted((x["k"], x["hull"], round(x["union"], 6)) for x in r.collect()) == [(0, 78 * 74.0, 3000.0), (1, 78 * 74.0, 3000.0)]
    empty = spark.range(1).select(S.st_isempty(S.st_convexhull_agg(F.lit(None).cast("binary"))).alias("e"), S.st_isempty(S.st_union_agg(F.lit(None).cast("binary"))).alias("u")).first()
    assert tuple(empty) == (True, True)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan


def test_makeline_keeps_the_given_order(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 5.0), (2, 9.0)], "o int, x double")
    line = df.agg(S.st_astext(S.st_makeline_agg(S.st_makepoint(F.col("x"), 0.0), F.col("o"))).alias("l")).first()["l"]
    assert line == "LINESTRING (5 0, 9 0, 1 0)"


def test_nested_calls_stay_objects(spark):
    plan = spark.range(1).select(S.st_length(S.st_makeline(S.st_makepoint(F.col("id"), 0.0), S.st_makepoint(3.0, 4.0))))._jdf.queryExecution().executedPlan().toString()
    assert "write" not in plan and "read" not in plan and "*(1)" in plan


def test_bytes_round_trip(spark):
    big = bytes.fromhex("00000000013ff00000000000004000000000000000")  # big-endian POINT (1 2)
    iso_z = bytes.fromhex("01e9030000000000000000f03f00000000000000400000000000000840")  # ISO POINT Z (1 2 3)
    df = spark.createDataFrame([(bytearray(big),), (bytearray(iso_z),)], "w binary")
    assert [r[0] for r in df.select(S.st_astext(S.st_geomfromwkb(F.col("w")))).collect()] == ["POINT (1 2)", "POINT Z (1 2 3)"]


def test_knn_index_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    boxes = [(x := rng.uniform(-50, 50), y := rng.uniform(-50, 50), x + rng.uniform(0.1, 9), y + rng.uniform(0.1, 9)) for _ in range(300)]
    gap = lambda b, px, py: math.hypot(max(b[0] - px, 0, px - b[2]), max(b[1] - py, 0, py - b[3]))
    probes = [(rng.uniform(-80, 80), rng.uniform(-80, 80)) for _ in range(60)]
    cands = spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], "i int, a double, b double, c double, d double")
    cands = cands.select("i", S.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("g"))
    array = cands.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "g"))), lambda s: s["g"]).alias("cs"))
    q = spark.createDataFrame(probes, "x double, y double").crossJoin(array)
    for r in q.select("x", "y", S.st_knn(S.st_makepoint(F.col("x"), F.col("y")), F.col("cs"), 7).alias("n")).collect():
        expected = sorted((gap(b, r["x"], r["y"]), i) for i, b in enumerate(boxes))[:7]
        assert [n["idx"] for n in r["n"]] == [i for _, i in expected]
        assert all(abs(n["distance"] - d) < 1e-9 for n, (d, _) in zip(r["n"], expected))
