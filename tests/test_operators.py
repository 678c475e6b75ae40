import random

import pytest
from pyspark.sql import functions as F

from terrane.functions import spatial as S
from terrane.operators import knn_join, spatial_join
from terrane.operators.join import _quadtree
from terrane.sources import geo


def boxes(spark, n, seed, key, name, scale):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice(scale)
        x, y = rng.randrange(-400, 400) / 8, rng.randrange(-400, 400) / 8
        rows.append((i, x, y, x + rng.randrange(0, 8) * size / 8, y + rng.randrange(1, 8) * size / 8))
    df = spark.createDataFrame(rows, f"{key} int, a double, b double, c double, d double")
    return df.select(key, S.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias(name)).union(spark.createDataFrame([(-1, None)], f"{key} int, {name} binary"))


@pytest.fixture(params=["0", "8388608"], ids=["cells", "index"])
def small(spark, request):
    """Both ways to plan a spatial join."""
    spark.conf.set("terrane.index.bytes", request.param)
    yield request.param
    spark.conf.unset("terrane.index.bytes")


@pytest.fixture(scope="module")
def sides(spark):
    # points, small boxes and giants, so that pairs meet on several levels
    left = boxes(spark, 150, 1, "i", "g", (0.0, 1.0, 40.0)).cache()
    right = boxes(spark, 150, 2, "j", "f", (0.5, 2.0, 90.0)).cache()
    return left, right


@pytest.mark.parametrize("predicate", ["intersects", "contains", "within", "covers", "coveredby", "overlaps", "touches", "bbox", "containsproperly", "crosses", "equals"])
def test_join_equals_nested_loop(sides, small, predicate):
    left, right = sides
    function = getattr(S, "st_intersects_extent" if predicate == "bbox" else f"st_{predicate}")
    expected = {tuple(r) for r in left.crossJoin(right).select("i", "j", function(F.col("g"), F.col("f")).alias("hit")).collect() if r["hit"]}
    expected = {(i, j) for i, j, _ in expected}
    got = [tuple(r) for r in spatial_join(left, right, "g", "f", predicate).select("i", "j").collect()]
    assert len(got) == len(set(got)) and set(got) == expected


@pytest.mark.parametrize("distance", [0.0, 3.0, 1000.0])
def test_distance_join(sides, small, distance):
    left, right = sides
    expected = left.crossJoin(right).select("i", "j", S.st_dwithin(F.col("g"), F.col("f"), distance).alias("hit")).collect()
    expected = {(r["i"], r["j"]) for r in expected if r["hit"]}
    got = [tuple(r) for r in spatial_join(left, right, "g", "f", "dwithin", distance=distance).select("i", "j").collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_outer_joins(sides, small):
    left, right = sides
    inner = spatial_join(left, right, "g", "f", "within").select("i").distinct()
    semi = spatial_join(left, right, "g", "f", "within", "left_semi", left_key=["i"])
    anti = spatial_join(left, right, "g", "f", "within", "left_anti", left_key=["i"])
    whole = spatial_join(left, right, "g", "f", "within", "left", left_key=["i"])
    assert semi.count() == inner.count() and semi.count() + anti.count() == left.count()
    assert whole.where("j is null").count() == anti.count()


def test_join_of_nothing(sides, small, spark):
    left, right = sides
    assert spatial_join(left.limit(0), right, "g", "f").count() == 0
    assert spatial_join(left, right.limit(0), "g", "f").columns == ["i", "g", "j", "f"]
    with pytest.raises(ValueError):
        spatial_join(left, right, "g", "f", "disjoint")


def test_same_column_names_get_a_suffix(sides, small):
    left, _ = sides
    pairs = spatial_join(left, left, "g", "g", "intersects", residual=F.expr("i < i_right"))
    assert pairs.columns == ["i", "g", "i_right", "g_right"] and pairs.where("i >= i_right").count() == 0


@pytest.mark.parametrize("k", [1, 4, 500])
def test_knn_both_ways(sides, k):
    left, right = sides
    few = left.where("i < 40")
    one = {tuple(r)[:2] + (r["rank"],) for r in knn_join(few, right, "g", "f", "i", "j", k).collect()}
    other = {tuple(r)[:2] + (r["rank"],) for r in _quadtree(few, right, "g", "f", "i", "j", k, 10).collect()}
    assert one == other and len(one) == few.where("g is not null").count() * min(k, 150)


def test_geometry_table_prunes(spark, sides, tmp_path):
    left, _ = sides
    geo.write_geo(left, str(tmp_path / "t"), "g", files=4)
    back = geo.read_geo(spark, str(tmp_path / "t"))
    assert set(geo.BOX) <= set(back.columns) and back.count() == left.count()
    wkt = "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0))"
    found = geo.where_spatial(back, "intersects", "g", wkt)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "LessThanOrEqual(xmin" in plan
    assert found.count() == left.where(S.st_intersects(F.col("g"), S.st_geomfromtext(wkt))).count()
    assert geo.where_spatial(back, "intersects", "g", "POINT EMPTY").count() == 0


def test_boundary_does_not_depend_on_size(spark):
    """The corner, edge, inside and outside of a square answer alike in small and large batches and prepared or not."""
    ring = ", ".join(f"{i / 64} 0" for i in range(65))
    large = f"POLYGON (({ring}, 1 1, 0 1, 0 0))"
    for n in (3, 4000):
        probes = spark.range(n).withColumn("p", F.element_at(F.array(S.st_makepoint(0.5, 0.5), S.st_makepoint(0.0, 0.0), S.st_makepoint(2.0, 2.0), S.st_makepoint(0.5, 0.0)), (F.col("id") % 4 + 1).cast("int")))
        for wkt in ("POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", large):
            for predicate, hits in (("within", {0}), ("coveredby", {0, 1, 3}), ("intersects", {0, 1, 3})):
                got = {r["m"] for r in geo.where_spatial(probes, predicate, "p", wkt).select((F.col("id") % 4).alias("m")).distinct().collect()}
                assert got == {h for h in hits if h < n}
