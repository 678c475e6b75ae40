"""The twelve-query trip workload, over tables of trips, zones, buildings and customers.

``tables`` derives these from the driver's star schema: coordinates are multiples of 1/64 and polygons are boxes, so that every
answer has a closed form.  The queries take the tables as DataFrames and would run on any trips of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import spatial as S
from terrane.operators import deal, knn_join, spatial_join
from terrane.sources.geo import where_spatial

CENTRE, RADIUS = "POINT (50 50)", 5.0
STUDY, MARGIN = (30.0, 30.0, 60.0, 60.0), 0.5
WINDOW = (20.0, 20.0, 50.0, 50.0)
NEARBY = 0.5
DEGREES_PER_METRE = 0.000009


def rectangle(x0: float, y0: float, x1: float, y1: float) -> str:
    return f"POLYGON (({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))"


def trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    o = o.selectExpr(
        "o_orderkey AS t_tripkey",
        "o_custkey % 40 AS t_custkey",
        "cast((o_orderkey * 7919) % 6397 AS double) / 64 AS px",
        "cast((o_orderkey * 104729) % 6389 AS double) / 64 AS py",
        "cast((o_orderkey * 31) % 2049 - 1024 AS double) / 64 AS dx",
        "cast((o_orderkey * 17) % 2049 - 1024 AS double) / 64 AS dy",
        "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400) AS t_pickuptime",
        "cast(o_orderkey % 97 AS double) / 4 AS t_distance",
        "o_totalprice AS t_fare",
        "cast((o_orderkey * 37) % 1000 AS double) / 64 AS t_tip",
    )
    o = o.withColumns({"t_dropofftime": F.expr("t_pickuptime + make_dt_interval(0, 0, 1 + t_tripkey % 90, 0)"), "t_pickuploc": S.st_makepoint(F.col("px"), F.col("py")), "t_dropoffloc": S.st_makepoint(F.col("px") + F.col("dx"), F.col("py") + F.col("dy"))})
    return o.select("t_tripkey", "t_custkey", "t_pickuploc", "t_dropoffloc", "t_pickuptime", "t_dropofftime", "t_distance", "t_fare", "t_tip")


def zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    n = n.selectExpr("cast(n_nationkey AS bigint) AS z_zonekey", "n_name AS z_name", "CASE WHEN n_nationkey = 24 THEN 512.0D ELSE 16.0D * (n_nationkey % 5) END AS x0",
                     "CASE WHEN n_nationkey = 24 THEN 512.0D ELSE 16.0D * (n_nationkey div 5) END AS y0", "CASE WHEN n_nationkey = 23 THEN 24.0D ELSE 16.0D END AS side")
    return n.select("z_zonekey", "z_name", S.box(F.col("x0"), F.col("y0"), F.col("x0") + F.col("side"), F.col("y0") + F.col("side")).alias("z_boundary"))


def building(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    p = p.selectExpr("p_partkey AS b_buildingkey", "p_name AS b_name", "cast((p_partkey * 3571) % 6361 AS double) / 64 AS x0", "cast((p_partkey * 15485863) % 6353 AS double) / 64 AS y0",
                     "cast(1 + p_partkey % 8 AS double) / 8 AS w", "cast(1 + p_partkey % 5 AS double) / 4 AS h")
    return p.select("b_buildingkey", "b_name", S.box(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")).alias("b_boundary"))


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")


def seconds(a: str = "t_pickuptime", b: str = "t_dropofftime"):
    return (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1e6


def _average(column, name: str, digits: int = 6):
    return F.round(F.avg(column), digits).alias(name)


def q1_trips_near_point(trips: DataFrame) -> DataFrame:
    near = where_spatial(trips, "dwithin", "t_pickuploc", CENTRE, RADIUS)
    distance = F.round(S.st_distance(F.col("t_pickuploc"), S.st_geomfromtext(CENTRE)), 9)
    near = near.select("t_tripkey", S.st_x(F.col("t_pickuploc")).alias("x"), S.st_y(F.col("t_pickuploc")).alias("y"), "t_pickuptime", distance.alias("distance_to_center"))
    return near.orderBy("distance_to_center", "t_tripkey").limit(100)


def q2_trips_in_zone(trips: DataFrame, zones: DataFrame, key: int = 7) -> DataFrame:
    """The zone's boundary is a subquery, and a constant to every task."""
    return where_spatial(trips, "intersects", "t_pickuploc", zones.where(F.col("z_zonekey") == key).select("z_boundary")).agg(F.count("*").alias("trip_count"))


def q3_monthly_stats(trips: DataFrame) -> DataFrame:
    near = where_spatial(trips, "dwithin", "t_pickuploc", rectangle(*STUDY), MARGIN)
    stats = near.groupBy(F.date_trunc("month", "t_pickuptime").cast("timestamp_ntz").alias("pickup_month")).agg(F.count("t_tripkey").alias("total_trips"), _average("t_distance", "avg_distance"), _average(seconds(), "avg_duration_seconds"), _average("t_fare", "avg_fare", 4))
    return stats.orderBy("pickup_month")


def q4_zones_of_top_tips(trips: DataFrame, zones: DataFrame) -> DataFrame:
    top = trips.orderBy(F.desc("t_tip"), "t_tripkey").limit(1000).select("t_pickuploc")
    found = spatial_join(top, zones, "t_pickuploc", "z_boundary", "within")
    return found.groupBy("z_zonekey", "z_name").agg(F.count("*").alias("trip_count")).orderBy(F.desc("trip_count"), "z_zonekey")


def q5_travel_hulls(trips: DataFrame, customers: DataFrame) -> DataFrame:
    trips = deal(trips.select("t_custkey", "t_pickuptime", "t_dropoffloc"), "t_dropoffloc")
    own = trips.join(customers, trips.t_custkey == customers.c_custkey)
    months = own.groupBy("c_custkey", F.col("c_name").alias("customer_name"), F.date_trunc("month", "t_pickuptime").cast("timestamp_ntz").alias("pickup_month"))
    hulls = months.agg(F.count("*").alias("dropoff_count"), S.st_convexhull_agg(F.col("t_dropoffloc")).alias("_hull")).where("dropoff_count > 5")
    hulls = hulls.select("c_custkey", "customer_name", "pickup_month", S.st_area(F.col("_hull")).alias("monthly_travel_hull_area"), "dropoff_count")
    return hulls.orderBy(F.desc("monthly_travel_hull_area"), "c_custkey", "pickup_month").limit(100)


def q6_zone_stats_in_window(trips: DataFrame, zones: DataFrame) -> DataFrame:
    inside = where_spatial(zones, "intersects", "z_boundary", rectangle(*WINDOW))
    found = spatial_join(trips, inside, "t_pickuploc", "z_boundary", "within")
    stats = found.groupBy("z_zonekey", "z_name").agg(F.count("t_tripkey").alias("total_pickups"), _average("t_distance", "avg_distance"), _average(seconds(), "avg_duration_seconds"))
    return stats.orderBy(F.desc("total_pickups"), "z_zonekey")


def q7_detour_ratio(trips: DataFrame) -> DataFrame:
    line = S.st_length(S.st_makeline(F.col("t_pickuploc"), F.col("t_dropoffloc"))) / DEGREES_PER_METRE
    t = trips.select("t_tripkey", F.col("t_distance").alias("reported_distance_m"), F.round(line, 6).alias("line_distance_m"))
    t = t.withColumn("detour_ratio", F.round(F.col("reported_distance_m") / F.expr("nullif(line_distance_m, 0D)"), 12))
    return t.orderBy(F.desc_nulls_last("detour_ratio"), F.desc("reported_distance_m"), "t_tripkey").limit(100)


def q8_pickups_near_buildings(trips: DataFrame, buildings: DataFrame) -> DataFrame:
    """Counts by key; only the rows that come out meet their names."""
    found = spatial_join(trips.select("t_pickuploc"), buildings.select("b_buildingkey", "b_boundary"), "t_pickuploc", "b_boundary", "dwithin", distance=NEARBY)
    order = (F.desc("nearby_pickup_count"), "b_buildingkey")
    top = found.groupBy("b_buildingkey").agg(F.count("*").alias("nearby_pickup_count")).orderBy(*order).limit(100)
    return buildings.select("b_buildingkey", "b_name").join(F.broadcast(top), "b_buildingkey").orderBy(*order)


def q9_building_overlaps(buildings: DataFrame) -> DataFrame:
    one = buildings.select(F.col("b_buildingkey").alias("building_1"), F.col("b_boundary").alias("g1"))
    two = buildings.select(F.col("b_buildingkey").alias("building_2"), F.col("b_boundary").alias("g2"))
    pairs = spatial_join(one, two, "g1", "g2", "intersects", residual=F.expr("building_1 < building_2"))
    pairs = pairs.select("building_1", "building_2", S.st_area(F.col("g1")).alias("area1"), S.st_area(F.col("g2")).alias("area2"), S.st_area(S.st_intersection(F.col("g1"), F.col("g2"))).alias("overlap_area"))
    either = F.col("area1") + F.col("area2") - F.col("overlap_area")
    iou = F.when(F.col("overlap_area") == 0, 0.0).when(either == 0, 1.0).otherwise(F.col("overlap_area") / either)
    return pairs.withColumn("iou", F.round(iou, 12)).orderBy(F.desc("iou"), "building_1", "building_2").limit(100)


def q10_zone_averages(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Inner join and aggregate first, then the zones without trips: only one row a zone meets the outer join."""
    found = spatial_join(trips, zones, "t_pickuploc", "z_boundary", "within")
    stats = found.groupBy(F.col("z_zonekey").alias("_z")).agg(_average(seconds(), "avg_duration_seconds"), _average("t_distance", "avg_distance"), F.count("t_tripkey").alias("n"))
    all_ = zones.select("z_zonekey", F.col("z_name").alias("pickup_zone")).join(stats, F.col("z_zonekey") == F.col("_z"), "left")
    all_ = all_.select("z_zonekey", "pickup_zone", "avg_duration_seconds", "avg_distance", F.coalesce("n", F.lit(0)).alias("num_trips"))
    return all_.orderBy(F.desc_nulls_last("avg_duration_seconds"), "z_zonekey").limit(100)


def q11_cross_zone_trips(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Two joins; only keys and the second point go from one to the other."""
    start = spatial_join(trips.select("t_pickuploc", "t_dropoffloc"), zones.select(F.col("z_zonekey").alias("pickup_zone"), F.col("z_boundary").alias("zb1")), "t_pickuploc", "zb1", "within")
    both = spatial_join(start.select("t_dropoffloc", "pickup_zone"), zones.select(F.col("z_zonekey").alias("dropoff_zone"), F.col("z_boundary").alias("zb2")), "t_dropoffloc", "zb2", "within", residual=F.expr("pickup_zone <> dropoff_zone"))
    return both.agg(F.count("*").alias("cross_zone_trip_count"))


def q12_nearest_buildings(trips: DataFrame, buildings: DataFrame, k: int = 5) -> DataFrame:
    near = knn_join(trips, buildings, "t_pickuploc", "b_boundary", "t_tripkey", "b_buildingkey", k)
    return near.groupBy("t_tripkey").agg(_average("distance", "avg_distance_to_5_nearest", 9)).orderBy(F.desc("avg_distance_to_5_nearest"), "t_tripkey").limit(100)


QUERIES = {
    "q1": lambda s, d: q1_trips_near_point(trip(s, d)),
    "q2": lambda s, d: q2_trips_in_zone(trip(s, d), zone(s, d)),
    "q3": lambda s, d: q3_monthly_stats(trip(s, d)),
    "q4": lambda s, d: q4_zones_of_top_tips(trip(s, d), zone(s, d)),
    "q5": lambda s, d: q5_travel_hulls(trip(s, d), customer(s, d)),
    "q6": lambda s, d: q6_zone_stats_in_window(trip(s, d), zone(s, d)),
    "q7": lambda s, d: q7_detour_ratio(trip(s, d)),
    "q8": lambda s, d: q8_pickups_near_buildings(trip(s, d), building(s, d)),
    "q9": lambda s, d: q9_building_overlaps(building(s, d)),
    "q10": lambda s, d: q10_zone_averages(trip(s, d), zone(s, d)),
    "q11": lambda s, d: q11_cross_zone_trips(trip(s, d), zone(s, d)),
    "q12": lambda s, d: q12_nearest_buildings(trip(s, d), building(s, d)),
}

TRIP_SQL = """trip AS (SELECT o_orderkey AS t_tripkey, o_custkey % 40 AS t_custkey,
  ((o_orderkey * 7919) % 6397)::DOUBLE / 64 AS px, ((o_orderkey * 104729) % 6389)::DOUBLE / 64 AS py,
  ((o_orderkey * 7919) % 6397)::DOUBLE / 64 + ((o_orderkey * 31) % 2049 - 1024)::DOUBLE / 64 AS qx,
  ((o_orderkey * 104729) % 6389)::DOUBLE / 64 + ((o_orderkey * 17) % 2049 - 1024)::DOUBLE / 64 AS qy,
  o_orderdate + to_seconds(o_orderkey % 86400) AS t_pickuptime, 60.0 * (1 + o_orderkey % 90) AS secs,
  (o_orderkey % 97)::DOUBLE / 4 AS t_distance, o_totalprice AS t_fare, ((o_orderkey * 37) % 1000)::DOUBLE / 64 AS t_tip FROM orders)"""
ZONE_SQL = """zone AS (SELECT *, x0 + side AS x1, y0 + side AS y1 FROM (SELECT n_nationkey::BIGINT AS z_zonekey, n_name AS z_name,
  CASE WHEN n_nationkey = 24 THEN 512.0::DOUBLE ELSE 16.0::DOUBLE * (n_nationkey % 5) END AS x0,
  CASE WHEN n_nationkey = 24 THEN 512.0::DOUBLE ELSE 16.0::DOUBLE * (n_nationkey // 5) END AS y0,
  CASE WHEN n_nationkey = 23 THEN 24.0::DOUBLE ELSE 16.0::DOUBLE END AS side FROM nation))"""
BUILDING_SQL = """building AS (SELECT *, x0 + w AS x1, y0 + h AS y1 FROM (SELECT p_partkey AS b_buildingkey, p_name AS b_name,
  ((p_partkey * 3571) % 6361)::DOUBLE / 64 AS x0, ((p_partkey * 15485863) % 6353)::DOUBLE / 64 AS y0,
  (1 + p_partkey % 8)::DOUBLE / 8 AS w, (1 + p_partkey % 5)::DOUBLE / 4 AS h FROM part))"""
_GAP = "sqrt(pow(greatest({b}x0 - px, 0, px - {b}x1), 2) + pow(greatest({b}y0 - py, 0, py - {b}y1), 2))"
_IN = "px > z.x0 AND px < z.x1 AND py > z.y0 AND py < z.y1"

SQL = {
    "q1": f"""WITH {TRIP_SQL}, n AS (SELECT *, sqrt(pow(px - 50, 2) + pow(py - 50, 2)) AS d FROM trip)
SELECT t_tripkey, px AS x, py AS y, t_pickuptime, round(d, 9) AS distance_to_center FROM n WHERE d <= 5 ORDER BY distance_to_center, t_tripkey LIMIT 100""",
    "q2": f"""WITH {TRIP_SQL}, {ZONE_SQL}
SELECT count(*) AS trip_count FROM trip, zone z WHERE z_zonekey = 7 AND px >= z.x0 AND px <= z.x1 AND py >= z.y0 AND py <= z.y1""",
    "q3": f"""WITH {TRIP_SQL}, n AS (SELECT *, sqrt(pow(greatest(30 - px, 0, px - 60), 2) + pow(greatest(30 - py, 0, py - 60), 2)) AS d FROM trip)
SELECT date_trunc('month', t_pickuptime)::TIMESTAMP AS pickup_month, count(*) AS total_trips, round(avg(t_distance), 6) AS avg_distance,
  round(avg(secs), 6) AS avg_duration_seconds, round(avg(t_fare), 4) AS avg_fare FROM n WHERE d <= 0.5 GROUP BY 1 ORDER BY 1""",
    "q4": f"""WITH {TRIP_SQL}, {ZONE_SQL}, top AS (SELECT * FROM trip ORDER BY t_tip DESC, t_tripkey LIMIT 1000)
SELECT z_zonekey, z_name, count(*) AS trip_count FROM top JOIN zone z ON {_IN} GROUP BY 1, 2 ORDER BY trip_count DESC, z_zonekey""",
    "q5": f"""WITH {TRIP_SQL}, own AS (SELECT c_custkey, c_name AS customer_name, date_trunc('month', t_pickuptime)::TIMESTAMP AS pickup_month, qx, qy
  FROM trip JOIN customer ON t_custkey = c_custkey),
g AS (SELECT c_custkey, customer_name, pickup_month, count(*) AS dropoff_count FROM own GROUP BY ALL HAVING count(*) > 5),
p AS (SELECT DISTINCT c_custkey, pickup_month, qx, qy FROM own SEMI JOIN g USING (c_custkey, pickup_month)),
edge AS (SELECT a.c_custkey, a.pickup_month, a.qx * b.qy - b.qx * a.qy AS twice
  FROM p a JOIN p b ON a.c_custkey = b.c_custkey AND a.pickup_month = b.pickup_month AND (a.qx <> b.qx OR a.qy <> b.qy)
  WHERE NOT EXISTS (SELECT 1 FROM p k WHERE k.c_custkey = a.c_custkey AND k.pickup_month = a.pickup_month
    AND ((b.qx - a.qx) * (k.qy - a.qy) - (b.qy - a.qy) * (k.qx - a.qx) < 0
      OR ((b.qx - a.qx) * (k.qy - a.qy) - (b.qy - a.qy) * (k.qx - a.qx) = 0
        AND (k.qx - a.qx) * (k.qx - b.qx) + (k.qy - a.qy) * (k.qy - b.qy) > 0))))
SELECT g.c_custkey, g.customer_name, g.pickup_month, coalesce(sum(twice), 0) / 2 AS monthly_travel_hull_area, any_value(dropoff_count) AS dropoff_count
FROM g LEFT JOIN edge USING (c_custkey, pickup_month) GROUP BY 1, 2, 3 ORDER BY monthly_travel_hull_area DESC, 1, 3 LIMIT 100""",
    "q6": f"""WITH {TRIP_SQL}, {ZONE_SQL}, inside AS (SELECT * FROM zone WHERE x0 <= 50 AND x1 >= 20 AND y0 <= 50 AND y1 >= 20)
SELECT z_zonekey, z_name, count(*) AS total_pickups, round(avg(t_distance), 6) AS avg_distance, round(avg(secs), 6) AS avg_duration_seconds
FROM trip JOIN inside z ON {_IN} GROUP BY 1, 2 ORDER BY total_pickups DESC, z_zonekey""",
    "q7": f"""WITH {TRIP_SQL}, l AS (SELECT t_tripkey, t_distance AS reported_distance_m, round(sqrt(pow(qx - px, 2) + pow(qy - py, 2)) / 0.000009::DOUBLE, 6) AS line_distance_m FROM trip)
SELECT *, round(reported_distance_m / nullif(line_distance_m, 0), 12) AS detour_ratio FROM l
ORDER BY detour_ratio DESC NULLS LAST, reported_distance_m DESC, t_tripkey LIMIT 100""",
    "q8": f"""WITH {TRIP_SQL}, {BUILDING_SQL}
SELECT b_buildingkey, b_name, count(*) AS nearby_pickup_count FROM trip JOIN building b
  ON px BETWEEN b.x0 - 0.5 AND b.x1 + 0.5 AND py BETWEEN b.y0 - 0.5 AND b.y1 + 0.5 AND {_GAP.format(b="b.")} <= 0.5
GROUP BY 1, 2 ORDER BY nearby_pickup_count DESC, b_buildingkey LIMIT 100""",
    "q9": f"""WITH {BUILDING_SQL}, pairs AS (SELECT a.b_buildingkey AS building_1, b.b_buildingkey AS building_2, a.w * a.h AS area1, b.w * b.h AS area2,
  (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS overlap_area
  FROM building a JOIN building b ON a.b_buildingkey < b.b_buildingkey AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)
SELECT *, round(CASE WHEN overlap_area = 0 THEN 0.0 WHEN area1 + area2 - overlap_area = 0 THEN 1.0 ELSE overlap_area / (area1 + area2 - overlap_area) END, 12) AS iou
FROM pairs ORDER BY iou DESC, building_1, building_2 LIMIT 100""",
    "q10": f"""WITH {TRIP_SQL}, {ZONE_SQL}
SELECT z_zonekey, z_name AS pickup_zone, round(avg(secs), 6) AS avg_duration_seconds, round(avg(t_distance), 6) AS avg_distance, count(t_tripkey) AS num_trips
FROM zone z LEFT JOIN trip ON {_IN} GROUP BY 1, 2 ORDER BY avg_duration_seconds DESC NULLS LAST, z_zonekey LIMIT 100""",
    "q11": f"""WITH {TRIP_SQL}, {ZONE_SQL}
SELECT count(*) AS cross_zone_trip_count FROM trip JOIN zone z ON {_IN}
JOIN zone y ON qx > y.x0 AND qx < y.x1 AND qy > y.y0 AND qy < y.y1 WHERE z.z_zonekey <> y.z_zonekey""",
    "q12": f"""WITH {TRIP_SQL}, {BUILDING_SQL}, d AS (SELECT t_tripkey, b_buildingkey, {_GAP.format(b="b.")} AS d FROM trip, building b),
n AS (SELECT *, row_number() OVER (PARTITION BY t_tripkey ORDER BY d, b_buildingkey) AS rank FROM d)
SELECT t_tripkey, round(avg(d), 9) AS avg_distance_to_5_nearest FROM n WHERE rank <= 5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""",
}
