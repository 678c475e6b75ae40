from pyspark.sql import functions as F

from terrane.functions import spatial as S
from terrane.plans import trips
from terrane.streaming import geofence
from tests.conftest import DATA


def test_stream_equals_batch(spark, tmp_path):
    t = trips.trip(spark, f"{DATA}/sf0.001").select("t_tripkey", "t_pickuploc", F.col("t_pickuptime").cast("timestamp").alias("at"))
    t.repartition(3).write.parquet(str(tmp_path / "in"))
    zones = trips.zone(spark, f"{DATA}/sf0.001")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = geofence.matches(stream, zones, "t_pickuploc", "z_boundary").select("t_tripkey", "z_zonekey")
    q = got.writeStream.format("memory").queryName("fenced").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = geofence.matches(t, zones, "t_pickuploc", "z_boundary").select("t_tripkey", "z_zonekey")
    assert sorted(map(tuple, spark.table("fenced").collect())) == sorted(map(tuple, batch.collect()))


def test_windows_count_visits(spark, tmp_path):
    rows = [("2024-01-01 00:00:30", 1.0, 1.0), ("2024-01-01 00:01:30", 2.0, 2.0), ("2024-01-01 00:01:40", 99.0, 99.0), ("2024-01-01 01:00:00", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "at string, x double, y double").select(F.col("at").cast("timestamp").alias("at"), S.st_makepoint(F.col("x"), F.col("y")).alias("p"))
    df.write.parquet(str(tmp_path / "in"))
    fences = spark.range(1).select(F.lit("f").alias("name"), S.box(0.0, 0.0, 5.0, 5.0).alias("g"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counted = geofence.visits(stream, fences, "p", "g", "at", "name", "1 minute", "5 minutes")
    q = counted.writeStream.format("memory").queryName("visited").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["visits"] for r in spark.table("visited").collect()) == [1, 1, 1]
