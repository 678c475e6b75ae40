from pyspark.sql import functions as F

from terrane.functions import spatial as S
from terrane.sources import tables


def places(spark):
    return spark.range(20).select(F.col("id"), S.st_setsrid(S.st_makepoint(F.col("id"), F.lit(0.5)), 4326).alias("g"))


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    tables.write_csv(places(spark), path, ["g"])
    back = tables.read_csv(spark, path, "id long, g string", ["g"])
    assert sorted(back.select("id", S.st_asewkt(F.col("g"))).collect())[3][1] == "SRID=4326;POINT (3 0.5)"
    assert back.dtypes == places(spark).dtypes


def test_json_lines(spark, tmp_path):
    tables.write_json_lines(places(spark), str(tmp_path / "json"), ["g"])
    assert spark.read.json(str(tmp_path / "json")).where("id = 7").first()["g"] == "SRID=4326;POINT (7 0.5)"


def test_table_lies_in_order(spark):
    tables.create_table(places(spark).orderBy(F.desc("id")), "places_sorted", "id", "overwrite")
    try:
        parts = spark.table("places_sorted").withColumn("f", F.input_file_name()).groupBy("f").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("a").collect()
        assert all(x["b"] < y["a"] for x, y in zip(parts, parts[1:])) and spark.table("places_sorted").count() == 20
    finally:
        spark.sql("DROP TABLE places_sorted")
