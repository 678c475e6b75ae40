"""Tables written and read again: geometry tables that are pruned by boxes, sorted tables, CSV and JSON lines.

The files go to the warehouse, which executors share, and are deleted when the session's process ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import functions as F

from terrane.functions import spatial as S
from terrane.plans import trips
from terrane.sources import geo, tables

_written: list[tuple] = []


def _place(spark, name: str) -> str:
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/terrane-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def clear() -> None:
    """Delete what this process has written."""
    while _written:
        spark, path = _written.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended before its process
            return


def tab_geometry_pruned(spark, sf_dir):
    """Buildings that meet a window, from a table in Z-order: boxes prune row groups before the exact predicate."""
    path = _place(spark, "buildings")
    geo.write_geo(trips.building(spark, sf_dir), path, "b_boundary", files=4)
    return geo.where_spatial(geo.read_geo(spark, path), "intersects", "b_boundary", trips.rectangle(*trips.WINDOW)).select("b_buildingkey")


def tab_trips_near_point(spark, sf_dir):
    """The first trip query over a geometry table of trips."""
    path = _place(spark, "trips")
    geo.write_geo(trips.trip(spark, sf_dir), path, "t_pickuploc")
    return trips.q1_trips_near_point(geo.read_geo(spark, path))


def tab_csv(spark, sf_dir):
    path = _place(spark, "csv")
    tables.write_csv(trips.zone(spark, sf_dir), path, ["z_boundary"])
    back = tables.read_csv(spark, path, "z_zonekey bigint, z_name string, z_boundary string", ["z_boundary"])
    return back.select("z_zonekey", "z_name", S.st_area(F.col("z_boundary")).alias("area"))


def tab_json_lines(spark, sf_dir):
    path = _place(spark, "json")
    tables.write_json_lines(trips.zone(spark, sf_dir), path, ["z_boundary"])
    back = tables.read_json_lines(spark, path, "z_zonekey bigint, z_name string, z_boundary string", ["z_boundary"])
    return back.select("z_zonekey", "z_name", S.st_area(F.col("z_boundary")).alias("area"))


def tab_sorted(spark, sf_dir):
    """CREATE TABLE AS SELECT in the order of a key, and a range of it read back."""
    name = f"terrane_{uuid.uuid4().hex}"
    tables.create_table(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal"), name, "c_acctbal")
    _written.append((spark, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}"))
    return spark.table(name).where("c_acctbal BETWEEN 1000 AND 2000").select("c_custkey", "c_name")


QUERIES = {"tab_geometry_pruned": tab_geometry_pruned, "tab_trips_near_point": tab_trips_near_point, "tab_csv": tab_csv, "tab_json_lines": tab_json_lines, "tab_sorted": tab_sorted}

_ZONES = f"WITH {trips.ZONE_SQL} SELECT z_zonekey, z_name, side * side AS area FROM zone"
SQL = {
    "tab_geometry_pruned": f"WITH {trips.BUILDING_SQL} SELECT b_buildingkey FROM building WHERE x0 <= 50 AND x1 >= 20 AND y0 <= 50 AND y1 >= 20",
    "tab_trips_near_point": trips.SQL["q1"], "tab_csv": _ZONES, "tab_json_lines": _ZONES,
    "tab_sorted": "SELECT c_custkey, c_name FROM customer WHERE c_acctbal BETWEEN 1000 AND 2000",
}
