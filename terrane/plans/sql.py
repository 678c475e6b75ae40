"""Spatial joins as SQL text: the optimizer rule plans them, be they JOIN .. ON, comma joins, outer, semi or anti joins."""

from __future__ import annotations

from terrane.functions import spatial as S
from terrane.plans import trips

TEXTS = {
    "sql_q4": """SELECT z_zonekey, z_name, count(*) AS trip_count FROM (SELECT * FROM {trip} ORDER BY t_tip DESC, t_tripkey LIMIT 1000) top
        JOIN {zone} z ON st_within(top.t_pickuploc, z.z_boundary) GROUP BY z_zonekey, z_name ORDER BY trip_count DESC, z_zonekey""",
    "sql_q8": """SELECT b_buildingkey, b_name, count(*) AS nearby_pickup_count FROM {trip} t, {building} b
        WHERE st_dwithin(t.t_pickuploc, b.b_boundary, 0.5) GROUP BY b_buildingkey, b_name ORDER BY nearby_pickup_count DESC, b_buildingkey LIMIT 100""",
    "sql_q10": """SELECT z_zonekey, z_name AS pickup_zone, round(avg((unix_micros(cast(t_dropofftime AS timestamp)) - unix_micros(cast(t_pickuptime AS timestamp))) / 1e6D), 6) AS avg_duration_seconds,
        round(avg(t_distance), 6) AS avg_distance, count(t_tripkey) AS num_trips FROM {zone} z LEFT JOIN {trip} t ON st_within(t.t_pickuploc, z.z_boundary)
        GROUP BY z_zonekey, z_name ORDER BY avg_duration_seconds DESC NULLS LAST, z_zonekey LIMIT 100""",
    "sql_q11": """SELECT count(*) AS cross_zone_trip_count FROM {trip} t, {zone} a, {zone} b
        WHERE st_within(t.t_pickuploc, a.z_boundary) AND st_contains(b.z_boundary, t.t_dropoffloc) AND a.z_zonekey <> b.z_zonekey""",
    "sql_near": """SELECT t_tripkey, b_buildingkey FROM {trip} t JOIN {building} b ON st_distance(t.t_pickuploc, b.b_boundary) < 0.25D""",
    "sql_semi": """SELECT t_tripkey FROM {trip} t LEFT SEMI JOIN {zone} z ON st_intersects(z.z_boundary, t.t_pickuploc)""",
    "sql_anti": """SELECT t_tripkey FROM {trip} t LEFT ANTI JOIN {zone} z ON st_intersects(z.z_boundary, t.t_pickuploc)""",
}


def run(spark, sf_dir: str, text: str):
    S.register(spark)
    tables = {n: f(spark, sf_dir) for n, f in (("trip", trips.trip), ("zone", trips.zone), ("building", trips.building)) if f"{{{n}}}" in text}
    return spark.sql(text, **tables)


QUERIES = {name: lambda s, d, text=text: run(s, d, text) for name, text in TEXTS.items()}

_IN = "px >= z.x0 AND px <= z.x1 AND py >= z.y0 AND py <= z.y1"
SQL = {
    **{f"sql_{q}": trips.SQL[q] for q in ("q4", "q8", "q10", "q11")},
    "sql_near": f"""WITH {trips.TRIP_SQL}, {trips.BUILDING_SQL} SELECT t_tripkey, b_buildingkey FROM trip JOIN building b
  ON px BETWEEN b.x0 - 0.25 AND b.x1 + 0.25 AND py BETWEEN b.y0 - 0.25 AND b.y1 + 0.25
  AND sqrt(pow(greatest(b.x0 - px, 0, px - b.x1), 2) + pow(greatest(b.y0 - py, 0, py - b.y1), 2)) < 0.25""",
    "sql_semi": f"WITH {trips.TRIP_SQL}, {trips.ZONE_SQL} SELECT t_tripkey FROM trip WHERE EXISTS (SELECT 1 FROM zone z WHERE {_IN})",
    "sql_anti": f"WITH {trips.TRIP_SQL}, {trips.ZONE_SQL} SELECT t_tripkey FROM trip WHERE NOT EXISTS (SELECT 1 FROM zone z WHERE {_IN})",
}
