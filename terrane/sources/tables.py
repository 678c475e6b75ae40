"""Tables and files beside geometry tables: sorted native tables, CSV and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create_table(df: DataFrame, name: str, key: str, mode: str = "error") -> None:
    """CREATE TABLE AS SELECT, lying in the order of ``key``: range-partitioned, so that files hold few keys each."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode).saveAsTable(name)


def write_csv(df: DataFrame, path: str, geometry: list[str] | None = None, mode: str = "error") -> None:
    """CSV with a header; geometry columns as EWKT."""
    from terrane.functions import spatial as S

    df.withColumns({g: S.st_asewkt(F.col(g)) for g in geometry or []}).write.mode(mode).csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str, geometry: list[str] | None = None) -> DataFrame:
    """CSV with a header, of a given schema (nothing is inferred); geometry columns are EWKT strings there."""
    from terrane.functions import spatial as S

    df = spark.read.schema(schema).csv(path, header=True)
    return df.withColumns({g: S.st_geomfromtext(F.col(g)) for g in geometry or []})


def write_json_lines(df: DataFrame, path: str, geometry: list[str] | None = None, mode: str = "error") -> None:
    """A JSON object a line; geometry columns as EWKT."""
    from terrane.functions import spatial as S

    df.withColumns({g: S.st_asewkt(F.col(g)) for g in geometry or []}).write.mode(mode).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str, geometry: list[str] | None = None) -> DataFrame:
    """A JSON object a line, of a given schema (nothing is inferred); geometry columns are EWKT strings there."""
    from terrane.functions import spatial as S

    df = spark.read.schema(schema).json(path)
    return df.withColumns({g: S.st_geomfromtext(F.col(g)) for g in geometry or []})
