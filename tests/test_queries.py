import pytest

import __spark_entry__ as entry
from terrane.plans import functions, relational, sql, tables, trips
from tests.conftest import DATA
from tests.oracle import same


PLANS = (trips, sql, functions, relational, tables)
QUERIES = {k: v for p in PLANS for k, v in p.QUERIES.items()}
SQL = {k: v for p in PLANS for k, v in p.SQL.items()}


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, name):
    same(spark, f"{DATA}/sf0.001", QUERIES[name], SQL[name])


@pytest.mark.parametrize("small", ["0", "8388608"])
@pytest.mark.parametrize("name", ["sql_q4", "sql_q8", "sql_q11", "sql_near", "q8", "q9"])
def test_spatial_joins_pair_by_index_or_cells(spark, name, small):
    """Never by all pairs, and the answer is the same either way."""
    spark.conf.set("terrane.index.bytes", small)
    try:
        df = QUERIES[name](spark, f"{DATA}/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and ("Kernels.cells" if small == "0" else "Kernels.matches") in plan
        same(spark, f"{DATA}/sf0.001", QUERIES[name], SQL[name])
    finally:
        spark.conf.unset("terrane.index.bytes")


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
