import numpy as np
import pytest
from pyspark.sql import types as T

from terrane.llm import vectors
from tests.conftest import DATA

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows, threshold=0.98):
    def cosine(a, b):
        a, b = np.array(a, float), np.array(b, float)
        return float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))

    usable = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    links, root = {id(r): 0 for r in rows}, {id(r): r[0] for r in rows}
    pairs = [(a, b) for i, a in enumerate(usable) for b in usable[:i] if a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= threshold]
    for a, b in pairs:
        links[id(a)] += 1
        links[id(b)] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[id(a)], root[id(b)])
            changed |= root[id(a)] != low or root[id(b)] != low
            root[id(a)] = root[id(b)] = low
    return [(r[0], links[id(r)], root[id(r)], r[0] == root[id(r)]) for r in rows]


def cloud(n, seed=3, groups=25):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, 32))
    return [[i, (centres[i % groups] + rng.standard_normal(32) * rng.choice([0.02, 0.1, 0.17, 1.5])).astype(np.float32).tolist(), i % 3] for i in range(n)]


def test_recall_and_no_false_link(spark):
    rows = cloud(900)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df, leaf=16, part=64).collect()}
    expected = {r[0]: r for r in brute(rows)}
    assert all(got[i]["n_links"] <= e[1] for i, e in expected.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(e[1] for e in expected.values()) > 0
    assert sum(got[i]["component_id"] == e[2] for i, e in expected.items()) >= 0.97 * len(rows)


def test_trees_hold_every_row_and_route_alike():
    rng = np.random.default_rng(4)
    x = vectors.units(rng.standard_normal((4000, 16)))
    nodes, leaves = vectors.grow(x, 4000, 100, 0.02, (1, 2))
    assert max(len(r) for _, r in leaves) <= 100 and set(np.concatenate([r for _, r in leaves]).tolist()) == set(range(4000))
    again = dict(vectors.route(x, np.arange(4000), nodes, 0.02, (1, 2)))
    assert all((again[node] == rows).all() for node, rows in leaves)
    assert sum(len(r) for _, r in leaves) < 2 * 4000  # spill is a band around each median


def test_dense_groups_are_not_split():
    rng = np.random.default_rng(5)
    x = vectors.units(np.ones(16) + rng.standard_normal((500, 16)) * 0.01)
    assert len(vectors.grow(x, 500, 16, 0.2 / 4, (1,))[1]) == 1


def test_cells_dealt_over_tasks_lose_few_links(spark):
    """A label of many times ``part``, with a dense group that cannot be split."""
    rows = cloud(1500, groups=200)
    rng = np.random.default_rng(6)
    rows += [[5000 + i, (np.ones(32) + rng.standard_normal(32) * 0.02).astype(np.float32).tolist(), 1] for i in range(200)]
    rows = [[i, v, 1] for i, v, _ in rows]
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), leaf=16, part=60, sample=640).collect()}
    expected = {r[0]: r for r in brute(rows)}
    assert all(got[i]["n_links"] <= e[1] for i, e in expected.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(e[1] for e in expected.values())
    assert {(got[5000 + i]["n_links"], got[5000 + i]["component_id"]) for i in range(200)} == {(199, 5000)}


def test_small_tables_are_exact(spark):
    nan, inf = float("nan"), float("inf")
    rows = [[1, [1.0, 0.0], 0], [2, [2.0, 0.0], 0], [3, [1.0, 0.0], 0], [3, [1.0, 0.0], 0], [4, [1.0, 0.0], 1], [5, [0.0, 0.0], 0], [6, None, 0], [7, [1.0, None], 0], [8, [nan, 1.0], 0], [9, [inf, 1.0], 0],
            [10, [1.0, 0.0], None], [11, [1.0, 0.0, 0.0], 0], [12, [1.0, 0.01], 0], [13, [-1.0, 0.0], 0], [None, [1.0, 0.0], 0], [14, [], 0], [15, [1e-30, 0.0], 0], [16, [3e38, 0.0], 0]]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: __import__("pyspark").sql.functions.lit("own") for c in ("n_links", "rep", "many", "id", "v", "k1")})
    got = sorted(map(tuple, vectors.near_duplicates(df).collect()), key=str)
    expected = sorted(brute(rows), key=str)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    assert vectors.near_duplicates(df.where("vec_id = 6")).collect()[0]["kept"]


def test_large_leaves_are_dealt_in_parts(spark):
    rng = np.random.default_rng(1)
    rows = [[i, (np.ones(8) + rng.standard_normal(8) * 0.01).astype(np.float32).tolist(), 0] for i in range(300)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), leaf=1000, part=50).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(299, 0)}


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_query(spark, sf):
    out = vectors.op5_embedding_near_dedup(spark, f"{DATA}/{sf}").collect()
    rows = [list(r) for r in spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    x, label = vectors.units(np.array([r[1] for r in rows])), np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    expected = dict(zip([r[0] for r in rows], (near.sum(axis=1) - 1).tolist()))
    assert sum(r["n_links"] for r in out) >= 0.9 * sum(expected.values()) and all(r["n_links"] <= expected[r["vec_id"]] for r in out)
