import re
from collections import defaultdict

import pytest

from terrane.llm import mixing
from tests.conftest import DATA
from tests.llm import data


def slow_targets(sizes, cap=3):
    """Share by weight, cap, share the excess again among the others, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s] + 1e-9}
        if not over:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


@pytest.mark.parametrize("rows", [data.corpus(200), data.awkward(), data.corpus(30) + [(500 + i, "few words", "en", "zz", 0) for i in range(3)]], ids=["even", "awkward", "small source"])
@pytest.mark.parametrize("clashing", [False, True])
def test_mix(spark, rows, clashing):
    out = mixing.mix(data.frame(spark, rows, clashing)).collect()
    assert len(out) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        assert r["size"] == count(r["text"]) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    expected = slow_targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - expected[r["source"]]) < 1e-6
    for s, t in taken.items():
        assert abs(t - expected[s]) <= 2
    epochs = defaultdict(set)
    for r in out:
        if r["size"]:
            epochs[r["source"]].add(r["taken"] // r["size"])
    assert all(max(e) - min(e) <= 1 for e in epochs.values())  # complete epochs come first


def test_order_is_by_keys_and_reruns_agree(spark):
    df = data.frame(spark, data.corpus(300))
    once, again = (sorted(map(tuple, mixing.mix(d).select("doc_id", "taken").collect())) for d in (df, df.repartition(7)))
    assert once == again
    drawn = mixing._drawn(df, 20, None).select("doc_id", "_source", "_key", "_size").collect()
    taken = dict(once)
    for s in {r["_source"] for r in drawn}:
        part = [taken[r["doc_id"]] % r["_size"] if taken[r["doc_id"]] % r["_size"] else taken[r["doc_id"]] // r["_size"] for r in sorted((r for r in drawn if r["_source"] == s), key=lambda r: r["_key"])]
        whole = [taken[r["doc_id"]] / r["_size"] for r in sorted((r for r in drawn if r["_source"] == s), key=lambda r: r["_key"])]
        assert whole == sorted(whole, reverse=True) and len(part) == len(whole)


def test_documents_of_the_mix(spark):
    df = data.frame(spark, data.corpus(60) + data.awkward(), True)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = defaultdict(int)
    for r in out.collect():
        assert r["size"] == "own size" and r["target"] == "own target"
        words[(r["doc_id"], r["source"])] += count(r["text"])
    expected = defaultdict(int)
    for r in mixing.mix(df.drop(*data.CLASHING)).collect():
        expected[(r["doc_id"], r["source"])] += r["taken"]
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in expected.items() if v}


def test_heavier_documents_come_earlier(spark):
    from pyspark.sql import functions as F

    rows = [(i, "w " * 10, "en", "a" if i < 400 else "b", 0) for i in range(800)]
    out = mixing.mix(data.frame(spark, rows), weight=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1)).where("source = 'a'").collect()
    heavy = sum(r["taken"] for r in out if r["doc_id"] % 2 == 0)
    assert heavy > 0.7 * sum(r["taken"] for r in out)


def test_empty(spark):
    assert mixing.mix(data.frame(spark, [])).count() == 0 and mixing.mixed_documents(data.frame(spark, [])).count() == 0


def test_query(spark):
    out = mixing.op8_mix_sources(spark, f"{DATA}/sf0.001")
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and out.count() == 200


def test_shares_are_those_of_the_mix(spark):
    df = data.frame(spark, data.corpus(120) + data.awkward(), True)
    names = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(str, mixing.shares(df).collect())) == sorted(map(str, mixing.mix(df).select(names).collect()))


def test_many_sources(spark):
    """As many sources as hosts: ranks and levels come out without a task that sees them all."""
    rows = [(i, "w " * (1 + i * i % 97), "en", f"h{i % 400}", 0) for i in range(900)]
    out = mixing.mix(data.frame(spark, rows)).collect()
    sizes = defaultdict(int)
    for r in out:
        sizes[r["source"]] += r["size"]
    expected = slow_targets(sizes)
    assert all(abs(r["target"] - expected[r["source"]]) < 1e-6 for r in out)


def test_sizes_and_targets_match_sql(spark):
    import duckdb

    out = mixing.op8_mix_sources(spark, f"{DATA}/sf0.01").select("doc_id", "size", "source_size").toPandas()
    sql = f"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM '{DATA}/sf0.01/documents.parquet')
      SELECT doc_id, size, sum(size) OVER (PARTITION BY source) AS source_size FROM s"""
    expected = duckdb.sql(sql).df()
    assert sorted(map(tuple, out.astype(int).to_numpy().tolist())) == sorted(map(tuple, expected.astype(int).to_numpy().tolist()))
