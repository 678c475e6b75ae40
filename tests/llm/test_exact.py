import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.llm import exact
from tests.conftest import DATA
from tests.llm import data
from tests.oracle import same


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    out = []
    for r in rows:
        own = [x[0] for x in rows if norm(x[1]) == norm(r[1])]
        ids = [i for i in own if i is not None]
        keep = min(ids) if ids else None
        out.append((r[0], keep, len(own), r[0] == keep, hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [data.awkward(), data.corpus(40) + [(100 + i, t, *x) for i, t, *x in data.corpus(40)], []], ids=["awkward", "copies", "empty"])
@pytest.mark.parametrize("clashing", [False, True])
def test_equals_brute_force(spark, rows, clashing):
    got = exact.exact_duplicates(data.frame(spark, rows, clashing)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_tight_budget_spills_and_agrees(spark):
    rows = data.corpus(80) + data.corpus(80)
    got = exact.owners(data.frame(spark, rows), budget=500).select("id", "n").collect()
    assert sorted((r["id"], r["n"]) for r in got) == [(i, 2) for i in range(80)]


def test_one_row_of_each_text_stays_as_it_was(spark):
    df = data.frame(spark, data.awkward(), clashing=True)
    out = exact.distinct_documents(df)
    assert out.columns == df.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert sorted(k for k in rows if k is not None) == [1, 3, 4, 6, 7, 8, 9, 10, 11]
    assert rows[4]["text"] == "one two  three" and rows[4]["n"] == "own n" and rows[1]["text"] is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=40))
def test_trie_holds_smallest_and_count(keys):
    trie = exact.Trie()
    for i, k in enumerate(keys):
        trie.insert(k, [len(keys) - i, 1, None])
    found = {k: (o[0], o[1]) for k, o in trie.spill(-1)}
    assert found == {k: (min(len(keys) - i for i, x in enumerate(keys) if x == k), keys.count(k)) for k in set(keys)}


def test_matches_sql(spark):
    same(spark, f"{DATA}/sf0.001", exact.op2_exact_dedup, exact.OP2_SQL)
