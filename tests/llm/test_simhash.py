import random
import re

import numpy as np
import pytest
import xxhash

from terrane.llm import common, simhash
from tests.llm import data


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", lower)
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(points, radius=4):
    """(id, fingerprint) → id → smallest id reachable."""
    of = list(range(len(points)))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, (_, a) in enumerate(points):
        for j, (_, b) in enumerate(points[:i]):
            if (a ^ b).bit_count() <= radius:
                x, y = find(i), find(j)
                of[max(x, y)] = min(x, y)
    groups = {}
    for i, (k, _) in enumerate(points):
        groups.setdefault(find(i), []).append(k)
    return {k: min(g) for g in groups.values() for k in g}


@pytest.mark.parametrize("clashing", [False, True])
def test_equals_brute_force(spark, clashing):
    rng = random.Random(4)
    rows = data.corpus(40, words=60)
    for i, t, *rest in data.corpus(40, words=60):  # near copies: one word changed
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w), *rest))
    rows += [(300 + i, *r) for i, *r in data.awkward() if i is not None and i > 6] + [(200, None, None, None, None), (201, "", "", "", 0)]
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(data.frame(spark, rows, clashing)).collect()}
    prints = {r[0]: slow_fingerprint(r[1]) for r in rows}
    component = brute(sorted(prints.items()))
    assert got == {k: (prints[k], component[k]) for k in prints}


def jaccard(a, b, k=5):
    one, two = (set(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) for w in ((t or "").lower().split() for t in (a, b)))
    return len(one & two) / len(one | two)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 200])
def test_majority_equals_counting(n):
    rows = np.random.default_rng(n).integers(0, 1 << 63, (n, 3), dtype=np.uint64) * np.uint64(2)
    bits = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")
    assert (np.unpackbits(simhash._majority(rows).view(np.uint8), bitorder="little") == (2 * bits.sum(axis=0) > n)).all()


@pytest.mark.parametrize("part", [2048, 4])
def test_near_copies_of_a_similarity(spark, part):
    """Copies of 0.85 and more are found, texts under 0.6 are left alone, whatever the size of buckets."""
    rng = random.Random(11)
    rows = [(i, data.prose(rng, rng.randint(60, 200)), "en", "s", 0) for i in range(60)]
    for c in range(4):
        for i in range(60):
            w = rows[i][1].split()
            for _ in range(rng.randint(0, len(w) // 60)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((100 * (c + 1) + i, " ".join(w), "en", "s", 0))
    df = data.frame(spark, rows)
    if part == 2048:
        of = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    else:
        fps = spark.createDataFrame([(bytearray(simhash.wide_fingerprint(t.encode())), i) for i, t, *_ in rows], "fp binary, rep long").groupBy("fp").agg({"rep": "min"}).toDF("fp", "rep")
        found = {r["node"]: r["component"] for r in common.connected_components(simhash.near_links(fps, 0.8, part=part)).collect()}
        first = {}
        for i, t, *_ in rows:
            first[t] = min(first.get(t, i), i)
        of = {i: found.get(first[t], first[t]) for i, t, *_ in rows}
    text = {r[0]: r[1] for r in rows}
    near = [(a, b) for a in text for b in text if a < b and a % 100 == b % 100]
    assert sum(of[a] == of[b] for a, b in near if jaccard(text[a], text[b]) >= 0.85) >= 0.99 * sum(jaccard(text[a], text[b]) >= 0.85 for a, b in near) > 0
    assert all(of[a] % 100 == a % 100 for a in text)


def test_dealt_buckets_lose_no_pair(spark):
    """Single near pairs inside one large cluster whose members are below the threshold to each other."""
    rng = np.random.default_rng(3)
    free = np.arange(1024) >= 288  # all blocks lie before these bits, so that every bucket holds the whole cluster
    cluster = (rng.random(1024) < 0.5) ^ (free & (rng.random((300, 1024)) < 0.28))
    copies = cluster[:40] ^ (free & (rng.random((40, 1024)) < 0.1))
    rows = [(bytearray(np.packbits(x, bitorder="little").tobytes()), i) for i, x in enumerate(np.concatenate([cluster, copies]))]
    fps = spark.createDataFrame(rows, "fp binary, rep long")
    whole, dealt = ({r["node"]: r["component"] for r in common.connected_components(simhash.near_links(fps, 0.8, part=part)).collect()} for part in (2048, 20))
    assert dealt == whole and all(whole.get(i) == whole.get(300 + i) == i for i in range(40))


def test_near_copies_of_awkward_rows(spark):
    by = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(data.frame(spark, data.awkward(), True)).collect()}
    assert by[8] == by[7] == 7 and by[1] == by[2] == by[3] == 1 and by[4] == by[5] == by[6] == 4 and by[9] == 9
    assert simhash.near_copies(data.frame(spark, [])).count() == 0


def test_awkward_rows(spark):
    out = simhash.near_duplicates(data.frame(spark, data.awkward(), True)).collect()
    assert len(out) == len(data.awkward())
    by = {r["doc_id"]: r["component_id"] for r in out}
    assert by[2] == by[3] == by[1] == 1 and by[5] == by[4] and all(r["component_id"] is not None for r in out if r["doc_id"] is not None)
    assert simhash.near_duplicates(data.frame(spark, [])).count() == 0


def test_stage_keeps_the_smallest_and_all_columns(spark):
    df = data.frame(spark, [(3, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "quite another text than that", "en", "s", 1), (None, "a b c d e f", "en", "s", 1)], True)
    out = simhash.stage(spark, df, "")
    assert out.columns == df.columns and sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 2]


@pytest.mark.parametrize("n", [10, 30_000_000, 10**10, 10**13])
def test_blocks_lose_no_pair(n):
    rng = random.Random(n)
    parts = simhash.blocks(n, 4)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        ka, kb = (np.array([simhash._keys(np.array([x], np.uint64), p)[0] for p in parts]) for x in (a, b))
        assert (ka == kb).any()


@pytest.mark.parametrize("part", [16_384, 20])
def test_streamed_buckets_lose_no_pair(spark, part):
    """Batches far smaller than a bucket: the window that is carried on must hold every partner."""
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 300:
        x = rng.choice(sorted(fps))
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            x ^= 1 << bit
        fps.add(x)
    points = list(enumerate(sorted(fps)))
    signed = [(x - (1 << 64) if x >= 1 << 63 else x, i) for i, x in points]
    links = simhash.links(spark.createDataFrame(signed, "fp long, rep long").repartition(2), batch=7, part=part)
    got = {r["node"]: r["component"] for r in common.connected_components(links).collect()}
    expected = brute(points)
    assert {k: got.get(k, k) for k in expected} == expected


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (None, 3), (1001, 2000)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(200)) and got[2000] == 1000 and len(got) == 262
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
