import random
import zlib

import pytest

from terrane.llm import toxicity
from tests.conftest import DATA
from tests.llm import data

RUDE = ["blockhead", "nitwit", "numbskull"]


def labelled(n=600, seed=2):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        words = data.prose(rng, rng.randint(20, 200)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(RUDE)
        rows.append((i, " ".join(words), "en", "s", 0))
        marks.append((i, 1, int(toxic)))
    return rows, marks


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def scored(spark):
    rows, marks = labelled()
    out = toxicity.toxicity(data.frame(spark, rows, True), data.labels(spark, marks)).collect()
    return {r["doc_id"]: r for r in out}, dict((i, t) for i, _, t in marks)


def test_held_out_accuracy(scored):
    out, truth = scored
    mine = [i for i in truth if held(i)]
    assert len(mine) > 100 and sum(out[i]["predicted"] == truth[i] for i in mine) >= 0.97 * len(mine)
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in out.items())


def test_held_out_labels_are_not_learned(spark, scored):
    rows, marks = labelled()
    turned = [(i, q, 1 - t if held(i) else t) for i, q, t in marks]
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(data.frame(spark, rows), data.labels(spark, turned)).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in scored[0].items())


def test_awkward_rows_and_tables(spark):
    rows, marks = labelled(200)
    shifted = [(None if i is None else 1000 + i, *r) for i, *r in data.awkward()]
    out = toxicity.toxicity(data.frame(spark, rows + shifted, True), data.labels(spark, marks + [(None, 1, 1), (5, None, None), (3, 1, 1), (3, 1, 0)])).collect()
    assert len(out) == len(rows) + len(shifted) and all(r["score"] is not None for r in out)
    assert toxicity.toxicity(data.frame(spark, []), data.labels(spark, marks)).count() == 0
    for few in ([], [(1, 1, 1)], [(2, 1, 0), (3, 1, 0)]):
        assert {r["predicted"] for r in toxicity.toxicity(data.frame(spark, rows[:20]), data.labels(spark, few)).collect()} == {0}


def test_every_word_of_a_long_text_counts():
    scorer = toxicity.Scorer(*toxicity.fit({g: (9, 0) for g in toxicity.grams("kind")} | {g: (0, 9) for g in toxicity.grams("nitwit")}), [-4.0, 0.0, 0.0, 0.0, 4.0])
    assert scorer.score("kind " * 50_000) < 0.5 < scorer.score("kind " * 50_000 + "nitwit nitwit nitwit")


def test_ratio_is_none_where_neither_class_knows_better():
    ratio, rest = toxicity.fit({g: (7, 7) for g in toxicity.grams("shared")})
    assert all(abs(r) < 1e-12 for r in ratio.values()) and all(abs(r) < 1e-12 for r in rest.values())
    ratio, _ = toxicity.fit({g: (0, 5) for g in toxicity.grams("nitwit")} | {g: (5, 0) for g in toxicity.grams("nitrate")})
    assert ratio["^nitwi"[-6:]] > 0 > ratio["^nitra"[-6:]]


def slow_probability(counts, types, c, h, x, discount=0.75):
    """P_c(x | h) by the definition: interpolated absolute discounting over shared Kneser-Ney continuation probabilities."""

    def low(h, x):
        k = len(h) + 1
        tails = {g[-k - 1 :] for g in types}
        n = {y: sum(t[1:] == h + y for t in tails) for y in {t[-1] for t in tails if t[1:-1] == h}}
        letters = len({t[-1] for t in types})
        shorter = low(h[1:], x) if h else 1 / letters
        whole = sum(n.values())
        return max(n.get(x, 0) - discount, 0) / whole + discount * len(n) / whole * shorter if whole else shorter

    own = {g[-1]: n[c] for g, n in counts.items() if g[:-1] == h and n[c]}
    if not own:
        return low(h[1:], x)
    return max(own.get(x, 0) - discount, 0) / sum(own.values()) + discount * len(own) / sum(own.values()) * low(h[1:], x)


def test_probabilities_sum_to_one_and_ratios_follow_the_definition():
    """Interpolated Kneser-Ney with the corpus's continuation counts: of all letters, the probabilities of a class are one."""
    import math

    counts = {}
    for n, w in enumerate(("anna", "annual", "banner", "nanna"), 1):
        for g in toxicity.grams(w):
            a, b = counts.get(g, (0, 0))
            counts[g] = (a + n, b + (n % 2) * 3)
    types = set(counts) | {g for w in ("bandana", "annex", "manual") for g in toxicity.grams(w)}
    ratio, rest = toxicity.fit(counts, toxicity.continuations(types))
    letters = {g[-1] for g in types}
    for h in {g[:-1] for g in counts}:
        p = [{x: slow_probability(counts, types, c, h, x) for x in letters} for c in (0, 1)]
        assert all(abs(sum(q.values()) - 1) < 1e-9 for q in p)
        for x in letters:
            mine = ratio[h + x] if h + x in ratio else rest.get(h, 0.0)
            assert abs(mine - math.log(p[1][x] / p[0][x])) < 1e-9


def test_shared_counts_come_from_all_documents(spark):
    rows = data.corpus(80) + data.awkward()
    sample = sorted({g for t in ("stonely river", "harbours") for w in t.split() for g in toxicity.grams(w)})
    types = {g for r in rows for w in toxicity.WORDS.findall((r[1] or "").lower()) for g in toxicity.grams(w)}
    contexts = {g[-k:-1] for g in sample for k in range(1, toxicity.ORDER)}
    expected = {s: n for s, n in toxicity.continuations(types).items() if s[:-1] in contexts}
    for room in (500_000, 3):
        assert toxicity._corpus_counts(data.frame(spark, rows), spark.createDataFrame([(g,) for g in sample], "g string"), room=room) == expected


def test_query_and_stage(spark):
    d = f"{DATA}/sf0.01"
    out = toxicity.op3_toxicity(spark, d).collect()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    mine = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(out) == 1000 and sum(r["predicted"] == truth[r["doc_id"]] for r in mine) >= 0.93 * len(mine)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = toxicity.stage(spark, docs, d)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out if not r["predicted"]}
