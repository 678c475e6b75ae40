import hashlib
from collections import defaultdict

import corpus_pipeline
from terrane.llm import common, exact, toxicity
from tests.conftest import DATA
from tests.llm import data
from tests.llm.test_mixing import count, slow_targets
from tests.llm.test_packing import check, tokenizer  # noqa: F401
from tests.llm.test_simhash import jaccard
from tests.llm.test_toxicity import labelled


def stages(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), name)
        yield name, docs


def test_each_stage_against_brute_force(spark, tmp_path, tokenizer):  # noqa: F811
    rows, marks = labelled(240)
    rows += [(1000 + i, t, *rest) for i, t, *rest in rows[:60]] + [(2000 + i, t + " tail", *rest) for i, t, *rest in rows[:60]] + [(None if i is None else 3000 + i, *r) for i, *r in data.awkward()]
    d = str(tmp_path)
    data.frame(spark, rows, True).write.parquet(f"{d}/documents.parquet")
    data.labels(spark, marks).write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = [tuple(r)[:5] for r in docs.collect()]
    for name, out in stages(spark, docs, d):
        if name == "best_fit_packing":
            check(out.collect(), before, tokenizer)
            continue
        assert out.columns == docs.columns
        after = [tuple(r)[:5] for r in out.collect()]
        if name == "toxicity":
            scorer = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
            expected = [r for r in before if scorer.score(r[1] or "") < 0.7]
            assert 0 < len(expected) < len(before)
        elif name == "exact_dedup":
            first = {}
            for r in before:
                key = exact.normal((r[1] or "").encode())
                first[key] = min(first.get(key, r), r, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
            expected = list(first.values())
        elif name == "simhash_near_dedup":
            kept = {r[0] for r in after}
            for r in before:
                partners = [(jaccard(r[1], o[1]), o[0]) for o in before if o[0] != r[0] and o[0] is not None] if r[0] is not None else []
                if r[0] not in kept:
                    assert max(partners)[0] >= 0.6
                assert not any(j >= 0.9 and o in kept for j, o in partners) or r[0] not in kept
            assert len(kept) < len(before) and set(after) <= set(before)
            expected = after
        else:
            sizes, taken, whole = defaultdict(int), defaultdict(int), {(r[0], r[3]): r[1] for r in before}
            for r in before:
                sizes[r[3]] += count(r[1])
            for r in after:
                taken[r[3]] += count(r[1])
                assert r[1] == whole[(r[0], r[3])] or whole[(r[0], r[3])].split()[: count(r[1])] == r[1].split()
            assert all(abs(t - taken[s]) <= 2 for s, t in slow_targets(sizes).items())
            expected = after
        assert sorted(map(str, after)) == sorted(map(str, expected))
        before = after


def test_run_is_the_stages(spark):
    d = f"{DATA}/sf0.001"
    run = corpus_pipeline.run(spark, d)
    *_, (_, last) = stages(spark, common.read(spark, d, "documents"), d)
    digest = lambda df: hashlib.sha256("\n".join(sorted(str((r["doc_id"], r["piece"], r["ids_crc32"])) for r in df.collect())).encode()).hexdigest()
    assert digest(run) == digest(last) and corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, tmp_path):
    d = str(tmp_path)
    data.frame(spark, []).write.parquet(f"{d}/documents.parquet")
    data.labels(spark, [(1, 1, 1)]).write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
