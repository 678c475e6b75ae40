import random

import pytest
from terrane.llm import licenses
from tests.conftest import DATA
from tests.llm import data

#: Notices in words of their own, held out from the training texts.
HELD_OUT = [
    ("apache", "This file is made available under the Apache License, Version 2.0; you may not use it except in compliance with the License."),
    ("mit", "The code is released under the terms of the MIT License."),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License, version 3, as published by the Free Software Foundation."),
    ("bsd", "Redistribution and use in source and binary forms, with or without changes, are permitted provided that these conditions are met."),
    ("cc", "This photo is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl", "This form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(2)
    rows = data.corpus(80)
    for i, (_, text) in enumerate(HELD_OUT):
        rows.append((100 + i, "\n".join([data.prose(rng, 30), text, data.prose(rng, 40)]), "en", "s", 0))
    rows += [(200, "All rights reserved by the people of the town.\nThe fishing license was issued on Monday.", "en", "s", 0)]
    rows += [(300 + (i or 0), *r) for i, *r in data.awkward()]
    out = licenses.scan(data.frame(spark, rows, True)).collect()
    assert len(out) == len(rows)
    return {r["doc_id"]: r for r in out}


def test_held_out_notices(found):
    assert sum(found[100 + i]["license"] == family for i, (family, _) in enumerate(HELD_OUT)) >= len(HELD_OUT) - 1
    assert all(found[100 + i]["found"][0]["paragraph"] == 1 for i in range(len(HELD_OUT)) if found[100 + i]["license"])


def test_others_are_clean_or_unknown(found):
    assert all(found[i]["license"] is None for i in range(80)) and found[200]["license"] in (None, "unknown")
    assert all(found[300 + i]["license"] is None for i in range(12) if 300 + i in found)


def test_empty_and_native(spark):
    assert licenses.scan(data.frame(spark, [])).count() == 0
    plan = licenses.op1_license_scan(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_corpus_lines(spark):
    lines = {"cc": "Licensed under CC BY-NC 4.0.", "gpl": "GNU General Public License, version 3", "apache": "Apache License, Version 2.0", "mit": "Released under the MIT License."}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    for r in licenses.op1_license_scan(spark, f"{DATA}/sf0.01").collect():
        true = next((k for k, v in lines.items() if v in texts[r["doc_id"]]), None)
        assert r["license"] == true


VERBATIM = {f: t for f, t in ((f, [x for x in texts if len(licenses.words(x)) > 5]) for f, texts in licenses.NOTICES.items())}


def test_anchors_miss_nothing_that_could_be_confirmed():
    """Whatever the corpus, less than the overlap of a notice's n-grams is free of anchors."""
    from collections import Counter

    notices = [set(licenses.grams(licenses.words(t))) for texts in licenses.NOTICES.values() for t in texts]
    everything = Counter({w: 1000 for n in notices for g in n for w in g.split()})
    for known in (Counter(), everything):
        chosen = set(licenses.anchors(notices, known, 0.5))
        assert all(sum(not chosen & set(g.split()) for g in n) < 0.5 * len(n) for n in notices)


def test_verbatim_altered_and_wrapped_notices_in_a_corpus_that_is_half_notices(spark):
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(240):
        lines = [data.prose(rng, rng.randint(5, 40)) for _ in range(4)]
        if i % 2:
            family = rng.choice(list(VERBATIM))
            w = rng.choice(VERBATIM[family]).split()
            kind = i // 2 % 3
            if kind == 1:  # one word in twelve lost
                w = [x for x in w if rng.random() > 1 / 12]
            text = " ".join(w) if kind < 2 else "\n".join(" ".join(w[k : k + 6]) for k in range(0, len(w), 6))
            lines.insert(rng.randint(0, 4), text)
            truth[i] = family
        rows.append((i, "\n".join(lines), "en", "s", 0))
    got = {r["doc_id"]: r["license"] for r in licenses.scan(data.frame(spark, rows)).collect()}
    wrong = {i: (f, got[i]) for i, f in truth.items() if got[i] != f}
    assert len(wrong) <= 0.03 * len(truth) and all(got[i] is None for i in range(240) if i not in truth), wrong


def test_probabilities_are_those_of_the_model(spark):
    """The data's path agrees with a plain one over the same paragraphs (alone in their documents, of one part)."""
    import numpy as np

    texts = [t for v in licenses.NOTICES.values() for t in v] + ["Nothing here but the terms of a sale.", "under the stone by the river"]
    df = data.frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    model = licenses.train(df)
    at = {g: k for k, g in enumerate(model.vocabulary)}
    for r in licenses.scan(df).collect():
        found = {g for g in licenses.grams(licenses.words(texts[r["doc_id"]])) if g in at}
        x = np.zeros(len(at) + 1)
        x[[at[g] for g in found]] = 1
        x[-1] = 1
        p = licenses._softmax((x @ model.weights)[None])[0]
        top = int(p[1:].argmax()) + 1
        share = max(licenses.share(found, set(licenses.grams(licenses.words(t)))) for t in licenses.NOTICES[model.classes[top]])
        family = model.classes[top] if p[top] >= 0.5 and share >= 0.5 else "unknown" if 1 - p[0] >= 0.5 else None
        if set(licenses.words(texts[r["doc_id"]])) & set(model.anchors):
            assert r["license"] == family and (family is None or len(licenses.words(texts[r["doc_id"]])) > 32 or abs(r["confidence"] - (p[top] if family != "unknown" else 1 - p[0])) < 2e-3)
        else:
            assert r["license"] is None
