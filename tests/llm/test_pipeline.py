"""The pipeline on the smallest tables, each stage against brute force on what it was given."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline as P
from holdfast.llm import decontaminate, mixing, quality_gam
from holdfast.llm.common import materialise, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES:
        seen[name] = docs
        docs = materialise(stage(spark, docs, sf), name.replace(" ", "_"))
        if name != "sharding":
            assert docs.columns == columns
    given = {n: Counter(r.doc_id for r in d.select("doc_id").collect()) for n, d in seen.items()}
    last = docs.collect()

    model = quality_gam.train(seen["quality classifier"], table(spark, sf, "labels"))
    rows = seen["quality classifier"].select("doc_id", "text").collect()
    scores = model.score(quality_gam.matrix([r.text for r in rows]))
    assert given["near-duplicates"] == Counter(r.doc_id for r, s in zip(rows, scores, strict=True) if s >= 0.3)

    from tests.llm.test_operators import near_groups

    rows = [tuple(r) for r in seen["near-duplicates"].collect()]
    assert given["decontamination"] == Counter({c for _, _, c in near_groups(rows, P.NEAR_PERCENT)})

    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    texts = {r.doc_id: r.text for r in seen["decontamination"].collect()}
    verbatim = {d for d, t in texts.items() if any(i in t for i in items)}
    gone = set(texts) - set(given["mixing"])
    assert verbatim <= gone
    shared = lambda d: max(len(_windows(texts[d]) & _windows(i)) / len(_windows(i)) for i in items)
    assert all(shared(d) >= decontaminate.COVERAGE for d in gone)

    plan = {r.doc_id: r.copies for r in mixing.mix_plan(seen["mixing"]).collect()}
    assert given["sharding"] == Counter({d: n for d, n in plan.items() if n})

    assert Counter(r.doc_id for r in last) == given["sharding"]
    assert {r.shard for r in last} <= set(range(24))
    for s in range(24):
        assert sorted(r.slot for r in last if r.shard == s) == list(range(sum(r.shard == s for r in last)))


def _windows(text):
    w = re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text.lower())
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_run(spark, sf):
    got = P.run(spark, sf)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} == set(got.columns)
    assert got.count() > 0
    assert P.ORACLE_SQL is None
