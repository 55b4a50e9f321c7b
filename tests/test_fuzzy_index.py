"""Fuzzy phrases over all chunks against aligning every chunk."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from holdfast.functions import fuzzy, scoring
from holdfast.functions.fuzzy import similarities
from holdfast.operators import fuzzy_index
from holdfast.operators import search as S
from holdfast.plans import search
from holdfast.queries import _calibration, _vectors
from holdfast.sources.library import from_tables

R = random.Random(53)


def distorted(text, share):
    """Some letters left out, doubled or changed."""
    return "".join(R.choice(["", c + c, "e"]) if R.random() < share else c for c in text)


def by_alignment(rows, phrase):
    best = {}
    for r, ratio in zip(rows, similarities([r.chunk_text for r in rows], phrase), strict=True):
        if ratio >= scoring.LEAST_RATIO and (r.item_id not in best or (-ratio, r.chunk_ix) < best[r.item_id]):
            best[r.item_id] = (-ratio, r.chunk_ix)
    return {i: (round(-a, 9), b) for i, (a, b) in best.items()}


def test_every_chunk_that_alignment_finds_is_found(spark, sf):
    lib = search.with_grams(from_tables(spark, sf))
    rows = lib.chunks.orderBy("chunk_id").collect()
    passages = [" ".join(R.choice(rows).chunk_text.split()[k : k + n]) for k, n in ((0, 9), (30, 12), (5, 3), (60, 6))]
    found = 0
    for phrase in [*passages, *[distorted(p, 0.08) for p in passages], "the of and", "zzz", ""]:
        want = by_alignment(rows, phrase)
        got = fuzzy_index.best_chunks(lib.chunks, lib.extra["grams"], phrase).collect()
        assert {r.item_id: (round(r.phrase_ratio, 9), r.chunk_ix) for r in got} == want, phrase
        found += len(want)
        some = fuzzy_index.best_chunks(lib.chunks, lib.extra["grams"], phrase, spark.range(50).toDF("id")).collect()
        assert {r.item_id for r in some} == {i for i in want if i < 50}
    assert found > 8


def test_a_phrase_that_candidates_miss(spark, tmp_path):
    """None of the phrase's words stands in the text as it is, and no vector is near."""
    rows = [(i * 1_000_000, i, 0, t) for i, t in enumerate(["yesterdy we drve to the forrest for mushroms", "quite another text", None, ""])]
    spark.createDataFrame(rows, "chunk_id long, item_id long, chunk_ix int, chunk_text string").write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    phrase = "yesterday wee drove forest mushrooms"
    assert S.phrase_evidence(chunks, phrase).collect() == []
    got = fuzzy_index.best_chunks(chunks, fuzzy_index.grams(chunks), phrase).collect()
    assert [r.item_id for r in got] == [0] and got[0].score > 0


def test_a_search_with_trigrams_has_all_phrase_hits(spark, sf):
    lib = search.prepared(from_tables(spark, sf))
    vectors, calibration = _vectors(lib), S.by_space(_calibration(lib))
    passage = " ".join(lib.chunks.orderBy("chunk_id").first().chunk_text.split()[3:12])
    few, all_ = (search.evidence(x, S.Filters(passage), vectors, calibration)["phrase"] for x in (lib, search.with_grams(lib)))
    known = {r["item_id"]: r["score"] for r in all_}
    assert few and all(known[r["item_id"]] >= r["score"] - 1e-9 for r in few)
    assert lib.chunks.where(F.col("item_id").isin(list(known))).count() >= len(known)


def test_trigrams_are_kept_in_blocks_without_a_shuffle(spark, monkeypatch):
    rows = [(i * 1_000_000, i, 0, t) for i, t in enumerate(["abcab", "ab", "xabc", "", None, "b", "ab", "bca bca", "жу ab\U0001d7d9c"])]
    chunks = spark.createDataFrame(rows, "chunk_id long, item_id long, chunk_ix int, chunk_text string").coalesce(1)
    want = {}
    for c, _, _, t in rows:
        for g in fuzzy._grams(fuzzy.fold_text(t)) if fuzzy.fold_text(t) else ():
            want.setdefault(g, set()).add(c)
    for size in (1, 2, 3, 4096):
        index = fuzzy_index.grams(chunks, size)
        assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
        got, ids, found = {}, {}, index.collect()
        for r in found:
            if r.gram is None:
                ids[r.block] = r.chunk_ids
        assert all(len(i) <= size for i in ids.values()) and sum(map(len, ids.values())) == 7
        for r in found:
            if r.gram is not None:
                own = [ids[r.block][p] for p in r.places]
                assert len(set(own)) == len(own) and not got.setdefault(r.gram, set()) & set(own)
                got[r.gram] |= set(own)
        assert got == want


def test_more_letters_than_a_number_holds(monkeypatch):
    texts = ["abcab", "ab", "xabc", "bca bca"]
    plain = fuzzy_index._grams_of_block(texts)
    monkeypatch.setattr(fuzzy_index, "PLACE_BITS", 58)
    for a, b in zip(plain, fuzzy_index._grams_of_block(texts), strict=True):
        assert list(a) == list(b)


def test_texts_aligned_in_one_go_cost_what_each_costs():
    own = [fuzzy.fold_text("".join(R.choice("aabc d") for _ in range(R.randrange(1, 80)))) or "a" for _ in range(300)]
    for phrase in ("a", "abc", "cab d a", "aab cd ab dd ca b a a c", own[5]):
        p = fuzzy.Phrase(phrase)
        assert p.costs(own) == [p.cost(t) for t in own]
        assert p.ratios(own) == [1 - p.cost(t) / (2 * len(p.codes)) for t in own]
