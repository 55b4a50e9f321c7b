"""Segments against rebuilt tables: edits, deletions, merges, lost races and what is left behind."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from holdfast.operators import search as S
from holdfast.plans import search
from holdfast.plans.live import LiveIndex
from holdfast.sources import segments
from holdfast.sources.library import from_tables
from holdfast.sources.segments import Segments

SCHEMA = "item_id long, text string"
R = random.Random(61)


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def ids_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def live(t):
    return sorted((r.item_id, r.text) for r in t.table().collect())


def test_random_changes_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "LEAST", 4)
    monkeypatch.setattr(segments, "GROWTH", 3)
    t, want = Segments(spark, f"file://{tmp_path}/t"), {}
    for step in range(10):
        ids = R.sample(range(12), R.randrange(1, 4))
        if step % 4 == 3:
            t.delete(ids_of(spark, ids))
            new = {}
        else:
            new = {i: [f"{step}.{k}" for k in range(R.randrange(3))] for i in ids}
            t.replace(rows_of(spark, [(i, x) for i, v in new.items() for x in v]), ids_of(spark, ids))
        want = {i: v for i, v in want.items() if i not in ids} | new
        if step % 3 == 2:
            t.merge()
        assert live(t) == sorted((i, x) for i, v in want.items() for x in v)
    while t.merge():
        pass
    assert live(t) == sorted((i, x) for i, v in want.items() for x in v)
    assert len(t.manifest()[1]) < 10
    assert t.orphans() and t.sweep() and not t.orphans()
    assert live(t) == sorted((i, x) for i, v in want.items() for x in v)


def test_an_edit_writes_one_small_segment(spark, tmp_path):
    t = Segments(spark, f"file://{tmp_path}/t")
    t.replace(rows_of(spark, [(i, f"text {i}") for i in range(500)]))
    before = t.manifest()[1]
    t.replace(rows_of(spark, [(7, "new")]), ids_of(spark, [7]))
    after = t.manifest()[1]
    assert after[:-1] == before and (after[-1].n_rows, after[-1].n_gone) == (1, 1)
    assert len(live(t)) == 500 and (7, "new") in live(t)


def test_two_writers_both_land(spark, tmp_path, monkeypatch):
    t, other = Segments(spark, f"file://{tmp_path}/t"), Segments(spark, f"file://{tmp_path}/t")
    t.replace(rows_of(spark, [(1, "a")]))
    manifest, raced = t.manifest, []

    def late():
        found = manifest()
        if not raced:
            raced.append(1)
            other.replace(rows_of(spark, [(2, "b")]), ids_of(spark, [2]))
        return found

    monkeypatch.setattr(t, "manifest", late)
    t.replace(rows_of(spark, [(3, "c")]), ids_of(spark, [3]))
    assert live(t) == [(1, "a"), (2, "b"), (3, "c")]
    monkeypatch.setattr(t, "_commit", lambda n, s: False)
    with pytest.raises(segments.Conflict):
        t.delete(ids_of(spark, [1]))
    assert (1, "a") in live(t) and t.orphans()


def test_a_manifest_without_its_end_does_not_count(spark, tmp_path):
    t = Segments(spark, f"file://{tmp_path}/t")
    with pytest.raises(LookupError):
        t.table()
    t.replace(rows_of(spark, [(1, "a")]))
    (tmp_path / "t" / "log" / f"{2:012d}").write_text('{"number": 2, "rows"')
    assert live(t) == [(1, "a")]


def test_an_index_follows_its_library(spark, sf, tmp_path):
    lib = from_tables(spark, sf)
    index = LiveIndex(spark, f"file://{tmp_path}/index")
    index.index(lib)
    edited = F.col("id").isin(5, 6)
    body = F.when(edited, F.lit("an edited note about in the harbour")).otherwise(F.col("body"))
    text, spoken = (F.when(edited & F.col(c).isNotNull(), body).otherwise(F.col(c)) for c in ("text_content", "transcript"))
    items = lib.items.where("id <> 9").withColumns({"body": body, "text_content": text, "transcript": spoken})
    changed = replace(lib, items=items)
    index.index(changed, ids_of(spark, [5, 6]))
    index.remove(ids_of(spark, [9]))
    for again in (True, False):
        now, anew = index.of(changed), search.prepared(changed)
        for name in ("chunks", "postings", "positions"):
            columns = sorted(anew.extra[name].columns)
            assert sorted(map(str, now.extra[name].select(columns).collect())) == sorted(map(str, anew.extra[name].select(columns).collect()))
        assert [tuple(r) for r in now.extra["chunk_stats"].collect()] == [tuple(r) for r in anew.extra["chunk_stats"].collect()]
        found = [sorted(map(str, search.hybrid(x, S.Filters('"in the harbour"'), {}).collect())) for x in (now, anew)]
        assert found[0] == found[1] and len(found[0]) == 2
        for _ in range(2 if again else 0):
            index.index(changed, ids_of(spark, [5]))
        assert not again or index.merge()
