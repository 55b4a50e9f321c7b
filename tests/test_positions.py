"""Phrases through positions against plain text search."""

from __future__ import annotations

import random

import pytest

from holdfast.operators import positions
from holdfast.operators import search as S
from holdfast.plans import search
from holdfast.sources.library import from_tables

R = random.Random(17)
ODD = ["", None, "   ", "in the", "IN\t\nTHE  house", "within them", "the in", "a a a a a", "Straße in theory", "in in the the", "in  a the", "\x85in the　end", "x" * 5000 + " in the"]
PHRASES = ["in the", "a a", "in", "the", "Strasse", "in the house", "n t", "the in", "zz", "in the the", "  ", "e", "a a a", "house in"]


def library(spark, tmp_path, texts, size=positions.BLOCK):
    rows = [(i, t if i % 3 else None, None if i % 3 else t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "id long, transcript string, text_content string").repartition(3).write.mode("overwrite").parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    positions.positions(items, size).write.mode("overwrite").parquet(str(tmp_path / "at"))
    index = spark.read.parquet(str(tmp_path / "at"))
    return items, index, positions.dictionary(index).cache()


def plain(t):
    return " ".join((t or "").lower().replace("ß", "ss").split())


@pytest.mark.parametrize("block, by_value", [(2, 1000), (4096, 0)])
def test_items_and_places_of_phrases(spark, tmp_path, monkeypatch, block, by_value):
    monkeypatch.setattr(positions, "BY_VALUE", by_value)
    texts = ODD + [" ".join(R.choice(["in", "the", "a", "house", "inn", "bathe"]) for _ in range(R.randrange(30))) for _ in range(60)]
    items, index, words = library(spark, tmp_path, [t.replace("\x85", " ").replace("　", " ") if t else t for t in texts], block)
    for phrase in PHRASES:
        needle = " ".join(phrase.casefold().split())
        want = {r.id for r in items.select("id", S.mentions(S.searched(), phrase).alias("n")).collect() if r.n > 0}
        assert want == ({i for i, t in enumerate(texts) if needle in plain(t)} if needle else set())
        found = positions.items_with(index, words, phrase, size=block)
        assert (set(found) if isinstance(found, list) else {r.id for r in found.collect()}) == want, phrase
        some = positions.items_with(index, words, phrase, spark.range(20).toDF("id"), block)
        assert (set(some) if isinstance(some, list) else {r.id for r in some.collect()}) == {i for i in want if i < 20}
    got = positions.starts(index, words, "in the", size=block).collect()
    assert sorted((r.item_id, r.start) for r in got) == sorted((i, p) for i, t in enumerate(texts) for w in [plain(t).split()] for p in range(len(w) - 1) if w[p].endswith("in") and w[p + 1].startswith("the"))


def test_a_word_of_every_text_is_split_into_blocks(spark, tmp_path):
    items, index, _ = library(spark, tmp_path, ["the " * 10_000, "the end"])
    rows = index.where("word = 'the'").orderBy("item_id", "block").collect()
    assert [(r.item_id, r.block, len(r["at"])) for r in rows] == [(0, 0, 4096), (0, 1, 4096), (0, 2, 1808), (1, 0, 1)]


@pytest.mark.parametrize("phrase", ["in the", "the of", "no such phrase here"])
def test_quoted_search_reads_texts_of_hits_only(spark, sf, phrase):
    lib = search.with_chunks(from_tables(spark, sf))
    plain_, through = (search.hybrid(x, S.Filters(f'"{phrase}"', ["text", "audio"]), {}) for x in (lib, search.with_positions(lib)))
    assert sorted(map(str, plain_.collect())) == sorted(map(str, through.collect()))


def test_only_found_items_chunks_are_shuffled(spark, sf):
    lib = search.with_chunks(from_tables(spark, sf))
    plan = S.exact_evidence(lib.items, lib.chunks, "in the")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "LeftSemi" in plan


def test_positions_are_made_without_a_shuffle_and_each_file_is_sorted(spark, sf, tmp_path):
    made = positions.positions(from_tables(spark, sf).items.repartition(3))
    assert "rangepartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    made.write.parquet(str(tmp_path / "at"))
    files = sorted((tmp_path / "at").glob("*.parquet"))
    for f in files:
        words = [r.word for r in spark.read.parquet(str(f)).select("word").collect()]
        assert words == sorted(words, key=str.encode)
    assert len(files) == 3
