"""Exact phrases through positions of words.

The index has a row for each word of an item and each BLOCK places of its text: the places where the word stands. Each of its files is sorted by word, so a
query reads its own words' rows; a dictionary tells how often each word stands. A phrase's first word may end a longer word and its last may begin one,
as a phrase is any part of a text, so the words that fit are looked up in the dictionary first.

The rarest word of the phrase gives the places where the phrase may begin. Each further word, rarer ones first, keeps those where it
stands so many places on: a join of places with the block in which the word would have to be, nothing is unfolded but the rarest word.
Texts are read of the items that are left, which also counts their mentions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.text import plain
from holdfast.operators import search as S

#: Places of a block; words that fit and items that are found, up to which they are looked for by value.
BLOCK, BY_VALUE = 4096, 1000
ROWS = 50_000


def _placed(size: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            words, items, blocks, at = [], [], [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own: dict[tuple[int, str], list[int]] = {}
                for place, word in enumerate(text.split(" ")):
                    own.setdefault((place // size, word), []).append(place)
                words += [w for _, w in own]
                blocks += [k for k, _ in own]
                items += [item] * len(own)
                at += own.values()
                if len(words) > ROWS:
                    yield _batch(words, items, blocks, at)
                    words, items, blocks, at = [], [], [], []
            yield _batch(words, items, blocks, at)

    return run


def _batch(words, items, blocks, at) -> pa.RecordBatch:
    arrays = [pa.array(words, pa.string()), pa.array(items, pa.int64()), pa.array(blocks, pa.int32()), pa.array(at, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(arrays, names=["word", "item_id", "block", "at"])


def positions(items: DataFrame, size: int = BLOCK) -> DataFrame:
    """word, item_id, block, at of the whole searched text of every item. Made without a shuffle: each task sorts what it has made by word, so every
    file of a stored index has its words in order, and a query reads a few pages of each. (To deal out ranges of words would make all rows twice, once to sample them.)"""
    rows = items.select(F.col("id").cast("long").alias("item_id"), plain(S.searched()).alias("t")).where("item_id is not null and t <> ''")
    made = rows.mapInArrow(_placed(size), "word string, item_id long, block int, at array<int>")
    return made.sortWithinPartitions("word", "item_id", "block")


def dictionary(index: DataFrame) -> DataFrame:
    """word, n_places of a stored index."""
    return index.groupBy("word").agg(F.sum(F.size("at")).cast("long").alias("n_places"))


@dataclass(frozen=True)
class Slot:
    """The place of a word in a phrase, and how it fits the words of a text."""

    offset: int
    word: str
    first: bool
    last: bool

    def fits(self, column: str = "word") -> Column:
        c, w = F.col(column), F.lit(self.word)
        if self.first and self.last:
            return F.contains(c, w)
        return F.endswith(c, w) if self.first else F.startswith(c, w) if self.last else c == w


def slots(phrase: str) -> list[Slot]:
    words = phrase.casefold().split()
    return [Slot(i, w, i == 0, i == len(words) - 1) for i, w in enumerate(words)]


def starts(index: DataFrame, words: DataFrame, phrase: str, ids: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """item_id, start: every place where the phrase begins. index: a stored table of `positions` with blocks of this size; words: its dictionary."""
    sought = slots(phrase)
    none = index.select("item_id", F.lit(0).alias("start")).limit(0)
    if not sought:
        return none
    sums = words.agg(*[f(F.when(s.fits(), x)).alias(f"{name}{s.offset}") for s in sought for name, f, x in (("n", F.sum, F.col("n_places")), ("words", F.count, F.lit(1)))]).first()
    if not all(sums[f"n{s.offset}"] for s in sought):
        return none
    # the slots whose few words are looked for by value: one small job for them all
    few = [s for s in sought if (s.first or s.last) and sums[f"words{s.offset}"] <= BY_VALUE]
    found = words.select("word", *[s.fits().alias(f"fits{s.offset}") for s in few]).where(" or ".join(f"fits{s.offset}" for s in few)).collect() if few else []

    def rows(s: Slot) -> DataFrame:
        if s in few:
            return index.where(F.col("word").isin([r.word for r in found if r[f"fits{s.offset}"]]))
        return index.where(s.fits())

    rarest, *others = sorted(sought, key=lambda s: (sums[f"n{s.offset}"], s.offset))
    begun = rows(rarest)
    if ids is not None:
        begun = begun.join(ids.select(F.col("id").alias("__allowed")), F.col("item_id") == F.col("__allowed"), "left_semi")
    begun = begun.select("item_id", F.explode("at").alias("p")).select("item_id", (F.col("p") - rarest.offset).alias("start")).where("start >= 0")
    for s in others:
        place = F.col("start") + s.offset
        block = rows(s).select(F.col("item_id").alias("i"), F.col("block").alias("k"), "at")
        # a word stands at a place once, so no start comes twice
        begun = begun.withColumn("b", F.floor(place / size).cast("int")).join(block, (F.col("item_id") == F.col("i")) & (F.col("b") == F.col("k"))).where(F.array_contains("at", place)).select("item_id", "start")
    return begun


def items_with(index: DataFrame, words: DataFrame, phrase: str, ids: DataFrame | None = None, size: int = BLOCK) -> list[int] | DataFrame:
    """The items whose text has the phrase: their ids if they are few, else a table of them (id)."""
    hits = starts(index, words, phrase, ids, size).select(F.col("item_id").alias("id")).distinct()
    few = hits.limit(BY_VALUE + 1).collect()
    return [r.id for r in few] if len(few) <= BY_VALUE else hits
