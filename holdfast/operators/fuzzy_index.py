"""Fuzzy phrases over all chunks, not only over those that BM25 or the vectors propose.

A chunk is compared with a phrase if it has at least LEAST_OVERLAP of the phrase's trigrams: that is part of the ratio's definition, so a join by
trigrams loses no chunk whose ratio counts. (At a ratio of 0.72 more than half a change a letter is allowed, so no run of letters has to be
kept whole, and a stricter signature would lose chunks.) The index has, for each block of chunks and trigram, the places in the block of the chunks with it, two bytes each; a query reads the rows of its own trigrams,
counts by block and place, and aligns the chunks that are left in Arrow tasks, wherever they lie.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import scoring
from holdfast.functions.fuzzy import LEAST_OVERLAP, Phrase, _codes
from holdfast.functions.text import fold_text
from holdfast.operators import search as S
from holdfast.sources.scratch import materialise

#: Chunks of a block, bits of a place in it, and letters after which a block ends.
BLOCK, PLACE_BITS, LETTERS = 4096, 12, 1 << 21
#: Items that a search takes from the phrase pass.
MOST_ITEMS = 1000


INDEX = "gram string, block long, places array<smallint>, chunk_ids array<long>"


def _grams_of_block(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Trigrams of folded texts, where each one's places begin (and the last one's end), and the places: texts' numbers."""
    short = sorted((t, i) for i, t in enumerate(texts) if len(t) < 3)
    letters = _codes("".join(texts))
    there = np.zeros(sys.maxunicode + 1, bool)
    there[letters] = True
    alphabet = np.flatnonzero(there)
    number = np.zeros(len(there), np.int64)
    number[alphabet] = np.arange(len(alphabet))
    c, n = number[letters], len(alphabet)
    lengths = np.array([len(t) for t in texts])
    of = np.repeat(np.arange(len(texts)), lengths)
    # those across the end of a text are left out, and each is kept once for a text
    whole = of[:-2] == of[2:]
    grams, at = ((c[:-2] * n + c[1:-1]) * n + c[2:])[whole], of[:-2][whole]
    if n**3 < 1 << (63 - PLACE_BITS):
        keys = grams << PLACE_BITS | at
        keys.sort()
        keys = keys[np.diff(keys, prepend=-1) != 0]
        grams, at = keys >> PLACE_BITS, keys & ((1 << PLACE_BITS) - 1)
    else:  # too many letters for a trigram and its text to be one number
        order = np.lexsort((at, grams))
        grams, at = grams[order], at[order]
        new = (np.diff(grams, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0)
        grams, at = grams[new], at[new]
    first = np.flatnonzero(np.diff(grams, prepend=-1))
    own = grams[first]
    names = alphabet[np.stack([own // (n * n), own // n % n, own % n], axis=1)].astype(np.uint32) if len(own) else np.zeros((0, 3), np.uint32)
    named = [*(names.view("<U3").ravel().tolist()), *dict.fromkeys(t for t, _ in short)]
    ends = [len(at) + i for i in range(len(short)) if i == 0 or short[i][0] != short[i - 1][0]]
    return named, np.array([*first, *ends, len(at) + len(short)], np.int32), np.concatenate([at, np.array([i for _, i in short], np.int64)]).astype(np.int16)


def _rows(block: int, chunks: list[int], texts: list[str]) -> pa.RecordBatch:
    named, starts, at = _grams_of_block(texts)
    places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], starts]).astype(np.int32)), pa.array(at))
    ids = pa.ListArray.from_arrays(pa.array(np.array([0, *[len(chunks)] * (len(named) + 1)], np.int32)), pa.array(chunks, pa.int64()))
    columns = [pa.array([None, *named], pa.string()), pa.array([block] * (len(named) + 1), pa.int64()), places, ids]
    return pa.RecordBatch.from_arrays(columns, names=["gram", "block", "places", "chunk_ids"])


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]):
        block, chunks, texts, letters = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for chunk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if folded := fold_text(text):
                    chunks.append(chunk)
                    texts.append(folded)
                    letters += len(folded)
                if len(chunks) == size or letters > LETTERS:
                    yield _rows(block, chunks, texts)
                    block, chunks, texts, letters = block + 1, [], [], 0
        if chunks:
            yield _rows(block, chunks, texts)

    return run


def grams(chunks: DataFrame, size: int = BLOCK) -> DataFrame:
    """gram, block, places, chunk_ids. A block is up to `size` chunks of a task; its row without a gram has their ids, and each of its
    trigrams has a row with the places in there of the chunks that have it. Nothing is shuffled; each task sorts its rows by trigram.
    """
    if size > 1 << PLACE_BITS:
        raise ValueError(f"a block has at most {1 << PLACE_BITS} chunks")
    rows = chunks.select("chunk_id", "chunk_text").where("chunk_id is not null").mapInArrow(_blocks(size), INDEX)
    return rows.sortWithinPartitions("gram", "block")


def candidates(index: DataFrame, phrase: str) -> DataFrame:
    """chunk_id of every chunk that has enough of the phrase's trigrams."""
    own = Phrase(phrase)
    if not own.folded:
        return index.select(F.lit(0).cast("long").alias("chunk_id")).limit(0)
    rows = index.where(F.col("gram").isin(sorted(own.grams))).select("block", F.explode("places").alias("place"))
    least = ceil(LEAST_OVERLAP * len(own.grams))
    enough = rows.groupBy("block", "place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    # an id of 8 bytes a chunk, by the block's number
    ids = index.where("gram is null").select("block", F.posexplode("chunk_ids").alias("place", "chunk_id")).select("block", F.col("place").cast("smallint").alias("place"), "chunk_id")
    return enough.join(ids, ["block", "place"]).select("chunk_id")


def _aligned(phrase: str):
    def run(batches: Iterator[pa.RecordBatch]):
        own = Phrase(phrase)
        for b in batches:
            # candidates have the trigrams that a ratio asks for
            ratios = own.ratios([fold_text(t) for t in b.column("chunk_text").to_pylist()])
            at = pa.array([i for i, r in enumerate(ratios) if r >= scoring.LEAST_RATIO], pa.int64())
            kept = b.take(at)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([ratios[i.as_py()] for i in at], pa.float64())], names=[*kept.schema.names, "ratio"])

    return run


def best_chunks(chunks: DataFrame, index: DataFrame, phrase: str, ids: DataFrame | None = None) -> DataFrame:
    """item_id, score, phrase_ratio, chunk_ix, chunk_text: of each item with a chunk that resembles the phrase the one that does most, the first of equal ones."""
    # ids are written first, so that their number is known and texts are shuffled only where they are very many
    own = materialise(candidates(index, phrase), "candidates")
    own = F.broadcast(own) if own.count() <= S.LOOKED_UP else own
    found = S.restricted_chunks(chunks, ids).join(own, "chunk_id", "left_semi").select("item_id", "chunk_ix", "chunk_text")
    rows = found.mapInArrow(_aligned(phrase), found.select("*").schema.add("ratio", "double"))
    best = rows.groupBy("item_id").agg(F.min_by(F.struct("ratio", "chunk_ix", "chunk_text"), F.struct(-F.col("ratio"), "chunk_ix")).alias("b"))
    score = scoring.phrase_score(F.col("b.ratio"), len(phrase.split()))
    return best.select("item_id", score.alias("score"), F.col("b.ratio").alias("phrase_ratio"), F.col("b.chunk_ix").alias("chunk_ix"), F.col("b.chunk_text").alias("chunk_text"))


def best_rows(chunks: DataFrame, index: DataFrame, phrase: str, ids: DataFrame | None = None, limit: int = MOST_ITEMS) -> list[dict]:
    """The `limit` best of these for a search."""
    return [r.asDict() for r in best_chunks(chunks, index, phrase, ids).orderBy(F.desc("score"), "item_id").limit(limit).collect()]
