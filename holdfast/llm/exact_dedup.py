"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of the digests, one a partition, are merged into at most `counters` candidates. Their exact counts
and winners are verified by an aggregation and broadcast (at most `counters` rows, whatever the input), so the rows of
frequent digests are decided map-side and never meet in one task. Every digest with more than rows / (counters + 1) rows
is among the candidates; of what remains the winners are found by an aggregation that combines map-side, and only winners of
repeated digests are joined back, where Spark can split what is still large.

Defined results: a null text is the empty text; texts are equal when equal after lower-casing A-Z; of equal texts the row
with the largest id stays (null ids lose to any other; of repeated rows with that id exactly one stays); an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import materialise, small_batches

COUNTERS = 256


def _digests(batches):
    for b in batches:
        texts = b.column(2).cast(pa.large_binary())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([hashlib.sha256((t.as_py() or b"").lower()).digest() for t in texts], pa.binary())],
            names=["row_id", "doc_id", "digest"],
        )


def shrink(counts: Counter, counters: int) -> Counter:
    """The Misra-Gries merge step: takes the largest count that must go from all counts and keeps what is above 0."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def _summaries(counters: int):
    def run(batches):
        kept: Counter = Counter()
        for b in batches:
            kept.update(b.column(0).to_pylist())
            kept = shrink(kept, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], names=["digest", "hits"])

    return run


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id long (unique), doc_id long, digest binary(32) of every row, written once."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(_digests, "row_id long, doc_id long, digest binary"), "digests")


def heavy_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Verified frequent digests: digest, keep struct(doc_id, row_id), group_size. At most `counters` rows."""
    found = digests.select("digest").mapInArrow(_summaries(counters), "digest binary, hits long")
    candidates = found.groupBy("digest").agg(F.sum("hits").alias("hits")).orderBy(F.desc("hits"), "digest").limit(counters).select("digest")
    exact = (
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    )
    return materialise(exact.where("group_size > 1"), "heavy")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """Every row's group: doc_id, keep_id, group_size, kept, text_sha256, and frequent (decided map-side)."""
    digests = text_digests(docs, id_col, text_col)
    heavy = heavy_digests(digests, counters)
    # ids may be null: struct ordering puts null first, so any id beats it
    own = F.struct("doc_id", "row_id")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    winners = rest.groupBy("digest").agg(F.max(own).alias("keep"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    rest = rest.join(winners, "digest", "left").withColumns({"keep": F.coalesce("keep", own), "group_size": F.coalesce("group_size", F.lit(1)).cast("long"), "frequent": F.lit(False)})
    often = digests.join(F.broadcast(heavy), "digest").withColumn("frequent", F.lit(True))
    return often.unionByName(rest).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("keep.row_id") == F.col("row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "frequent",
    )
