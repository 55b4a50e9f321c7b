"""Greedy thinning as chains of pointers, so that no task holds a key's rows.

Each row points to the first row of its key at least `gap` later. What a pass from the first row on keeps is the chain of these pointers;
it is found by doubling: pointers are composed with themselves while the kept rows double, so a chain of n rows takes log2(n) rounds of joins.

Pointers come from buckets of width `gap`: a row's target lies in the next bucket or is the first row of a later one. In its bucket it is found by
one running minimum from the end, which streams over sorted rows; the later bucket's first row comes from the small table of buckets. Joins are on
key and time, which are unique, so a hot key is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.sources import scratch
from holdfast.sources.scratch import clear_scratch, materialise


def pointers(times: DataFrame, gap: int) -> DataFrame:
    """key, t, next: of distinct rows (key, t) the first t of the key at least `gap` later; rows without one are left out."""
    rows = times.withColumn("bucket", F.floor(F.col("t") / F.lit(gap)))
    along = Window.partitionBy("key").orderBy("bucket")
    buckets = rows.groupBy("key", "bucket").agg(F.min("t").alias("first")).select("key", "bucket", F.lead("bucket").over(along).alias("b1"), F.lead("first").over(along).alias("t1"), F.lead("first", 2).over(along).alias("t2"))
    # the next bucket is searched, so what follows it counts
    later = F.when(F.col("b1") == F.col("bucket") + 1, F.col("t2")).otherwise(F.col("t1"))
    asks = rows.join(buckets, ["key", "bucket"]).select("key", (F.col("bucket") + 1).alias("bucket"), (F.col("t") + gap).alias("at"), F.lit(1).alias("ask"), F.col("t").alias("asker"), later.alias("later"))
    here = rows.select("key", "bucket", F.col("t").alias("at"), F.lit(0).alias("ask"), F.lit(None).cast("long").alias("asker"), F.lit(None).cast("long").alias("later"))
    down = Window.partitionBy("key", "bucket").orderBy(F.desc("at"), "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = here.unionByName(asks).withColumn("found", F.last(F.when(F.col("ask") == 0, F.col("at")), ignorenulls=True).over(down)).where("ask = 1")
    return found.select("key", F.col("asker").alias("t"), F.coalesce("found", "later").alias("next")).where(F.col("next").isNotNull())


def thinned(rows: DataFrame, by: list[str], time: str, gap: int) -> DataFrame:
    """by, time: of each key's times the first, then each that is at least `gap` after the last one kept.

    Times and gap are whole numbers (milliseconds, say), so that sums are exact. Null times go; null keys are a key; equal times are kept
    once; no rows give no rows.
    """
    if gap <= 0:
        raise ValueError("gap must be positive")
    spark, before = rows.sparkSession, len(scratch.MADE)
    own = rows.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)]).alias("key"), F.col(time).cast("long").alias("t")).where(F.col("t").isNotNull()).distinct()
    times = materialise(own, "times")
    jumps = materialise(pointers(times, gap), "pointers")
    parts = [materialise(times.groupBy("key").agg(F.min("t").alias("t")), "kept")]
    while True:
        kept = parts[0]
        for part in parts[1:]:
            kept = kept.unionByName(part)
        new = materialise(kept.join(jumps, ["key", "t"]).select("key", F.col("next").alias("t")), "kept")
        if new.isEmpty():
            break
        parts.append(new)
        step = jumps.select("key", F.col("t").alias("next"), F.col("next").alias("beyond"))
        jumps = materialise(jumps.join(step, ["key", "next"]).select("key", "t", F.col("beyond").alias("next")), "pointers")
    out = materialise(kept.select(*[F.col(f"key.k{i}").alias(c) for i, c in enumerate(by)], F.col("t").alias(time)), "thinned")
    clear_scratch(spark, before, keep=(scratch.MADE[-1],))
    return out
