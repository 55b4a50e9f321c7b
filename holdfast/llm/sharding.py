"""Sharding by sampled splitters, in DataFrame functions only.

Keys are sampled in proportion to their rows' sizes, quantiles of the sample become boundaries, and every row falls into
a range. Exact totals of the ranges follow; ranges of more than twice the mean size are subdivided at quantiles of their
own, and a key that is several boundaries at once (or null, if nulls are more than a range) is dealt out to as many cells, so one hot key does not fill a task.
Running sums inside the cells and a prefix sum over the cells (a bounded number) give every row its place on the line of
all bytes in the order of the keys. A shard is the ranges that lie in its equal part of the line; a range that crosses
the end of a part is subdivided there, exactly. So the splitters decide what a task sorts, and another sample gives the same shards.

Law: `bytes`. A shard's size differs from the mean by one row's size at most. Each row is placed by itself: groups of equal texts may
lie in several shards, as a group may be larger than a shard. Defined results: a null text has 0 bytes
and the crc32 of the empty text; null keys come first; repeated rows are placed one by one; an empty table gives an
empty table; other columns are carried along by `shard_rows`, and its new columns replace columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import Scope, fresh, numbered, unit_hash

SHARDS = 24
#: Sampled keys for each range, ranges for each shard, rows meant for a range, the most ranges, and parts of an overfull one.
SAMPLES, LEAST_RANGES, RANGE_ROWS, MOST_RANGES, PARTS = 48, 8, 1_000_000, 4096, 16
SEED = 6
#: The salt of keys that are not dealt out, above all others.
UNSALTED = 1 << 30


def range_of(key: Column, bounds: list, kind: str = "bigint") -> Column:
    """How many of the sorted bounds (of the key's type `kind`) are at or below the key, by binary search; null: 0."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    # one literal, however many bounds
    literal = F.split(F.lit(",".join(map(str, bounds))), ",").cast(f"array<{kind}>")
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(literal, at + step - 1) <= key), at + step).otherwise(at),
    )


def splitters(rows: DataFrame, key: str, size: str, ranges: int, total: int, samples: int = SAMPLES) -> list:
    """ranges - 1 quantiles, or none, of a sample in which a row stands size / step times on average. A hot key stands more than once."""
    step = max(total / (ranges * samples), 1.0)
    copies = F.floor(F.col(size) / step + unit_hash(F.col(key), seed=SEED)).cast("int")
    sample = rows.select(F.col(key).alias("k"), copies.alias("n")).where("n > 0 and k is not null").select("k", F.explode(F.sequence(F.lit(1), "n")))
    return sorted(sample.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("q")).first()["q"] or [])


class Cells:
    """Ranges of a key, subdivided, as columns of new names (range, part, salt) whose order is that of the key.

    rows: key and size; total, nulls: bytes of all rows and of those with a null key; columns: names that the new ones differ from.
    If `hot`, `subdivide` and `placed` need the name of a column with row numbers that were written with the rows.
    """

    def __init__(self, rows: DataFrame, key: str, size: str, ranges: int, total: int, nulls: int, columns: list[str], samples: int = SAMPLES):
        self.key, self.size, self.ranges, self.total, self.kind = key, size, ranges, total, rows.schema[key].dataType.simpleString()
        self.names = fresh(columns, "range", "part", "salt")
        self.finer, self.own = fresh([*columns, *self.names], "finer", "own")
        found = splitters(rows, key, size, ranges, total, samples)
        self.bounds = sorted(set(found))
        hot = {k: n for k in self.bounds if (n := found.count(k)) > 1}
        self.often = F.lit(None).cast("int")
        if hot:
            self.often = F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), lambda k, _: k == F.col(key))), 0)
        parts = math.ceil(nulls * ranges / max(total, 1))
        if parts > 1:
            self.often = F.when(F.col(key).isNull(), F.lit(parts)).otherwise(self.often)
        self.hot, self.full = bool(hot) or parts > 1, None

    def subdivide(self, scope: Scope, rows: DataFrame) -> None:
        """Ranges of more than twice the mean size: at most `ranges` rows with PARTS numbers each, so they are broadcast."""
        quantiles = F.percentile_approx(self.key, [i / PARTS for i in range(1, PARTS)], 50 * PARTS)
        sums = rows.groupBy(range_of(F.col(self.key), self.bounds, self.kind).alias(self.own)).agg(F.sum(self.size).alias("b"), quantiles.alias(self.finer))
        full = sums.where(F.col("b") > 2 * self.total / self.ranges).select(self.own, F.array_sort(F.array_distinct(self.finer)).alias(self.finer))
        self.full = scope.write(full, "overfull")

    def placed(self, rows: DataFrame, row: str | None) -> DataFrame:
        range_, part, salt = self.names
        # rows of a hot key come before the range's other rows and differ in their number only
        salted = F.coalesce(F.pmod(F.col(row), self.often).cast("int"), F.lit(UNSALTED)) if self.hot else F.lit(UNSALTED)
        steps = F.array(*[F.lit(1 << k) for k in range(PARTS.bit_length() - 1, -1, -1)])
        finer = F.col(self.finer)
        place = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size(finer)) & (F.get(finer, at + s - 1) <= F.col(self.key)), at + s).otherwise(at))
        rows = rows.withColumns({range_: range_of(F.col(self.key), self.bounds, self.kind), salt: salted})
        rows = rows.join(F.broadcast(self.full), F.col(range_) == F.col(self.own), "left")
        return rows.withColumn(part, F.when(finer.isNotNull(), place).otherwise(0)).drop(self.finer, self.own)


def shard_rows(rows: DataFrame, key: str = "doc_id", size: str = "size", tie: str | None = None, shards: int = SHARDS) -> DataFrame:
    """rows with shard int and slot long. key: a numeric column; size: long, at least 1; tie: orders rows of one key."""
    given = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    rows, scope = rows.select(*[F.col(f"`{c}`") for c in given]), Scope(rows.sparkSession)
    total, n, nulls = rows.agg(F.sum(size), F.count(F.lit(1)), F.sum(F.when(F.col(key).isNull(), F.col(size)).otherwise(0))).first()
    if not n:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    ranges = min(max(LEAST_RANGES * shards, math.ceil(n / RANGE_ROWS)), MOST_RANGES)
    cells_of, row = Cells(rows, key, size, ranges, total, nulls, [*rows.columns, "row_id"]), None
    if cells_of.hot:
        rows, row = numbered(scope, rows)
    cells_of.subdivide(scope, rows)
    dealt, cell = cells_of.placed(rows, row), cells_of.names
    sum_, at, bytes0, rows0, first_, shard_ = fresh([*dealt.columns, "shard", "slot"], "sum", "at", "bytes0", "rows0", "first", "of")
    order = [F.col(key), *([F.col(tie)] if tie else []), F.col(size)]
    inside = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({sum_: F.sum(size).over(inside), at: F.count(F.lit(1)).over(inside)})
    # cells: at most PARTS + 1 times `ranges`, and as many again for hot keys
    cells = dealt.groupBy(*cell).agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(as_) for c, as_ in (("b", bytes0), ("n", rows0))]
    cells = scope.write(cells.select(*cell, *starts), "cells")
    middle = 2 * (F.col(bytes0) + F.col(sum_)) - F.col(size)
    own = [F.col(f"`{c}`") for c in given]
    placed = placed.join(F.broadcast(cells), cell).select(
        *own,
        F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * total))).cast("int").alias("shard"),
        (F.col(rows0) + F.col(at) - 1).alias(at),
    )
    first = scope.write(placed.groupBy(F.col("shard").alias(shard_)).agg(F.min(at).alias(first_)), "first")
    scope.release("numbered", "overfull", "cells", "first")
    return placed.join(F.broadcast(first), F.col("shard") == F.col(shard_)).select(*own, "shard", (F.col(at) - F.col(first_)).alias("slot"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard_rows(Scope(docs.sparkSession).write(narrow, "sizes"), "doc_id", "size", "text_crc32", shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """The documents with all their columns, shard and slot."""
    (size,) = fresh([*docs.columns, "shard", "slot"], "size")
    rows = docs.drop("shard", "slot").withColumn(size, (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 8).cast("long"))
    return shard_rows(rows, id_col, size, None, shards).drop(size)
