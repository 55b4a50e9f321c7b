"""Mixing sources to target weights, in DataFrame functions only.

Sizes are summed by source, a water-filling over the sources gives the targets, and every document is taken floor(rate)
times plus once more if a number from the hash of its id, its text and the seed is below the fraction of its source's rate. Of rows
with one id and one text the first has number 0, the next 1 and so on, and the number goes into the hash, so such rows fall
independently; which of them has which number doesn't matter, as they are alike.

The sources may be many: they are numbered over range partitions, and the level of the filling is found by sums over the table of sources,
so no task holds them all.

Defined results: a null text has size 0 and counts as the empty text; a null source is a source of its own and the last; null
ids have the empty string in the hash; a source of size 0 has target 0 and is not taken; an empty table gives an
empty table; `mixed` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import Scope, fresh, numbered, unit_hash

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 8
WORD = r"[^\x20\x09-\x0D]+"
#: The partition in a row number of monotonically_increasing_id.
PART_BITS = 33


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighed(scope: Scope, totals: DataFrame, weights: tuple) -> DataFrame:
    """totals with w, the weight by the place of the source in the order of code points, null last."""
    order = F.col("source").asc_nulls_last()
    dealt = scope.write(totals.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "totals")
    # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    return dealt.join(F.broadcast(offsets), "part").select("source", "source_size", weight.alias("w"))


def source_targets(scope: Scope, sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size long, target double, rate double. sizes: source string, size long.

    The level is what a unit of weight gets. Sources whose share reaches `most` times their size are full; what is left is shared by the
    others, which raises the level, until no more become full.
    """
    rows = scope.write(weighed(scope, sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "weighed")
    cap = F.col("source_size") * float(most)
    level, full, is_full = 0.0, -1, F.lit(False)
    while True:
        sums = rows.agg(F.count_if(is_full).alias("full"), F.coalesce(F.sum(F.when(is_full, cap)), F.lit(0.0)).alias("caps"), F.sum(F.when(~is_full, F.col("w"))).alias("w"), F.sum("source_size").cast("double").alias("total")).first()
        if sums.full == full or not sums.w:
            break
        full, level = sums.full, (sums.total - sums.caps) / sums.w
        is_full = F.lit(level) * F.col("w") >= cap
    target = F.when(is_full, cap).otherwise(F.lit(level) * F.col("w"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return scope.write(rows.select("source", "source_size", target.alias("target")).withColumn("rate", rate), "targets")


def identity(doc_id: Column, text: Column) -> Column:
    """What repeated rows have in common: id and text."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def repeated(scope: Scope, rows: DataFrame, key: str) -> DataFrame:
    """The keys that more than one row has."""
    return scope.write(rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated")


def repeats(rows: DataFrame, keys: DataFrame, key: str, row: str) -> DataFrame:
    """row, repeat long: the numbers from 0 of rows with one of the keys. row: numbers of monotonically_increasing_id, written with the rows.

    Rows are counted inside the partition that wrote them, and partitions are added up before each, so a key that very many rows have isn't one task's.
    """
    own = rows.select(F.col(key).alias("key"), F.col(row).alias("row"), F.shiftright(F.col(row), PART_BITS).alias("part")).join(keys, "key", "left_semi")
    inside = Window.partitionBy("key", "part").orderBy("row")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = own.withColumn("place", F.row_number().over(inside)).join(offsets, ["key", "part"])
    return placed.select("row", (F.col("offset") + F.col("place") - 1).alias("repeat"))


def copies(rate: Column, key: Column, repeat: Column, seed: int = SEED) -> Column:
    """floor(rate) and one more with the probability of the fraction."""
    return F.floor(rate) + (unit_hash(key, repeat, seed=seed) < rate - F.floor(rate)).cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row."""
    scope = Scope(docs.sparkSession)
    id_, text = F.col(id_col), F.col(text_col)
    sizes = docs.select(id_.alias("doc_id"), F.col(source_col).cast("string").alias("own"), word_count(text).alias("size"), identity(id_, text).alias("key"))
    sizes, row = numbered(scope, sizes, "sizes")
    targets = source_targets(scope, sizes.select(F.col("own").alias("source"), "size"), weights)
    places = scope.write(repeats(sizes, repeated(scope, sizes, "key"), "key", row), "places")
    # a row for each source: Spark broadcasts the table if its file is below the threshold, and joins by shuffle with skew handling if not
    rows = sizes.join(targets, F.col("own").eqNullSafe(F.col("source"))).join(places, F.col(row) == F.col("row"), "left")
    taken = copies(F.col("rate"), F.col("key"), F.coalesce("repeat", F.lit(0)), seed)
    scope.release("sizes", "targets", "places")
    return rows.withColumn("copies", taken).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    scope = Scope(docs.sparkSession)
    own, key, source, rate, place, repeat, times = fresh(docs.columns, "own", "key", "source_key", "rate", "row", "repeat", "times")
    targets = source_targets(scope, docs.select(F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), weights)
    targets = targets.select(F.col("source").alias(source), F.col("rate").alias(rate))
    rows = docs.withColumns({own: F.col(source_col).cast("string"), key: identity(F.col(id_col), F.col(text_col))})
    many = repeated(scope, rows, key)
    if many.isEmpty():
        rows = rows.withColumn(repeat, F.lit(0))
    else:
        # only where rows repeat do they need numbers
        rows, row = numbered(scope, rows)
        places = scope.write(repeats(rows, many, key, row).select(F.col("row").alias(place), F.col("repeat").alias(repeat)), "places")
        rows = rows.join(places, F.col(row) == F.col(place), "left").withColumn(repeat, F.coalesce(repeat, F.lit(0)))
    rows = rows.join(targets, F.col(own).eqNullSafe(F.col(source))).withColumn(times, copies(F.col(rate), F.col(key), F.col(repeat), seed))
    scope.release("targets", "places", "numbered")
    return rows.where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
