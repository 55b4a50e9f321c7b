"""Near-duplicates by b-bit MinHash.

Every row gets its set of 5-word shingles, PERMUTATIONS minima, BANDS band hashes and the low two bits of all minima,
packed. Rows with equal sets are one class. Classes that share a band are candidates:

1. every class against the smallest class of each of its bands (a number of pairs linear in the classes);
2. in bands whose classes are not all in one component yet every class against its NEIGHBOURS predecessors in the order of
   the packed bits, which puts the most alike side by side (again linear; it only spares work in the third step);
3. bands that are still of several components are joined with themselves, by classes of sizes that allow the threshold. Only pairs
   of different components come out, once each (in their first common band), and only those whose similarity estimated from the packed bits,
   corrected for chance agreement, is not below the threshold by more than SIGMAS standard deviations.

All pairs of the three steps are confirmed on the full sets, and components follow from the confirmed links. Pairs inside a
component that is already whole are left out, as they cannot change it; no others are. A pair at a similarity of 0.85 shares
no band with probability (1 - 0.85^5)^25 < 1e-6, one at 0.8 with 5e-5.

No band or centre of a star is one task's: the HOT most frequent ones, found by counts and so few that they are broadcast, are dealt out; a
band that is none of them has at most a HOT-th of the rows.

Defined results: an empty or null text has no shingles and is linked with nothing; fewer than five words are one shingle;
repeated rows are in one component; null ids lose to any other; an empty table gives an empty table; other columns are
ignored. Rows are numbered once and written with their numbers, so executors may come and go.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import Scope, fresh, guard, numbered, small_batches, without
from holdfast.llm.components import components
from holdfast.llm.shingles import WordHashes, mix, multipliers, shingle_set

SHINGLE, THRESHOLD_PERCENT = 5, 85
PERMUTATIONS, BANDS, BAND_ROWS, BITS = 512, 25, 5, 2
SIGMAS, SEED, CHUNK, NEIGHBOURS = 4.5, 10, 1024, 4
#: Keys that are dealt out, rows meant for a part of one, and classes of an open band meant for a task.
HOT, STAR_ROWS, BAND_ROWS_A_TASK = 1024, 10_000, 2_000
SKETCH = "row_id long, doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>"


class Sketcher:
    """Minima, band hashes and packed low bits of a shingle set."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.a = r.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = r.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
        self.m = multipliers(BAND_ROWS, seed + 1)
        self.salt = multipliers(BANDS, seed + 2)
        self.shift = np.arange(0, 64, BITS, dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x, out = (shingles >> np.uint64(32)).astype(np.uint32), None
        for i in range(0, len(x), CHUNK):
            low = (x[i : i + CHUNK, None] * self.a + self.b).min(axis=0)
            out = low if out is None else np.minimum(out, low)
        return out

    def bands(self, minima: np.ndarray) -> np.ndarray:
        rows = minima[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(np.uint64)
        return mix((rows * self.m).sum(axis=1, dtype=np.uint64) + self.salt)

    def bits(self, minima: np.ndarray) -> np.ndarray:
        low = (minima & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
        return (low << self.shift).sum(axis=1, dtype=np.uint64)


def _lists(parts: list, dtype=np.int64) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate(parts).view(dtype) if parts else np.array([], dtype)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _sketches(batches):
    cache, sketcher, none = WordHashes(), Sketcher(), np.array([], np.uint64)
    for b in batches:
        n, digests, bands, bits = [], [], [], []
        for t in b.column(2):
            s = shingle_set(t.as_py(), cache, SHINGLE)
            n.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            m = sketcher.minima(s) if len(s) else None
            bands.append(sketcher.bands(m) if len(s) else none)
            bits.append(sketcher.bits(m) if len(s) else none)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), _lists(bands), _lists(bits)],
            names=["row_id", "doc_id", "n_shingles", "digest", "bands", "bits"],
        )


def _sets(batches):
    cache = WordHashes()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingle_set(t.as_py(), cache, SHINGLE) for t in b.column(1)])], names=["id", "shingles"])


def _neighbours(percent: int, batches):
    """Pairs of rows at most NEIGHBOURS apart that share a band but no component and aren't ruled out by sizes and packed bits."""
    most, words, kept = most_mismatches(percent / 100), PERMUTATIONS * BITS // 64, None
    for batch in batches:
        if not batch.num_rows:
            continue
        band, ids, root, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "id", "root", "n_shingles"))
        bits = batch.column("bits").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)
        rows = (band, ids, root, n, bits)
        rows = rows if kept is None else tuple(np.concatenate([k, r]) for k, r in zip(kept, rows, strict=True))
        band, ids, root, n, bits = rows
        old, a, b = 0 if kept is None else len(kept[0]), [], []
        for d in range(1, NEIGHBOURS + 1):
            at = np.arange(max(old, d), len(ids))
            x = bits[at] ^ bits[at - d]
            apart = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)
            small, large = np.minimum(n[at], n[at - d]), np.maximum(n[at], n[at - d])
            hit = at[(band[at] == band[at - d]) & (root[at] != root[at - d]) & (100 * small >= percent * large) & (apart <= most)]
            a.append(np.minimum(ids[hit], ids[hit - d]))
            b.append(np.maximum(ids[hit], ids[hit - d]))
        kept = tuple(r[-NEIGHBOURS:] for r in rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def mismatches(a: Column, b: Column) -> Column:
    """In how many of the packed minima the low bits differ."""
    words = PERMUTATIONS * BITS // 64
    total = None
    for i in range(words):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        total = F.bit_count(x) if total is None else total + F.bit_count(x)
    return total


def most_mismatches(threshold: float) -> int:
    """With agreement by chance at 2^-BITS: more mismatches than that put a pair SIGMAS standard deviations below the threshold."""
    p = threshold + (1 - threshold) * 2.0**-BITS
    return int(PERMUTATIONS * (1 - p) + SIGMAS * (PERMUTATIONS * p * (1 - p)) ** 0.5)


def estimate(a: Column, b: Column) -> Column:
    """The similarity estimated from the packed bits, corrected for agreement by chance."""
    chance = 2.0**-BITS
    return (1 - mismatches(a, b) / PERMUTATIONS - chance) / (1 - chance)


def near(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the threshold, and an estimate that doesn't rule it out."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (mismatches(F.col(f"{a}.bits"), F.col(f"{b}.bits")) <= most_mismatches(percent / 100))


def dealt_join(scope: Scope, rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """rows joined to side, a written table with a row for each key and n, its number of rows: the most frequent keys by broadcast, the rest by shuffle."""
    hot = F.broadcast(scope.write(side.orderBy(F.desc("n"), key).limit(HOT), "hot"))
    rest = rows.join(hot.select(key), key, "left_anti").join(side.join(hot.select(key), key, "left_anti"), key)
    return rows.join(hot, key).unionByName(rest)


def confirmed(scope: Scope, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. pairs: a written table."""
    counts = pairs.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / STAR_ROWS).cast("int")
    hot = F.broadcast(scope.write(counts.orderBy(F.desc("n"), "id").limit(HOT).select(F.col("id").alias("a"), parts.alias("parts")), "hot"))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    one = sets.join(hot, F.col("id") == F.col("a"), "left").select(F.col("id").alias("a"), F.col("shingles").alias("x"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    found = dealt.join(one, ["a", "part"]).join(two, "b").withColumn("both", both)
    return found.where(100 * F.col("both") >= percent * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def judged_stars(scope: Scope, pairs: DataFrame, narrow: DataFrame, percent: int) -> DataFrame:
    """The pairs of a centre a and a class b that sizes and packed bits don't rule out. pairs: a written table."""
    counts = pairs.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    centres = scope.write(counts.join(narrow, "id").select(F.col("id").alias("a"), "n", F.col("n_shingles").alias("size_a"), F.col("bits").alias("bits_a")), "centres")
    judged = dealt_join(scope, pairs, centres, "a").join(narrow, F.col("b") == F.col("id"))
    sizes = 100 * F.least("size_a", "n_shingles") >= percent * F.greatest("size_a", "n_shingles")
    return judged.where(sizes & (mismatches(F.col("bits_a"), F.col("bits")) <= most_mismatches(percent / 100))).select("a", "b")


def size_class(n: Column, percent: int) -> Column:
    """Sets whose sizes allow the threshold are in one class or in two that follow each other."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / percent) * (1 + 1e-9))).cast("int")


def open_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of step 3 from the rows of open bands (band, id, root, n_shingles, bits, bands, n: the band's rows)."""
    parts = F.ceil(F.col("n") / BAND_ROWS_A_TASK).cast("int")
    rows = open_.withColumn("size", size_class(F.col("n_shingles"), percent))
    # one side stands in one part of its band, the other in all of them and in three size classes
    x = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    y = rows.withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    common = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), True)
    first_band = F.element_at("x.bands", common.cast("int")) == F.col("x.band")
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.part") == F.col("y.part"))
    return x.alias("x").join(y.alias("y"), same & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & near("x", "y", percent) & first_band).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def grouped_rows(scope: Scope, rows: DataFrame, percent: int) -> DataFrame:
    """near_duplicates of a written table (row_id, doc_id, text); leaves the tables `sketches` and `grouped` in the scope."""
    small_batches(rows.sparkSession)
    sketches = scope.write(rows.mapInArrow(_sketches, SKETCH), "sketches")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")
    classes = sketches.where("n_shingles > 0").groupBy("digest").agg(F.min(rank).alias("rank"))
    first = sketches.select(F.col("row_id").alias("first"), "n_shingles", "bands", "bits")
    # the row id of a class's first row names the class
    classes = scope.write(classes.join(first, F.col("rank.row_id") == F.col("first")).select(F.col("first").alias("id"), "rank", "digest", "n_shingles", "bands", "bits"), "classes")
    narrow = classes.select("id", "n_shingles", "bits")

    rows_of_bands = classes.select("id", F.explode("bands").alias("band"))
    shared = rows_of_bands.groupBy("band").agg(F.min("id").alias("centre"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("centre < last")
    shared = scope.write(shared.select("band", "centre", "n"), "shared")
    members = scope.write(dealt_join(scope, rows_of_bands, shared, "band"), "members")
    pairs = scope.write(members.where("id <> centre").select(F.col("id").alias("b"), F.col("centre").alias("a")).distinct(), "pairs")
    stars = scope.write(judged_stars(scope, pairs, narrow, percent), "stars")

    ids = scope.write(members.select("id").distinct(), "ids")
    sets = scope.write(rows.where(guard(ids)(F.col("row_id"))).join(ids, F.col("row_id") == F.col("id")).select("id", "text").mapInArrow(_sets, "id long, shingles array<long>"), "sets")
    links = scope.write(confirmed(scope, stars, sets, percent), "links")
    round_ = Scope(scope.spark)
    found = components(links, round_)

    def still_open() -> DataFrame:
        """The rows of bands with classes of different components, with what pairs are judged by."""
        placed = scope.write(members.select("id", "band").join(found, "id", "left").select("id", "band", F.coalesce("root", "id").alias("root")), "placed")
        mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
        mixed = scope.write(mixed.select("band", "n"), "mixed")
        return scope.write(dealt_join(scope, placed, mixed, "band").join(classes.select("id", "n_shingles", "bits", "bands"), "id"), "open")

    open_ = still_open()
    beside = open_.select("band", "bits", "id", "root", "n_shingles").repartitionByRange("band", "bits").sortWithinPartitions("band", "bits", "id")
    beside = scope.write(beside.mapInArrow(partial(_neighbours, percent), "a long, b long").distinct().join(stars, ["a", "b"], "left_anti"), "beside")
    added = scope.write(confirmed(scope, beside, sets, percent), "links")
    if not added.isEmpty():
        links = links.unionByName(added)
        found = components(links, round_)
        open_ = still_open()

    more = scope.write(open_pairs(open_, percent).join(stars.unionByName(beside), ["a", "b"], "left_anti"), "more")
    added = scope.write(confirmed(scope, more, sets, percent), "links")
    if not added.isEmpty():
        found = components(links.unionByName(added), round_)

    grouped = scope.write(classes.select("id", "rank", "digest").join(found, "id", "left").select("digest", "rank", F.coalesce("root", "id").alias("root")), "grouped")
    round_.release()
    scope.release("rows", "numbered", "sketches", "grouped")
    best = grouped.groupBy("root").agg(F.min("rank").alias("best"))
    placed = grouped.join(best, "root").select(F.col("digest").alias("own"), "best")
    result = sketches.select("row_id", "doc_id", "n_shingles", "digest").join(placed, (F.col("digest") == F.col("own")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return result.select(
        "row_id",
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        (F.col("best").isNull() | (F.col("best.row_id") == F.col("row_id"))).alias("stays"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """row_id, doc_id, n_shingles, component_id, kept, stays (exactly one row of each component) of every row; links from `percent` up."""
    scope = Scope(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = grouped_rows(scope, scope.write(rows, "rows"), percent)
    scope.release("sketches", "grouped")
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns."""
    scope = Scope(docs.sparkSession)
    all_, row = numbered(scope, docs)
    (gone,) = fresh(all_.columns, "gone")
    rows = all_.select(F.col(row).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lost = scope.write(grouped_rows(scope, rows, percent).where("not stays").select(F.col("row_id").alias(gone)), "gone")
    scope.release("numbered", "gone")
    return without(all_, row, lost).drop(row)
