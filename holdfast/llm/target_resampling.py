"""Resampling documents towards a target distribution.

Features are runs of one to three consecutive words, hashed into buckets by crc32. The buckets of all documents and of all
texts of the target are counted; the gain of a bucket is a floored log ratio, and a document's weight is the sum of the gains of
its features, read from one array of gains. Weight plus Gumbel noise from the hash of the id is the score, so the largest
scores are a sample without replacement that is drawn in proportion to the weights.

The k-th largest score is found exactly by radix selection: the key is (score descending, null id last, id, features, row number), and each
round counts the next digit of the rows that are still in question, over the whole table, and descends into the digit where the
k-th row lies. At most 2**DIGIT counts a round reach the driver, however large the table. Only rows up to the k-th key are
range-sorted and ranked.

Words and hashes are worked out with numpy over the bytes of a whole Arrow batch: crc32 goes on from the end of one word over a space
to the next, for all places of the batch together.

Defined results: a null or empty text has no features, weight 0 and is not eligible; a null id hashes as the empty string and
comes after all other ids of its score; rows that repeat id and score are drawn in order of their features, and whole repeats are told apart by
their row number only, so they are alike; an empty target has no counts, and all gains follow the documents' own; an empty
table gives an empty table; `resampled` keeps all columns, whatever their names. A batch, or a single longer text, takes some 150 bytes a
word in its task.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import Scope, fresh, numbered, small_batches

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 3, 42, 20, 5
#: Bits of a digit: a round counts 2**DIGIT values at most.
DIGIT = 12
POLYNOMIAL = 0xEDB88320
SPACE = 0x20


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


def _folded() -> np.ndarray:
    """For each byte: A-Z in lower case, bytes that belong to no word as 0. All bytes of characters beyond ASCII are word bytes."""
    t = np.zeros(256, np.uint8)
    for chars in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", bytes(range(128, 256))):
        t[list(chars)] = list(chars)
    t[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = list(b"abcdefghijklmnopqrstuvwxyz")
    return t


CRC, FOLDED = _crc_table(), _folded()


def _fed(state: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 registers after size bytes from start. Longer words go first, so that every step takes a slice."""
    order = np.argsort(-size, kind="stable")
    state, start = state[order], start[order]
    many = len(size) - np.cumsum(np.bincount(size, minlength=1))  # words of more than j bytes
    for j, n in enumerate(many[:-1]):
        state[:n] = CRC[(state[:n] ^ raw[start[:n] + j]) & 255] ^ (state[:n] >> 8)
    out = np.empty_like(state)
    out[order] = state
    return out


def features(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: the buckets of all features, the text that each belongs to, and the number of words of each text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = FOLDED[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = np.concatenate(([False], raw != 0, [False]))
    # a text ends its words, too: where one begins inside a run, the run is cut
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edges[::2], edges[1::2]
    cuts = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(raw))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1]])
    start, stop = np.sort(np.concatenate((start, cuts))), np.sort(np.concatenate((stop, cuts)))
    owner = np.searchsorted(ends, start, side="right") - 1
    size = stop - start
    words = np.bincount(owner, minlength=len(texts))
    found, owners, state = [], [], np.full(len(start), 0xFFFFFFFF, np.uint32)
    for n in range(longest):
        # the features of n + 1 words: those of n words go on over a space to the next word, if that is one of the same text
        m = max(len(start) - n, 0)
        on = np.flatnonzero(owner[:m] == owner[n:])
        begun, state = state[on], np.zeros(m, np.uint32)
        if n:
            begun = CRC[(begun ^ SPACE) & 255] ^ (begun >> 8)
        state[on] = _fed(begun, raw, start[n:][on], size[n:][on])
        found.append((state[on] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
        owners.append(owner[on])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), words


def _counted(buckets: int, longest: int):
    """A task's counts: one row for each bucket that occurs."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(features(b.column(0), buckets, longest)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """Of all whole texts; `buckets` numbers, however many texts there are."""
    small_batches(texts.sparkSession)
    rows = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_counted(buckets, longest), "bucket long, n long")
    out = [0] * buckets
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(own: list[int], target: list[int]) -> list[int]:
    s, t = np.array(own, float), np.array(target, float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64).tolist()


def _weighed(gain: list[int], longest: int):
    values = np.array(gain, np.int64)

    def run(batches):
        for b in batches:
            at, owner, words = features(b.column(b.num_columns - 1), len(values), longest)
            order = np.argsort(owner, kind="stable")
            upto = np.concatenate(([0], np.cumsum(values[at[order]])))
            n = np.bincount(owner, minlength=b.num_rows)
            ends = np.cumsum(n)
            weight = upto[ends] - upto[ends - n]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(x, pa.int64()) for x in (n, words, weight)]], names=[*b.schema.names[:-1], "n_features", "n_words", "weight"])

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = SEED, extra: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, the extra columns, n_features, n_words, weight, score of every row."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *extra, F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = rows.drop("text").schema.add("n_features", "long").add("n_words", "long").add("weight", "long")
    return rows.mapInArrow(_weighed(gain, LONGEST), schema).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


class Field(NamedTuple):
    """A long column of the key, smallest first, not null."""

    name: str

    @property
    def bits(self) -> Column:
        """The value with the sign turned over: in the order of unsigned numbers."""
        return F.col(self.name).bitwiseXOR(F.lit(-(1 << 63)))

    def above(self, shift: int) -> Column:
        return F.shiftrightunsigned(self.bits, shift) if shift else self.bits


def _unsigned(value: int) -> int:
    return value + (1 << 63)


def _literal(bits: int) -> Column:
    """64 bits as a long."""
    return F.lit(bits - (1 << 64) if bits >= 1 << 63 else bits).cast("long")


def kth_key(rows: DataFrame, key: list[str], k: int, digit: int = DIGIT) -> Column:
    """True of the first k rows in the order of the key. key: long columns without nulls, unique together; 1 <= k <= number of rows."""
    taken, same = F.lit(False), F.lit(True)
    for name in key:
        field = Field(name)
        low, high, n = rows.where(same).agg(F.min(name), F.max(name), F.count(F.lit(1))).first()
        if n == k:
            return taken | same
        low, high = _unsigned(low), _unsigned(high)
        shift = (low ^ high).bit_length()  # the bits above are the same in all rows
        prefix = high >> shift
        while shift:
            step = min(digit, shift)
            left = same & (field.above(shift) == _literal(prefix)) if shift < 64 else same
            shift -= step
            value = field.above(shift).bitwiseAND(F.lit((1 << step) - 1))
            counts = {r.v: r.n for r in rows.where(left).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 2**digit at most
            at = 0
            for at in sorted(counts):
                if k <= counts[at]:
                    break
                k -= counts[at]
            prefix = (prefix << step) | at
            if k == counts[at]:  # all rows of this prefix are in
                most = ((prefix + 1) << shift) - 1
                return taken | (same & (F.col(name) <= most - (1 << 63)))
        kth = prefix - (1 << 63)
        taken, same = taken | (same & (F.col(name) < kth)), same & (F.col(name) == kth)
    return taken | same


def ranked(scope: Scope, drawn: DataFrame, key: list[str]) -> DataFrame:
    """drawn with `rank` from 1 in the order of the key: sorted by ranges, each counted by itself."""
    dealt = scope.write(drawn.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "drawn")
    # a row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*key))
    return dealt.join(F.broadcast(offsets), "part").withColumn("rank", (F.col("offset") + place).cast("long")).drop("part", "offset")


KEY = ["worse", "no_id", "id", "n_features", "row_id"]


def drawn_and_rest(scope: Scope, rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """The drawn rows with their rank, and the others. rows: a written table of doc_id, n_features, n_words, score, row_id and more."""
    keyed = rows.withColumns({"worse": -F.col("score"), "no_id": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0))})
    eligible = keyed.where(F.col("n_words") >= least_words)
    k = percent * eligible.count() // 100
    if not k:
        return rows.where(F.lit(False)).withColumn("rank", F.lit(None).cast("long")), rows
    first = kth_key(eligible.select(KEY), KEY, k) & (F.col("n_words") >= least_words)
    drawn = ranked(scope, keyed.where(first), KEY).select(*rows.columns, "rank")
    return drawn, keyed.where(~first).select(*rows.columns)


def resample_plan(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn), n_words of every row."""
    scope = Scope(docs.sparkSession)
    rows, _ = numbered(scope, scored(docs, target, id_col, text_col, target_col, seed), "scored")
    drawn, rest = drawn_and_rest(scope, rows, percent)
    scope.release("scored", "drawn")
    both = drawn.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))
    return both.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn documents with all their columns and `rank`, which takes the place of a column of that name.

    The rows are numbered and written once, as a row is known by its number only.
    """
    scope = Scope(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != "rank"]
    own, row = numbered(scope, docs.select(*[F.col(f"`{c}`") for c in kept]))
    rows = scope.write(scored(own, target, id_col, text_col, target_col, seed, (F.col(row).alias("row_id"),)), "scored")
    drawn, _ = drawn_and_rest(scope, rows, percent)
    (number,) = fresh([*own.columns, "rank"], "number")
    scope.release("numbered", "scored", "drawn")
    return own.join(drawn.select(F.col("row_id").alias(number), "rank"), F.col(row) == F.col(number)).select(*[F.col(f"`{c}`") for c in kept], "rank")
