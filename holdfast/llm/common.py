"""What the operators share: text expressions, limits of Arrow batches, row numbers, and the library's scratch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.sources.scratch import Scope, clear_scratch, materialise, remove, scratch_path, write_table  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An Arrow batch ends at so many rows or bytes, whichever comes first; a single longer text is a batch of its own.
ARROW_ROWS, ARROW_BYTES = "256", "32m"


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Python workers when texts are long. Spark reads the settings when a plan runs, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores in front as set it apart from all columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(scope: Scope, docs: DataFrame, label: str = "numbered") -> tuple[DataFrame, str]:
    """docs with a long column of a new name that names each row, and this name.

    The numbers depend on how the input falls into partitions, which changes with the executors at hand. So they are written
    together with the rows, once, and every step reads this table: no step numbers rows anew.
    """
    (name,) = fresh(docs.columns, "row_id")
    return scope.write(docs.select(F.monotonically_increasing_id().alias(name), "*"), label), name


#: Bits of the smallest and of the largest guard (1 MB), and bits meant for a key.
LEAST_GUARD, MOST_GUARD, GUARD_BITS = 1 << 14, 1 << 23, 16


def guard(keys: DataFrame):
    """A column function that is true of all values of the one column of keys, and of few others, up to a number of keys that fills MOST_GUARD bits.

    What it lets through goes on to a join; the rest, as a rule nearly all rows with their texts, need not be shuffled.
    """
    bits = min(max(1 << (GUARD_BITS * keys.count()).bit_length(), LEAST_GUARD), MOST_GUARD)
    places = lambda c: [F.pmod(h, F.lit(bits)) for h in (F.xxhash64(c), F.xxhash64(c, F.lit(1)))]
    # places of bits are below 2^23, so a word's bits can be added up
    at = keys.select(F.explode(F.array(*places(F.col(keys.columns[0])))).alias("at")).distinct()
    words = at.groupBy(F.shiftright("at", 5).alias("word")).agg(F.sum(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits")).collect()  # bits / 32 rows at most
    table = ["0"] * (bits // 32)
    for r in words:
        table[r.word] = str(r.bits)
    literal = F.split(F.lit(",".join(table)), ",").cast("array<bigint>")

    def may(c: Column) -> Column:
        found = F.lit(True)
        for p in places(c):
            found = found & (F.get(literal, F.shiftright(p, 5).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 32).cast("int"))) != 0)
        return F.coalesce(found & c.isNotNull(), F.lit(False))

    return may


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is not in gone, a written table of one column of another name."""
    may, (other,) = guard(gone), gone.columns
    return rows.where(~may(F.col(key))).unionByName(rows.where(may(F.col(key))).join(gone, F.col(key) == F.col(other), "left_anti"))


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def unit_hash(*cols: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the values and the seed; null counts as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    digest = F.md5(F.concat_ws(":", *parts, F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2**52)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
