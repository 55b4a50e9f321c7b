"""Secret scans, in DataFrame functions only.

Three patterns give the base spans. Beyond them every run of LEAST or more characters that keys are made of is scored
by two character Markov models, one of random strings and one of ordinary identifiers: the sum of the logarithms of the
ratios of their transition probabilities. Above MARGIN in all and RATE a transition it is a `markov` span. The models are counted from labelled samples;
`samples` makes some by rule, and any table of (text, label) can stand in for it.

Defined results: a null text is empty and has no spans; places count code points, ends are exclusive; spans are sorted by start, then by
kind in the order assign, access, hex, markov; repeated rows give repeated results; an empty table gives an empty table;
other columns are ignored; samples without a label or with other labels than 0 and 1 are left out, and without samples
there are no markov spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The runs of the base patterns that are long enough are those of 20 and 24 characters or more.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"(?<![0-9a-f])[0-9a-f]{24,}"
VALUE = 6
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
MARGIN, RATE, SMOOTHING, SAMPLES, SEED = 8.0, 0.5, 0.5, 6000, 9
#: Matches in a block.
BLOCK = 256
#: Words from which ordinary identifiers are put together.
WORDS = """
get set user name file path data list item index count total value key table column row page view list order date time start
end first last next previous update delete create insert select filter group window stream source target server client
request response handler manager service factory builder parser reader writer buffer cache queue stack node tree graph
edge path color width height size length number string text word line block image video audio message error result
status config option default version release build test module package library function method class object
bericht ergebnis zeitung gesellschaft entwicklung verantwortung gouvernement developpement information administration
desarrollo gobierno comunicacion organizacion international understanding relationship environment
"""


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """text, label of n random strings (1: base64, hex, upper-case keys) and n ordinary identifiers (0), made by rule from hashes."""
    rows = spark.range(n)
    pick = lambda j, k: F.pmod(F.xxhash64(F.col("id"), F.lit(j), F.lit(SEED)), F.lit(k)).cast("int")
    raw = F.sha2(F.concat(F.lit("r"), F.col("id").cast("string")).cast("binary"), 256)
    base64 = F.translate(F.base64(F.unhex(raw)), "=", "")
    upper = F.translate(F.translate(F.upper(base64), "+/", "Q7"), "=", "")
    random = F.element_at(F.array(base64, base64, raw, upper), pick(0, 4) + 1)
    random = F.substring(random, 1, 16 + pick(1, 28))
    words = F.array(*[F.lit(w) for w in sorted(set(WORDS.split()))])
    w = [F.element_at(words, F.pmod(pick(2 + j, 1_000_003), F.size(words)) + 1) for j in range(4)]
    forms = [
        F.concat_ws("_", *w[:3]),
        F.concat_ws("-", *w),
        F.concat(w[0], *[F.initcap(x) for x in w[1:]]),
        F.concat(*[F.initcap(x) for x in w]),
        F.concat(*w),
        F.upper(F.concat_ws("_", *w[:3])),
        F.concat(w[0], F.lit("/"), w[1], F.lit("/"), w[2], pick(7, 100).cast("string")),
        F.rpad((F.xxhash64(F.col("id"), F.lit(11)).bitwiseAND(F.lit(2**62 - 1))).cast("string"), 16, "0"),
        F.repeat(F.substring(F.lit(ALPHABET), pick(9, len(ALPHABET)) + 1, F.lit(1)), F.lit(20)),
    ]
    ordinary = F.element_at(F.array(*forms), pick(8, len(forms)) + 1)
    return rows.select(random.alias("text"), F.lit(1).alias("label")).unionByName(rows.select(ordinary.alias("text"), F.lit(0).alias("label")))


def codes(text: Column) -> Column:
    """For each character its place in the alphabet from 1, or 0."""
    return F.transform(F.split(text, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))


def train(labelled: DataFrame) -> list[float] | None:
    """Logarithms of the ratios of transition probabilities, row by row of (from, to); their counts are a bounded table."""
    size = len(ALPHABET) + 1
    c = labelled.where("label in (0, 1) and text is not null").select("label", codes(F.col("text")).alias("c")).where(F.size("c") > 1)
    pairs = F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c") - 1).alias("b"))
    found = c.select("label", F.explode(pairs).alias("p")).groupBy("label", F.col("p.a").alias("a"), F.col("p.b").alias("b")).count().collect()
    if not found:
        return None
    counts = [[[SMOOTHING] * size for _ in range(size)] for _ in range(2)]
    for r in found:
        counts[r.label][r.a][r.b] += r["count"]
    logs = [[[math.log(n / sum(row)) for n in row] for row in model] for model in counts]
    return [logs[1][a][b] - logs[0][a][b] for a in range(size) for b in range(size)]


def log_ratio(text: Column, ratios: list[float]) -> Column:
    """How much likelier the text is as a random string than as an identifier, as a logarithm."""
    size = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(f"{r:.6f}" for r in ratios)), ",").cast("array<double>")
    steps = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.get(table, a * size + b))
    return F.aggregate(steps(codes(text)), F.lit(0.0), lambda total, x: total + x)


def let(value: Column, of) -> Column:
    """`of` a value that is worked out once, however often it stands in there."""
    return F.get(F.transform(F.array(value), of), 0)


def spans(text: Column, found: Column, pattern: str, kind: str, keep: Column) -> Column:
    """Structs (start, rank, stop) of all matches `found` of the pattern in the text for which `keep`, an array of booleans, is true.

    The text between matches and the matches themselves give the places. They are added up in blocks of BLOCK matches, then inside
    each, as an array that grows match by match would be copied for each.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.char_length(s))
    lengths = F.transform(found, lambda s: F.char_length(s))
    both = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), lengths.alias("length"), keep.alias("keep"))
    none, no_place = F.array().cast("array<struct<start:int,rank:int,stop:int>>"), F.array().cast("array<int>")
    blocks = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda i: F.slice(all_, i * BLOCK + 1, F.lit(BLOCK)))
    length = lambda block: F.aggregate(block, F.lit(0), lambda t, x: t + x["gap"] + x["length"])

    def starts(parts: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), no_place.alias("out"))
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(F.transform(parts, length), first, step, lambda acc: acc["out"])

    def inside(block: Column, start: Column) -> Column:
        def step(acc, x):
            at = acc["at"] + x["gap"]
            span = F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (at + x["length"]).alias("stop"))
            return F.struct((at + x["length"]).alias("at"), F.when(x["keep"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    placed = let(both, lambda all_: let(blocks(all_), lambda parts: F.flatten(F.zip_with(parts, starts(parts), inside))))
    return F.when(F.exists(keep, lambda k: k), placed).otherwise(none)


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, rate: float = RATE) -> DataFrame:
    """doc_id and spans array<struct<start, rank, stop>>, sorted, of every row; rank is the place of the kind in KINDS."""
    ratios = train(samples(docs.sparkSession) if labelled is None else labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    every = {"assign": ASSIGN, "access": ACCESS, "hex": HEX} | ({"markov": CANDIDATE} if ratios else {})
    rows = rows.withColumns({k: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in every.items()} | {"values": F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))})
    keep = {k: F.transform(k, lambda _: F.lit(True)) for k in ("access", "hex")}
    keep["assign"] = F.transform("values", lambda v: F.char_length(v) >= VALUE)
    if ratios:
        keep["markov"] = F.transform("markov", lambda s: let(log_ratio(s, ratios), lambda v: (v > margin) & (v > rate * (F.char_length(s) - 1))))
    rows = rows.withColumns({f"keep_{k}": c for k, c in keep.items()})
    found = [spans(text, F.col(k), p, k, F.col(f"keep_{k}")) for k, p in every.items()]
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def joined(found: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(name, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    of = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    base = joined(F.filter("spans", lambda s: s["rank"] < 3))
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
