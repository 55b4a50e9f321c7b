"""Benchmark decontamination by template canonicalisation.

Texts become tokens in three forms. `typed`: numbers, units after numbers, and capitalised words inside sentences are
placeholders that keep their values as slots; all else is in lower case. `named`: so are capitalised words at the start of
sentences, as names may stand there too. `plain`: all tokens in lower case. Windows of WINDOW
tokens of the benchmark are hash-joined to those of the documents. Hits of an item on one diagonal (place in the document less
place in the item) form a line. Lines on diagonals up to SHIFT apart that lie beside each other in
the document and add windows to each other form an alignment, so tokens put in or left
out do not break it, but pieces scattered over a document are not added up.

Slots are checked in each alignment. A quantity of the item is a number with the token after it, a unit with the number before it, or a name:
`60 km` and `60 minutes` may become 40 and 30, while two places of `40 balls` stand for one value. With `shared_values` 5 apples and 7 pears may
both become 6; without it a value that would stand for two of the item's counts for neither. A name that becomes two names voids its alignment. The value of another quantity is the one that most of the alignment's windows show (the smallest of equal ones); windows that show another one are cut
out, the rest stays. A document is contaminated by an item of which the remaining windows of one alignment cover COVERAGE of the windows of a
form. The verdict comes from the values of the alignment that covers most: `reparameterised` if any differs from the item's, else `verbatim`.

A filter of the benchmark's windows (two bits each, at most FILTER_BYTES in all, however large the benchmark) goes to the tasks, so
that nearly all other windows are not emitted; the join decides.

Defined results: null or empty texts have no windows; an item of fewer than WINDOW tokens is one window of its own length;
typed and named windows of the benchmark with fewer than LITERALS tokens that are no placeholders are left out, an item
without such windows has its plain form only, and one without capitalised starts has no named form; repeated rows give
repeated results; null ids stay null; empty tables give an empty table; other columns are ignored. `clean_documents` goes by the
text: equal texts stay or go together.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import Scope, fresh, small_batches, without
from holdfast.llm.shingles import windows

WINDOW, COVERAGE, LITERALS, SHIFT = 5, 0.8, 2, 3
#: Slices of the filter, bits of the smallest and of the largest one, and the bits meant for a window.
SLICES, LEAST_BITS, MOST_BITS, BITS_A_WINDOW = 64, 10, 22, 32
FILTER_BYTES = SLICES * 2**MOST_BITS // 8
#: Rows meant for an emitted batch, tokens that a worker remembers, tokens taken together, and windows looked up at a time.
EMITTED, REMEMBERED, TOGETHER, LOOKED_UP = 4096, 1_000_000, 200_000, 1 << 18
PLAIN, TYPED, NAMED = 0, 1, 2
BREAK, NUMBER, UNIT, CAPITAL, END = 1, 2, 4, 8, 16
#: Stands after each text: a token like no other, which no window of the benchmark has.
END_OF_TEXT = "\0"
#: What placeholders hash to: numbers, units, names.
PLACEHOLDERS = tuple(np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\0n", b"\0u", b"\0p"))
#: Units of measure and money, in lower case.
UNITS = """
mm cm m km in ft yd mi mg g kg t oz lb lbs ml l gal ms s sec secs min mins h hr hrs hour hours minute minutes second seconds
day days week weeks month months year years percent mph kmh kph hz khz mhz ghz kb mb gb tb v w kw kwh mw j kj cal kcal k c f
inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters
gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons degree degrees
dollar dollars cent cents euro euros usd eur gbp
"""
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]|\d+(?:[.,]\d+)*")
MATCHES = "row_id long, doc_id long, digest string, hash long, form int, place int, slots array<string>"
FOUND = "doc_id long, digest string, item_id long, coverage double, verdict string, n_places long"


class Lexicon(dict):
    """The number of a token; by number its hash in lower case and its kinds as bits."""

    def __init__(self):
        self.units = frozenset(UNITS.split())
        self.hash, self.kind = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint8)

    def __missing__(self, token: str) -> int:
        at, low = len(self), token.lower()
        if at == len(self.hash):
            self.hash, self.kind = np.resize(self.hash, 2 * at), np.resize(self.kind, 2 * at)
        self.hash[at] = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass"))
        capital = token[0].isupper() and not token.isupper()
        self.kind[at] = BREAK if token in ".!?\n" else END if token == END_OF_TEXT else NUMBER * token[0].isdigit() | UNIT * (low in self.units) | CAPITAL * capital
        self[token] = at
        return at

    def numbers(self, tokens: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


#: The lexicon of this Python worker: what a task has met serves the worker's next one.
LEXICONS: list[Lexicon] = []


def lexicon_of_worker() -> Lexicon:
    if not LEXICONS:
        LEXICONS.append(Lexicon())
    return LEXICONS[0]


@dataclass
class Forms:
    """raw: tokens as they stand; real: places of those that are no ends of sentences. By form the hashes of real tokens and where placeholders
    are. ends: the real places of ends of texts. beside: where a token's partner is, the next one for numbers, the one before for units."""

    raw: list[str]
    real: np.ndarray
    hashes: list[np.ndarray]
    slots: list[np.ndarray]
    ends: np.ndarray
    beside: np.ndarray

    def quantities(self, form: int, place: int, k: int) -> list[str]:
        """What a window's slots stand for: the value, a space, and its partner if there is one."""
        out = []
        for i in range(place, place + k):
            if self.slots[form][i]:
                partner = i + int(self.beside[i])
                named = self.raw[self.real[partner]].lower() if partner != i and partner < len(self.real) else ""
                out.append(f"{self.raw[self.real[i]].lower()} {named}")
        return out

    def values(self, form: int, place: int, k: int) -> list[str]:
        """The values of a window's slots, in lower case."""
        return [self.raw[self.real[i]].lower() for i in range(place, place + k) if self.slots[form][i]]


def forms_of(raw: list[str], lexicon: Lexicon) -> Forms:
    at = lexicon.numbers(raw)
    kind = lexicon.kind[at]
    real = np.nonzero(kind != BREAK)[0]
    start = np.concatenate([[True], kind & (BREAK | END) > 0])[:-1][real]
    kind, plain = kind[real], lexicon.hash[at[real]]
    number = kind & NUMBER > 0
    unit = (kind & UNIT > 0) & np.concatenate([[False], number])[:-1]
    name = (kind & CAPITAL > 0) & ~number & ~unit
    typed = plain.copy()
    for where, value in zip((number, unit, name & ~start), PLACEHOLDERS, strict=True):
        typed[where] = value
    named = typed.copy()
    named[name & start] = PLACEHOLDERS[2]
    inside = number | unit | (name & ~start)
    return Forms(raw, real, [plain, typed, named], [np.zeros(len(real), bool), inside, inside | name], np.nonzero(kind == END)[0], number.astype(np.int8) - unit)


def _hashes(form: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k tokens; none if there are fewer."""
    return windows(form, k) + np.uint64(k) if len(form) >= k else np.array([], np.uint64)


def _items(batches):
    lexicon = Lexicon()
    for b in batches:
        rows = []
        for item_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forms = forms_of(TOKEN.findall(text or ""), lexicon)
            k = min(WINDOW, len(forms.real))
            if not k:
                continue
            for form in (PLAIN, TYPED, NAMED):
                # without slots of its own a form is the one before
                if form != PLAIN and (forms.slots[form] == forms.slots[form - 1]).all():
                    continue
                # a form whose windows all lack literals would match anything
                mask = k - np.convolve(forms.slots[form], np.ones(k, int), "valid") >= min(LITERALS, k)
                n, h = int(mask.sum()), _hashes(forms.hashes[form], k).view(np.int64)
                rows += [(item_id, int(h[p]), form, p, k, n, forms.quantities(form, p, k)) for p in np.nonzero(mask)[0].tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())))],
            names=["item_id", "hash", "form", "item_place", "k", "n_windows", "item_slots"],
        )


def item_windows(scope: Scope, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return scope.write(rows.mapInArrow(_items, "item_id long, hash long, form int, item_place int, k int, n_windows int, item_slots array<string>"), "items")


class Sieve:
    """Two bits for each hash, in the slice that its upper bits name."""

    def __init__(self, bits: int, slices: dict[int, bytes]):
        self.bits = np.uint64(bits)
        self.table = np.zeros(SLICES * 2**bits // 8, np.uint8)
        for i, octets in slices.items():
            self.table[i * 2**bits // 8 : (i + 1) * 2**bits // 8] = np.frombuffer(octets, np.uint8)

    @staticmethod
    def probes(h: np.ndarray, bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        mask = (np.uint64(1) << bits) - np.uint64(1)
        return h & mask, (h >> np.uint64(29)) & mask

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where hashes may be among the sought ones."""
        left = np.arange(len(h))
        for probe in (0, 1):
            own = h[left]
            at = (own >> np.uint64(58) << self.bits) | self.probes(own, self.bits)[probe]
            left = left[(self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return left


def _slices(bits: int):
    def run(batches):
        made: dict[int, np.ndarray] = {}
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            part = (h >> np.uint64(58)).astype(np.int64)
            for i in np.unique(part).tolist():
                own = made.setdefault(i, np.zeros(2**bits, bool))
                for at in Sieve.probes(h[part == i], np.uint64(bits)):
                    own[at] = True
        for i, own in made.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "octets": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    return run


def sieve(items: DataFrame, n: int) -> Sieve:
    """At most FILTER_BYTES reach the driver: a row for each slice, made by one task."""
    bits = min(max((BITS_A_WINDOW * n // SLICES).bit_length(), LEAST_BITS), MOST_BITS)
    rows = items.select("hash").repartition(SLICES, F.shiftrightunsigned("hash", 58)).mapInArrow(_slices(bits), "slice int, octets binary")
    return Sieve(bits, {r.slice: r.octets for r in rows.collect()})


def found_windows(forms: Forms, k: int, sought: Sieve):
    """(form, place) of the windows of k tokens that may be the benchmark's."""
    n = len(forms.real) - k + 1
    for a in range(0, n, LOOKED_UP):
        plain = np.array([], np.int64)
        before = None
        for form in (PLAIN, TYPED, NAMED):
            h = _hashes(forms.hashes[form][a : a + LOOKED_UP + k - 1], k)
            if before is None:
                plain = sought.places(h)
            else:
                # windows without slots of their own are the form's before
                other = np.nonzero(h != before)[0]
                plain = np.concatenate([plain[h[plain] == before[plain]], other[sought.places(h[other])]])
            before = h
            yield from ((form, a + p, int(x)) for p, x in zip(plain.tolist(), h[plain].view(np.int64).tolist(), strict=True))


def _matches(lengths: list[int], sought):
    """sought: a broadcast Sieve."""

    def run(batches):
        lexicon, rows = lexicon_of_worker(), []

        def of(texts: list[tuple], raw: list[str]):
            forms = forms_of(raw, lexicon)
            starts = np.concatenate([[0], forms.ends + 1])
            for k in lengths:
                for form, p, h in found_windows(forms, k, sought.value):
                    text = int(np.searchsorted(forms.ends, p))
                    yield (*texts[text], h, form, p - int(starts[text]), forms.values(form, p, k))

        for b in batches:
            texts, raw = [], []
            for *own, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                texts.append(own)
                raw += TOKEN.findall(text or "")
                raw.append(END_OF_TEXT)
                if len(raw) > TOGETHER:
                    rows += of(texts, raw)
                    texts, raw = [], []
            rows += of(texts, raw)
            for i in range(0, len(rows), EMITTED):
                yield _emit(rows[i : i + EMITTED])
            rows = []
        yield _emit(rows)

    return run


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["row_id", "doc_id", "digest", "hash", "form", "place", "slots"])


#: A window of an item that a document has: its place and pairs of quantity and value.
Found = tuple[int, list[tuple[str, str]]]


@dataclass
class Alignment:
    """Lines of one form that lie together: text from first to last, the last diagonal, the item's places, and all windows."""

    first: int
    last: int
    diagonal: int
    places: set[int] = field(default_factory=set)
    windows: list[Found] = field(default_factory=list)

    def take(self, first: int, last: int, diagonal: int, windows: list[Found]) -> None:
        self.first, self.last, self.diagonal = min(self.first, first), max(self.last, last), diagonal
        self.places.update(p for p, _ in windows)
        self.windows += windows

    def settled(self, shared_values: bool) -> tuple[int, bool]:
        """Places whose windows show the values that quantities have, and whether these are the item's own."""
        votes: dict[str, Counter] = defaultdict(Counter)
        for _, pairs in self.windows:
            for quantity, value in pairs:
                votes[quantity][value] += 1
        if any(len(own) > 1 and q.endswith(" ") and not q[0].isdigit() for q, own in votes.items()):
            return 0, False
        value_of = {q: min(own, key=lambda v: (-own[v], v)) for q, own in votes.items()}
        same = all(q.split(" ")[0] == v for q, v in value_of.items())
        if not shared_values:
            stands_for: dict[str, set[str]] = defaultdict(set)
            for q, v in value_of.items():
                stands_for[v].add(q.split(" ")[0])
            value_of = {q: v for q, v in value_of.items() if len(stands_for[v]) == 1}
        return len({p for p, pairs in self.windows if all(value_of.get(q) == v for q, v in pairs)}), same


def aligned(lines: list[tuple[int, list[Found]]], k: int) -> list[Alignment]:
    """Alignments of one item's lines (diagonal, windows) in ascending order of diagonals."""
    out: list[Alignment] = []
    live: list[Alignment] = []
    for diagonal, found in lines:
        own = {p for p, _ in found}
        first, last = min(own) + diagonal, max(own) + diagonal + k - 1
        live = [a for a in live if diagonal - a.diagonal <= SHIFT]
        beside = [a for a in live if first <= a.last + WINDOW + SHIFT and last >= a.first - WINDOW - SHIFT and own - a.places]
        if beside:
            best = max(beside, key=lambda a: len(own - a.places))
        else:
            best = Alignment(first, last, diagonal)
            out.append(best)
            live.append(best)
        best.take(first, last, diagonal, found)
    return out


def judged(forms: dict[int, tuple[int, list[Alignment]]], shared_values: bool) -> tuple[float, str, int] | None:
    """coverage, verdict and number of places of one item in one document; forms: its windows and alignments by form."""
    found = {}
    for form, (n, all_) in forms.items():
        settled = [a.settled(shared_values) for a in all_ if len(a.places) >= COVERAGE * n]
        found[form] = [(places / n, same) for places, same in settled if places >= COVERAGE * n]
    every = [x for own in found.values() for x in own]
    if not every:
        return None
    coverage, same = max(every)
    return coverage, "verbatim" if same else "reparameterised", max(map(len, found.values()))


def _judge(shared_values: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        """Lines in the order of document row, item, form and diagonal."""
        key, forms, lines, out = None, {}, [], []

        def end_form():
            if lines:
                forms[key[4]] = (key[5], aligned(lines, key[6]))

        def end_item():
            end_form()
            if key is not None and (got := judged(forms, shared_values)) is not None:
                out.append((key[1], key[2], key[3], *got))

        def flush():
            types = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "digest", "item_id", "coverage", "verdict", "n_places"])

        for b in batches:
            for row in b.to_pylist():
                now = (row["row_id"], row["doc_id"], row["digest"], row["item_id"], row["form"], row["n_windows"], row["k"])
                if key is None or (now[0], now[3]) != (key[0], key[3]):
                    end_item()
                    key, forms, lines = now, {}, []
                elif now[4] != key[4]:
                    end_form()
                    key, lines = now, []
                lines.append((row["diagonal"], [(x["p"], list(zip(x["i"], x["d"], strict=True))) for x in row["windows"]]))
            yield flush()
            out = []
        end_item()
        yield flush()

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: Scope | None = None, shared_values: bool = False) -> DataFrame:
    """doc_id, digest (SHA-256 of the text), item_id, coverage double, verdict string, n_places long: one row for each document and item that it contains."""
    spark = docs.sparkSession
    small_batches(spark)
    items = item_windows(scope or Scope(spark), benchmark)
    lengths = [(r.k, r.n) for r in items.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect()]  # WINDOW rows at most
    sent = spark.sparkContext.broadcast(sieve(items, sum(n for _, n in lengths)))
    text = F.col(text_col).cast("string")
    # rows are numbered for this pass only
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("text"))
    hits = rows.mapInArrow(_matches([k for k, _ in lengths], sent), MATCHES).join(items, ["hash", "form"]).withColumn("diagonal", F.col("place") - F.col("item_place"))
    own = ["row_id", "doc_id", "digest", "item_id", "form", "n_windows", "k", "diagonal"]
    window = F.struct(F.col("item_place").alias("p"), F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    lines = hits.repartition("row_id", "item_id").groupBy(*own).agg(F.collect_set(window).alias("windows"))
    return lines.sortWithinPartitions("row_id", "item_id", "form", "diagonal").mapInArrow(_judge(shared_values), FOUND)


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", shared_values: bool = False) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    scope = Scope(docs.sparkSession)
    own, gone = fresh(docs.columns, "digest", "gone")
    bad = scope.write(contaminated(docs, benchmark, id_col, text_col, scope, shared_values).select(F.col("digest").alias(gone)).distinct(), "contaminated")
    scope.release("contaminated")
    rows = docs.withColumn(own, F.sha2(F.col(text_col).cast("string").cast("binary"), 256))
    return without(rows, own, bad).drop(own)
