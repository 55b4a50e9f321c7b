"""Text expressions of the library: words, snippets, labels, chunks, mentions, names, dates."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_WORDS, CHUNK_OVERLAP, SEGMENT_WORDS = 180, 40, 60
SNIPPET_WORDS, LABEL_WORDS = 25, 8
ELLIPSIS, UNTITLED, UNNAMED = "…", "Без назви", "запис"
NAME_LENGTH = 80
#: White space as \s means it in the SQL; Java's \s takes the vertical tab, too.
WHITE = r"[\t\n\f\r ]+"


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def let(value: Column, of) -> Column:
    """`of` a value that is worked out once, however often it stands in there."""
    return F.get(F.transform(F.array(value), of), 0)


def first_words(text: Column, n: int) -> Column:
    """The first n words, with an ellipsis if there are more."""
    return let(words(text), lambda w: F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, ELLIPSIS).otherwise("")))


def snippet(text: Column, n: int = SNIPPET_WORDS) -> Column:
    return first_words(text, n)


def default_label(text: Column, n: int = LABEL_WORDS, blank: str = UNTITLED) -> Column:
    """The first n words; `blank` if there are none."""
    return let(first_words(text, n), lambda x: F.when(x == "", blank).otherwise(x))


def stem(path: Column) -> Column:
    """A file's name without folders and its last suffix."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def first_filled(*texts: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def chunk_array(text: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping chunks of words; a text of one chunk keeps its inner white space. A text is split once, not for each of its chunks."""
    step = size - overlap

    def cut(w: Column) -> Column:
        count = F.greatest(F.floor((F.size(w) - overlap - 1) / step), F.lit(0)) + 1
        many = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.array_join(F.slice(w, (i * step + 1).cast("int"), size), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) <= size, F.array(F.trim(F.regexp_replace(text, f"^{WHITE}|{WHITE}$", "")))).otherwise(many)

    return let(words(text), cut)


def chunks(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, chunk_ix, chunk_text."""
    return items.select(F.col(id_col).alias("item_id"), F.posexplode(chunk_array(F.col(text_col))).alias("chunk_ix", "chunk_text"))


def segment_chunks(segments: Column, least: int = SEGMENT_WORDS) -> Column:
    """Joins consecutive segments (start, text) until they have `least` words; a chunk starts where its first segment does.

    Sequential by nature: a fold over the array.
    """
    blank = F.struct(F.lit(None).cast("double").alias("start"), F.lit("").alias("text"), F.lit(0).alias("n"))
    start = F.struct(F.array().cast("array<struct<ts_s:double,text:string>>").alias("done"), blank.alias("open"))

    def closed(s):
        return F.concat(s["done"], F.array(F.struct(s["open"]["start"].alias("ts_s"), s["open"]["text"].alias("text"))))

    def step(s, x):
        o = s["open"]
        grown = F.struct(
            F.when(o["n"] == 0, x["start"]).otherwise(o["start"]).alias("start"),
            F.when(o["n"] == 0, F.trim(x["text"])).otherwise(F.concat(o["text"], F.lit(" "), F.trim(x["text"]))).alias("text"),
            (o["n"] + word_count(x["text"])).alias("n"),
        )
        s = F.struct(s["done"].alias("done"), grown.alias("open"))
        return F.when(s["open"]["n"] >= least, F.struct(closed(s).alias("done"), blank.alias("open"))).otherwise(s)

    return F.aggregate(segments, start, step, lambda s: F.when(s["open"]["n"] > 0, closed(s)).otherwise(s["done"]))


def plain(text: Column) -> Column:
    """Lower case with ß as ss, runs of white space as one space, trimmed: the form in which exact phrases are sought."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"\s+", " "))


def mentions(text: Column, phrase: str) -> Column:
    """How often the phrase stands in the text, without overlaps."""
    needle = " ".join(phrase.casefold().split())
    if not needle:
        return F.lit(0)
    hay = plain(text)
    return ((F.length(hay) - F.length(F.replace(hay, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def literally_contains(text: Column, phrase: Column) -> Column:
    return F.contains(plain(text), plain(phrase))


QUOTED = r'(?s)^\s*[«"“]\s*(.+?)\s*[»"”]\s*$'


def exact_query(query: str) -> str | None:
    """What stands in quotation marks, if they enclose all of the query."""
    found = re.match(QUOTED, query)
    return (found[1].strip() or None) if found else None


def exact_query_column(query: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(query, QUOTED, 1)), F.lit(""))


def query_tokens(query: str) -> list[str]:
    """Tokens of two or more word characters, in lower case, each once."""
    return list(dict.fromkeys(t.lower() for t in re.findall(r"\w{2,}", query)))


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters; a shorter text is its own."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, 3))
    return F.when(F.length(text) < 3, F.array(text)).otherwise(F.array_distinct(runs))


def trigram_overlap(query: Column | str, text: Column) -> Column:
    """The share of the query's trigrams that the text has. For a query given as a string each of its trigrams is looked for in the text."""
    if isinstance(query, str):
        runs = list(dict.fromkeys(query[i : i + 3] for i in range(max(len(query) - 2, 1))))
        has = [F.contains(text, F.lit(r)) if len(r) == 3 else text == r for r in runs]
        return F.coalesce(sum(h.cast("int") for h in has) / len(runs), F.lit(0.0)) if query else F.lit(0.0)
    q = trigrams(query)
    return F.when((F.length(query) == 0) | (F.length(text) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(q, trigrams(text))) / F.size(q))


#: Letters that transcripts confuse, and apostrophes.
LETTERS = str.maketrans("іїыєэёґ", "иииееег", "'’ʼ`")


def fold_text(text: str | None) -> str:
    """Compatibility form, case folded, confusable letters made one, apostrophes dropped, punctuation to spaces."""
    folded = unicodedata.normalize("NFKC", text or "").casefold().translate(LETTERS)
    return " ".join(re.sub(r"[^\w\s]", " ", folded).split())


#: Texts that a task folds at a time: a batch has 10,000, whose Python strings would all be there at once.
FOLDED_AT_ONCE = 128


@F.arrow_udf(T.StringType())
def fold(texts: pa.Array) -> pa.Array:
    parts = [pa.array([fold_text(t) for t in texts.slice(at, FOLDED_AT_ONCE).to_pylist()], pa.string()) for at in range(0, len(texts), FOLDED_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def safe_name(label: Column) -> Column:
    """A file name from a label."""
    name = F.regexp_replace(label, r"[<>:\"/\\|?*\x00-\x1f]", " ")
    name = F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), r"\.+$", ""), r"\s+", " "))
    return F.when(F.length(name) == 0, UNNAMED).otherwise(F.rtrim(F.substring(name, 1, NAME_LENGTH)))


def unique_names(rows: DataFrame, name: str, order: str, suffix: str = "") -> DataFrame:
    """The names with " (2)", " (3)"... for those that are taken, in the given order."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.withColumn(name, F.concat(F.col(name), F.when(n > 1, F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(""), F.lit(suffix)))


def parse_moment(text: Column) -> Column:
    """ISO dates (with Z or an offset) and camera dates (yyyy:MM:dd HH:mm:ss), as UTC."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def backup_moment(name: Column, fallback: Column) -> Column:
    """The moment in a snapshot's name library-YYYYMMDD-HHMMSSmmm-reason, else the fallback."""
    stamp = F.regexp_replace(F.regexp_extract(name, r"^library-(\d{8}-\d{9})-", 1), r"(\d{3})$", ".$1")
    return F.coalesce(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd-HHmmss.SSS")), fallback)


def backup_reason(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^library-\d{8}-\d{9}-([\w-]+?)(?:\.\w+)?$", 1), F.lit(""))


def format_bytes(size: Column) -> Column:
    """Steps of 1024, a decimal comma, no decimals from 100 on."""
    step = F.least(F.greatest(F.floor(F.log(1024.0, F.greatest(size, F.lit(1)).cast("double")) + 1e-12), F.lit(0)), F.lit(4)).cast("int")
    value = size / F.pow(F.lit(1024.0), step)
    unit = F.get(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")]), step)
    shown = F.when((value >= 100) | (step == 0), F.format_string("%.0f", value)).otherwise(F.replace(F.format_string("%.1f", value), F.lit("."), F.lit(",")))
    return F.concat(shown, F.lit(" "), unit)


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.concat((s / 60).cast("long").cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def plural_form(n: Column, one: str, few: str, many: str) -> Column:
    """Slavic plural: 1, 21... one; 2 to 4, 22... few; else many."""
    ten, hundred = n % 10, n % 100
    teen = hundred.between(11, 14)
    return F.when((ten == 1) & ~teen, one).when(ten.between(2, 4) & ~teen, few).otherwise(many)
