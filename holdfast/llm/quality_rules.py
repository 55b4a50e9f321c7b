"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Counts of words, symbols, stop words and lines are expressions over the whole text; every row of `RULES` is a bound on a count or on
a ratio of two counts, in percent, and becomes a comparison of integers. A row of documents needs nothing but itself: no shuffle.

Repeated windows: the hashes of all windows of eight words are sorted with their places inside the row, neighbours of one hash are
compared by their words, and the places that are left are added up as a union of intervals; rows whose hashes all differ skip the sort.

Defined results: a null or empty text has no words and fails `short`; a ratio over nothing (no words, no lines) breaks no bound;
rows are judged one by one, so repeated rows and null ids change nothing; an empty table gives an empty table; `kept_documents` and
`judged` keep all columns, whatever their names. A very long text is one row of a task: its words and their places are held in memory,
some 100 bytes a word.
"""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import fresh

#: Characters that part words (and no others), and the symbols.
BLANKS, SYMBOLS, MARKS, DIGITS = " \t\n\x0b\x0c\r", "#*$%&|<>", "!?", "0123456789"
WINDOW = 8
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
a an and are as at be by for from has have he in is it of on or that the they this to was were which with you
au aux ce dans de des du elle en est et il la le les ne ou par pas pour que qui se sont sur un une
auch auf aus das dem den der die ein eine er es für im ist mit nicht sich sie sind und von war wie zu
al como con del el ella es fue las lo los más no para pero por se ser sin su también una y
""".split()


class Rule(NamedTuple):
    """Fails where count is below `least` or above `most`; with `per`, where 100 * count is below least * per or above most * per."""

    name: str
    count: str
    per: str | None
    least: int | None
    most: int | None


#: The first two are the base.
RULES = (
    Rule("short", "n_words", None, 20, None),
    Rule("repeated_windows", "n_repeat_words", "n_words", None, 30),
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("marks", "n_marks", "n_words", None, 10),
    Rule("digits", "n_digits", "word_chars", None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 3, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("stutter", "n_same_words", "n_words", None, 20),
    Rule("bullets", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", None, 30),
)
BASE = ("short", "repeated_windows")


def let(value: Column, then) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), 0)


def n_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1)), " "), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many of the words (an array bound by `let` or a column) lie in a window that occurs twice or more."""

    def covered(hashes: Column) -> Column:
        def places(found: Column) -> Column:
            own = lambda x: F.slice(words, x["at"] + 1, F.lit(window))
            same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (own(x) == own(y)), F.lit(False))
            marked = F.transform(found, lambda x, i: F.when(same(x, F.get(found, i - 1)) | same(x, F.get(found, i + 1)), x["at"]))
            return F.sort_array(F.filter(marked, lambda at: at.isNotNull()))

        def union(at: Column) -> Column:
            lengths = F.transform(at, lambda a, i: F.coalesce(F.least(F.get(at, i + 1) - a, F.lit(window)), F.lit(window)))
            return F.aggregate(lengths, F.lit(0), lambda total, n: total + n)

        found = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(found, places), union))

    def joined(h: Column, step: int) -> Column:
        return F.transform(h, lambda a, i: F.xxhash64(a, F.get(h, i + step)))

    # hashes of one word, of two, of four and so on: each from two of the one before
    hashes, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < window:
        step = min(width, window - width)
        hashes = let(hashes, partial(joined, step=step))
        width += step
    return F.when(F.size(words) > window, let(F.slice(hashes, F.lit(1), F.size(words) - (window - 1)), covered)).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """A struct of all counts of a text, long."""

    def counts(words: Column) -> list[Column]:
        return [
            F.size(words).alias("n_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop_words"),
            F.size(F.filter(words, lambda w, i: F.coalesce(w == F.get(words, i - 1), F.lit(False)))).alias("n_same_words"),
            repeated_words(words).alias("n_repeat_words"),
        ]

    def of_lines(lines: Column) -> list[Column]:
        return [
            F.size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("n_ellipsis_lines"),
        ]

    whole = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    plain = [(F.length(whole) - n_of(whole, BLANKS)).alias("word_chars"), n_of(whole, SYMBOLS).alias("n_symbols"), n_of(whole, MARKS).alias("n_marks"), n_of(whole, DIGITS).alias("n_digits")]
    of_words = let(words_of(whole), lambda w: F.struct(*counts(w)))
    return F.struct(F.struct(*plain).alias("chars"), of_words.alias("words"), let(lines, lambda x: F.struct(*of_lines(x))).alias("lines"))


#: Where each count stands in the struct.
PLACES = {
    **{c: f"chars.{c}" for c in ("word_chars", "n_symbols", "n_marks", "n_digits")},
    **{c: f"words.{c}" for c in ("n_words", "n_stop_words", "n_same_words", "n_repeat_words")},
    **{c: f"lines.{c}" for c in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")},
}


def broken(rule: Rule, count) -> Column:
    """Whether a row breaks the rule. count: gives the column of a count by its name."""
    if rule.count not in PLACES or rule.per not in (None, *PLACES):
        raise ValueError(f"rule {rule.name}: unknown count, choose from {', '.join(PLACES)}")
    value, per = (count(rule.count), F.lit(1)) if rule.per is None else (100 * count(rule.count), count(rule.per))
    bounds = [value < rule.least * per] if rule.least is not None else []
    bounds += [value > rule.most * per] if rule.most is not None else []
    failed = F.lit(False)
    for b in bounds:
        failed = failed | b
    return failed if rule.per is None else failed & (per > 0)


def judged(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, dict[str, str]]:
    """docs with a column for each count and `broken`, the sorted names of the rules that the row breaks; and the columns' names, as
    docs may have some of them already."""
    wanted = [*PLACES, "broken"]
    names = dict(zip(wanted, fresh(docs.columns, *wanted), strict=True))
    (m,) = fresh([*docs.columns, *names.values()], "measures")
    count = lambda c: F.col(f"{m}.{PLACES[c]}").cast("long")
    failed = F.array_sort(F.array_compact(F.array(*[F.when(broken(r, count), F.lit(r.name)) for r in rules]))) if rules else F.array().cast("array<string>")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], measures(F.col(f"`{text_col}`")).alias(m))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *[count(c).alias(names[c]) for c in PLACES], failed.alias(names["broken"])), names


def kept_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that break no rule, with all their columns."""
    rows, names = judged(docs, text_col, rules)
    return rows.where(F.size(names["broken"]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept, broken of every row."""
    rows, _ = judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    base = F.arrays_overlap("broken", F.array(*map(F.lit, BASE)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.size("broken") == 0).alias("kept"), F.concat_ws(",", "broken").alias("broken"), "n_lines", "n_stop_words", "n_same_words", "n_marks", "n_digits", "n_bullet_lines", "n_ellipsis_lines")
