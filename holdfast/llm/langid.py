"""Language ID, words first.

Words are runs of letters in lower case; digits and other numeric characters are no letters. A word of the vocabulary adds
its log frequency in every language; any other falls back to its character 4-grams, then 3-, 2- and 1-grams, and adds the
mean of those that the model knows at the first length that has any. The language with the largest sum wins.

Learning takes about `per_language` documents of each language (those whose hash of id and text falls below a language's rate; all
of a smaller one) of the `languages` most frequent ones; rows that repeat id and text are learnt from once. Each language has a vocabulary of its own: its `vocabulary` most
frequent words and as many n-grams, down to those seen once; with many languages fewer, so that the tables have at most
`cells` entries. A token that any language keeps has its counts in all of them. Scoring covers all whole texts. Defined results: `und` with
score 0 for a null text, one without letters, and when nothing was learnt; ties go to the first language in order; null
ids are never held out and count as training rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import Scope, held_out, small_batches, unit_hash

PER_LANGUAGE, VOCABULARY, LONGEST, SMOOTHING, SEED = 1500, 20_000, 4, 0.5, 7
#: The most languages, and the most entries of the tables of log frequencies.
LANGUAGES, CELLS = 512, 16_000_000
#: Unknown words whose sums a task remembers; all go when the store is full. Numbers gathered at a time.
REMEMBERED, GATHERED = 200_000, 1 << 19
WORD = re.compile(r"[^\W\d_]+")


@cache
def numerals() -> dict[int, str]:
    """Characters that the pattern of words takes for letters although they are none (fractions, superscripts, letter-like numbers), to spaces."""
    return {i: " " for i in range(128, 0x20000) if chr(i).isalnum() and not chr(i).isalpha() and not chr(i).isdecimal()}


def words_of(text: str | None) -> list[str]:
    t = (text or "").lower()
    if not t.isascii() and not numerals().keys().isdisjoint(map(ord, set(t))):
        t = t.translate(numerals())
    return WORD.findall(t)


def grams(word: str, n: int) -> list[str]:
    """With marks for the ends, but for single characters."""
    w = word if n == 1 else f"\x02{word}\x03"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _counts(batches):
    total: Counter = Counter()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total.update((lang, w) for w in words_of(text))
        if len(total) > REMEMBERED:
            yield from _spread(total)
            total = Counter()
    yield from _spread(total)


def _spread(total: Counter):
    """Words have length 0; n-grams their n."""
    out: Counter = Counter()
    for (lang, w), n in total.items():
        out[lang, 0, w] += n
        for k in range(1, LONGEST + 1):
            for g in grams(w, k):
                out[lang, k, g] += n
    rows = list(out.items())
    for i in range(0, len(rows), 50_000):
        part = rows[i : i + 50_000]
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k, _ in part], "length": pa.array([k[1] for k, _ in part], pa.int32()), "token": [k[2] for k, _ in part], "n": pa.array([v for _, v in part], pa.int64())})


class Model:
    """languages; for words (0) and each length of n-grams a token's row in a table of log frequencies, a column a language."""

    def __init__(self, rows: list[tuple[str, int, str, int]]):
        self.languages = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.languages)}
        self.rows: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        for _, length, token, _ in rows:
            self.rows[length].setdefault(token, len(self.rows[length]))
        self.logs = [np.zeros((len(r), len(at))) for r in self.rows]
        for lang, length, token, n in rows:
            self.logs[length][self.rows[length][token], at[lang]] += n
        for i, counts in enumerate(self.logs):
            self.logs[i] = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * (len(counts) + 1)))

    def of_unknown(self, words: list[str]) -> np.ndarray:
        """What words outside the vocabulary add: a row each."""
        out = np.zeros((len(words), len(self.languages)))
        left = np.arange(len(words))
        for k in range(LONGEST, 0, -1):
            if not len(left):
                break
            get = self.rows[k].get
            marked = [words[i] if k == 1 else f"\x02{words[i]}\x03" for i in left]
            sizes = np.array([max(len(m) - k + 1, 0) for m in marked])
            at = np.fromiter([get(m[i : i + k], -1) for m in marked for i in range(len(m) - k + 1)], np.int64, sizes.sum())
            owner = np.repeat(np.arange(len(left)), sizes)[at >= 0]
            at = at[at >= 0]
            n = np.bincount(owner, minlength=len(left))
            for j in range(out.shape[1] if len(at) else 0):
                out[left[n > 0], j] = np.bincount(owner, self.logs[k][at, j], len(left))[n > 0] / n[n > 0]
            left = left[n == 0]
        return out


class Scorer:
    """The rows of words in a table that grows by the sums of unknown words."""

    def __init__(self, model: Model):
        self.model = model
        self.known = dict(model.rows[0])
        self.table = np.zeros((len(self.known) + REMEMBERED, max(len(model.languages), 1)))
        if model.languages:
            self.table[: len(self.known)] = model.logs[0]
        self.step = max(GATHERED // self.table.shape[1], 1)

    def _sum(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self.known})
        if len(self.known) + len(new) > len(self.table):
            self.known = dict(self.model.rows[0])
            new = list({w for w in words if w not in self.known})
        self.table[len(self.known) : len(self.known) + len(new)] = self.model.of_unknown(new)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Texts are taken together as far as their words go into the store."""
        out, step = [], min(self.step, REMEMBERED // 2)
        for text in texts:
            words = words_of(text)
            if not words or not self.model.languages:
                out.append(("und", 0.0))
                continue
            total = sum(self._sum(words[i : i + step]) for i in range(0, len(words), step))
            total = (total - total.max()) / math.sqrt(len(words))
            p = np.exp(total)
            best = int(np.argmax(total))
            out.append((self.model.languages[best], float(p[best] / p.sum())))
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, vocabulary: int = VOCABULARY, languages: int = LANGUAGES, cells: int = CELLS) -> Model:
    small_batches(docs.sparkSession)
    scope = Scope(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.withColumn("own", F.xxhash64("doc_id", "text", F.lit(SEED)))
    # the share of a language comes from its different rows, so neither null ids nor copies decide how much is learnt
    sizes = {r.lang: r.different for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("own").alias("different")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not sizes:
        return Model([])
    own = min(vocabulary, max(1, cells // (2 * len(sizes) ** 2)))
    rate = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, per_language / max(n, 1)))])
    chosen = rows.where(F.col("lang").isin(*sizes)).where(unit_hash(F.col("doc_id"), F.col("own"), seed=SEED) < F.element_at(rate, F.col("lang")))
    chosen = chosen.groupBy("lang", "own").agg(F.max("text").alias("text"))
    counted = scope.write(chosen.select("lang", "text").mapInArrow(_counts, "lang string, length int, token string, n long").groupBy("lang", "length", "token").agg(F.sum("n").alias("n")), "counts")
    # a language's tokens: those of a bounded sample
    of_language = Window.partitionBy("lang", F.col("length") == 0).orderBy(F.desc("n"), "length", "token")
    kept = counted.withColumn("place", F.row_number().over(of_language)).where(F.col("place") <= own).select("length", "token").distinct()
    found = counted.join(kept, ["length", "token"], "left_semi").collect()
    scope.release()
    return Model(sorted((r.lang, r.length, r.token, r.n) for r in found))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col))  # at most CELLS numbers and their tokens

    def run(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            found = scorer.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
