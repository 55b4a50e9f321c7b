"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a row of numbers, each number a bin. Boosting goes round the features again and again; each step fits a
tree of two splits to the gradient histogram of one feature and adds it to that feature's lookup table. The pairs whose
residuals gain most from a four-leaf tree get tables over two coarse features, boosted in turn. A score is the logistic of a sum of
table entries.

Training takes at most `train_rows` labels, those with the smallest hashes of their ids, and one row for each; all else covers all rows.
Defined results: a null or empty text is scored like any other by its features; without usable labels every score is the
prior (0.5); labels that are null are left out, and of several labels of one id the largest counts; null ids are never
held out and never learnt from; of several rows of one id the one with the smallest features is learnt from; an empty table
gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import fresh, held_out, small_batches

FEATURES = ("bytes", "words", "word_length", "distinct", "repeats", "upper", "stops", "bangs", "bars", "symbols", "digits", "other_bytes", "lines", "marked_words", "brackets")
TRAIN_ROWS, KEEP_AT, SEED = 20_000, 0.3, 2
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAST, RIDGE = 64, 12, 150, 60, 8, 0.1, 4, 0.5


def _classes() -> np.ndarray:
    """For each byte the column of the counts that it falls into."""
    where = np.zeros(256, np.int64)
    for i, chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:?", b"!", b"|", b"#$%&*@^~+=\\/_", b"0123456789", bytes(range(128, 256)), b"\n", b"()[]{}<>\"'"], 1):
        where[list(chars)] = i
    where[list(b"abcdefghijklmnopqrstuvwxyz")] = 10
    return where


CLASSES = _classes()


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, w = max(len(raw), 1), max(len(words), 1)
    c = np.bincount(CLASSES, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 11)
    letters = max(c[1] + c[10], 1.0)
    marked = sum(x[-1] in b"#$%&*@^~+=!|" for x in words)
    return [np.log1p(len(raw)), np.log1p(len(words)), len(raw) / w, len(set(words)) / w, sum(map(eq, words, words[1:])) / w, c[1] / letters, c[2] / n, c[3] / n, c[4] / n, c[5] / n, c[6] / n, c[7] / n, c[8] / n, marked / w, c[9] / n]


def matrix(texts: list) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram; place 0: none."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = np.where((nl >= LEAST) & (nr >= LEAST), gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE), -np.inf) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) and gain[at] > 1e-9 else (0.0, 0)


def _tree(g, h, n) -> np.ndarray:
    """A tree of at most two splits on one feature, as a table."""
    cuts = [0, len(g)]
    for _ in range(2):
        best = max(((*_split(g[a:b], h[a:b], n[a:b]), a) for a, b in zip(cuts, cuts[1:], strict=False)), default=(0.0, 0, 0))
        if not best[1]:
            break
        cuts = sorted({*cuts, best[2] + best[1]})
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _pair_tree(g, h, n) -> tuple[float, np.ndarray]:
    """One cut of the rows, then a cut of the columns on each side: four leaves."""
    best, out = 0.0, np.zeros_like(g)
    for r in range(1, len(g)):
        gain, table = 0.0, np.zeros_like(g)
        for part in (slice(0, r), slice(r, None)):
            a, b, m = g[part].sum(0), h[part].sum(0), n[part].sum(0)
            got, at = _split(a, b, m)
            gain += got
            for cols in (slice(0, at), slice(at, None)):
                if b[cols].size:
                    table[part, cols] = -a[cols].sum() / (b[cols].sum() + RIDGE)
        if gain > best:
            best, out = gain, table
    return best, out


class Gam:
    """edges and tables of each feature, coarse edges, and (i, j, table) of each pair."""

    def __init__(self, prior: float = 0.0):
        self.prior, self.edges, self.tables, self.coarse, self.pairs = prior, [], [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        if not len(y):
            return self
        share = (y.sum() + 1) / (len(y) + 2)
        self.prior = float(np.log(share / (1 - share)))
        cut = lambda column, n: np.unique(np.quantile(column, np.linspace(0, 1, n + 1)[1:-1]))
        self.edges, self.coarse = [cut(c, BINS) for c in x.T], [cut(c, PAIR_BINS) for c in x.T]
        bins = [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)]
        wide = [np.searchsorted(e, c, side="right") for e, c in zip(self.coarse, x.T, strict=True)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        total = np.full(len(y), self.prior)

        def gradient():
            p = 1 / (1 + np.exp(-total))
            return p - y, p * (1 - p)

        for _ in range(ROUNDS):
            for b, t in zip(bins, self.tables, strict=True):
                g, h = gradient()
                step = RATE * _tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), np.bincount(b, minlength=len(t)))
                t += step
                total += step[b]

        def histogram(i, j, g, h):
            shape = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
            at = wide[i] * shape[1] + wide[j]
            return at, [np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h, np.ones(len(y)))]

        g, h = gradient()
        ranked = sorted(((_pair_tree(*histogram(i, j, g, h)[1])[0], i, j) for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])), reverse=True)
        self.pairs = [(i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))) for gain, i, j in ranked[:PAIRS] if gain > 0]
        for _ in range(PAIR_ROUNDS):
            for i, j, t in self.pairs:
                at, sums = histogram(i, j, *gradient())
                step = RATE * _pair_tree(*sums)[1]
                t += step
                total += step.reshape(-1)[at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        for e, t, c in zip(self.edges, self.tables, x.T, strict=False):
            total += t[np.searchsorted(e, c, side="right")]
        for i, j, t in self.pairs:
            total += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-total))


def _features(batches):
    for b in batches:
        x = matrix(b.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Gam:
    """Fits on labelled rows that aren't held out; at most train_rows labels reach the driver, as numbers."""
    small_batches(docs.sparkSession)
    usable = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__id is not null and __label in (0, 1)")
    usable = usable.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("__label").alias("__label"))
    chosen = usable.orderBy(F.xxhash64("__id", F.lit(SEED)), "__id").limit(train_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    found = rows.select("doc_id", "__label", "text").mapInArrow(_features, "doc_id long, label int, x array<double>")
    found = found.groupBy("doc_id", "label").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id")
    x = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES))
    return Gam().fit(x, found["label"].to_numpy(float))


def scored(docs: DataFrame, model: Gam, columns: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The given columns of docs and the score. Batches pass through with their other columns as they are."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # some tables of a few KB

    def run(batches):
        for b in batches:
            scores = sent.value.score(matrix(b.column(b.num_columns - 1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], score_col])

    (text,) = fresh(columns, "text")
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).cast("string").alias(text))
    schema = rows.drop(text).schema.add(score_col, "double")
    return rows.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(docs, labels, id_col, text_col)
    rows = scored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model, ["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    model = train(docs, labels, id_col, text_col)
    (score,) = fresh(docs.columns, "score")
    return scored(docs, model, docs.columns, text_col, score).where(F.col(score) >= KEEP_AT).drop(score)
