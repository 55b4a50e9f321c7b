"""Nearest neighbours through inverted lists with product-quantised residuals.

Fitting uses a bounded sample (`sample` rows, those with the smallest hashes of their ids): k-means gives the lists' centroids, and the residuals'
parts of PART dimensions get codebooks of at most 256 entries. Indexing covers every row: each goes to its nearest centroid's list and keeps
its code (a byte a part) beside its vector. Lists are folders, so a search reads the codes of the lists that it probes and nothing else; the
best by decoded distance are then compared exactly, for which only their own vectors are read.

How many lists to probe is measured, not set: for some indexed vectors as queries the true neighbours are found by one exact pass, and
the ranks of their lists tell how many must be probed for k neighbours at a wanted recall (`probes`). Under a filter that lets a share of the rows
through, the k nearest that pass lie as deep as the k / share nearest of all, so more lists are probed; where that is deeper than what was measured, all
are. `batches.nearest_many` stays the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators import batches
from holdfast.sources.scratch import scratch_path

#: Rows of the fitting sample, the most lists, sampled rows for each list at least, dimensions of a part, and rounds of k-means.
SAMPLE, MOST_LISTS, ROWS_OF_LIST, PART, ENTRIES, ROUNDS = 20_000, 4096, 4, 4, 256, 8
#: Queries and neighbours by which probes are measured; the recall that is wanted; candidates for each neighbour that are compared exactly.
MEASURED, DEEPEST, RECALL, REFINE = 48, 1000, 0.95, 8


def _nearest(x: np.ndarray, centres: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + step] @ centres.T - half, axis=1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """At most k centres. A centre without rows moves to a row that is far from its own."""
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
        if not filled.all():
            far = np.argsort(-((x - centres[own]) ** 2).sum(axis=1), kind="stable")[: (~filled).sum()]
            centres[~filled] = x[far]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """centroids of the lists, and of each part of the residuals the entries of its codebook."""

    centroids: np.ndarray
    books: list[np.ndarray]

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def encoded(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and its code."""
        own = _nearest(m, self.centroids)
        rest, at, codes = m - self.centroids[own], 0, []
        for book in self.books:
            codes.append(_nearest(rest[:, at : at + book.shape[1]], book))
            at += book.shape[1]
        return own, np.stack(codes, axis=1).astype(np.uint8)

    def decoded(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centroids[own] + np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)

    def order(self, q: np.ndarray) -> np.ndarray:
        """All lists of each query, nearest first."""
        return np.argsort(((self.centroids**2).sum(axis=1) / 2)[None] - q @ self.centroids.T, axis=1, kind="stable")


def fitted(vectors: DataFrame, dim: int, n: int, key: str = "vec_id", lists: int | None = None, sample: int = SAMPLE, seed: int = 5) -> Quantiser:
    """lists: about the root of the number of rows if not given."""
    rows = vectors.select(F.col(key).alias("id"), "embedding").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).collect()
    x, rng = np.array([r.embedding for r in rows], np.float64).reshape(-1, dim), np.random.default_rng(seed)
    lists = min(lists or max(int(n**0.5), 1), MOST_LISTS, max(len(x) // ROWS_OF_LIST, 1))
    centroids = k_means(x, lists, rng)
    rest = x - centroids[_nearest(x, centroids)]
    books = [k_means(rest[:, i : i + PART], ENTRIES, rng) for i in range(0, dim, PART)]
    return Quantiser(centroids, books)


@dataclass(frozen=True)
class VectorIndex:
    """path: the table of all rows in folders by list; sizes: rows of each list; ranks: by measured query and neighbour the rank of the neighbour's list."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    quantiser: Quantiser
    sizes: np.ndarray
    ranks: np.ndarray

    @property
    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def probes(self, k: int, share: float = 1.0, recall: float = RECALL) -> int:
        """How many lists a search for k rows reads if a filter lets this share of all rows through."""
        deep = int(np.ceil(k / max(share, 1e-12)))
        all_ = len(self.sizes)
        if not self.ranks.size or deep > self.ranks.shape[1]:
            return all_
        return min(all_, int(np.quantile(self.ranks[:, :deep], recall, method="higher")) + 1)


def _indexed(quantiser: Quantiser):
    def run(parts: Iterator[pa.RecordBatch]):
        for own, m in batches.matrices(parts, quantiser.dim):
            lists, codes = quantiser.encoded(m)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lists, pa.int32())], names=[*own.schema.names, "code", "list_id"])

    return run


def built(vectors: DataFrame, key: str = "vec_id", lists: int | None = None, sample: int = SAMPLE, measured: int = MEASURED) -> VectorIndex:
    """An index of one space. vectors: `key`, embedding and any other columns; rows without a key, or whose vector hasn't the most frequent size, are left out.

    Rows are written sorted by key inside ranges of (list, key), so one large list is many files.
    """
    spark = vectors.sparkSession
    dims = vectors.where(F.col(key).isNotNull() & (F.size("embedding") > 0)).groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        raise ValueError("there are no vectors to index")
    dim, n = dims[0].dim, dims[0].n
    rows = vectors.where(F.col(key).isNotNull() & (F.size("embedding") == dim)).withColumn(key, F.col(key).cast("long"))
    quantiser = fitted(rows, dim, n, key, lists, sample)
    whole = rows.mapInArrow(_indexed(quantiser), rows.select("*").schema.add("code", "binary").add("list_id", "integer"))
    path = scratch_path(spark, "vectors")
    whole.repartitionByRange("list_id", key).sortWithinPartitions("list_id", key).write.partitionBy("list_id").parquet(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema)
    index = VectorIndex(spark, path, schema, key, quantiser, np.zeros(len(quantiser.centroids), np.int64), np.zeros((0, 0), np.int64))
    sizes = index.sizes
    for r in index.table.groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each list
        sizes[r.list_id] = r.n
    return VectorIndex(spark, path, schema, key, quantiser, sizes, _ranks(index, min(DEEPEST, n), measured))


def _ranks(index: VectorIndex, k: int, measured: int) -> np.ndarray:
    """By some indexed vectors as queries: the ranks of the lists of their k nearest others."""
    queries = index.table.orderBy(F.xxhash64(index.key, F.lit(7)), index.key).limit(measured).select(F.col(index.key).alias("query_id"), F.col("embedding").alias("q"))
    blocks = list(batches.blocks(queries))
    if k < 2 or not blocks:
        return np.zeros((0, 0), np.int64)
    (block,) = blocks
    found = batches.nearest_many(index.table, queries, k - 1, index.key, others=True)
    # measured * DEEPEST rows at most
    rows = found.join(index.table.select(index.key, "list_id"), index.key).select("query_id", "place", "list_id").collect()
    place_of = np.argsort(index.quantiser.order(block.q), axis=1)
    at, out = {q: i for i, q in enumerate(block.ids.tolist())}, np.zeros((len(block), k - 1), np.int64)
    for r in rows:
        out[at[r.query_id], r.place - 1] = place_of[at[r.query_id], r.list_id]
    return out


def _candidates(b: batches.Block, quantiser: Quantiser, probed: np.ndarray, k: int, key: str):
    """Of each query the k rows of a task's probed lists whose decoded vectors are nearest."""

    def run(parts: Iterator[pa.RecordBatch]):
        best = batches.Best(b.q, k)
        for part in parts:
            for start in range(0, part.num_rows, batches.VECTOR_BLOCK):
                own = part.slice(start, batches.VECTOR_BLOCK)
                lists = own.column("list_id").to_numpy()
                codes = np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint8).reshape(len(lists), -1)
                best.add(own.column(key).to_numpy(), quantiser.decoded(lists, codes), probed[:, lists])
        yield best.batch(b.ids)

    return run


def _distances(b: batches.Block):
    """The rows' own columns but the vectors, and the exact distance to their query."""
    at = {q: i for i, q in enumerate(b.ids.tolist())}

    def run(parts: Iterator[pa.RecordBatch]):
        for own, m in batches.matrices(parts, b.q.shape[1]):
            of = np.array([at[q] for q in own.column("query_id").to_pylist()], np.int64)
            kept = [n for n in own.schema.names if n != "embedding"]
            yield pa.RecordBatch.from_arrays([*[own.column(n) for n in kept], pa.array(np.sqrt(((m - b.q[of]) ** 2).sum(axis=1)), pa.float64())], names=[*kept, "distance"])

    return run


def search(index: VectorIndex, queries: DataFrame, k: int, ids: DataFrame | None = None, item: str = "item_id", probes: int | None = None, recall: float = RECALL, keep: tuple[str, ...] = (), block: int = batches.QUERY_BLOCK) -> DataFrame:
    """query_id, `key`, the kept columns, distance (exact), place of about the k nearest rows of every query (query_id, q).

    ids: a column `id` of items; only rows of these are searched, and as many lists as hold enough of them. A block of queries is
    two passes: codes of the lists that any of its queries probes, then the vectors of the candidates.
    """
    table, share = index.table, 1.0
    if ids is not None:
        table = table.join(ids.select(F.col("id").alias("__allowed")).distinct(), F.col(item) == F.col("__allowed"), "left_semi")
        share = table.count() / max(int(index.sizes.sum()), 1)  # reads the items' ids only
    n = min(len(index.sizes), probes or index.probes(k, share, recall))
    names, out = [c for c in keep if c != index.key], None
    for b in batches.blocks(queries, block):
        if b.q.shape[1] != index.quantiser.dim:
            continue
        order = index.quantiser.order(b.q)
        probed = np.zeros((len(b), len(index.sizes)), bool)
        np.put_along_axis(probed, order[:, :n], True, axis=1)
        lists = [int(i) for i in np.flatnonzero(probed.any(axis=0)) if index.sizes[i]]
        own = table.where(F.col("list_id").isin(lists))
        found = own.select(index.key, "code", "list_id").mapInArrow(_candidates(b, index.quantiser, probed, k * REFINE, index.key), "query_id long, id long, distance double")
        # block * k * REFINE rows at most, so they may be broadcast
        found = batches.merged(found, k * REFINE).select("query_id", "id")
        if len(b) * k * REFINE <= 1_000_000:
            found = F.broadcast(found)
        vectors = own.select(F.col(index.key).alias("id"), "embedding", *names).join(found, "id").select("query_id", "id", *names, "embedding")
        exact = vectors.mapInArrow(_distances(b), vectors.drop("embedding").schema.add("distance", "double"))
        out = batches.merged(exact, k) if out is None else out.unionByName(batches.merged(exact, k))
    if out is None:
        out = index.table.select(F.col(index.key).alias("query_id"), F.col(index.key).alias("id"), *names, F.lit(0.0).alias("distance"), F.lit(0).alias("place")).limit(0)
    return out.withColumnRenamed("id", index.key)


def nearest_rows(indexes: dict[str, VectorIndex], queries: dict[str, list[float]], k: int, ids: DataFrame | None = None, keep: tuple[str, ...] = ()) -> list[dict]:
    """Of each space about the k rows nearest to its query, as rows: space, key, the kept columns, distance, cosine. Spaces are searched side by side."""

    def one(space: str) -> list[dict]:
        index = indexes[space]
        query = index.spark.createDataFrame([(0, queries[space])], "query_id long, q array<double>")
        rows = search(index, query, k, ids, keep=tuple(c for c in keep if c in index.table.columns)).drop("query_id", "place").collect()  # k rows
        return [r.asDict() | {"space": space, "cosine": 1 - r.distance**2 / 2} for r in rows]

    with ThreadPoolExecutor(max(len(queries), 1)) as pool:
        return [r for rows in pool.map(one, [s for s in queries if s in indexes]) for r in rows]


def recall_of(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """query_id, n (exact neighbours), hits, recall."""
    hit = F.col("distance").isNotNull()
    rows = exact.select("query_id", key).join(found.select("query_id", key, "distance"), ["query_id", key], "left")
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits")).withColumn("recall", F.col("hits") / F.col("n"))
