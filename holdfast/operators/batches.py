"""Many queries at once: blocks of queries times blocks of vectors, as matrix products in Arrow tasks.

A block of queries (a stated set, at most QUERY_BLOCK of them on the driver at a time) goes to the tasks that read the vectors; no pair leaves a
task but the k best of each query, or sums and counts over the task's vectors. Products use BLAS; what is within SLACK of a decision is
worked out again pair by pair, so results don't depend on how the vectors fall into batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, VECTOR_BLOCK, SLACK = 1024, 2048, 1e-9
#: Results of tasks are merged in so many lanes first, then together.
LANES = 16


@dataclass
class Block:
    """ids and vectors of some queries; own: another column of theirs, or nothing."""

    ids: np.ndarray
    q: np.ndarray
    own: list

    def __len__(self) -> int:
        return len(self.ids)


def blocks(queries: DataFrame, size: int = QUERY_BLOCK, own: str | None = None) -> Iterator[Block]:
    """queries (query_id, q) in blocks of about `size`; null or empty vectors are left out. One block at a time is on the driver."""
    rows = queries.where("query_id is not null and size(q) > 0").select(F.col("query_id").cast("long"), "q", *([F.col(own).alias("own")] if own else []))
    n = max(1, -(-rows.count() // size))
    for i in range(n):
        found = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).orderBy("query_id").collect()
        for dim in sorted({len(r.q) for r in found}):
            same = [r for r in found if len(r.q) == dim]
            yield Block(np.array([r.query_id for r in same], np.int64), np.array([r.q for r in same], np.float64), [r.own if own else None for r in same])


def matrices(batches: Iterator[pa.RecordBatch], dim: int, vector: str = "embedding") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Of Arrow batches the rows with vectors of this size, VECTOR_BLOCK at most, and their vectors in double precision."""
    for b in batches:
        for start in range(0, b.num_rows, VECTOR_BLOCK):
            part = b.slice(start, VECTOR_BLOCK)
            column = part.column(vector)
            at = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
            if len(at):
                own = part.take(pa.array(at))
                yield own, own.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def pairwise(f: Callable, a: np.ndarray, b: np.ndarray, step: int = 4096) -> np.ndarray:
    """f of rows of a and b, some at a time."""
    return np.concatenate([f(a[i : i + step], b[i : i + step]) for i in range(0, len(a), step)] or [np.zeros(0)])


class Best:
    """The k nearest rows of each query so far; ties go to the smaller id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.norms = (queries**2).sum(axis=1)
        self.kth = np.full(len(queries), np.inf)
        self.owner, self.id, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, m: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """ids and vectors of rows. allowed: by query and row whether the row is in question."""
        squared = np.maximum(self.norms[:, None] + (m**2).sum(axis=1)[None] - 2 * self.q @ m.T, 0)
        if allowed is not None:
            squared[~allowed] = np.inf
        if len(ids) >= self.k:
            self.kth = np.minimum(self.kth, np.sqrt(np.partition(squared, self.k - 1, axis=1)[:, self.k - 1]))
        owner, at = np.nonzero((squared <= (self.kth[:, None] + 1e-6) ** 2) & np.isfinite(squared))
        exact = pairwise(lambda o, a: np.sqrt(((m[a] - self.q[o]) ** 2).sum(axis=1)), owner, at)
        owner, ids, d = np.concatenate((self.owner, owner)), np.concatenate((self.id, ids[at])), np.concatenate((self.d, exact))
        order = np.lexsort((ids, d, owner))
        owner, ids, d = owner[order], ids[order], d[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = place < self.k
        self.owner, self.id, self.d = owner[kept], ids[kept], d[kept]
        last = place == self.k - 1
        self.kth[owner[last]] = np.minimum(self.kth[owner[last]], d[last])

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"query_id": pa.array(query_ids[self.owner], pa.int64()), "id": pa.array(self.id, pa.int64()), "distance": pa.array(self.d, pa.float64())})


def merged(rows: DataFrame, k: int) -> DataFrame:
    """rows (query_id, id, distance and more) with place: each query's k best. Lanes of tasks are merged first, so a query's rows of all tasks never meet at once."""
    order = [F.col("distance"), F.col("id")]
    rows = rows.withColumn("lane", F.spark_partition_id() % LANES)
    for by in (["query_id", "lane"], ["query_id"]):
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)
    return rows.drop("lane")


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", others: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, `key`, distance, place: the exact k nearest vectors of every query (query_id, q). others: without the row of the query's own id.

    Each block of queries is one pass over the vectors; vectors of another size than a query's aren't compared with it.
    """
    rows, out = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), "embedding"), None
    for b in blocks(queries, block):

        def run(batches, b=b):
            best = Best(b.q, k)
            for own, m in matrices(batches, b.q.shape[1]):
                ids = own.column("id").to_numpy()
                best.add(ids, m, b.ids[:, None] != ids[None] if others else None)
            yield best.batch(b.ids)

        found = merged(rows.mapInArrow(run, "query_id long, id long, distance double"), k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = queries.sparkSession.createDataFrame([], "query_id long, id long, distance double, place int")
    return out.withColumnRenamed("id", key)


def moments(vectors: DataFrame, b: Block, key: str = "vec_id") -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation (of the population) of each query's similarities to all vectors but its own."""

    def run(batches):
        sums = np.zeros((3, len(b)))
        for own, m in matrices(batches, b.q.shape[1]):
            s = b.q @ m.T
            other = b.ids[:, None] != own.column(key).to_numpy()[None]
            sums += [other.sum(axis=1), (s * other).sum(axis=1), (s**2 * other).sum(axis=1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(b)), pa.int64()), *map(pa.array, sums)], names=["i", "n", "s", "ss"])

    rows = vectors.select(key, "embedding").mapInArrow(run, "i long, n double, s double, ss double")
    found = rows.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect()  # a row for each query of the block
    n, s, ss = (np.zeros(len(b)) for _ in range(3))
    for r in found:
        n[r.i], s[r.i], ss[r.i] = max(r.n, 1), r.s, r.ss
    mean = s / np.maximum(n, 1)
    return mean, np.sqrt(np.maximum(ss / np.maximum(n, 1) - mean**2, 0))


def _dots(m: np.ndarray, q: np.ndarray):
    return lambda o, a: (m[a] * q[o]).sum(axis=1)


def first_ranks(vectors: DataFrame, b: Block, group: str, key: str = "vec_id", half: bool = False) -> DataFrame:
    """query_id, rank: the place of the first row of the query's group (b.own) among all rows but its own, by similarity, ties by id; null
    if there is none. half: the vectors and queries in half precision.

    Two passes, in which nothing but numbers of the queries leaves a task: the best row of the group, then how many rows are before it.
    """
    q = b.q.astype(np.float16).astype(np.float64) if half else b.q
    cast = (lambda m: m.astype(np.float16).astype(np.float64)) if half else (lambda m: m)
    groups = {g: [i for i, x in enumerate(b.own) if x == g] for g in dict.fromkeys(b.own) if g is not None}

    def best(batches):
        top, first = np.full(len(b), -np.inf), np.zeros(len(b), np.int64)
        for own, m in matrices(batches, q.shape[1]):
            m, ids, labels = cast(m), own.column(key).to_numpy(), np.array(own.column(group).to_pylist(), object)
            for g, of_group in groups.items():
                rows = np.flatnonzero(labels == g)
                if not len(rows):
                    continue
                s = np.where(b.ids[of_group][:, None] == ids[rows][None], -np.inf, q[of_group] @ m[rows].T)
                i, j = np.nonzero((s >= np.maximum(s.max(axis=1), top[of_group])[:, None] - SLACK) & np.isfinite(s))
                o, a = np.array(of_group)[i], rows[j]
                for x, y, id_ in zip(o, pairwise(_dots(m, q), o, a), ids[a], strict=True):
                    if (y, -id_) > (top[x], -first[x]):
                        top[x], first[x] = y, id_
        at = np.flatnonzero(np.isfinite(top))
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int64()), "s": pa.array(top[at], pa.float64()), "id": pa.array(first[at], pa.int64())})

    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), group, "embedding")
    found = rows.mapInArrow(best, "i long, s double, id long").groupBy("i").agg(F.max(F.struct("s", (-F.col("id")).alias("id"))).alias("m")).collect()  # a row for each query of the block
    limit, first = np.full(len(b), np.inf), np.zeros(len(b), np.int64)
    for r in found:
        limit[r.i], first[r.i] = r.m.s, -r.m.id

    def before(batches):
        count = np.zeros(len(b), np.int64)
        for own, m in matrices(batches, q.shape[1]):
            m, ids = cast(m), own.column(key).to_numpy()
            other = (b.ids[:, None] != ids[None]) & (first[:, None] != ids[None])
            s = q @ m.T
            count += ((s > limit[:, None] + SLACK) & other).sum(axis=1)
            o, a = np.nonzero((np.abs(s - limit[:, None]) <= SLACK) & other)
            y = pairwise(_dots(m, q), o, a)
            np.add.at(count, o, (y > limit[o]) | ((y == limit[o]) & (ids[a] < first[o])))
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(b)), pa.int64()), "n": pa.array(count, pa.int64())})

    counts = {r.i: r.n for r in rows.select(key, "embedding").mapInArrow(before, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    ranked = [(int(b.ids[i]), int(counts[i]) + 1 if np.isfinite(limit[i]) else None) for i in range(len(b))]
    return vectors.sparkSession.createDataFrame(ranked, "query_id long, rank long")
