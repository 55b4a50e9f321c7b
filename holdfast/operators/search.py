"""The parts of a search: filters, nearest neighbours, calibration, ensembles, BM25, phrases, evidence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.functions import scoring, vector
from holdfast.functions.fuzzy import similarities
from holdfast.functions.text import let, mentions, plain, query_tokens
from holdfast.sources.library import KINDS
from holdfast.sources.scratch import materialise

K, CONTENDERS, PHRASE_CHUNKS, BM25_ROWS = 200, 150, 60, 200
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SAMPLE, LEAST_ITEMS = 400, 1
IMAGE_SPACES = ("image_a", "image_b")
#: On equal scores the earlier source wins.
PRIORITY = {"image": 0, "text": 1, "phrase": 2}


@dataclass
class Filters:
    """Groups are joined by AND, values of a group by OR; an empty group restricts nothing."""

    query: str = ""
    kinds: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    date_from: datetime | date | None = None
    date_to: datetime | date | None = None

    def __post_init__(self):
        if unknown := set(self.kinds) - set(KINDS):
            raise ValueError(f"no such kinds: {sorted(unknown)}")

    @property
    def restricts(self) -> bool:
        return bool(self.kinds or self.tags or self.date_from or self.date_to)


def date_predicates(created: Column, date_from, date_to) -> list[Column]:
    """Both ends included; a plain date stands for its whole day."""
    whole = lambda d: isinstance(d, date) and not isinstance(d, datetime)
    out = []
    if date_from is not None:
        out.append(created >= F.lit(str(date_from)).cast("timestamp_ntz"))
    if date_to is not None:
        out.append(created < F.lit(str(date_to + timedelta(days=1))).cast("timestamp_ntz") if whole(date_to) else created <= F.lit(str(date_to)).cast("timestamp_ntz"))
    return out


def allowed(items: DataFrame, tags: DataFrame, item_tags: DataFrame, f: Filters) -> DataFrame | None:
    """Ids of the items that pass, or None if nothing is restricted. The state of an item doesn't matter."""
    if not f.restricts:
        return None
    rows = items
    if f.kinds:
        rows = rows.where(F.col("kind").isin(f.kinds))
    for p in date_predicates(F.col("created_at"), f.date_from, f.date_to):
        rows = rows.where(p)
    if f.tags:
        tagged = item_tags.join(tags.where(F.col("name").isin(f.tags)), "tag_id").select(F.col("item_id").alias("id"))
        rows = rows.join(tagged, "id", "left_semi")
    return rows.select("id")


def restricted(embeddings: DataFrame, ids: DataFrame | None) -> DataFrame:
    return embeddings if ids is None else embeddings.join(ids.withColumnRenamed("id", "item_id"), "item_id", "left_semi")


def among(column: str, numbers: list[int]) -> Column:
    """Whether a column is one of some hundred whole numbers, as one expression."""
    return F.expr(f"{column} in ({', '.join(str(int(n)) for n in numbers)})") if numbers else F.lit(False)


def places(pairs: list[tuple]) -> Column:
    """Whether (item_id, chunk_ix) is one of some hundred pairs of whole numbers; the items alone narrow the scan."""
    known = [(int(i), int(c)) for i, c in pairs if c is not None]
    keys = ", ".join(f"'{i}:{c}'" for i, c in known)
    return among("item_id", sorted({i for i, _ in known})) & F.expr(f"concat_ws(':', item_id, chunk_ix) in ({keys})") if known else F.lit(False)


def local(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Bounded results that were put together on the driver, as one partition."""
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema).coalesce(1)


def _vectors(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of this size, and the vectors in double precision."""
    at = np.nonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)[0]
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    return at, flat.astype(np.float64).reshape(-1, dim)


def _closest(queries: dict[str, list[float]], k: int, key: str, keep: list[str]):
    """Of each space the k rows of a partition that are nearest to its query, with their distance."""
    sought = {s: np.array(q, np.float64) for s, q in queries.items()}

    def run(batches: Iterator[pa.RecordBatch]):
        best: dict[str, pa.Table] = {}
        for b in batches:
            for space, q in sought.items():
                own = b.filter(pc.equal(b.column("space"), space))
                at, m = _vectors(own.column("embedding"), len(q))
                if not len(at):
                    continue
                found = pa.Table.from_batches([own.take(pa.array(at))]).select(keep).append_column("distance", pa.array(np.sqrt(((m - q) ** 2).sum(axis=1))))
                found = pa.concat_tables([best[space], found]) if space in best else found
                best[space] = found.take(pc.sort_indices(found, [("distance", "ascending"), (key, "ascending")])[:k])
        for t in best.values():
            yield from t.to_batches()

    return run


def nearest_by_space(embeddings: DataFrame, queries: dict[str, list[float]], k: int = K, ids: DataFrame | None = None, key: str = "vec_id", keep: list[str] | None = None) -> DataFrame:
    """Of each space the k vectors nearest to its query: the given columns (all), distance, cosine.

    One pass over the vectors for all spaces: products are worked out on Arrow batches, each partition keeps its k best, and only those are
    shuffled. The filter comes before the limit.
    """
    rows = restricted(embeddings.where(F.col("space").isin(*queries)), ids)
    keep = list(dict.fromkeys(["space", key, *(keep or rows.columns)]))
    read = rows.select(*dict.fromkeys([*keep, "embedding"]))
    schema = read.select(*keep).schema.add("distance", "double")
    place = F.row_number().over(Window.partitionBy("space").orderBy("distance", key))
    found = read.mapInArrow(_closest(queries, k, key, keep), schema).withColumn("__n", place).where(F.col("__n") <= k).drop("__n")
    return found.withColumn("cosine", vector.cosine_of_distance(F.col("distance")))


def nearest(embeddings: DataFrame, space: str, query: list[float], k: int = K, ids: DataFrame | None = None, key: str = "vec_id") -> DataFrame:
    """The k nearest vectors of a space: all columns, distance, cosine."""
    return nearest_by_space(embeddings, {space: query}, k, ids, key).orderBy("distance", key)


EVIDENCE = ["item_id", "frame_id", "chunk_ix", "ts_s"]


def nearest_rows(embeddings: DataFrame, queries: dict[str, list[float]], k: int = K, ids: DataFrame | None = None, key: str = "vec_id") -> list[dict]:
    """The same as rows: at most k for each space."""
    return [r.asDict() for r in nearest_by_space(embeddings, queries, k, ids, key, [c for c in EVIDENCE if c in embeddings.columns]).collect()]


def calibration(embeddings: DataFrame, decoys: dict[str, list[list[float]]], sample: int = SAMPLE, least: int = LEAST_ITEMS, key: str = "vec_id") -> DataFrame:
    """A row for each space: space, mean, stddev (of the population), sample_n, population: similarities of decoy queries, which have nothing to
    do with each other or the library, to the first `sample` vectors. Spaces with fewer than `least` vectors, or without spread, have none.
    """
    own = embeddings.where(F.col("space").isin(*decoys))
    place = F.row_number().over(Window.partitionBy("space").orderBy(key))
    # `sample` vectors a space
    rows = own.select("space", key, "embedding").withColumn("__n", place).where(F.col("__n") <= sample).select("space", "embedding").collect()
    population = {r.space: r.n for r in own.groupBy("space").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for space, queries in decoys.items():
        dim = len(queries[0]) if queries else 0
        vectors = [r.embedding for r in rows if r.space == space and len(r.embedding) == dim]
        if not dim or len(vectors) < least:
            continue
        found = np.array(queries, np.float64) @ np.array(vectors, np.float64).T
        if found.std() >= scoring.LEAST_SPREAD:
            out.append({"space": space, "mean": float(found.mean()), "stddev": float(found.std()), "sample_n": found.size, "population": population[space]})
    return local(embeddings.sparkSession, out, "space string, mean double, stddev double, sample_n long, population long")


def stale(found: dict | None, population: int, growth: float = 1.5) -> bool:
    """Whether a stored calibration has to be made anew: none, or the space has grown by half since."""
    return found is None or population > growth * max(found["population"], 1)


Calibrations = dict[str, tuple[float, float]]


def by_space(calibrations: DataFrame | Calibrations) -> Calibrations:
    """mean and stddev by space: a row for each."""
    return calibrations if isinstance(calibrations, dict) else {r.space: (r.mean, r.stddev) for r in calibrations.collect()}


def _missing(queries: dict[str, list[float]], wanted: set[tuple]):
    """item_id, frame_id, space, cosine, ts_s of the vectors that are wanted by (item, frame, space)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = b.select(["item_id", "frame_id", "space", "ts_s"]).to_pylist()
            at = [i for i, r in enumerate(rows) if (r["item_id"], r["frame_id"], r["space"]) in wanted]
            found = [(rows[i], v) for i, v in zip(at, b.column("embedding").take(pa.array(at, pa.int64())).to_pylist(), strict=True) if v is not None and len(v) == len(queries[rows[i]["space"]])]
            cosines = [float(np.dot(np.array(v, np.float64), queries[r["space"]])) for r, v in found]
            types = {"item_id": pa.int64(), "frame_id": pa.int64(), "space": pa.string(), "ts_s": pa.float64()}
            columns = [pa.array([r[c] for r, _ in found], t) for c, t in types.items()]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cosines, pa.float64())], names=[*types, "cosine"])

    return run


def image_rows(embeddings: DataFrame, queries: dict[str, list[float]], found: list[dict], calibrations: Calibrations) -> list[dict]:
    """item_id, score, frame_id, ts_s, n_spaces from the nearest rows of the image spaces.

    They are pooled by (item, frame); the contenders with the highest cosine get their exact cosine in the spaces
    that didn't find them; calibrated scores are averaged over the spaces a key has. A null frame is a key like any other.
    """
    most = lambda a, b: b if a is None else a if b is None else max(a, b)
    keys: dict[tuple, dict[str, float]] = {}
    times: dict[tuple, float | None] = {}

    def add(r: dict) -> None:
        key = (r["item_id"], r.get("frame_id"))
        own = keys.setdefault(key, {})
        own[r["space"]] = most(own.get(r["space"]), r["cosine"])
        times[key] = most(times.get(key), r.get("ts_s"))

    for r in found:
        if r["space"] in queries:
            add(r)
    order = lambda key: (key[0], key[1] is not None, key[1] or 0)
    contenders = sorted(keys, key=lambda key: (-max(keys[key].values()), *order(key)))[:CONTENDERS]
    wanted = {(*key, s) for key in contenders for s in queries if s not in keys[key]}
    if wanted:
        rows = embeddings.where(F.col("space").isin(*queries) & among("item_id", sorted({w[0] for w in wanted})))
        filled = rows.select("item_id", "frame_id", "space", "ts_s", "embedding").mapInArrow(_missing(queries, wanted), "item_id long, frame_id long, space string, ts_s double, cosine double")
        for r in filled.groupBy("item_id", "frame_id", "space").agg(F.max("cosine").alias("cosine"), F.max("ts_s").alias("ts_s")).collect():
            add(r.asDict())
    best: dict[int, dict] = {}
    for key in sorted(keys, key=order):
        scores = [scoring.calibrated_value(c, *calibrations.get(s, (None, None))) for s, c in keys[key].items()]
        score = sum(scores) / len(scores)
        if key[0] not in best or score > best[key[0]]["score"]:
            best[key[0]] = {"item_id": key[0], "score": score, "frame_id": key[1], "ts_s": times[key], "n_spaces": len(scores)}
    return list(best.values())


IMAGE = "item_id long, score double, frame_id long, ts_s double, n_spaces long"


def image_evidence(embeddings: DataFrame, queries: dict[str, list[float]], calibrations: DataFrame | Calibrations, k: int = K, ids: DataFrame | None = None) -> DataFrame:
    """item_id, score, frame_id, ts_s, n_spaces: the best picture or frame of every item over two models."""
    return local(embeddings.sparkSession, image_rows(embeddings, queries, nearest_rows(embeddings, queries, k, ids), by_space(calibrations)), IMAGE)


def best_per(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def text_rows(found: list[dict], calibrations: Calibrations, space: str = "text") -> tuple[list[dict], list[tuple]]:
    """Each item's best chunk from the nearest rows of the space, and (item_id, chunk_ix) of the nearest chunks for the phrase pass."""
    own = sorted((r for r in found if r["space"] == space), key=lambda r: (r["distance"], r["vec_id"]))
    best: dict[int, dict] = {}
    for r in sorted(own, key=lambda r: (r["chunk_ix"] is not None, r["chunk_ix"] or 0)):
        score = scoring.calibrated_value(r["cosine"], *calibrations.get(space, (None, None)))
        if r["item_id"] not in best or score > best[r["item_id"]]["score"]:
            best[r["item_id"]] = {"item_id": r["item_id"], "score": score, "chunk_ix": r["chunk_ix"], "ts_s": r["ts_s"]}
    return list(best.values()), [(r["item_id"], r["chunk_ix"]) for r in own[:PHRASE_CHUNKS]]


def text_evidence(embeddings: DataFrame, query: list[float], calibrations: DataFrame | Calibrations, k: int = K, ids: DataFrame | None = None, space: str = "text") -> tuple[DataFrame, list[tuple]]:
    """item_id, score, chunk_ix, ts_s of each item's best chunk, and the nearest chunks."""
    best, near = text_rows(nearest_rows(embeddings, {space: query}, k, ids), by_space(calibrations), space)
    return local(embeddings.sparkSession, best, "item_id long, score double, chunk_ix int, ts_s double"), near


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(chunks: DataFrame) -> DataFrame:
    """token, chunk_id, tf, length: made once and stored, it serves every query.

    A chunk is one row, so its tokens are counted inside the row and nothing is shuffled; a chunk id that comes twice is two chunks.
    """
    own = chunks.select("chunk_id", tokens(F.col("chunk_text")).alias("t")).select("chunk_id", F.explode_outer(counted(F.col("t"))).alias("c"))
    return own.where("c is not null").select("c.token", "chunk_id", F.col("c.length").alias("length"), F.col("c.tf").alias("tf"))


def counted(found: Column) -> Column:
    """Array of (token, length, tf) of an array of tokens: runs in the sorted array. length: how many tokens there are in all."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        stop = lambda b, j: F.coalesce(F.get(b, j + 1), F.size(s))
        return let(begins, lambda b: F.transform(b, lambda p, j: F.struct(F.get(s, p).alias("token"), F.size(s).alias("length"), (stop(b, j) - p).cast("long").alias("tf"))))

    return let(F.sort_array(found), runs)


def _frequency(found: str, token: str) -> Column:
    """How often a token of the query stands among those of a chunk; parts joined by an underscore have to follow each other."""
    parts = [p for p in token.split("_") if p]
    if len(parts) == 1:
        return F.size(F.filter(found, lambda x: x == parts[0])).cast("double")
    here = lambda x, i: reduce(lambda a, b: a & b, [F.get(F.col(found), i + j) == p for j, p in enumerate(parts)], F.lit(True))
    return F.size(F.filter(found, here)).cast("double")


def bm25(chunks: DataFrame, query: str, limit: int = BM25_ROWS) -> DataFrame:
    """chunk_id, score of the best chunks that have any token of the query.

    One pass over the texts: only the query's tokens are counted, so nothing but hits is shuffled.
    """
    sought = sorted({t for t in query_tokens(query) if t.strip("_")})
    if not sought:
        return chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    own = chunks.select("chunk_id", tokens(F.col("chunk_text")).alias("t"))
    # a few numbers for each chunk, written once, as statistics and scores both need them
    own = materialise(own.select("chunk_id", F.size("t").cast("double").alias("length"), *[_frequency("t", s).alias(f"tf{i}") for i, s in enumerate(sought)]), "counts")
    stats = own.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(sought))])
    rows = own.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(sought)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))).otherwise(0.0)
    hit = F.greatest(*[F.col(f"tf{i}") for i in range(len(sought))], F.lit(0.0)) > 0
    return rows.where(hit).select("chunk_id", score.alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)


def needs_order(query: str) -> bool:
    """Whether a token of the query is parts that follow each other, which postings don't tell."""
    return any("_" in t.strip("_") for t in query_tokens(query))


def bm25_indexed(index: DataFrame, stats: DataFrame, query: str, limit: int = BM25_ROWS) -> DataFrame:
    """The same from stored postings and their stats (n, mean_length): reads the query's tokens only."""
    if needs_order(query):
        raise ValueError("postings have no order of tokens: use bm25")
    hits = index.where(F.col("token").isin([t.strip("_") for t in query_tokens(query)]))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats))  # a row for each token
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    sought = sorted({t.strip("_") for t in query_tokens(query)} - {""})
    rows = hits.join(F.broadcast(df), "token").withColumn("part", part)
    return summed(rows, sought).orderBy(F.desc("score"), "chunk_id").limit(limit)


def summed(rows: DataFrame, sought: list[str]) -> DataFrame:
    """chunk_id, score from token, chunk_id, part: the parts are added in the order of tokens, as `bm25` does, not in that in which a shuffle brings
    them. Else equal chunks differ in the last digit and the limit cuts them at random.
    """
    if not sought:
        return rows.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    parts = rows.groupBy("chunk_id").agg(*[F.sum(F.when(F.col("token") == t, F.col("part"))).alias(f"part{i}") for i, t in enumerate(sought)])
    return parts.select("chunk_id", reduce(lambda a, b: a + b, [F.coalesce(F.col(f"part{i}"), F.lit(0.0)) for i in range(len(sought))]).alias("score"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: n, mean_length in tokens."""
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens(F.col("chunk_text")))).alias("mean_length"))


def phrase_rows(chunks: DataFrame, query: str, words: list[int], near: list[tuple] = (), ids: DataFrame | None = None, n_words: int | None = None) -> list[dict]:
    """item_id, score, phrase_ratio, chunk_ix of the items whose chunks resemble the phrase.

    Candidates are the BM25 rows and the nearest chunks, BM25_ROWS + PHRASE_CHUNKS at most, so their texts are compared where the search is put together.
    """
    found = restricted_chunks(chunks.where(among("chunk_id", words) | places(list(near))), ids).select("item_id", "chunk_ix", "chunk_text").collect() if words or near else []
    n = len(query.split()) if n_words is None else n_words
    best: dict[int, dict] = {}
    for r, ratio in zip(found, similarities([r.chunk_text for r in found], query), strict=True):
        if ratio < scoring.LEAST_RATIO:
            continue
        old = best.get(r.item_id)
        if old is None or (-ratio, r.chunk_ix) < (-old["phrase_ratio"], old["chunk_ix"]):
            best[r.item_id] = {"item_id": r.item_id, "score": scoring.phrase_value(ratio, n), "phrase_ratio": ratio, "chunk_ix": r.chunk_ix, "chunk_text": r.chunk_text}
    return list(best.values())


def phrase_evidence(chunks: DataFrame, query: str, near: list[tuple] = (), ids: DataFrame | None = None, prefilter: bool = False) -> DataFrame:
    """The same as a DataFrame; the item filter comes after BM25's limit unless `prefilter`."""
    words = [r.chunk_id for r in bm25(restricted_chunks(chunks, ids) if prefilter else chunks, query).collect()]
    return local(chunks.sparkSession, phrase_rows(chunks, query, words, near, ids), "item_id long, score double, phrase_ratio double, chunk_ix int, chunk_text string")


def restricted_chunks(chunks: DataFrame, ids: DataFrame | None) -> DataFrame:
    return chunks if ids is None else chunks.join(ids.withColumnRenamed("id", "item_id"), "item_id", "left_semi")


def searched() -> Column:
    """The text of an item in which exact phrases are sought."""
    return F.coalesce(F.nullif("transcript", F.lit("")), F.nullif("text_content", F.lit("")), F.lit(""))


#: Found items up to which their ids are broadcast (some 8 MB).
LOOKED_UP = 1_000_000


def exact_evidence(items: DataFrame, chunks: DataFrame, phrase: str, ids: DataFrame | None = None, carry: list[str | Column] = (), few: list[int] | None = None) -> DataFrame:
    """item_id, n_mentions, chunk_ix, chunk_text, seam: items whose whole text has the phrase, and the first chunk that has it, else the first chunk.

    carry: columns of the items that come along. The found items are written, and only their chunks are compared and shuffled.
    few: ids that are known to be all that can be found; then nothing is written, and items and chunks are read by these ids.
    """
    rows = items if ids is None else items.join(ids, "id", "left_semi")
    counted = rows.select(F.col("id").alias("item_id"), mentions(searched(), phrase).alias("n_mentions"), *carry).where("n_mentions > 0")
    if few is not None:
        counted, own = counted.where(among("item_id", few)), chunks.where(among("item_id", few))
    else:
        counted = materialise(counted, "counted")
        found = counted.select("item_id")
        own = chunks.join(F.broadcast(found) if found.count() <= LOOKED_UP else found, "item_id", "left_semi")
    needle = " ".join(phrase.casefold().split())
    seam = ~F.contains(plain(F.col("chunk_text")), F.lit(needle))
    # the first chunk of each item by an aggregation that combines map-side
    first = own.groupBy("item_id").agg(F.min_by(F.struct("chunk_ix", "chunk_text", seam.alias("seam")), F.struct(seam, "chunk_ix")).alias("c"))
    return counted.join(first, "item_id").select("*", "c.chunk_ix", "c.chunk_text", "c.seam").drop("c")


def fused_rows(evidence: dict[str, list[dict]]) -> list[dict]:
    """The best evidence of each item over the sources, with source and priority; on equal scores the earlier source."""
    best: dict[int, dict] = {}
    for source in sorted(evidence, key=PRIORITY.__getitem__):
        for r in evidence[source]:
            if r["item_id"] not in best or r["score"] > best[r["item_id"]]["score"]:
                best[r["item_id"]] = r | {"source": source, "priority": PRIORITY[source]}
    return list(best.values())


def fuse(evidence: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """item_id, source, score and the given columns: the best evidence of each item over the sources, each of which a top-k bounds."""
    rows = None
    for source, found in evidence.items():
        own = found.select("item_id", F.lit(source).alias("source"), F.lit(PRIORITY[source]).alias("priority"), "score", *[F.col(c) if c in found.columns else F.lit(None).alias(c) for c in columns])
        rows = own if rows is None else rows.unionByName(own)
    return best_per(rows.coalesce(1), "item_id", [F.desc("score"), F.asc("priority")]).select("item_id", "source", "priority", "score", *columns)


def nearest_frame(hits: DataFrame, frames: DataFrame) -> DataFrame:
    """hits (item_id, frame_id?, ts_s?) with frame_path: the frame itself, else the nearest in time, else the first."""
    f = frames.select(F.col("item_id").alias("__item"), F.col("id").alias("__id"), F.col("ts_s").alias("__ts"), F.col("path").alias("__path"))
    rows = hits.join(f, F.col("item_id") == F.col("__item"), "left")
    known = F.coalesce(F.col("__id") == F.col("frame_id"), F.lit(False))
    place = F.struct((~known).alias("a"), F.coalesce(F.abs(F.col("__ts") - F.col("ts_s")), F.lit(0.0)).alias("b"), F.col("__ts").alias("c"), F.col("__id").alias("d"))
    return rows.groupBy(*hits.columns).agg(F.min_by("__path", place).alias("frame_path"))
