"""Retrieval metrics and ensembles, without a table of all pairs."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import scoring, vector
from holdfast.operators import batches


def ranks(vectors: DataFrame, queries: DataFrame, group: str, key: str = "vec_id", half: bool = False) -> DataFrame:
    """query_id, rank of the first row of the query's own group. queries: query_id, q, own. vectors: key, embedding, group."""
    return _united(queries, [batches.first_ranks(vectors, b, group, key, half) for b in batches.blocks(queries, own="own")])


def ensemble_ranks(vectors: DataFrame, queries: DataFrame, weights: dict[str, float], group: str, key: str = "vec_id") -> DataFrame:
    """The same by the weighted sum of the models' z-scores. A model is a column of vectors and of queries.

    A z-score is the similarity less a number of the query, over another: so the sum ranks like one product of the models' vectors
    end to end, with each query's part scaled by weight over deviation.
    """
    whole = vectors.withColumn("embedding", F.concat(*weights))
    out = []
    for b in batches.blocks(queries.withColumn("q", F.concat(*weights)), own="own"):
        at, scaled = 0, b.q.copy()
        for model, weight in weights.items():
            dim = queries.select(F.size(model)).first()[0]
            part = batches.Block(b.ids, b.q[:, at : at + dim], b.own)
            _, deviation = batches.moments(vectors.select(key, F.col(model).alias("embedding")), part, key)
            scaled[:, at : at + dim] *= (weight / np.maximum(deviation, scoring.LEAST_SPREAD))[:, None]
            at += dim
        out.append(batches.first_ranks(whole, batches.Block(b.ids, scaled, b.own), group, key))
    return _united(queries, out)


def _united(queries: DataFrame, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], "query_id long, rank long")


def metrics(ranked: DataFrame) -> DataFrame:
    """recall_1, recall_3, mrr, n_queries."""
    within = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return ranked.agg(within(1).alias("recall_1"), within(3).alias("recall_3"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count(F.lit(1)).alias("n_queries"))


def mean_vector(rows: DataFrame, by: str, v: str = "embedding") -> DataFrame:
    """The normalised mean of vectors, element by element."""
    parts = rows.select(by, F.posexplode(v).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    return whole.select(by, vector.normalize(F.col("p.x")).alias(v))


def real_time_factor(rows: DataFrame, spent: str, audio: str) -> DataFrame:
    return rows.agg(F.when(F.sum(audio) > 0, F.sum(spent) / F.sum(audio)).alias("rtf"))
