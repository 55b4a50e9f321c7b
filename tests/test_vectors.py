"""Batched and indexed nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import batches, evaluate, vector_index
from holdfast.operators import search as S
from holdfast.plans import search
from holdfast.queries import _calibration, _vectors
from holdfast.sources.library import from_tables, read

RNG = np.random.default_rng(3)


def table(spark, tmp_path, m, name="v", **more):
    rows = [(i, i % 50, [float(x) for x in v]) for i, v in enumerate(m)]
    spark.createDataFrame(rows, "vec_id long, item_id long, embedding array<float>").repartition(5).write.mode("overwrite").parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def clustered(n, dim=32, groups=40):
    centres = RNG.normal(size=(groups, dim))
    m = centres[RNG.integers(groups, size=n)] + 0.15 * RNG.normal(size=(n, dim))
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def queries_of(df, where="vec_id % 100 = 0"):
    return df.where(where).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def plain_nearest(m, ids, q, k, skip=None):
    d = np.sqrt(((m.astype(np.float64) - q.astype(np.float64)) ** 2).sum(axis=1))
    return [i for _, i in sorted((x, i) for x, i in zip(d, ids, strict=True) if i != skip)[:k]]


@pytest.mark.parametrize("block", [2, 1024])
@pytest.mark.parametrize("others", [False, True])
def test_many_queries_against_brute_force(spark, tmp_path, block, others):
    m = np.concatenate([RNG.normal(size=(200, 6)), np.zeros((30, 6)), np.ones((3, 6))]).astype(np.float32)  # ties among copies
    df = table(spark, tmp_path, m).unionByName(spark.createDataFrame([(900, 1, [1.0, 2.0]), (901, 1, None), (None, 1, [0.0] * 6)], "vec_id long, item_id long, embedding array<float>"))
    got = batches.nearest_many(df, queries_of(df, "vec_id % 40 = 0"), 7, others=others, block=block).collect()
    for q in range(0, 233, 40):
        own = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.place)]
        assert own == plain_nearest(m, range(233), m[q], 7, q if others else None)


def test_many_queries_of_nothing(spark, tmp_path):
    df = table(spark, tmp_path, np.zeros((3, 4), np.float32))
    assert batches.nearest_many(df, queries_of(df, "false"), 5).collect() == []
    assert batches.nearest_many(df.where("false"), queries_of(df, "vec_id = 0"), 5).collect() == []


@pytest.mark.parametrize("half", [False, True])
def test_ranks_against_brute_force(spark, tmp_path, half):
    m = np.concatenate([RNG.normal(size=(150, 8)), np.zeros((20, 8))]).astype(np.float32)
    df = table(spark, tmp_path, m).withColumn("label", F.when(F.col("vec_id") != 77, F.col("vec_id") % 9))
    queries = queries_of(df, "vec_id % 11 = 0").join(df.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    got = {r.query_id: r["rank"] for r in evaluate.ranks(df, queries, "label", half=half).collect()}
    x = m.astype(np.float16).astype(np.float64) if half else m.astype(np.float64)
    for q in range(0, 170, 11):
        order = sorted((-float((x[i] * x[q]).sum()), i) for i in range(170) if i != q)
        places = [n + 1 for n, (_, i) in enumerate(order) if i % 9 == q % 9 and i != 77]
        assert got[q] == (None if q == 77 else places[0])


def test_index_finds_nine_in_ten(spark, sf):
    e = read(spark, sf, "embeddings").withColumn("item_id", F.col("vec_id"))
    index, queries = vector_index.built(e), queries_of(e)
    for ids in (None, spark.range(250).toDF("id"), spark.range(40).toDF("id"), spark.range(0).toDF("id")):
        exact = batches.nearest_many(S.restricted(e, ids), queries, 50)
        rows = vector_index.recall_of(vector_index.search(index, queries, 50, ids), exact).collect()
        assert sum(r.hits for r in rows) >= 0.9 * sum(r.n for r in rows)
    assert index.sizes.sum() == e.count() == index.table.count()


def test_rows_read_fall_with_the_lists_probed(spark, tmp_path):
    m = clustered(6000)
    df = table(spark, tmp_path, m)
    index, queries = vector_index.built(df, sample=3000), queries_of(df, "vec_id = 17")
    assert index.probes(10) <= len(index.sizes) / 4 < index.probes(10, share=1e-6) == len(index.sizes)
    assert index.probes(10) <= index.probes(10, share=0.05) and index.probes(10, recall=0.5) <= index.probes(10)
    found = vector_index.search(index, queries, 10)
    assert "PartitionFilters: [list_id" in found._jdf.queryExecution().executedPlan().toString()
    few = index.table.where(F.col("list_id").isin([int(i) for i in index.quantiser.order(m[17:18].astype(float))[0][: index.probes(10)]])).count()
    assert few <= len(m) / 4
    all_ = queries_of(df)
    exact = batches.nearest_many(df, all_, 10)
    recall = lambda n: sum(r.hits for r in vector_index.recall_of(vector_index.search(index, all_, 10, probes=n), exact).collect()) / 600
    assert recall(None) >= 0.9 and recall(1) < recall(len(index.sizes)) and recall(len(index.sizes)) >= 0.98


def test_odd_vectors_are_left_out_of_an_index(spark, tmp_path):
    df = table(spark, tmp_path, clustered(60, dim=10)).unionByName(spark.createDataFrame([(900, 1, [1.0, 2.0]), (901, 1, None), (None, 1, [0.0] * 10)], "vec_id long, item_id long, embedding array<float>"))
    index = vector_index.built(df)
    assert index.table.count() == 60
    assert vector_index.search(index, queries_of(df, "vec_id = 900"), 5).collect() == []
    got = vector_index.search(index, queries_of(df, "vec_id = 3"), 100, keep=("item_id",)).collect()
    assert len(got) == 60 and all(r.item_id == r.vec_id % 50 for r in got)
    with pytest.raises(ValueError, match="no vectors"):
        vector_index.built(df.where("vec_id = 901"))


def test_a_search_through_indexes(spark, sf):
    lib = search.prepared(from_tables(spark, sf))
    vectors, calibration, f = _vectors(lib), S.by_space(_calibration(lib)), S.Filters("the of", ["text", "video"])
    plain, indexed = (search.evidence(x, f, vectors, calibration) for x in (lib, search.with_vector_indexes(lib)))
    for source in ("image", "text"):
        score = [{r["item_id"]: round(r["score"], 6) for r in e[source]} for e in (plain, indexed)]
        both = score[0].keys() & score[1].keys()
        assert len(both) >= 0.9 * len(score[0]) and sum(score[0][i] == score[1][i] for i in both) >= 0.9 * len(both)
