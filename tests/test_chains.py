"""Thinning by pointers against a plain pass."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from holdfast.operators import chains


def plain(rows, gap):
    kept, last = set(), {}
    for k, t in sorted({(k, t) for k, t in rows if t is not None}, key=lambda r: (str(r[0]), r[1])):
        if k not in last or t - last[k] >= gap:
            last[k] = t
            kept.add((k, t))
    return kept


@pytest.mark.parametrize("gap", [1, 7, 1000])
def test_thinned_equals_a_pass(spark, gap):
    rng = random.Random(gap)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(-300, 300)) for _ in range(300)]
    rows += [("far", t) for t in (-5000, 0, 6, 7, 9000, 9006, 9007, 9014)] + [("one", 3), ("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "key string, t long").withColumn("next", F.lit("clash"))
    got = [tuple(r) for r in chains.thinned(df, ["key"], "t", gap).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, gap)


def test_a_long_chain_and_no_rows(spark):
    df = spark.range(3000).select(F.lit(1).alias("item"), F.lit(2).alias("part"), (F.col("id") * 10).alias("at"))
    got = chains.thinned(df, ["item", "part"], "at", 25)
    assert got.columns == ["item", "part", "at"] and {r["at"] for r in got.collect()} == set(range(0, 30000, 30))
    assert chains.thinned(df.where("item = 5"), ["item", "part"], "at", 25).count() == 0
    with pytest.raises(ValueError):
        chains.thinned(df, ["item"], "at", 0)
