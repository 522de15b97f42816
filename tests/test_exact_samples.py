"""Samples of an exact size that do not depend on the layout."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from panelytics.operators import filters


def order(key, seed=7):
    return hashlib.md5(f"{key}:{seed}".encode()).hexdigest()[:15]


@pytest.mark.parametrize("size", [0, 1, 37, 10_000])
def test_smallest_hashes_of_each_group_in_every_layout(spark, size):
    rows = [(g, i) for g, n in (("hot", 5_000), ("small", 20), (None, 60)) for i in range(n)]
    want = set()
    for g in ("hot", "small", None):
        own = sorted((i for k, i in rows if k == g), key=lambda i: (order(i), i))
        want |= {(g, i) for i in own[:size]}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "g string, id long").repartition(parts, F.rand(parts)).withColumn("_h", F.lit("clash")).drop("_h")
        got = [(r.g, r.id) for r in filters.exact_sample(df, ["g"], size, "id", seed=7).collect()]
        assert len(got) == len(want) and set(got) == want


def test_sizes_by_group_nulls_and_repeats(spark):
    rows = [("a", i, 3) for i in range(50)] + [("b", i, 60) for i in range(50)] + [("c", None, 1), ("c", 4, 1), ("d", 9, 2), ("d", 9, 2), ("d", 9, 2)]
    df = spark.createDataFrame(rows, "g string, id long, want int")
    got = filters.exact_sample(df, ["g"], F.col("want"), "id")
    assert got.columns == df.columns
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {"a": 3, "b": 50, "c": 1, "d": 2}
    assert got.where("g = 'c'").first().id == 4
    assert filters.exact_sample(df.limit(0), ["g"], 5, "id").collect() == []
