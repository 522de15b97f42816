"""Sums of floats that are the same bits for every order and grouping of the rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from panelytics.functions import statistics as st
from panelytics.operators import divergence, ranks


def values(seed: int = 2, n: int = 4_000) -> list[float]:
    rng = random.Random(seed)
    return [rng.choice([1, -1]) * 10 ** rng.uniform(-12, 6) for _ in range(n)] + [0.1] * 1_000 + [1e15, -1e15, -0.0]


def test_same_bits_in_every_partitioning_and_near_the_exact_sum(spark):
    rows = values()
    df = spark.createDataFrame([(i % 3, x) for i, x in enumerate(rows)], "k int, x double")
    seen, plain = set(), set()
    for parts in range(1, 11):
        spread = df.repartition(parts, F.rand(parts)).groupBy("k").agg(st.steady_sum("x").alias("s"), st.steady_avg("x").alias("a"), st.steady_std("x").alias("d"), F.sum("x").alias("p"))
        got = sorted(spread.collect())
        seen.add(tuple((r.k, r.s, r.a, r.d) for r in got))
        plain.add(tuple(r.p for r in got))
    assert len(seen) == 1 and len(plain) > 1
    for k, s, a, _ in seen.pop():
        own = [x for i, x in enumerate(rows) if i % 3 == k]
        assert math.isclose(s, math.fsum(own), rel_tol=1e-13) and math.isclose(a, math.fsum(own) / len(own), rel_tol=1e-13)


@pytest.mark.parametrize(
    ("rows", "want"),
    [([], None), ([None, None], None), ([1.5, None], 1.5), ([float("inf"), 1.0], math.inf), ([1e300, 1e300], 2e300), ([-0.25, 0.25], 0.0), ([2.0**61] * 8, 2.0**64)],
)
def test_odd_groups(spark, rows, want):
    df = spark.createDataFrame([(x,) for x in rows], "x double")
    assert df.agg(st.steady_sum("x")).first()[0] == want
    assert df.agg(st.steady_std("x")).first()[0] is None or len([x for x in rows if x is not None]) > 1


def test_nan_stays_nan(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,)], "x double")
    assert math.isnan(df.agg(st.steady_sum("x")).first()[0])


def test_divergence_is_the_same_bits_over_ten_partitionings(spark):
    rng = random.Random(3)
    rows = [("a", m, p, rng.randrange(1, 500)) for m in range(3) for p in range(300) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "project string, m int, page_id long, tot_count_views long").select(
        "project", F.add_months(F.lit("2020-01-01").cast("date"), F.col("m")).alias("date"), "page_id", F.col("page_id").cast("string").alias("page"), "tot_count_views"
    )
    seen = set()
    for parts in range(1, 11):
        panel = df.repartition(parts, F.rand(parts))
        aligned = divergence.align_pairs(ranks.fractional_rank(panel)).cache()
        divs = divergence.divergences(aligned.repartition(parts, F.rand(parts + 50)), [0, 0.3, math.inf])
        totals = divergence.total_divergence(divs).collect()
        stats = divergence.pair_statistics(aligned, divs, panel).collect()
        seen.add((tuple(sorted(map(str, totals))), tuple(sorted(map(str, stats)))))
        aligned.unpersist()
    assert len(seen) == 1
