"""Sets of bits against plain sets, over more periods than one long holds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panelytics.operators import lifetime, overlap
from panelytics.plans import bitmaps


def made(seed: int = 4, top: int = 200, pages: int = 40) -> dict[tuple[str, int], set[int]]:
    rng = random.Random(seed)
    sets = {(rng.choice("ab"), p): set(rng.sample(range(top), rng.choice([1, 2, 5, 60, 150]))) for p in range(pages)}
    sets["a", 900], sets["b", 901], sets["a", 902] = set(range(top)), {63, 64, 127, 128, 191, 192}, {0, top - 1}
    sets["b", 903] = set(range(60, 130))
    return sets


def frame(spark, sets):
    rows = [(k, p, t) for (k, p), own in sets.items() for t in own] * 2
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows + [("a", 950, None)], "k string, page_id long, t long")


def runs_of(own: set[int]) -> list[tuple[int, int]]:
    out = []
    for t in sorted(own):
        if out and out[-1][0] + out[-1][1] == t:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((t, 1))
    return out


@pytest.fixture(scope="module")
def sets():
    return made()


@pytest.fixture(scope="module")
def bits(spark, sets):
    return bitmaps.presence_bits(frame(spark, sets), ["k", "page_id"], F.col("t"), bitmaps.words_for(199)).cache()


def unpacked(words: list[int]) -> set[int]:
    return {64 * w + i for w, x in enumerate(words) for i in range(64) if x >> i & 1}


def test_sizes_spans_and_shifts(bits, sets):
    lags = (0, 1, 2, 63, 64, 65, 128, 199, 300)
    moved = [bitmaps.later("bits", F.lit(g), 4).alias(f"g{g}") for g in lags]
    pairs = [f(F.col("bits"), bitmaps.later("bits", 3, 4), 4).alias(n) for n, f in (("both", bitmaps.both), ("less", bitmaps.without))]
    rows = bits.select("k", "page_id", "bits", bitmaps.size("bits", 4).alias("n"), bitmaps.span("bits", 4).alias("span"), *moved, *pairs).collect()
    assert len(rows) == len(sets) + 1
    for r in rows:
        own = sets.get((r.k, r.page_id), set())
        assert unpacked(r.bits) == own and r.n == len(own) and r.span == (max(own) - min(own) if own else -1)
        for g in lags:
            assert unpacked(r[f"g{g}"]) == {t + g for t in own if t + g < 256}
        later = {t + 3 for t in own}
        assert unpacked(r.both) == own & later and unpacked(r.less) == own - later


def test_runs(bits, sets):
    for r in bits.select("k", "page_id", bitmaps.run_lengths("bits", 4).alias("runs")).collect():
        assert r.runs == [n for _, n in runs_of(sets.get((r.k, r.page_id), set()))]


def test_counts_by_period(bits, sets):
    got = {(r.k, r.period_idx): r.nb for r in bitmaps.counts_by_period(bitmaps.patterns(bits, ["k"]), ["k"]).collect()}
    want = {}
    for (k, _), own in sets.items():
        for t in own:
            want[k, t] = want.get((k, t), 0) + 1
    assert got == want


def panel(spark, sets):
    dated = F.add_months(F.lit("2000-01-01").cast("date"), F.col("t").cast("int")).alias("date")
    return frame(spark, sets).where("t is not null").distinct().select(F.col("k").alias("project"), "page_id", F.col("page_id").cast("string").alias("page"), "t", dated)


def test_flux_by_lag_over_many_periods(spark, sets):
    got = {(r.project, r.period_idx, r.lag): (round(r.new, 9), round(r.gone, 9)) for r in overlap.flux_by_lag(panel(spark, sets), max_lag=70).collect()}
    want = {}
    for k in "ab":
        own = {t: {p for (q, p), s in sets.items() if q == k and t in s} for t in range(200)}
        there = [t for t in range(200) if own[t]]
        for i, t in enumerate(there):
            for lag in range(1, min(i, 70) + 1):
                now, then = own[t], own[there[i - lag]]
                want[k, i + 1, lag] = (round(len(now - then) / len(now) * 100, 9), round(len(then - now) / len(now) * 100, 9))
    assert got == want


def test_overlaps_over_many_periods(spark, sets):
    binned = panel(spark, sets).withColumn("rank_range", F.lit(0))
    one = {(r.project, r.date): r.overlap for r in overlap.overlap_at_lag(binned, 65, 10).collect()}
    many = {(r.project, r.date): r for r in overlap.overlap_at_lags(binned, [1, 66], 10).collect()}
    dates = {r.t: r.date for r in panel(spark, sets).select("t", "date").distinct().collect()}
    for k in "ab":
        own = {t: {p for (q, p), s in sets.items() if q == k and t in s} for t in range(200)}
        there = [t for t in range(200) if own[t]]
        for i, t in enumerate(there):
            if i >= 65:
                assert one.pop((k, dates[t])) == len(own[t] & own[there[i - 65]]) * 10
            if i >= 66:
                r, now, a, b = many.pop((k, dates[t])), own[t], own[there[i - 1]], own[there[i - 66]]
                common = now & a & b
                assert (r.nb_common, r.nb_only_current, r.nb_only_lag_1, r.nb_only_lag_66) == tuple(map(len, (common, now - common, a - common, b - common)))
    assert not one and not many


def test_profiles_equal_runs(spark, sets):
    rows = panel(spark, sets).withColumn("volume", F.lit("core"))
    each = lifetime.longest_runs(lifetime.run_lengths(rows)).groupBy("project", "volume", "max_lifetime", "consecutive_occurrences", "nb_occurrences").count()
    profile = lifetime.run_profile(rows).groupBy("project", "volume", "max_lifetime", "consecutive_occurrences", "nb_occurrences").sum("n")
    assert sorted(map(tuple, each.collect())) == sorted(map(tuple, profile.collect()))
    want = sorted((k, p, i + 1, n, len(s), len(runs_of(s))) for (k, p), s in sets.items() for i, (_, n) in enumerate(runs_of(s)))
    got = lifetime.run_lengths(rows).select("project", "page_id", "run", "lifetime", "nb_occurrences", "consecutive_occurrences")
    assert sorted(map(tuple, got.collect())) == want


def test_no_rows(spark):
    none = spark.createDataFrame([], "project string, page_id long, page string, date date, volume string, rank_range int")
    for out in (overlap.flux_by_lag(none), overlap.overlap_at_lag(none), overlap.overlap_at_lags(none, [1]), lifetime.run_lengths(none), lifetime.run_profile(none), lifetime.common_unique_shares(none), overlap.always_present_share(none)):
        assert out.collect() == []


def test_rows_before_the_sum_grow_with_lags(spark):
    """One set of 150 of 150 periods: 149 lags of 3 longs, not 11,175 pairs; and no list of periods is built."""
    rows = panel(spark, {("a", 1): set(range(150))})
    plan = overlap.flux_by_lag(rows)._jdf.queryExecution().toString()
    assert "collect_set" not in plan
    sets = bitmaps.presence_bits(rows.select("project", "page_id", "t"), ["project", "page_id"], F.col("t"), 3)
    built = sets._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in built and "SortAggregate" not in built and "ObjectHash" not in built
    spans = sets.select(F.explode(F.sequence(F.lit(1), F.lit(149))).alias("lag"), "bits")
    words = spans.select(F.explode(bitmaps.both(F.col("bits"), bitmaps.later("bits", F.col("lag"), 3), 3)).alias("w")).where("w <> 0")
    assert words.count() <= 149 * 3
