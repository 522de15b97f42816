"""Cells by leading bits, and order statistics over them, with a bound small enough to need several rounds."""

from __future__ import annotations

import datetime as dt
import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from panelytics.operators import statistics
from panelytics.plans import histogram


def bits_of(x: float) -> int:
    if math.isnan(x):
        return (1 << 63) - 1
    own = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -own if x < 0 else own


def doubles(seed: int = 8, n: int = 3_000) -> list[float]:
    rng = random.Random(seed)
    out = [0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 2.0**-1022, math.nextafter(2.0**-1022, 0), 1.7976931348623157e308]
    for e in range(-1074, 1024, 7):
        p = 2.0**e
        out += [p, -p, math.nextafter(p, 0), math.nextafter(p, math.inf), p * 1.5]
    out += [struct.unpack("<d", struct.pack("<q", rng.getrandbits(63)))[0] for _ in range(n)]
    return out + [rng.gauss(0, 1) for _ in range(n)]


def test_bits_of_doubles_are_their_own(spark):
    values = doubles()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", histogram.order_bits(df, "v").alias("k")).collect()
    for r in got:
        assert r.k == bits_of(r.v), r.v


@pytest.mark.parametrize(
    ("kind", "values"),
    [
        ("bigint", [-(2**63), -5, 0, 7, 2**63 - 1]),
        ("int", [-3, 0, 9]),
        ("date", [dt.date(1, 1, 1), dt.date(1969, 12, 31), dt.date(2020, 2, 2)]),
        ("decimal(12,3)", [Decimal("-1.500"), Decimal("0.001"), Decimal("99999999.999")]),
        ("float", [-1.5, 0.25, 3.0]),
    ],
)
def test_bits_keep_the_order(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    keys = [r.k for r in df.select("v", histogram.order_bits(df, "v").alias("k")).orderBy("v").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(values)


def rows_of(seed: int = 3):
    """Three keys: heavy tails over many magnitudes, few values, one dense run far from zero."""
    rng = random.Random(seed)
    rows = [("tails", math.copysign(10 ** rng.uniform(-300, 300), rng.choice([-1, 1]))) for _ in range(900)]
    rows += [("few", rng.choice([1.0, 2.0, 2.5])) for _ in range(50)] + [("one", 7.0)] * 30
    rows += [("dense", 1e15 + i * 0.125) for i in range(700)] + [("dense", -1e300), ("dense", 1e300)]
    return rows


@pytest.mark.parametrize("bits", [1, 4, 12])
def test_no_cell_over_the_bound(spark, monkeypatch, bits):
    monkeypatch.setattr(histogram, "RADIX_BITS", bits)
    hist = spark.createDataFrame(rows_of(), "k string, v double").distinct().cache()
    rows = histogram.value_cells(hist, ["k"], "v", most=20).cache()
    assert rows.count() == hist.count()
    assert rows.groupBy("k", "_cell").count().agg(F.max("count")).first()[0] <= 20
    assert rows.where("k in ('few', 'one')").select("k", "_cell").distinct().count() == 2
    ordered = rows.orderBy("k", "v").collect()
    assert all(a.k != b.k or a._cell <= b._cell for a, b in zip(ordered, ordered[1:]))


def test_span_of_all_longs_is_split(spark):
    hist = spark.createDataFrame([("a", v) for v in [-(2**63), -(2**63) + 1, -1, 0, 1, 2**62, 2**63 - 2, 2**63 - 1]], "k string, v long")
    rows = histogram.value_cells(hist, ["k"], "v", most=1).orderBy("v").collect()
    assert len({r._cell for r in rows}) == 8 and [r._cell for r in rows] == sorted(r._cell for r in rows)


@pytest.mark.parametrize("most", [5, 1 << 20])
def test_running_counts_and_quantiles(spark, monkeypatch, most):
    monkeypatch.setattr(histogram, "VALUE_CELL_ROWS", most)
    rows = rows_of()
    df = spark.createDataFrame(rows, "k string, v double")
    hist = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    got = {(r.k, r.v): (r.n_below, r.n_total) for r in histogram.running_counts(hist, ["k"], "v", ["n"]).collect()}
    own: dict[str, list[float]] = {}
    for k, v in rows:
        own.setdefault(k, []).append(v)
    assert got == {(k, v): (sum(x < v for x in vs), len(vs)) for k, vs in own.items() for v in set(vs)}
    found = {r.k: (r.a, r.m, r.z) for r in histogram.exact_quantiles(df, ["k"], "v", {"a": 0.0, "m": 0.5, "z": 0.9}).collect()}
    for k, vs in own.items():
        vs = sorted(vs)
        for q, x in zip((0.0, 0.5, 0.9), found[k]):
            at = q * (len(vs) - 1)
            low, high = vs[math.floor(at)], vs[math.ceil(at)]
            assert x == low + (high - low) * (at - math.floor(at))


def test_rank_tests_do_not_depend_on_the_bound(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("a", round(rng.gauss(s, 1), 2), s) for s in (0, 1) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v double, side int")
    tests = []
    for most in (4, 1 << 20):
        monkeypatch.setattr(histogram, "VALUE_CELL_ROWS", most)
        tests.append(statistics.mann_whitney(df, "v", F.col("side") == 0, F.col("side") == 1, ["k"]).collect())
    assert tests[0] == tests[1]
    first, second = ([v for _, v, s in rows if s == side] for side in (0, 1))
    assert tests[0][0].u1 == sum((a > b) + 0.5 * (a == b) for a in first for b in second)


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert histogram.exact_quantiles(none, ["k"], "v", {"m": 0.5}).collect() == []
    nulls = spark.createDataFrame([("a", None), (None, 1.0)], "k string, v double")
    assert histogram.exact_quantiles(nulls, ["k"], "v", {"m": 0.5}).collect() == []
