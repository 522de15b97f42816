"""Codes against comparing everything with everything in Python's integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelytics.llm import vector_codes
from panelytics.llm.vector_codes import Settings

SCHEMA = "vec_id long, embedding array<double>, label int, whole string, codes int, error string, own int"


def plain(rows, s: Settings):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    scaled = [[max(-(2**62), min(2**62, math.floor(x * s.scale))) if abs(x) < 1e300 else (2**62 if x > 0 else -(2**62)) for x in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, scaled[i]))
    kept, scaled = [kept[i] for i in order], [scaled[i] for i in order]
    same = [i for i in range(len(kept)) if len(scaled[i]) == len(scaled[0])]
    kept, scaled = [kept[i] for i in same], [scaled[i] for i in same]
    if not kept:
        return []
    width = -(-len(scaled[0]) // s.parts)
    parts = [[(v + [0] * (s.parts * width - len(v)))[p * width : (p + 1) * width] for p in range(s.parts)] for v in scaled]
    books = [[v[p] for v in parts[: s.entries]] for p in range(s.parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], e)), k) for k, e in enumerate(books[p])) for p in range(s.parts)] for v in parts]

    for _ in range(s.rounds):
        hit = assign()
        for p in range(s.parts):
            for k in range(len(books[p])):
                own = [parts[i][p] for i in range(len(parts)) if hit[i][p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    hit = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in h) for h in hit]
    label = {}
    for r, e in zip(kept, errors):
        label[r[2]] = label.get(r[2], 0) + min(e, 2**63 - 1)
    return [
        (r[0], "".join(f"{k:02x}" for _, k in h), min(e, 2**63 - 1), min(label[r[2]], 2**63 - 1), digest)
        for r, h, e in zip(kept, hit, errors)
    ]


def found(spark, rows, s: Settings):
    frame = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    return [tuple(r) for r in vector_codes.compress(frame, s).collect()]


def key(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def vectors(count: int, width: int, seed: int = 3):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0, 0.2, width).tolist(), int(i % 4) if i % 5 else None) for i in range(count)]


@pytest.mark.parametrize("width", [0, 1, 4, 12, 16, 20, 21])
def test_equals_plain_comparison(spark, width):
    s = Settings(entries=9, rounds=2)
    rows = vectors(60, width)
    assert key(found(spark, rows, s)) == key(plain(rows, s))


def test_odd_rows(spark):
    s = Settings(entries=5, rounds=3)
    base = vectors(30, 8)
    odd = [(100, None, 1), (101, [None] * 8, 1), (102, [float("nan")] * 8, 1), (103, [float("inf")] + [0.0] * 7, None), (104, [0.1] * 7, 1), (105, [], 2)]
    odd += [(None, [0.5] * 8, 1), (7, [0.25] * 8, 2), (7, [0.25] * 8, 2), (106, [-0.0] * 8, 3)] + [(107, [1.0] * 8, 3)] * 20
    rows = base + odd
    assert key(found(spark, rows, s)) == key(plain(rows, s))
    assert found(spark, [], s) == [] and found(spark, odd[:4], s) == []


def test_fewer_rows_than_entries_and_huge_components(spark):
    rows = vectors(20, 8) + [(50 + i, [1e30 * (-1) ** i, 3e9, 1e17, -1e308, *([0.5] * 4)], 9) for i in range(6)]
    s = Settings(rounds=2)
    assert key(found(spark, rows, s)) == key(plain(rows, s))


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_nearest_is_exact(data):
    width = data.draw(st.integers(1, 9))
    number = data.draw(st.sampled_from([st.integers(-3, 3), st.integers(-1_500, 1_500), st.integers(-(2**26), 2**26), st.integers(-(2**40), 2**40)]))
    rows = data.draw(st.lists(st.lists(number, min_size=width, max_size=width), min_size=1, max_size=8))
    books = data.draw(st.lists(st.lists(number, min_size=width, max_size=width), min_size=1, max_size=12))
    index, apart = vector_codes.nearest(np.array(rows), np.array(books))
    want = [min((sum((a - b) ** 2 for a, b in zip(r, e)), k) for k, e in enumerate(books)) for r in rows]
    assert [(int(d), int(k)) for d, k in zip(apart, index)] == want


@pytest.mark.parametrize(("width", "largest"), [(16, 1_447), (16, 1_448), (3, 5_792), (3, 5_793), (16, 67_108_863), (16, 67_108_864)])
def test_widest_components_of_each_kind_of_numbers(width, largest):
    """On both sides of the bounds, with the differences that make the largest coefficients."""
    rng = np.random.default_rng(largest)
    signs = rng.choice([-1, 1], (40, width))
    rows, books = np.concatenate([signs, np.ones((1, width), dtype=np.int64)]) * largest, np.concatenate([-signs[:20], -np.ones((1, width), dtype=np.int64)]) * largest
    index, apart = vector_codes.nearest(rows, books)
    whole = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)) for e in books] for r in rows]
    assert [(int(d), int(k)) for d, k in zip(apart, index)] == [min((d, k) for k, d in enumerate(w)) for w in whole]


def test_transform_keeps_distances_and_orders_by_sign_changes():
    for width in (1, 2, 8, 32):
        order = vector_codes.sequency(width)
        signs = vector_codes.walsh(np.eye(width, dtype=np.int64))[order]
        assert [(np.diff(r) != 0).sum() for r in signs] == list(range(width))
        a, b = np.arange(width)[None] ** 2, 3 * np.arange(width)[None]
        assert ((vector_codes.walsh(a) - vector_codes.walsh(b)) ** 2).sum() == width * ((a - b) ** 2).sum()


def test_entries_are_eliminated_early(monkeypatch):
    """Clustered parts: hardly any entry is compared in its last coefficients, and the result is that of all of them."""
    rng = np.random.default_rng(1)
    centre = rng.integers(-500, 500, (64, 16)).cumsum(axis=1)
    rows = centre[rng.integers(0, 64, 512)] + rng.integers(-9, 9, (512, 16))
    index, apart = vector_codes.nearest(rows, centre)
    whole = ((rows[:, None] - centre[None]) ** 2).sum(axis=2)
    assert (index == whole.argmin(axis=1)).all() and (apart == whole.min(axis=1)).all()
