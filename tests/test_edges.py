"""Hand-made edge cases, compared with brute force in plain Python."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from panelytics.functions.namespaces import NAMESPACE_TERMS
from panelytics.functions.topics import most_specific, parse_topics, topic_code
from panelytics.operators import (
    divergence, filters, hinge, identity, lifetime, models, overlap, pairs, ranks, statistics, transitions,
)
from panelytics.plans import histogram
from panelytics.plans.joins import attach
from panelytics.sources import tables

PANEL = "project string, date date, page_id bigint, page string, tot_count_views bigint"
JAN = dt.date(2020, 1, 1)


def month(i: int) -> dt.date:
    return dt.date(2020 + i // 12, 1 + i % 12, 1)


def panel(spark, rows):
    """rows of (month index, page_id, views)."""
    return spark.createDataFrame([("en", month(m), p, f"p{p}", v) for m, p, v in rows], PANEL)


def random_panel(spark, seed, n=400, ids=2**34, top=60):
    rnd = random.Random(seed)
    chosen = rnd.sample(range(ids), n)
    return [(rnd.randrange(2), p, 1 + int(top / (1 + rnd.randrange(top)))) for p in chosen]


def brute_curve(rows):
    """Ranks, curve and slopes as a row-by-row walk."""
    out = {}
    for m in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == m), key=lambda r: (-r[2], r[1]))
        total, n, cum = sum(r[2] for r in group), len(group), 0
        points = []
        for i, r in enumerate(group, 1):
            cum += r[2]
            points.append((r[1], i, cum / total * 100, i / n * 100))
        hinge_at = None
        for before, here, after in zip(points, points[1:], points[2:]):
            if (after[2] - before[2]) / 2 <= 100 / n:
                hinge_at = here
                break
        out[m] = (points, hinge_at)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_curve_and_hinge_match_brute_force(spark, seed):
    rows = random_panel(spark, seed)
    df = panel(spark, rows)
    want = brute_curve(rows)
    got = {(r.date, r.page_id): r for r in hinge.cumulative_curve(df).collect()}
    for m, (points, _) in want.items():
        for page, rank, perc, perc_rank in points:
            r = got[month(m), page]
            assert (r["rank"], r.perc_views, r.perc_rank) == (rank, perc, perc_rank)
    hinges = {r.date: (r.hinge_perc, r.hinge_rank) for r in hinge.hinge_points(df).collect()}
    assert hinges == {month(m): (h[2], h[3]) for m, (_, h) in want.items() if h}


def test_hinge_of_equal_views_is_decided_by_the_same_floats(spark):
    rows = [(m, p, v) for m, (n, v) in enumerate([(7, 3), (50, 1), (333, 7), (2, 5), (1, 9), (3, 4)]) for p in range(n)]
    want = {month(m): (h[2], h[3]) for m, (_, h) in brute_curve(rows).items() if h}
    df = panel(spark, rows)
    assert {r.date: (r.hinge_perc, r.hinge_rank) for r in hinge.hinge_points(df).collect()} == want
    labelled = hinge.label_volumes(df)
    assert {r.date for r in labelled.select("date").distinct().collect()} == set(want)


def test_hinge_from_rows_equals_hinge_from_histogram(spark):
    df = panel(spark, random_panel(spark, 9))
    rows = hinge.hinge_of_curve(hinge.cumulative_curve(df))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, hinge.hinge_points(df).collect()))


def test_zipf_core_and_tail_share_all_rows(spark):
    df = panel(spark, [(0, p, 1_000_000 // p) for p in range(1, 1001)])
    labelled = hinge.label_volumes(df)
    counts = {r.volume: r["count"] for r in labelled.groupBy("volume").count().collect()}
    assert counts["core"] + counts["tail"] == 1000 and counts["core"] < counts["tail"]
    again = hinge.core(df.withColumn("rank", F.lit(0)))
    assert again.count() == counts["core"]


def test_kept_rank_shows_in_perc_rank(spark):
    df = panel(spark, [(0, p, 100 - p) for p in range(20)]).withColumn("rank", (F.col("page_id") + 1) * 3)
    curve = hinge.cumulative_curve(df, keep_rank="rank")
    assert {r.page_id: r.perc_rank for r in curve.collect()}[19] == 60 / 20 * 100
    assert hinge.label_volumes(df, keep_rank="rank").count() == 20


def test_ties_across_id_cells(spark):
    ids = [5, 2**20 - 1, 2**20, 2**20 + 7, 2**33, 3, 2**40]
    df = panel(spark, [(0, p, 10) for p in ids] + [(0, 99, 11), (0, 98, 9)])
    got = {r.page_id: (r["rank"], r.fractional_rank) for r in histogram.curve(df).collect()}
    order = [99, *sorted(ids), 98]
    assert {p: r for p, (r, _) in got.items()} == {p: i for i, p in enumerate(order, 1)}
    assert got[5][1] == 1 + (len(ids) + 1) / 2
    mean = sum(f for _, f in got.values()) / len(got)
    assert mean == (len(got) + 1) / 2


def test_text_ids_and_limits_agree_between_both_ways(spark):
    rnd = random.Random(3)
    rows = [("en", JAN, f"id{i}", f"t{i}", rnd.randrange(1, 4)) for i in range(500)]
    df = spark.createDataFrame(rows, PANEL.replace("page_id bigint", "page_id string"))
    full = {r.page_id: r["rank"] for r in ranks.rank_rows(df).collect()}
    top = {r.page_id: r["rank"] for r in ranks.rank_rows(df, lim=120).collect()}
    cut = {r.page_id: r["rank"] for r in histogram.curve(df, lim=120).collect()}
    assert sorted(full.values()) == list(range(1, 501))
    assert top == cut == {p: r for p, r in full.items() if r <= 120}


def test_bins(spark):
    df = panel(spark, [(0, p, 1000 - p) for p in range(100)])
    binned = {r["rank"]: r.rank_range for r in ranks.rank_bins(df, lim=20, slicing=5).collect()}
    assert binned == {r: min(r // 5, 3) for r in range(1, 21)}
    decades = {r["rank"]: r.rank_range for r in ranks.rank_bins(df, lim=100, slicing=1, log=True).collect()}
    assert decades[1] == 0 and decades[9] == 0 and decades[10] == 1 and decades[100] == 2
    low = ranks.view_bins(df, lim=100, nb_bins=2, min_views=950, max_views=1000)
    with pytest.raises(Exception, match="below the first bin"):
        low.collect()


def test_period_bins_do_not_repeat_the_last_edge(spark):
    df = panel(spark, [(m, 1, 1) for m in range(7)])
    got = [r.date_range for r in ranks.period_bins(df, 3).orderBy("date").collect()]
    assert got == [0, 0, 1, 1, 2, 2, 2]


def test_missing_ids_and_redirects(spark):
    rows = [
        ("en", "A", "1", "desktop", 10), ("en", "A", None, "desktop", 3), ("en", "B", None, "desktop", 9),
        ("en", "B", "2", "desktop", 1), ("en", "C", "null", "desktop", 8), ("en", "D", "1", "mobile-web", 12),
        ("en", "E", "3", "desktop", 5), ("en", "E", "4", "desktop", 5),
    ]
    df = spark.createDataFrame(rows, "project string, page string, page_id string, access_type string, counts bigint")
    df = df.withColumn("date", F.lit(JAN))
    got = {r.page_id: (r.page, r.tot_count_views) for r in identity.collapse_redirects(df).collect()}
    # B and C have no id on their largest row; E is a tie and takes the lower id.
    assert got == {"1": ("D", 25), "3": ("E", 10)}
    sides = {(r.page, r.page_id): (r.desktop_views, r.mobile_views) for r in identity.collapse_by_access(df).collect()}
    assert sides == {("A", "1"): (13, None), ("D", "1"): (None, 12), ("E", "3"): (10, None)}


def test_chains_of_every_length(spark):
    rows, want, page = [], {}, 0
    start = 0
    for length in (1, 2, 3, 12):
        ids = []
        for k in range(length):
            page += 1
            ids.append(page)
            # Id k is seen for two months; its second title is the next id's first.
            rows.append((month(start + 2 * k), page, f"c{length}_{k}"))
            rows.append((month(start + 2 * k + 1), page, f"c{length}_{k + 1}"))
        for i in ids:
            want[i] = ids[-1]
    # A break of one month: no link.
    rows += [(month(0), 101, "x"), (month(2), 102, "x")]
    want |= {101: 101, 102: 102}
    # Two ids end in one.
    rows += [(month(0), 201, "y1"), (month(1), 201, "y"), (month(1), 202, "y"), (month(2), 203, "y")]
    want |= {201: 203, 202: 203, 203: 203}
    df = spark.createDataFrame([(d, p, t, 1) for d, p, t in rows], "date date, page_id bigint, page string, tot_count_views bigint")
    found = identity.succession_map(df).collect()
    assert {r.page_ids: r.last_page_id for r in found} == want
    assert len(found) == len(want)
    firsts = {r.page_ids: r.first_date for r in found}
    assert firsts[203] == month(0)


def test_flux_counts_existing_periods(spark):
    # Month 2 is absent for all pages, so month 3 follows month 1.
    rows = [(0, 1, 5), (1, 1, 5), (3, 1, 5), (0, 2, 5), (3, 2, 5), (1, 3, 5)]
    marked = overlap.mark_flux(panel(spark, rows)).collect()
    flow = {(r.date, r.page_id): (r.flow, r.leaves) for r in marked}
    assert flow == {
        (month(0), 1): (None, False), (month(1), 1): ("staying", False), (month(3), 1): ("staying", None),
        (month(0), 2): (None, True), (month(3), 2): ("incoming", None), (month(1), 3): ("incoming", True),
    }
    gone = {(r.date, r.page_id) for r in overlap.outgoing(panel(spark, rows)).collect()}
    assert gone == {(month(1), 2), (month(3), 3)}


def test_flux_by_lag_brute_force(spark):
    rnd = random.Random(5)
    rows = [(m, p, 1) for m in range(6) for p in range(40) if rnd.random() < 0.4]
    sets = {m: {p for q, p, _ in rows if q == m} for m in range(6)}
    got = {(r.period_idx, r.lag): (r.new, r.gone) for r in overlap.flux_by_lag(panel(spark, rows)).collect()}
    for t, k in itertools.product(range(1, 7), range(1, 6)):
        if t - k < 1:
            assert (t, k) not in got
            continue
        now, then = sets[t - 1], sets[t - 1 - k]
        new, gone = got[t, k]
        assert math.isclose(new, len(now - then) / len(now) * 100)
        assert math.isclose(gone, len(then - now) / len(now) * 100)


def test_run_lengths_sum_to_occurrences(spark):
    rows = [(m, 1, 1) for m in (0, 1, 2, 4, 7, 8)] + [(3, 2, 1)]
    df = panel(spark, rows).withColumn("volume", F.lit("core"))
    runs = lifetime.run_lengths(df).collect()
    assert sorted(r.lifetime for r in runs if r.page_id == 1) == [1, 2, 3]
    assert all(r.nb_occurrences == (6 if r.page_id == 1 else 1) for r in runs)
    longest = {r.page_id: r.max_lifetime for r in lifetime.longest_runs(lifetime.run_lengths(df)).collect()}
    assert longest == {1: 3, 2: 1}


def aligned(spark, first, second):
    rows = [(0, p, v) for p, v in first.items()] + [(1, p, v) for p, v in second.items()]
    return divergence.align_pairs(ranks.fractional_rank(panel(spark, rows)))


@pytest.mark.parametrize("alpha", [0, 0.3, 1.0, math.inf])
def test_divergence_of_equal_and_of_disjoint_periods(spark, alpha):
    views = {p: 100 - p for p in range(30)}
    same = divergence.divergences(aligned(spark, views, views), [alpha]).agg(F.sum("div")).first()[0]
    assert same == 0
    other = {p + 1000: v for p, v in views.items()}
    apart = divergence.divergences(aligned(spark, views, other), [alpha]).agg(F.sum("div")).first()[0]
    assert math.isclose(apart, 1.0, rel_tol=1e-9)


def test_divergence_of_unequal_disjoint_periods(spark):
    first = {p: 1000 - p for p in range(80)}
    second = {p + 1000: 500 - p for p in range(20)}
    total = divergence.divergences(aligned(spark, first, second), [0.3]).agg(F.sum("div")).first()[0]
    assert math.isclose(total, 0.885, abs_tol=5e-4)


def test_alignment_fills_absent_ranks_and_cuts_the_top(spark):
    got = {r.page_id: (r.rank_1, r.rank_2) for r in aligned(spark, {1: 9, 2: 8, 3: 7}, {1: 5, 4: 4}).collect()}
    # N1 = 3, N2 = 2, N = 1: absent ranks are 3.5 and 3.
    assert got == {1: (1.0, 1.0), 2: (2.0, 3.0), 3: (3.0, 3.0), 4: (3.5, 2.0)}
    rows = [(0, p, 10 - p) for p in range(5)] + [(1, p, 10 - p) for p in range(5)]
    top = divergence.align_pairs(ranks.fractional_rank(panel(spark, rows)), top=4)
    assert {r.page_id for r in top.collect()} == {0, 1}


def mwu(x, y):
    """U of the first sample and the asymptotic z, by comparing all pairs."""
    u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    n1, n2 = len(x), len(y)
    n = n1 + n2
    ties = sum(c**3 - c for c in (list(x + y).count(v) for v in set(x + y)))
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
    return u, z, min(1.0, math.erfc(z / math.sqrt(2)))


@pytest.mark.parametrize("seed", range(3))
def test_mann_whitney_brute_force(spark, seed):
    rnd = random.Random(seed)
    x = [rnd.randrange(20) + 0.5 for _ in range(60)]
    y = [rnd.randrange(24) + 0.5 for _ in range(45)]
    rows = [("t", 1, v) for v in x] + [("t", 2, v) for v in y] + [("t", 2, None), ("u", 1, 3.0)]
    df = spark.createDataFrame(rows, "k string, side int, v double")
    got = statistics.mann_whitney(df, "v", F.col("side") == 1, F.col("side") == 2, ["k"]).collect()
    assert [r.k for r in got] == ["t"]
    u, z, p = mwu(x, y)
    assert got[0].u1 == u and got[0].u1 + got[0].u2 == 60 * 45
    assert math.isclose(got[0].z_two_sided, z) and math.isclose(got[0].p_two_sided, p)


def test_exact_quantiles_brute_force(spark):
    rnd = random.Random(1)
    values = [rnd.gauss(0, 1) for _ in range(5000)] + [0.25] * 3000
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("c", None)], "k string, v double")
    got = {r.k: r for r in histogram.exact_quantiles(df, ["k"], "v", {"q10": 0.1, "q50": 0.5, "q99": 0.99}).collect()}
    ordered = sorted(values)
    for name, q in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99)):
        at = q * (len(ordered) - 1)
        low, part = int(at), at - int(at)
        want = ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * part
        assert math.isclose(got["a"][name], want, abs_tol=1e-12)
    assert got["b"].q50 == 1.0 and "c" not in got


def test_topic_lists(spark):
    lists = [["a*", "b*"], ["a*", "b", "c"], ["b"], [], None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i int, t array<string>")
    got = {r.i: r.s for r in df.select("i", most_specific(F.col("t")).alias("s")).collect()}
    assert got == {0: "a*", 1: "b", 2: "b", 3: None, 4: None}
    text = "[{'topic': 'Culture.Media.Films', 'score': 0.9}\n {'topic': ' STEM.STEM*', 'score': 0.6}]"
    row = spark.createDataFrame([(text,)], "t string").select(parse_topics(F.col("t")).alias("x")).first()
    assert row.x == ["culture.media.films", "stem.stem*"]
    code = spark.createDataFrame([("x",), ("y",)], "t string").select(topic_code(F.col("t"), ["x"]).alias("c"))
    assert [r.c for r in code.collect()] == [0, None]


def test_namespaces(spark):
    rows = [("en", "User:A"), ("en", "A_talk:B"), ("en", "Utilisateur:A"), ("fr", "Utilisateur:A"), ("de", "User:A")]
    df = spark.createDataFrame(rows, "project string, page string")
    kept = {tuple(r) for r in filters.drop_namespaces(df, ["en", "fr", "de"]).collect()}
    assert kept == {("en", "Utilisateur:A"), ("de", "User:A")}
    first = {tuple(r) for r in filters.drop_namespaces(df, ["fr", "en"], mode="first_match").collect()}
    assert first == {("en", "Utilisateur:A"), ("fr", "Utilisateur:A")}
    assert len(NAMESPACE_TERMS) == 15
    with pytest.raises(TypeError):
        filters.editions_and_periods(df, "en.wikipedia")


def links(spark, rows):
    df = spark.createDataFrame(rows, "prev string, curr string, type string, count bigint")
    return transitions.transition_counts(df.withColumn("date", F.lit(JAN)), ["date"])


def test_transition_matrix_without_sources_or_transitions(spark):
    labels = spark.createDataFrame([(JAN, "a", "core"), (JAN, "b", "tail")], "date date, page string, volume string")
    rows = [
        ("other-internal", "a", "external", 7), ("b", "b", "link", 3), ("other-external", "b", "external", 5),
        ("other-empty", "b", "external", 50), ("zz", "a", "link", 9), ("b", "zz", "link", 1), ("a", "b", "other", 2),
    ]
    counts = links(spark, rows)
    got = {r.curr: r for r in transitions.source_fractions(transitions.transition_matrix(counts, labels, ["date"])).collect()}
    assert got["a"].total == 0 and got["a"].frac_core is None
    assert got["b"].total == 8 and got["b"]["other-search"] == 0 and got["b"].tail == 3
    loss = transitions.label_loss(counts, labels, ["date"]).first()
    assert (loss.initial_links, loss.final_links) == (5, 3)


def test_similar_pairs_brute_force(spark):
    rnd = random.Random(2)
    sizes = {f"e{i:02d}": rnd.randrange(50, 400) for i in range(60)}
    sizes["same1"], sizes["same2"], sizes["none"] = 77, 77, 0
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "project string, n bigint")
    got = {(r.lang1, r.lang2) for r in pairs.similar_pairs(df, ["n"], 0.9).collect()}
    want = {
        (a, b) for a, b in itertools.combinations(sorted(sizes), 2)
        if sizes[a] and sizes[b] and 0 < abs(math.log(sizes[a] / sizes[b])) <= -math.log(0.9)
    }
    assert got == want


def test_pair_entries_by_tail_before(spark):
    labelled = spark.createDataFrame(
        [
            # Q1: both enter in month 1, only a came from the tail.
            ("a", "Q1", month(0), "tail"), ("a", "Q1", month(1), "core"), ("b", "Q1", month(1), "core"),
            # Q2: both from the tail. Q3: neither.
            ("a", "Q2", month(0), "tail"), ("b", "Q2", month(0), "tail"), ("a", "Q2", month(1), "core"),
            ("b", "Q2", month(1), "core"), ("a", "Q3", month(1), "core"), ("b", "Q3", month(1), "core"),
            # Q4: b was in the core before.
            ("b", "Q4", month(0), "core"), ("a", "Q4", month(1), "core"), ("b", "Q4", month(1), "core"),
        ],
        "project string, item_id string, date date, volume string",
    ).withColumn("tot_count_views", F.month("date").cast("bigint") * 10)
    matched = spark.createDataFrame([("a", "b")], "lang1 string, lang2 string")
    members = pairs.pair_members(pairs.pair_entries(labelled, matched))
    assert {r.item_id for r in members.collect()} == {"Q1", "Q2", "Q3"}
    treated = pairs.treated_pairs(members).collect()
    assert {(r.item_id, r.project, r.was_in_tail) for r in treated} == {("Q1", "a", 1), ("Q1", "b", 0)}
    views = {(r.item_id, r.project, r.views_pre_treat, r.views_post_treat) for r in pairs.pre_post_views(members).collect()}
    assert {v for v in views if v[0] == "Q1"} == {("Q1", "a", 10, 20), ("Q1", "b", 0, 20)}


def test_difference_in_differences_by_hand(spark):
    rows = [(0, 1.0, 2.0), (0, 3.0, 6.0), (1, 2.0, 9.0), (1, 4.0, 15.0)]
    df = spark.createDataFrame(rows, "was_in_tail int, views_pre_treat double, views_post_treat double")
    got = {r.term: r for r in pairs.difference_in_differences(df).collect()}
    assert {t: r.coef for t, r in got.items()} == {"intercept": 2, "post": 2, "treated": 1, "post:treated": 7}
    # Residuals are 1, 2, 1 and 3 on either side of the cell means.
    s2 = 2 * (1 + 4 + 1 + 9) / 4
    assert math.isclose(got["intercept"].std_err, math.sqrt(s2 / 2))
    assert math.isclose(got["post:treated"].std_err, math.sqrt(s2 * 2))


def test_class_weights_and_split(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0), float(i)) for i in range(1000)], "page_id bigint, is_core int, x double")
    weights = {r.is_core: r.weight for r in models.with_class_weight(df).collect()}
    assert math.isclose(weights[1], 1 / 0.2) and math.isclose(weights[0], 1 / 1.8)
    train, test = models.split(df)
    assert train.count() + test.count() == 1000 and not train.join(test, "page_id").count()
    assert 600 < train.count() < 800


def test_attach_gives_the_same_rows_with_and_without_broadcast(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 50)
    small = rows.groupBy("k").count()
    near = sorted(map(tuple, attach(rows, small, ["k"]).collect()))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, attach(rows, small, ["k"]).collect())) == near
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_ranks_leave_out_nulls_at_any_limit(spark):
    rows = [("a", month(0), 1, "p", 5), ("a", month(0), 2, "q", 3), ("a", month(0), 3, "r", None), ("a", None, 4, "s", 9), (None, month(0), 5, "t", 9)]
    df = spark.createDataFrame(rows, "project string, date date, page_id bigint, page string, tot_count_views bigint")
    for lim in (2, 1_000, 1_001, None):
        assert sorted((r.page_id, r["rank"]) for r in ranks.rank_rows(df, lim=lim).collect()) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_labels_by_weight_equal_labels_by_rank(spark, seed):
    df = panel(spark, [*random_panel(spark, seed), *[(7, p, p % 3) for p in range(60)], *[(8, p, int(p < 4)) for p in range(30)], *[(9, p, 2) for p in range(50)]])
    want = {(r.date, r.page_id): r.volume for r in hinge.label_volumes(df).collect()}
    assert {(r.date, r.page_id): r.volume for r in hinge.volume_labels(df).collect()} == want
    bounds = {r.date: r for r in hinge.core_bounds(df).collect()}
    for date in {d for d, _ in want}:
        own = [v for (d, _), v in want.items() if d == date]
        assert (bounds[date].nb_core, bounds[date].nb_pages) == (own.count("core"), len(own))
    assert set(bounds) == {d for d, _ in want}


def test_articles_are_counted_by_title_and_id(spark):
    counts = spark.createDataFrame([("a", "T1", 1, 10), ("a", "T1 redirect", 1, 2), ("a", "T2", 2, 5)], "project string, page string, page_id bigint, tot_count_views bigint")
    known = spark.createDataFrame([("a", "T1", 1), ("a", "T2", 2)], "project string, page string, page_id bigint")
    assert [tuple(r) for r in pairs.edition_totals(counts, known).collect()] == [("a", 2, 15)]


def test_a_redirect_listed_twice_is_counted_once(spark):
    df = panel(spark, [(0, 7, 11)])
    redirects = spark.createDataFrame([(7, 9), (7, 8)], "redirect bigint, target bigint")
    assert [(r.page_id, r.tot_count_views) for r in identity.remap_ids(df, redirects).collect()] == [(8, 11)]


def test_panel_store_prunes_partitions(spark, tmp_path):
    df = panel(spark, [(m, p, 1) for m in range(3) for p in range(10)])
    tables.write_panel(df, str(tmp_path / "p"))
    read = tables.read_panel(spark, str(tmp_path / "p")).where(F.col("date") == month(1))
    assert read.count() == 10


def test_forked_ids_count_views_once(spark):
    """Ids 2 and 3 both begin with the title that id 1 ends with, and end apart: the one of more views goes on."""
    rows = [(0, 1, "t", 6), (1, 2, "t", 4), (1, 3, "t", 5), (2, 2, "u", 1), (2, 3, "w", 2), (3, 4, "w", 1), (3, 5, "w", 1), (4, 5, "z", 0)]
    df = spark.createDataFrame([(month(m), p, t, w) for m, p, t, w in rows], "date date, page_id bigint, page string, tot_count_views bigint")
    found = {r.page_ids: r.last_page_id for r in identity.succession_map(df).collect()}
    assert found == {1: 4, 2: 2, 3: 4, 4: 4, 5: 5}
    once = identity.apply_identity(df, identity.succession_map(df))
    assert once.agg(F.sum("tot_count_views")).first()[0] == sum(w for *_, w in rows)
    forked = identity.succession_map(df, fork=True)
    assert {(r.page_ids, r.last_page_id) for r in forked.collect()} == {(1, 2), (1, 4), (1, 5), (2, 2), (3, 4), (3, 5), (4, 4), (5, 5)}


def test_views_survive_any_identity_map(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        rows = {(rnd.randrange(8), rnd.randrange(40)): (f"t{rnd.randrange(6)}", rnd.randrange(1, 9)) for _ in range(120)}
        df = spark.createDataFrame([(month(m), p, t, w) for (m, p), (t, w) in rows.items()], "date date, page_id bigint, page string, tot_count_views bigint")
        moved = identity.apply_identity(df, identity.succession_map(df))
        assert moved.count() == len(rows)
        assert moved.agg(F.sum("tot_count_views")).first()[0] == sum(w for _, w in rows.values())
