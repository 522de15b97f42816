"""Queries for the core / tail split (hinge method)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelytics.catalog.registry import curve_sql, labels_sql, query
from panelytics.operators import hinge, ranks
from panelytics.plans.joins import few
from panelytics.plans.views import Tables

CURVE = curve_sql("v_panel")
R = 6  # decimals of reported shares


@query(
    "core_sizes",
    f"""WITH {CURVE}
    SELECT project, date, COUNT(*) AS nb_pages, CAST(COUNT_IF(volume = 'core') AS BIGINT) AS nb_core,
           round(hinge_perc, 6) AS hinge_perc, round(hinge_rank, 6) AS hinge_rank
    FROM vol GROUP BY project, date, hinge_perc, hinge_rank""",
)
def core_sizes(t: Tables):
    return hinge.core_bounds(t.view("v_panel")).select(
        "project", "date", "nb_pages", "nb_core",
        F.round("hinge_perc", R).alias("hinge_perc"), F.round("hinge_rank", R).alias("hinge_rank"),
    )


@query(
    "h1_cumulative_curve",
    f"""WITH {CURVE} SELECT project, date, page_id, tot_count_views, rank, cum_views,
    round(perc_views, 6) AS perc_views, round(perc_rank, 6) AS perc_rank FROM pc""",
)
def h1(t: Tables):
    return hinge.cumulative_curve(t.view("v_panel")).select(
        "project", "date", "page_id", "tot_count_views", "rank", "cum_views",
        F.round("perc_views", R).alias("perc_views"),
        F.round("perc_rank", R).alias("perc_rank"),
    )


@query(
    "h1_sampled_curve",
    """WITH rk AS (SELECT *, row_number() OVER (PARTITION BY project, date ORDER BY tot_count_views DESC, page_id) AS rank FROM v_panel),
    st AS (SELECT CAST(unnest([1, 5, 50]) AS BIGINT) AS sampling), sm AS (SELECT rk.*, sampling FROM rk JOIN st ON rank % sampling = 0 OR rank = 1),
    cv AS (SELECT *, CAST(SUM(tot_count_views) OVER (PARTITION BY project, date, sampling ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_views,
        CAST(SUM(tot_count_views) OVER (PARTITION BY project, date, sampling) AS BIGINT) AS tot,
        COUNT(*) OVER (PARTITION BY project, date, sampling) AS nb FROM sm)
    SELECT project, date, page_id, sampling, rank, cum_views, round(cum_views / tot * 100, 6) AS perc_views,
      round(rank / (nb * sampling) * 100, 6) AS perc_rank FROM cv""",
)
def h1_sampled(t: Tables):
    return hinge.sampled_curve(t.view("v_panel"), [1, 5, 50]).select(
        "project", "date", "page_id", "sampling", "rank", "cum_views",
        F.round("perc_views", R).alias("perc_views"), F.round("perc_rank", R).alias("perc_rank"),
    )


@query(
    "h2_central_difference",
    f"""WITH {CURVE} SELECT project, date, page_id, rank, round(d_perc_views, 6) AS d_perc_views,
    round(d_cum_views, 6) AS d_cum_views
    FROM (SELECT *, (lead(cum_views) OVER (PARTITION BY project, date ORDER BY rank)
        - lag(cum_views) OVER (PARTITION BY project, date ORDER BY rank)) / 2 AS d_cum_views FROM gr)
    WHERE d_perc_views IS NOT NULL""",
)
def h2(t: Tables):
    curve = hinge.cumulative_curve(t.view("v_panel"))
    return hinge.central_difference(curve, "cum_views").select(
        "project", "date", "page_id", "rank",
        F.round("d_perc_views", R).alias("d_perc_views"),
        F.round("d_cum_views", R).alias("d_cum_views"),
    )


@query(
    "h3_hinge_point",
    f"""WITH {CURVE} SELECT project, date, round(hinge_perc, 6) AS hinge_perc,
    round(hinge_rank, 6) AS hinge_rank FROM hg""",
)
def h3(t: Tables):
    points = hinge.hinge_points(t.view("v_panel"))
    return points.select(
        "project", "date", F.round("hinge_perc", R).alias("hinge_perc"), F.round("hinge_rank", R).alias("hinge_rank")
    )


LABELS = labels_sql("v_panel", "page_id, page, tot_count_views")


@query(
    "h4_core_extraction",
    f"WITH {LABELS} SELECT project, date, page_id, page, tot_count_views, rank FROM lb WHERE volume = 'core'",
)
def h4(t: Tables):
    return hinge.core(t.view("v_panel")).select("project", "date", "page_id", "page", "tot_count_views", "rank")


@query(
    "h5_tail_extraction",
    f"WITH {LABELS} SELECT project, date, page_id, page, tot_count_views, rank FROM lb WHERE volume = 'tail'",
)
def h5(t: Tables):
    return hinge.tail(t.view("v_panel")).select("project", "date", "page_id", "page", "tot_count_views", "rank")


DAILY = curve_sql("v_daily")


@query(
    "h6_volume_labels",
    f"WITH {DAILY} SELECT project, date, page_id, volume FROM vol",
)
def h6(t: Tables):
    return hinge.volume_labels(t.view("v_daily")).select("project", "date", "page_id", "volume")


@query(
    "h7_hinge_summary",
    f"""WITH {CURVE}, s AS (SELECT project, date, COUNT(*) AS nb_pages FROM v_panel GROUP BY 1, 2)
    SELECT project, COUNT(*) AS nb, round(avg(hinge_perc), 6) AS avg_views, round(stddev_samp(hinge_perc), 6) AS std_views,
      round(avg(hinge_rank), 6) AS avg_rank, round(stddev_samp(hinge_rank), 6) AS std_rank,
      round(avg(hinge_rank * nb_pages / 100), 6) AS avg_core_pages,
      round(avg((100 - hinge_rank) * nb_pages / 100), 6) AS avg_tail_pages
    FROM hg JOIN s USING (project, date) GROUP BY project""",
)
def h7(t: Tables):
    points = few(hinge.core_bounds(t.view("v_panel")))
    sizes = hinge.volume_sizes(points)
    summary = hinge.hinge_summary(points, ["project"]).join(
        sizes.groupBy("project").agg(
            F.avg("core_pages").alias("avg_core_pages"), F.avg("tail_pages").alias("avg_tail_pages")
        ),
        "project",
    )
    rounded = ["avg_views", "std_views", "avg_rank", "std_rank", "avg_core_pages", "avg_tail_pages"]
    return summary.select("project", "nb", *[F.round(c, R).alias(c) for c in rounded])


@query(
    "h8_mean_curve",
    f"""WITH {CURVE} SELECT project, perc_rank, round(avg(perc_views), 6) AS perc_views,
      round(stddev_samp(perc_views) * 1.96 / sqrt(COUNT(*)), 6) AS error_views, COUNT(*) AS nb_points
    FROM (SELECT project, round(perc_rank, 1) AS perc_rank, perc_views FROM pc WHERE rank % 50 = 0)
    GROUP BY project, perc_rank""",
)
def h8(t: Tables):
    mean = hinge.mean_curve(hinge.cumulative_curve(t.view("v_panel")), 50, ["project"], digits=1)
    return mean.select(
        "project", "perc_rank", F.round("perc_views", R).alias("perc_views"),
        F.round("error_views", R).alias("error_views"), "nb_points",
    )


STEPS = [1, 5, 50, 100, 300, 700, 1000]


@query(
    "h9_sampling_sensitivity",
    """WITH rk AS (SELECT *, row_number() OVER (PARTITION BY project, date ORDER BY tot_count_views DESC, page_id) AS rank FROM v_panel),
    st AS (SELECT CAST(unnest([1, 5, 50, 100, 300, 700, 1000]) AS BIGINT) AS sampling),
    sm AS (SELECT rk.*, sampling FROM rk JOIN st ON rank % sampling = 0 OR rank = 1),
    cv AS (SELECT *, CAST(SUM(tot_count_views) OVER (PARTITION BY project, date, sampling ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_views,
        CAST(SUM(tot_count_views) OVER (PARTITION BY project, date, sampling) AS BIGINT) AS tot_views,
        COUNT(*) OVER (PARTITION BY project, date, sampling) AS nb_pages FROM sm),
    pc AS (SELECT *, cum_views / tot_views * 100 AS perc_views, rank / (nb_pages * sampling) * 100 AS perc_rank FROM cv),
    gr AS (SELECT *, (lead(perc_views) OVER (PARTITION BY project, date, sampling ORDER BY rank)
        - lag(perc_views) OVER (PARTITION BY project, date, sampling ORDER BY rank)) / 2 AS d FROM pc),
    hg AS (SELECT project, date, sampling, arg_min(perc_views, rank) AS hinge_perc, arg_min(perc_rank, rank) AS hinge_rank
        FROM gr WHERE d <= CAST(100 AS DOUBLE) / nb_pages GROUP BY 1, 2, 3)
    SELECT project, sampling, COUNT(*) AS nb, round(avg(hinge_perc), 6) AS avg_views, round(stddev_samp(hinge_perc), 6) AS std_views,
      round(avg(hinge_rank), 6) AS avg_rank, round(stddev_samp(hinge_rank), 6) AS std_rank FROM hg GROUP BY project, sampling""",
)
def h9(t: Tables):
    summary = hinge.hinge_summary(hinge.hinge_by_sampling(t.view("v_panel"), STEPS), ["project", "sampling"])
    return summary.select(
        "project", "sampling", "nb",
        *[F.round(c, R).alias(c) for c in ("avg_views", "std_views", "avg_rank", "std_rank")],
    )


EPS = [1, 0.5, 0.1, 0.05, 0.01, 0.001]


@query(
    "h10_slope_sensitivity",
    f"""WITH {CURVE}, es AS (SELECT CAST(unnest([1, 0.5, 0.1, 0.05, 0.01, 0.001]) AS DOUBLE) AS eps),
    he AS (SELECT project, date, eps, arg_min(perc_views, rank) AS hinge_perc, arg_min(perc_rank, rank) AS hinge_rank
        FROM gr JOIN es ON d_perc_views <= 100 * eps / nb_pages GROUP BY 1, 2, 3)
    SELECT project, eps, COUNT(*) AS nb, round(avg(hinge_perc), 6) AS avg_views, round(stddev_samp(hinge_perc), 6) AS std_views,
      round(avg(hinge_rank), 6) AS avg_rank, round(stddev_samp(hinge_rank), 6) AS std_rank FROM he GROUP BY project, eps""",
)
def h10(t: Tables):
    summary = hinge.hinge_summary(hinge.hinge_by_slope(t.view("v_panel"), EPS), ["project", "eps"])
    return summary.select(
        "project", "eps", "nb",
        *[F.round(c, R).alias(c) for c in ("avg_views", "std_views", "avg_rank", "std_rank")],
    )


TOPS = [20, 50, 90]


@query(
    "h11_common_maximisation",
    """WITH rk AS (SELECT *, row_number() OVER (PARTITION BY project, date ORDER BY tot_count_views DESC, page_id) AS rank FROM v_supply),
    ns AS (SELECT CAST(unnest([20, 50, 90]) AS BIGINT) AS top_n),
    np AS (SELECT COUNT(DISTINCT date) AS nb_periods FROM v_supply),
    sd AS (SELECT project, date, page_id, top_n, 'core' AS volume FROM rk JOIN ns ON rank <= top_n
           UNION ALL SELECT project, date, page_id, top_n, 'tail' FROM rk JOIN ns ON rank >= top_n),
    pg AS (SELECT project, top_n, volume, page_id, COUNT(*) AS c FROM sd GROUP BY ALL),
    cm AS (SELECT project, top_n, volume, CAST(COUNT_IF(c = nb_periods) AS BIGINT) AS nb_common FROM pg, np GROUP BY ALL),
    pm AS (SELECT project, date, top_n, volume, COUNT(*) AS nb FROM sd GROUP BY ALL)
    SELECT project, top_n, volume, MAX(nb_common) AS nb_common, round(avg(nb_common / nb * 100), 6) AS avg_share,
      round(stddev_samp(nb_common / nb * 100), 6) AS std_share
    FROM pm JOIN cm USING (project, top_n, volume) GROUP BY ALL""",
)
def h11(t: Tables):
    share = hinge.common_share(ranks.rank_rows(t.view("v_supply")), TOPS)
    return share.select(
        "project", "top_n", "volume", "nb_common",
        F.round("avg_share", R).alias("avg_share"), F.round("std_share", R).alias("std_share"),
    )


@query(
    "h12_boundary_views",
    f"""WITH {CURVE} SELECT project, date, MIN(CASE WHEN volume = 'core' THEN tot_count_views END) AS min_core_views,
      MAX(CASE WHEN volume = 'tail' THEN tot_count_views END) AS max_tail_views,
      CAST(COUNT_IF(volume = 'tail') AS BIGINT) AS nb_tail_pages FROM vol GROUP BY 1, 2""",
)
def h12(t: Tables):
    return hinge.boundary_views(hinge.core_bounds(t.view("v_panel")))
