"""Ranks, bins and top-N (weights descending, ties by id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelytics import PANEL_KEYS, WEIGHT
from panelytics.plans import histogram
from panelytics.plans.calendar import period_table
from panelytics.plans.joins import attach


def rank_rows(
    panel: DataFrame,
    by: Sequence[str] = PANEL_KEYS,
    weight: str = WEIGHT,
    tie: Sequence[str] = ("page_id",),
    lim: int | None = None,
) -> DataFrame:
    """Ordinal rank in each group; with ``lim`` only the first ranks.

    One way for every limit: rows without a group or a weight have no rank and are left out, and no
    group, however hot, is sorted in one task (see ``histogram.curve``).
    """
    return histogram.curve(panel, by, weight, tie, lim).select(*panel.columns, "rank")


def fractional_rank(
    panel: DataFrame, by: Sequence[str] = PANEL_KEYS, weight: str = WEIGHT
) -> DataFrame:
    """Mean ordinal rank over equal weights."""
    return histogram.fractional_ranks(panel, by, weight)


def rank_range(rank: Column, lim: int, slicing: int) -> Column:
    """Bin of a rank with edges 0, s, 2s, .., lim; the last bin is closed."""
    bins = -(-lim // slicing)
    return F.least(F.floor(rank / F.lit(slicing)), F.lit(bins - 1)).cast("bigint")


def rank_decade(rank: Column) -> Column:
    """Bin of a rank between powers of ten (counted by digits, not by log)."""
    return (F.length(rank.cast("string")) - 1).cast("bigint")


def rank_bins(
    panel: DataFrame,
    lim: int = 100_000,
    slicing: int = 5_000,
    by: Sequence[str] = PANEL_KEYS,
    log: bool = False,
    tie: Sequence[str] = ("page_id",),
) -> DataFrame:
    """Top ``lim`` of each group with a ``rank_range``."""
    top = rank_rows(panel, by, tie=tie, lim=lim)
    spot = rank_decade(F.col("rank")) if log else rank_range(F.col("rank"), lim, slicing)
    return top.withColumn("rank_range", spot)


def view_bins(
    panel: DataFrame,
    lim: int = 100_000,
    nb_bins: int = 3,
    min_views: int = 5_000,
    max_views: int = 10_000_000,
    by: Sequence[str] = PANEL_KEYS,
    tie: Sequence[str] = ("page_id",),
) -> DataFrame:
    """Top ``lim`` of each group binned by weight; the last bin is open.

    A weight below ``min_views`` is an error, as it lies outside every bin.
    """
    step = int((max_views - min_views) / nb_bins)
    edges = len(range(min_views, max_views, step))
    weight = F.col(WEIGHT)
    spot = F.least(F.floor((weight - min_views) / F.lit(step)), F.lit(edges - 1)).cast("bigint")
    low = F.raise_error(F.concat(F.lit("weight below the first bin: "), weight.cast("string")))
    return rank_rows(panel, by, tie=tie, lim=lim).withColumn(
        "freq_bins", F.when(weight < min_views, low.cast("bigint")).otherwise(spot)
    )


def period_bins(
    panel: DataFrame, nb_bins: int, keys: Sequence[str] = (), source: DataFrame | None = None
) -> DataFrame:
    """Adds ``date_range``: runs of ``nb_periods // nb_bins`` periods.

    Edges are every step-th period and the last one; the last bin is closed.
    An edge that would be repeated is left out.
    """
    source = panel if source is None else source
    step = F.greatest(F.floor(F.col("nb_periods") / nb_bins), F.lit(1))
    last = F.greatest(F.ceil((F.col("nb_periods") - 1) / step) - 1, F.lit(0))
    bins = period_table(source, keys).select(
        *keys,
        "date",
        F.least(F.floor((F.col("period_idx") - 1) / step), last).cast("bigint").alias("date_range"),
    )
    return attach(panel, bins, [*keys, "date"])


def period_rank_bins(
    panel: DataFrame,
    lim: int = 100_000,
    slicing: int = 5_000,
    nb_bin_dates: int = 3,
    keys: Sequence[str] = ("project",),
    tie: Sequence[str] = ("page_id", "date"),
) -> DataFrame:
    """Ranks and rank bins over the page-periods of each run of periods."""
    return rank_bins(
        period_bins(panel, nb_bin_dates, keys), lim, slicing, by=(*keys, "date_range"), tie=tie
    )


def zipf_profile(ranked: DataFrame, ranks: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Mean weight over periods at chosen ranks, with two power laws to compare."""
    points = ranked.where(F.col("rank").isin([int(r) for r in ranks]))
    r = F.col("rank").cast("double")
    return points.groupBy(*keys, "rank").agg(
        F.avg(WEIGHT).alias("avg_views"),
        F.stddev_samp(WEIGHT).alias("std_views"),
        F.count("*").alias("nb_periods"),
    ).select(
        *keys,
        "rank",
        "avg_views",
        "std_views",
        (F.col("std_views") * 1.96 / F.sqrt("nb_periods")).alias("error"),
        (F.lit(1.5e7) * F.pow(r, F.lit(-1 / 2))).alias("law_half"),
        (F.lit(1.5e7) * F.pow(r, F.lit(-2 / 3))).alias("law_two_thirds"),
    )
