"""Transition counts between entities, by the volume of source and target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelytics import PANEL_KEYS
from panelytics.functions.statistics import steady_avg, steady_error95
from panelytics.sources.tables import PSEUDO_PAGES

# Sources that are left out, and the columns of the matrix.
UNUSED_SOURCES = ["other-other", "other-empty"]
SOURCE_VOLUMES = ["core", "tail", "other-external", "other-search"]


def transition_counts(links: DataFrame, by: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """Counts per source and target, without unused types and sources."""
    kept = links.where((F.col("type") != "other") & ~F.col("prev").isin(UNUSED_SOURCES))
    return kept.groupBy(*by, "prev", "curr").agg(F.sum("count").alias("count"))


def source_volumes(counts: DataFrame, labels: DataFrame, by: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """Adds ``volume_prev``; NULL where the source is unknown.

    The pseudo-sources send a large share of all transitions. They are their
    own label, so they never enter the join: only real pages are shuffled by
    source.
    """
    pseudo = F.col("prev").isin(list(PSEUDO_PAGES))
    named = labels.select(*by, F.col("page").alias("prev"), F.col("volume").alias("volume_prev"))
    pages = counts.where(~pseudo).join(named, [*by, "prev"], "left")
    return pages.unionByName(counts.where(pseudo).withColumn("volume_prev", F.col("prev")))


def labelled_transitions(counts: DataFrame, labels: DataFrame, by: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """Transitions whose two ends are known, with both volumes."""
    sources = source_volumes(counts, labels, by).where("volume_prev is not null")
    named = labels.select(*by, F.col("page").alias("curr"), F.col("volume").alias("volume_curr"))
    return sources.join(named, [*by, "curr"])


def label_loss(counts: DataFrame, labels: DataFrame, by: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """Transitions before and after the label joins, and the percentage lost.

    Links are counted by target before the target's label is joined, so a hot target is one row then.
    """
    sources = source_volumes(counts, labels, by)
    targets = sources.groupBy(*by, "curr").agg(F.count("*").alias("_n"), F.count("volume_prev").alias("_known"))
    named = labels.select(*by, F.col("page").alias("curr"), F.col("volume").alias("volume_curr"))
    both = targets.join(named, [*by, "curr"], "left")
    final = F.sum(F.when(F.col("volume_curr").isNotNull(), F.col("_known")).otherwise(0))
    return both.groupBy(*by).agg(
        F.sum("_n").alias("initial_links"), final.alias("final_links"),
        (100 - final / F.sum("_n") * 100).alias("loss"),
    )


def transition_matrix(counts: DataFrame, labels: DataFrame, by: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """Per target: transitions by volume of the source, with totals.

    Sources are summed by volume *before* the target's label is joined, so a
    target that receives a large share of all transitions is one row then.
    """
    sources = source_volumes(counts, labels, by).where("volume_prev is not null")
    sums = [
        F.coalesce(F.sum(F.when(F.col("volume_prev") == v, F.col("count"))), F.lit(0)).alias(v)
        for v in SOURCE_VOLUMES
    ]
    wide = sources.groupBy(*by, "curr").agg(*sums)
    named = labels.select(*by, F.col("page").alias("curr"), F.col("volume").alias("volume_curr"))
    external = F.col("other-external") + F.col("other-search")
    return wide.join(named, [*by, "curr"]).select(
        *by, "curr", "volume_curr", *[F.col(f"`{v}`") for v in SOURCE_VOLUMES],
        external.alias("total-external"),
        (external + F.col("core") + F.col("tail")).alias("total"),
    )


def source_fractions(matrix: DataFrame) -> DataFrame:
    """Percentages of core, tail and external sources; NULL without transitions."""
    def share(name: str) -> Column:
        return F.try_divide(F.col(f"`{name}`"), F.col("total")) * 100

    return matrix.select(
        "*", share("core").alias("frac_core"), share("total-external").alias("frac_external"),
        share("tail").alias("frac_tail"),
    )


def fraction_means(fractions: DataFrame, value: str, by: Sequence[str] = (*PANEL_KEYS, "volume_curr")) -> DataFrame:
    """Mean fraction with 95 % error and rows per period and volume."""
    return fractions.groupBy(*by).agg(
        steady_avg(value).alias("avg"), steady_error95(value, F.count("*")).alias("error"), F.count("*").alias("nb")
    )


def fraction_medians(
    fractions: DataFrame, value: str, by: Sequence[str] = (*PANEL_KEYS, "volume_curr"), approximate: bool = False
) -> DataFrame:
    """Median fraction per period and volume, exact or by sketch."""
    if approximate:
        return fractions.groupBy(*by).agg(F.percentile_approx(value, 0.5).alias("median"))
    from panelytics.plans.histogram import exact_quantiles

    return exact_quantiles(fractions, by, value, {"median": 0.5})
