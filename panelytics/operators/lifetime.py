"""How long and how often entities are present."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelytics import WEIGHT
from panelytics.functions.statistics import error95
from panelytics.operators.overlap import with_share
from panelytics.plans import bitmaps
from panelytics.plans.calendar import month_number, months_apart, stored_periods, with_period_idx
from panelytics.session import stage

ENTITY = ("project", "volume", "page_id")
VOLUME = ("project", "volume")


def with_baseline(labelled: DataFrame, name: str = "all") -> DataFrame:
    """Every row under its volume and under the whole panel."""
    return labelled.withColumn("volume", F.explode(F.array(F.col("volume"), F.lit(name))))


def month_offsets(panel: DataFrame, anchor: dt.date) -> DataFrame:
    """Adds ``months_before``: whole months from each period to the anchor."""
    return panel.withColumn("months_before", months_apart(F.lit(anchor), F.col("date")))


def with_occurrences(
    panel: DataFrame, entity: Sequence[str] = ENTITY, name: str = "nb_months_in"
) -> DataFrame:
    """Adds the number of periods each entity is in; the window holds one entity."""
    return panel.withColumn(name, F.count("*").over(Window.partitionBy(*entity)))


def common_unique_shares(
    labelled: DataFrame, group: Sequence[str] = VOLUME, nb_periods: int | None = None, source: DataFrame | None = None
) -> DataFrame:
    """Per period: share of entities present in all periods, in one, and the rest.

    Entities are counted by their set of periods; the shares are sums by bit position over the sets of each kind.
    """
    periods, last = stored_periods(labelled if source is None else source, ["project"])
    rows = with_period_idx(labelled, ["project"], periods=periods)
    own = list(dict.fromkeys(["project", *group]))
    words = bitmaps.words_for(last)
    sets = bitmaps.presence_bits(rows, [*own, "nb_periods", "page_id"], F.col("period_idx"), words)
    every = F.col("nb_periods") if nb_periods is None else F.lit(nb_periods)
    held = bitmaps.size("bits", words)
    kinds = F.array_compact(F.array(F.lit("all"), F.when(held == every, "common"), F.when(held == 1, "unique")))
    patterns = stage(bitmaps.patterns(sets, [*own, "nb_periods"]), "patterns")
    counts = bitmaps.counts_by_period(patterns.withColumn("kind", F.explode(kinds)), [*own, "kind"])
    nb = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("nb"))), F.lit(0)) for k in ("all", "common", "unique")}
    shares = counts.join(periods.select("project", "date", "period_idx"), ["project", "period_idx"]).groupBy(*group, "date").agg(
        (nb["common"] / nb["all"]).alias("perc_common"), (nb["unique"] / nb["all"]).alias("perc_unique"), nb["all"].alias("tot_pages")
    )
    return shares.withColumn("perc_left", 1 - F.col("perc_common") - F.col("perc_unique"))


def month_sets(panel: DataFrame, entity: Sequence[str], step: Column | None = None) -> tuple[DataFrame, int]:
    """(entity, bits): the steps (default: calendar months) of each entity, counted from the first one of the panel; and the longs of a set."""
    steps = panel.select(*entity, (month_number("date") if step is None else step).alias("_t"))
    first, last = steps.agg(F.min("_t"), F.max("_t")).first()
    first, last = first or 0, last or 0
    words = bitmaps.words_for(last - first)
    return bitmaps.presence_bits(steps, entity, F.col("_t") - F.lit(first), words), words


def run_lengths(
    panel: DataFrame, entity: Sequence[str] = ENTITY, step: Column | None = None
) -> DataFrame:
    """One row per run of consecutive months of an entity.

    ``step`` numbers the periods (default: calendar months). One shuffle by entity makes its set of months, whose runs are
    read off. Months that repeat count once, rows without a month not at all.
    """
    sets, words = month_sets(panel, entity, step)
    sets = sets.withColumns({"_runs": bitmaps.run_lengths("bits", words), "nb_occurrences": bitmaps.size("bits", words)})
    number = F.size("_runs").cast("bigint").alias("consecutive_occurrences")
    runs = sets.select(*entity, "nb_occurrences", number, F.posexplode("_runs").alias("_k", "lifetime"))
    return runs.select(*entity, (F.col("_k") + 1).alias("run"), "lifetime", "nb_occurrences", "consecutive_occurrences")


def longest_runs(runs: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """One row per entity: longest run, number of runs, periods present."""
    return runs.groupBy(*entity).agg(
        F.max("lifetime").alias("max_lifetime"),
        F.count("*").alias("consecutive_occurrences"),
        F.sum("lifetime").alias("nb_occurrences"),
    )


def run_profile(
    panel: DataFrame, entity: Sequence[str] = ENTITY, group: Sequence[str] = VOLUME, step: Column | None = None
) -> DataFrame:
    """``longest_runs`` of the entities of each group, counted: (group, the three measures, n).

    Runs are looked up once for a set of months, however many entities have it.
    """
    sets, words = month_sets(panel, entity, step)
    patterns = bitmaps.patterns(sets, group).withColumn("_runs", bitmaps.run_lengths("bits", words))
    return patterns.where(F.size("_runs") > 0).select(
        *group,
        F.array_max("_runs").alias("max_lifetime"),
        F.size("_runs").cast("bigint").alias("consecutive_occurrences"),
        bitmaps.size("bits", words).alias("nb_occurrences"),
        "n",
    )


def distribution(rows: DataFrame, value: str, group: Sequence[str] = VOLUME, n: str | None = None) -> DataFrame:
    """Entities and percentage per value of a small domain; a row stands for ``n`` entities, if given."""
    counts = rows.groupBy(*group, value).agg((F.count("*") if n is None else F.sum(n)).alias("nb_pages"))
    return with_share(counts, group, name="frac_pages")


def describe(
    rows: DataFrame, value: str, group: Sequence[str] = VOLUME, quantiles: Sequence[float] = (0.25, 0.5, 0.75, 0.9),
    weight: str | None = None,
) -> DataFrame:
    """Count, mean, deviation, extremes and exact quantiles of whole numbers.

    Values are counted first (a row counts ``weight`` times, if given), so the quantile state is as small as the number
    of distinct values (periods, months). Unbounded values take
    ``histogram.exact_quantiles``.
    """
    each = F.count("*") if weight is None else F.sum(weight)
    hist = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(each.alias("_n"))
    v, n = F.col(value).cast("double"), F.col("_n")
    total = F.sum(n)
    mean = F.sum(v * n) / total
    spread = F.sum(v * v * n) - total * mean * mean
    points = F.percentile(value, F.array(*[F.lit(float(q)) for q in quantiles]), n)
    return hist.groupBy(*group).agg(
        total.alias("count"),
        mean.alias("mean"),
        F.when(total > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (total - 1))).alias("stddev"),
        F.min(value).alias("min"),
        points.alias("_q"),
        F.max(value).alias("max"),
    ).select(
        *group, "count", "mean", "stddev", "min",
        *[F.get("_q", F.lit(i)).alias(quantile_name(q)) for i, q in enumerate(quantiles)],
        "max",
    )


def quantile_name(q: float) -> str:
    return f"p{round(q * 1000) / 10:g}".replace(".", "_")


def with_stability(
    labelled: DataFrame, group: Sequence[str] = VOLUME, nb_periods: int | None = None, source: DataFrame | None = None
) -> DataFrame:
    """Adds ``stable``: the entity is in its group in every period."""
    rows = with_occurrences(labelled, [*group, "page_id"], "nb_occ")
    if nb_periods is None:
        rows = with_period_idx(rows, ["project"], labelled if source is None else source)
        every = F.col("nb_periods")
    else:
        every = F.lit(nb_periods)
    return rows.withColumn("stable", F.col("nb_occ") == every)


def stable_views(
    labelled: DataFrame, group: Sequence[str] = VOLUME, nb_periods: int | None = None, source: DataFrame | None = None
) -> DataFrame:
    """Mean views of entities that are always present and of the others, per period."""
    return with_stability(labelled, group, nb_periods, source).groupBy(*group, "stable", "date").agg(
        F.avg(WEIGHT).alias("avg_views"), error95(WEIGHT).alias("error"), F.count("*").alias("nb_pages")
    )
