"""Summaries and rank tests over whole groups, without samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelytics import WEIGHT
from panelytics.functions.statistics import steady_avg, steady_error95, steady_std, upper_tail
from panelytics.operators.lifetime import quantile_name
from panelytics.plans.histogram import exact_quantiles, running_counts

QUARTILES = (0.25, 0.5, 0.75, 0.9)


def view_statistics(
    panel: DataFrame,
    by: Sequence[str] = ("date",),
    quantiles: Sequence[float] = QUARTILES,
    approximate: bool = False,
) -> DataFrame:
    """Extremes, mean, deviation, sum, count and quantiles of views per group.

    Exact quantiles run over counts of equal views, which are few (see
    ``plans.histogram``); ``approximate`` reads the rows once instead.
    """
    if approximate:
        rows, v, n = panel, F.col(WEIGHT), F.lit(1).cast("bigint")
        points = F.percentile_approx(WEIGHT, F.array(*[F.lit(float(q)) for q in quantiles]))
    else:
        rows = panel.groupBy(*by, WEIGHT).agg(F.count("*").alias("_n"))
        v, n = F.col(WEIGHT), F.col("_n")
        points = F.percentile(WEIGHT, F.array(*[F.lit(float(q)) for q in quantiles]), n)
    total = F.sum(n)
    mean = F.sum(v * n) / total
    square = F.sum(v.cast("double") * v * n)
    return rows.groupBy(*by).agg(
        F.max(v).alias("max"),
        F.min(v).alias("min"),
        mean.alias("avg"),
        F.when(total > 1, F.sqrt(F.greatest(square - total * mean * mean, F.lit(0.0)) / (total - 1))).alias("std"),
        F.sum(v * n).alias("sum"),
        total.alias("nb_pages"),
        points.alias("_q"),
    ).select(
        *by, "max", "min", "avg", "std", "sum", "nb_pages",
        *[F.get("_q", F.lit(i)).alias(quantile_name(q)) for i, q in enumerate(quantiles)],
    )


def describe_report(report: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of the columns of a report.

    A report has one row per period, so the exact quantile state is small.
    """
    long = report.unpivot(
        list(by) or [F.lit(0).alias("_all")],
        [F.col(c).cast("double").alias(c) for c in columns], "measure", "value",
    ).where("value is not null")
    return long.groupBy(*by, "measure").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.percentile("value", 0.25).alias("p25"),
        F.percentile("value", 0.5).alias("p50"),
        F.percentile("value", 0.75).alias("p75"),
        F.max("value").alias("max"),
    )


def describe_values(
    df: DataFrame, value: str, by: Sequence[str], quantiles: Sequence[float] = QUARTILES
) -> DataFrame:
    """Summary of a measured column in groups of any size, with exact quantiles.

    The mean is that of the values in millionths, summed as whole numbers and rounded half up to millionths, so it
    depends neither on the order of rows nor on the edge of a float.
    """
    names = {quantile_name(q): q for q in quantiles}
    rows = df.where(F.col(value).isNotNull()).withColumn("_micro", F.round(F.col(value) * 1_000_000).cast("bigint"))
    basics = rows.groupBy(*by).agg(
        F.count(value).alias("count"),
        (F.expr("(2 * sum(_micro) + count(_micro)) div (2 * count(_micro))") / 1_000_000).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return basics.join(exact_quantiles(df, by, value, names), list(by))


def reconcile(own: DataFrame, published: DataFrame, skip: Column | None = None) -> DataFrame:
    """Own and published totals under each other, with their source."""
    totals = own.groupBy("date").agg(F.sum(WEIGHT).alias("tot_views"))
    if skip is not None:
        totals = totals.where(~skip)
    return totals.withColumn("source", F.lit("own")).unionByName(
        published.select("date", "tot_views").withColumn("source", F.lit("published"))
    )


def coverage_ratio(own: DataFrame, published: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of own over published page counts with its 95 % error (population deviation)."""
    ratio = F.try_divide(F.col("nb_own"), F.col("nb_published"))
    both = own.join(published, [*by, "date"]).withColumn("_ratio", ratio)
    return both.groupBy(*by).agg(
        F.avg("_ratio").alias("mean_ratio"),
        (F.stddev_pop("_ratio") * 1.96 / F.sqrt(F.count("_ratio"))).alias("error"),
        F.count("_ratio").alias("nb_periods"),
    )


def mean_with_error(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean and 95 % error per group."""
    return df.groupBy(*by).agg(
        steady_avg(value).alias("avg"), steady_std(value).alias("std"), F.count(value).alias("nb"),
        steady_error95(value).alias("error"),
    )


def mann_whitney(
    df: DataFrame,
    value: str,
    first: Column,
    second: Column,
    by: Sequence[str],
    p_values: bool = True,
) -> DataFrame:
    """Mann-Whitney U of two sides of every group, over all rows.

    Ties get their mean rank by way of the value histogram, so neither side is
    ever sorted or collected. ``u1`` counts pairs in which the first side is
    greater; the z scores carry the tie and continuity corrections of the
    usual asymptotic test.
    """
    hist = (
        df.where(F.col(value).isNotNull() & (first | second))
        .groupBy(*by, value)
        .agg(F.count_if(first).alias("_n1"), F.count_if(second).alias("_n2"))
        .withColumn("n", F.col("_n1") + F.col("_n2"))
    )
    ranked = running_counts(hist, by, value, ["n"])
    n = F.col("n").cast("double")
    middle = F.col("n_below") + (n + 1) / 2
    sums = ranked.groupBy(*by).agg(
        F.sum("_n1").alias("n1"),
        F.sum("_n2").alias("n2"),
        F.sum(F.col("_n1") * middle).alias("_r1"),
        F.sum(n * n * n - n).alias("_ties"),
    ).where("n1 > 0 and n2 > 0")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    both = n1 + n2
    u = sums.withColumn("u1", F.col("_r1") - n1 * (n1 + 1) / 2).withColumn("u2", n1 * n2 - F.col("u1"))
    sd = F.sqrt(n1 * n2 / 12 * ((both + 1) - F.try_divide(F.col("_ties"), both * (both - 1))))
    centre = n1 * n2 / 2
    tested = u.withColumn("_sd", sd).select(
        *by, "n1", "n2", "u1", "u2",
        F.try_divide(F.col("u1") - centre - 0.5, F.col("_sd")).alias("z_greater"),
        F.try_divide(F.col("u2") - centre - 0.5, F.col("_sd")).alias("z_less"),
        F.try_divide(F.greatest("u1", "u2") - centre - 0.5, F.col("_sd")).alias("z_two_sided"),
    )
    if not p_values:
        return tested
    return tested.select(
        "*",
        upper_tail("z_greater").alias("p_greater"),
        upper_tail("z_less").alias("p_less"),
        F.least(2 * upper_tail("z_two_sided"), F.lit(1.0)).alias("p_two_sided"),
    )
