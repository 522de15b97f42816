"""Ages and creation cohorts of entities."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelytics import WEIGHT
from panelytics.operators import lifetime
from panelytics.operators.filters import exact_sample
from panelytics.operators.overlap import with_share
from panelytics.operators.statistics import mann_whitney
from panelytics.plans.calendar import with_period_idx
from panelytics.plans.joins import attach

EDITION = ("project",)


def with_age(panel: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows of known entities with ``creation_date`` and ``age_in_months``."""
    return panel.join(meta.select("page_id", "creation_date"), "page_id").withColumn(
        "age_in_months", F.months_between("date", "creation_date")
    )


def drop_bad_creation(aged: DataFrame, keys: Sequence[str] = EDITION) -> DataFrame:
    """Without entities that were ever seen before their creation."""
    life = Window.partitionBy(*keys, "page_id")
    return aged.withColumn("_youngest", F.min("age_in_months").over(life)).where("_youngest >= 0").drop("_youngest")


def creation_histogram(
    rows: DataFrame, by: Sequence[str] = (*EDITION, "date"), created: str = "creation_date"
) -> DataFrame:
    """Entities and percentage per creation month within each group."""
    counts = rows.groupBy(*by, created).agg(F.count("*").alias("nb_pages"))
    return with_share(counts, by)


def creation_quantiles(
    aged: DataFrame,
    quantiles: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9),
    by: Sequence[str] = (*EDITION, "date"),
    approximate: bool = False,
) -> DataFrame:
    """Creation months at the quantiles of age, per period.

    Ages are whole months, so the exact state is one counter per month.
    """
    aggs = []
    for q in quantiles:
        name = lifetime.quantile_name(q)
        if approximate:
            aggs.append(F.percentile_approx("age_in_months", float(q)).alias(name))
        else:
            text = f"percentile_disc({float(q)}) within group (order by age_in_months)"
            aggs.append(F.expr(text).alias(name))
    ages = aged.groupBy(*by).agg(*aggs)
    return ages.select(
        *by,
        *[
            F.add_months("date", -F.col(lifetime.quantile_name(q)).cast("int")).alias(lifetime.quantile_name(q))
            for q in quantiles
        ],
    )


def newborn_flux(
    flux: DataFrame, panel: DataFrame, meta: DataFrame, keys: Sequence[str] = EDITION
) -> DataFrame:
    """Newborns in the incoming flux: share of the flux, and of all newborns."""
    group = [*keys, "date"]
    born = F.col("date") == F.col("creation_date")
    made = meta.select("page_id", "creation_date")
    came = flux.join(made, "page_id").groupBy(*group).agg(
        F.count("*").alias("nb_flux"), F.count_if(born).alias("nb_newborn")
    )
    everywhere = panel.join(made, "page_id").where(born).groupBy(*group).agg(F.count("*").alias("nb_newborn_all"))
    return came.join(everywhere, group).select(
        *group, "nb_flux", "nb_newborn", "nb_newborn_all",
        (F.col("nb_newborn") / F.col("nb_flux") * 100).alias("perc_flux"),
        (F.col("nb_newborn") / F.col("nb_newborn_all") * 100).alias("perc_core"),
    )


def newborn_volumes(
    flux: DataFrame, tail: DataFrame, meta: DataFrame, months: int = 0, keys: Sequence[str] = EDITION
) -> DataFrame:
    """Of entities created ``months`` ago: those that come into the core, against the tail.

    ``flux`` is the incoming core flux with ages and without bad creations.
    """
    group = [*keys, "date"]
    due = F.col("date") == F.add_months("creation_date", months)
    core_side = flux.where(due).groupBy(*group).agg(F.count("*").alias("nb_core"))
    tail_side = tail.join(meta.select("page_id", "creation_date"), "page_id").where(due).groupBy(*group).agg(
        F.count("*").alias("nb_tail")
    )
    return core_side.join(tail_side, group).withColumn(
        "perc", F.col("nb_core") / (F.col("nb_core") + F.col("nb_tail")) * 100
    )


def old_flux_tests(
    flux: DataFrame,
    created_by: dt.date,
    lag: int = 1,
    level: float = 0.05,
    keys: Sequence[str] = EDITION,
    source: DataFrame | None = None,
    equal: int | None = None,
) -> DataFrame:
    """Are the ages of old incoming entities alike in two periods ``lag`` apart?

    Every period is tested against the one ``lag`` positions earlier, on all rows, or, with the seed ``equal``, on samples
    that are as large as the smaller side of each pair; ``significant`` compares with the level divided by the tests made.
    Ages at the later period are compared with ages at the earlier one.
    """
    old = with_period_idx(flux.where(F.col("creation_date") <= F.lit(created_by)), keys, source)
    both = F.array(
        F.struct(F.col("period_idx").alias("pair"), F.lit(2).alias("side")),
        F.struct((F.col("period_idx") + lag).alias("pair"), F.lit(1).alias("side")),
    )
    sides = old.withColumn("_p", F.explode(both)).select(*keys, "_p.pair", "_p.side", "page_id", "age_in_months")
    if equal is not None:
        pair = [*keys, "pair"]
        sides = sides.where("age_in_months IS NOT NULL")
        sizes = sides.groupBy(*pair).agg(F.least(F.count_if(F.col("side") == 1), F.count_if(F.col("side") == 2)).alias("_size"))
        sized = attach(sides, sizes.where("_size > 0"), pair)
        sides = exact_sample(sized, [*pair, "side"], F.col("_size"), "page_id", equal).drop("_size")
    tests = mann_whitney(sides, "age_in_months", F.col("side") == 1, F.col("side") == 2, [*keys, "pair"])
    # One row per test: the window over all of them is small.
    per_edition = Window.partitionBy(*keys)
    return tests.withColumn("threshold", F.lit(level) / F.count("*").over(per_edition)).withColumn(
        "significant", F.col("p_two_sided") <= F.col("threshold")
    )


def from_tail_histogram(previous: DataFrame, meta: DataFrame, keys: Sequence[str] = EDITION) -> DataFrame:
    """Creation months of entities that were never in the core before, newborns left out."""
    fresh = previous.where("nb_prev_times = 0").join(meta.select("page_id", "creation_date"), "page_id")
    return creation_histogram(fresh.where("creation_date <> date"), [*keys, "date"])


def stability_ages(
    labelled: DataFrame,
    panel: DataFrame,
    meta: DataFrame,
    required: int,
    before: dt.date,
    keys: Sequence[str] = EDITION,
) -> DataFrame:
    """Rows with their age and ``stability``: present in ``required`` periods, or in fewer.

    Periods before ``before`` count. Entities younger than their number of
    appearances are inconsistent and left out.
    """
    seen = panel.where(F.col("date") < F.lit(before)).groupBy(*keys, "page_id").agg(F.count("*").alias("nb_app"))
    aged = with_age(labelled, meta).join(seen, [*keys, "page_id"]).where("age_in_months >= nb_app")
    state = F.when(F.col("nb_app") == required, "stable").when(F.col("nb_app") < required, "unstable")
    return aged.withColumn("stability", state).where("stability is not null")


def stability_tests(rows: DataFrame, by: Sequence[str] = (*EDITION, "volume")) -> DataFrame:
    """Stable against unstable ages in each group."""
    return mann_whitney(
        rows, "age_in_months", F.col("stability") == "stable", F.col("stability") == "unstable", by
    )


def unmatched_profile(panel: DataFrame, meta: DataFrame, identity: DataFrame) -> DataFrame:
    """Views and age (since first seen) of entities without metadata."""
    lost = panel.join(meta.select("page_id"), "page_id", "left_anti").join(
        identity.select(F.col("page_ids").alias("page_id"), "first_date"), "page_id"
    )
    long = lost.select(
        F.explode(
            F.array(
                F.struct(F.lit("views").alias("measure"), F.col(WEIGHT).alias("value")),
                F.struct(
                    F.lit("age_in_months").alias("measure"),
                    F.months_between("date", "first_date").cast("bigint").alias("value"),
                ),
            )
        ).alias("_m")
    ).select("_m.*")
    return lifetime.describe(long, "value", ["measure"])


def seen_before_creation(panel: DataFrame, meta: DataFrame, keys: Sequence[str] = EDITION) -> DataFrame:
    """Rows dated before the creation of their entity, with its number of rows."""
    seen = lifetime.with_occurrences(panel, [*keys, "page_id"], "nb_occ")
    return seen.join(meta.select("page_id", "creation_date"), "page_id").where("creation_date > date").distinct()


def stable_view_tests(
    labelled: DataFrame, group: Sequence[str] = lifetime.VOLUME, nb_periods: int | None = None, source: DataFrame | None = None
) -> DataFrame:
    """Rank tests of the views of always-present entities (first side) against the others, per group and period."""
    rows = lifetime.with_stability(labelled, group, nb_periods, source)
    return mann_whitney(rows, WEIGHT, F.col("stable"), ~F.col("stable"), [*group, "date"])


def degree_tests(
    degrees: DataFrame, pairs: Sequence[tuple[str, str]] = (("core", "tail"), ("tail", "all")), keys: Sequence[str] = ("project",)
) -> DataFrame:
    """Rank tests of degrees between volumes, per kind of degree; ``degrees`` has every row under its volume and under ``all``."""
    sides = [
        F.when(F.col("volume") == v, F.struct(F.lit(f"{one}-{two}").alias("comparison"), F.lit(i).alias("side")))
        for one, two in pairs
        for i, v in ((1, one), (2, two))
    ]
    rows = degrees.select(*keys, "degree_type", "degree", F.explode(F.array_compact(F.array(*sides))).alias("_s")).select(*keys, "degree_type", "degree", "_s.*")
    return mann_whitney(rows, "degree", F.col("side") == 1, F.col("side") == 2, [*keys, "degree_type", "comparison"])
