"""Matched editions and the natural experiment of entering the core."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelytics import WEIGHT
from panelytics.operators.hinge import volume_labels
from panelytics.plans.joins import few


def edition_totals(counts: DataFrame, known: DataFrame | None = None, views: str = WEIGHT) -> DataFrame:
    """Articles and views per edition, of entities that metadata know.

    ``known`` has (project, page, page_id): a row of another title of a known id, such as a redirect, is no article.
    """
    keys = ["project", "page", "page_id"]
    rows = counts if known is None else counts.join(known.select(*keys), keys, "left_semi")
    return rows.groupBy("project").agg(F.count("*").alias("nb_articles"), F.sum(views).alias("nb_views"))


def similar_pairs(totals: DataFrame, measures: Sequence[str], precision: float) -> DataFrame:
    """Edition pairs whose measures all differ by a ratio within ``precision``.

    0 < |ln(a / b)| <= -ln(precision) for every measure. Editions are put in
    bands of that width on the first measure, so each meets its own and the
    two neighbouring bands by an equi-join and no product is formed. Names in
    a pair are in order.
    """
    width = -math.log(precision)
    usable = totals.where(" and ".join(f"{m} > 0" for m in measures))
    band = F.floor(F.ln(F.col(measures[0])) / width)
    left = usable.select(
        F.col("project").alias("lang1"), band.alias("_band"), *[F.col(m).alias(f"{m}_1") for m in measures]
    )
    right = usable.select(
        F.col("project").alias("lang2"),
        F.explode(F.array(band - 1, band, band + 1)).alias("_band"),
        *[F.col(m).alias(f"{m}_2") for m in measures],
    )
    pairs = left.join(right, "_band").where("lang1 < lang2")
    for m in measures:
        gap = F.abs(F.ln(F.col(f"{m}_1") / F.col(f"{m}_2")))
        pairs = pairs.where((gap != 0) & (gap <= width))
    return pairs.drop("_band").withColumn("pairs", F.array("lang1", "lang2"))


def both_orientations(pairs: DataFrame) -> DataFrame:
    """Every pair as (a, b) and (b, a); lang1 and lang2 stay as they are."""
    turned = pairs.withColumn("pairs", F.array("lang2", "lang1"))
    return pairs.unionByName(turned)


def pairs_by_mean_views(
    stats: DataFrame, matched: DataFrame, precision: float = 0.85, value: str = "avg_views"
) -> DataFrame:
    """Pairs whose mean views of one month are close too, in both orientations."""
    close = similar_pairs(stats, [value], precision)
    return both_orientations(close.join(matched.select("lang1", "lang2"), ["lang1", "lang2"], "left_semi"))


def item_panel(counts: DataFrame, items: DataFrame) -> DataFrame:
    """Views per edition, period and item; absent counts are zero and kept.

    ``counts`` has (project, date, page_id, counts), ``items`` adds item_id.
    """
    filled = counts.withColumn("counts", F.coalesce("counts", F.lit(0)))
    sums = filled.groupBy("project", "date", "page_id").agg(F.sum("counts").alias(WEIGHT))
    return sums.join(items.select("project", "page_id", "item_id"), ["project", "page_id"])


def first_entries(labelled: DataFrame, volume: str = "core") -> DataFrame:
    """The row in which each item of an edition is in a volume for the first time, and the month before it.

    Adds ``was_in_tail`` (the item was in that edition's tail one month earlier), ``views_post_treat`` (views of the month) and
    ``views_pre_treat`` (of the month before, zero if not seen). One shuffle by item serves all of them; ``labelled`` has one row
    per edition, item and period, with a null volume where the edition has no hinge.
    """
    life = Window.partitionBy("project", "item_id")
    before = F.lag(F.struct("date", "volume", WEIGHT)).over(life.orderBy("date"))
    first = F.min(F.when(F.col("volume") == volume, F.col("date"))).over(life)
    rows = labelled.withColumns({"_first": first, "_before": before}).where((F.col("date") == F.col("_first")) & (F.col("volume") == volume))
    last_month = F.col("_before.date") == F.add_months("date", -1)
    return rows.select(
        *labelled.columns,
        F.when(last_month & (F.col("_before.volume") == "tail"), 1).otherwise(0).alias("was_in_tail"),
        F.col(WEIGHT).alias("views_post_treat"),
        F.when(last_month, F.col(f"_before.{WEIGHT}")).otherwise(F.lit(0)).alias("views_pre_treat"),
    )


def pair_items(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(date, item, lang1, lang2) for items that both editions of a pair have, with ``own1`` and ``own2`` if rows have ``own``.

    Rows meet the short list of pairs first, so an item that many editions
    share makes no more rows than there are pairs.
    """
    own = "own" in rows.columns
    spots = rows.select("date", "item_id", "project", *(["own"] if own else []))
    spots = spots if own else spots.distinct()
    named = [spots.withColumnRenamed("project", f"lang{i}").withColumnRenamed("own", f"own{i}") for i in (1, 2)]
    return named[0].join(few(pairs.select("lang1", "lang2")), "lang1").join(named[1], ["date", "item_id", "lang2"])


MEMBER = ("was_in_tail", "views_post_treat", "views_pre_treat")


def pair_entries(labelled: DataFrame, pairs: DataFrame) -> DataFrame:
    """Items that enter the core of both editions of a pair in the same period; ``own1`` and ``own2`` tell of each edition."""
    entries = first_entries(labelled).withColumn("own", F.struct(*MEMBER))
    return pair_items(entries, pairs)


def pair_members(entries: DataFrame) -> DataFrame:
    """One row per member of each entry, with its pair; ``intail`` counts the members that came from the tail."""
    members = F.array(*[F.struct(F.col(f"lang{i}").alias("project"), F.col(f"own{i}").alias("own")) for i in (1, 2)])
    intail = (F.col("own1.was_in_tail") + F.col("own2.was_in_tail")).cast("bigint").alias("intail")
    return entries.select("date", "item_id", "lang1", "lang2", intail, F.explode(members).alias("_m")).select(
        "date", "item_id", "lang1", "lang2", "_m.project", *[f"_m.own.{c}" for c in MEMBER], "intail"
    )


def treated_pairs(members: DataFrame) -> DataFrame:
    """Members of entries in which exactly one of the two came from the tail."""
    return members.where("intail = 1")


def matched_pairs(panel: DataFrame, pairs: DataFrame, tie: Sequence[str] = ("page_id",)) -> DataFrame:
    """All steps from an item panel to the natural experiment."""
    labelled = volume_labels(panel, tie=tie, everyone=True)
    return treated_pairs(pair_members(pair_entries(labelled, pairs)))


def pre_post_views(members: DataFrame) -> DataFrame:
    """Members by treatment date, with their views in that month and in the month before."""
    return members.withColumnRenamed("date", "treatment_date").withColumn("previous_date", F.add_months("treatment_date", -1))


def difference_in_differences(
    members: DataFrame, treatment_date: dt.date | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """``views ~ post * treated`` by least squares, as one row per coefficient.

    The model is saturated, so the coefficients are differences of the four
    cell means and the residual variance is the pooled one: four sums per
    cell, whatever the number of rows.
    """
    rows = members if treatment_date is None else members.where(F.col("treatment_date") == F.lit(treatment_date))
    long = rows.select(
        *by,
        "was_in_tail",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("post"), F.col("views_pre_treat").cast("double").alias("y")),
                F.struct(F.lit(1).alias("post"), F.col("views_post_treat").cast("double").alias("y")),
            )
        ).alias("_v"),
    ).select(*by, F.col("was_in_tail").alias("t"), "_v.post", "_v.y")
    cells = [(p, t) for p in (0, 1) for t in (0, 1)]
    aggs = []
    for p, t in cells:
        y = F.when((F.col("post") == p) & (F.col("t") == t), F.col("y"))
        aggs += [F.count(y).alias(f"n{p}{t}"), F.avg(y).alias(f"m{p}{t}"), F.var_pop(y).alias(f"v{p}{t}")]
    wide = long.groupBy(*by).agg(*aggs, F.var_pop("y").alias("_v"), F.count("y").alias("n"))
    within = sum((F.coalesce(f"v{p}{t}", F.lit(0.0)) * F.col(f"n{p}{t}") for p, t in cells), F.lit(0.0))
    inverse = {(p, t): F.try_divide(F.lit(1.0), F.col(f"n{p}{t}")) for p, t in cells}
    variance = F.try_divide(F.col("_rss"), F.col("n") - 4)
    m = {(p, t): F.col(f"m{p}{t}") for p, t in cells}
    terms = [
        ("intercept", m[0, 0], inverse[0, 0]),
        ("post", m[1, 0] - m[0, 0], inverse[0, 0] + inverse[1, 0]),
        ("treated", m[0, 1] - m[0, 0], inverse[0, 0] + inverse[0, 1]),
        ("post:treated", m[1, 1] - m[1, 0] - m[0, 1] + m[0, 0], sum(inverse.values(), F.lit(0.0))),
    ]
    out = F.array(
        *[
            F.struct(
                F.lit(name).alias("term"),
                coef.alias("coef"),
                F.sqrt(variance * spread).alias("std_err"),
            )
            for name, coef, spread in terms
        ]
    )
    return (
        wide.withColumn("_rss", within)
        .withColumn("r_squared", 1 - F.try_divide(F.col("_rss"), F.col("_v") * F.col("n")))
        .select(*by, "n", "r_squared", F.explode(out).alias("_t"))
        .select(*by, "_t.*", F.try_divide(F.col("_t.coef"), F.col("_t.std_err")).alias("t_value"), "n", "r_squared")
    )


def covered_editions(panel: DataFrame, meta: DataFrame, date: dt.date, least: float = 0.89) -> DataFrame:
    """Editions whose articles of one period are more than ``least`` of the known ones."""
    own = panel.where(F.col("date") == F.lit(date)).groupBy("project").agg(F.count("*").alias("nb_custom"))
    known = meta.groupBy("project").agg(F.count("*").alias("nb_articles"))
    return own.join(known, "project").withColumn("coverage", F.col("nb_custom") / F.col("nb_articles")).where(
        F.col("coverage") > least
    )


def pairs_per_date(members: DataFrame) -> DataFrame:
    """Number of matched pairs per treatment month (two members each)."""
    return members.groupBy("treatment_date").agg((F.count("*") / 2).alias("nb_pairs"))
