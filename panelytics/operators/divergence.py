"""Rank-turbulence divergence between consecutive periods, all pairs at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelytics import WEIGHT
from panelytics.functions.statistics import steady_sum
from panelytics.plans import histogram
from panelytics.plans.calendar import period_table, with_period_idx
from panelytics.plans.joins import attach
from panelytics.session import stage

EDITION = ("project",)


def pair_dates(source: DataFrame, keys: Sequence[str] = EDITION) -> DataFrame:
    """(keys, pair, prev_date, date): each period with the one before it."""
    table = period_table(source, keys)
    before = Window.partitionBy(*keys).orderBy("period_idx")
    return table.select(
        *keys, F.col("period_idx").alias("pair"), F.lag("date").over(before).alias("prev_date"), "date"
    ).where("prev_date is not null")


def pair_sides(panel: DataFrame, keys: Sequence[str] = EDITION, source: DataFrame | None = None) -> DataFrame:
    """Every row twice: as the late side of its own pair and the early side of the next."""
    idx = with_period_idx(panel, keys, source)
    both = F.array(
        F.struct(F.col("period_idx").alias("pair"), F.lit(2).alias("side")),
        F.struct((F.col("period_idx") + 1).alias("pair"), F.lit(1).alias("side")),
    )
    return (
        idx.withColumn("_p", F.explode(both))
        .select(*panel.columns, "_p.pair", "_p.side", "nb_periods")
        .where("pair > 1 and pair <= nb_periods")
        .drop("nb_periods")
    )


def align_pairs(
    ranked: DataFrame,
    keys: Sequence[str] = EDITION,
    source: DataFrame | None = None,
    top: int | None = None,
) -> DataFrame:
    """Ranks of each entity in both periods of every pair.

    ``ranked`` needs ``fractional_rank``; ids that an identity map has merged
    have their ranks summed. An absent rank is filled with
    ``N1 + (N2 - N) / 2`` or ``N2 + (N1 - N) / 2``. With ``top`` only the
    first rows of both periods together take part. One shuffle by entity, in which
    each row goes once; the counts of a pair come back as one row.
    """
    rows = ranked.select(*keys, "date", "page_id", "page", "fractional_rank")
    # Counted per pair and then read again, in other columns: written out once.
    wide = stage(neighbours(rows, keys, source) if top is None else top_sides(rows, keys, source, top), "aligned")
    return filled_ranks(wide, pair_dates(ranked if source is None else source, keys), keys)


def filled_ranks(wide: DataFrame, dates: DataFrame, keys: Sequence[str] = EDITION) -> DataFrame:
    """``wide`` (both ranks, null where absent; read twice) with the pair's dates and counts, and absent ranks filled."""
    pair = [*keys, "pair"]
    sizes = wide.groupBy(*pair).agg(
        F.count("prev_rank_1").alias("n1"),
        F.count("prev_rank_2").alias("n2"),
        F.count(F.col("prev_rank_1") + F.col("prev_rank_2")).alias("n_both"),
    ).where("n1 > 0 and n2 > 0")
    full = attach(wide, sizes.join(dates, pair), pair)
    return full.withColumn(
        "rank_1", F.coalesce("prev_rank_1", F.col("n1") + 0.5 * (F.col("n2") - F.col("n_both")))
    ).withColumn("rank_2", F.coalesce("prev_rank_2", F.col("n2") + 0.5 * (F.col("n1") - F.col("n_both"))))


def neighbours(rows: DataFrame, keys: Sequence[str], source: DataFrame | None) -> DataFrame:
    """Both ranks of every entity and pair: a row meets the one before it, and stands alone if its entity is gone after it."""
    entity = [*keys, "page_id"]
    idx = with_period_idx(rows, keys, source).repartition(*entity)
    one = idx.groupBy(*entity, "period_idx", "nb_periods").agg(F.max("page").alias("page"), F.sum("fractional_rank").alias("rank"))
    life = Window.partitionBy(*entity).orderBy("period_idx")
    spot = F.col("period_idx")
    met = one.withColumns({"_b": F.lag(F.struct("period_idx", "page", "rank")).over(life), "_after": F.lead("period_idx").over(life)})
    before = F.when(F.col("_b.period_idx") == spot - 1, F.col("_b"))

    def row(pair: Column, page: Column, first: Column, second: Column) -> Column:
        return F.struct(pair.alias("pair"), page.alias("page"), first.alias("prev_rank_1"), second.alias("prev_rank_2"))

    own = row(spot, F.greatest("page", before["page"]), before["rank"], F.col("rank"))
    gone = row(spot + 1, F.col("page"), F.col("rank"), F.lit(None).cast("double"))
    leaves = (spot < F.col("nb_periods")) & ~F.coalesce(F.col("_after") == spot + 1, F.lit(False))
    both = F.array_compact(F.array(F.when(spot > 1, own), F.when(leaves, gone)))
    out = met.select(*entity, F.explode(both).alias("_r")).select(*keys, "_r.pair", "page_id", "_r.page", "_r.prev_rank_1", "_r.prev_rank_2")
    return out


def top_sides(rows: DataFrame, keys: Sequence[str], source: DataFrame | None, top: int) -> DataFrame:
    """As ``neighbours``, from the ``top`` first rows of both periods of a pair together."""
    pair = [*keys, "pair"]
    sides = pair_sides(rows, keys, source)
    # Fractional ranks are halves, so twice the rank is a whole weight.
    falling = sides.withColumnRenamed("fractional_rank", "_f").withColumn("_w", (-2 * F.col("_f")).cast("bigint"))
    kept = histogram.curve(falling, pair, "_w", ("page_id", "side"), lim=top)
    rank = F.col("_f")
    return kept.groupBy(*pair, "page_id").agg(
        F.max("page").alias("page"),
        F.sum(F.when(F.col("side") == 1, rank)).alias("prev_rank_1"),
        F.sum(F.when(F.col("side") == 2, rank)).alias("prev_rank_2"),
    )


def _inverse(rank: Column, alpha: float) -> Column:
    return F.pow(F.lit(1.0) / rank, F.lit(float(alpha)))


def _present_terms(alpha: float) -> tuple[Column, Column]:
    """What each present rank adds to the normaliser, for both sides."""
    r1, r2 = F.col("prev_rank_1"), F.col("prev_rank_2")
    last_1 = F.col("n1") + 0.5 * F.col("n2")
    last_2 = F.col("n2") + 0.5 * F.col("n1")
    if alpha == 0:
        return F.abs(F.ln(r1 / last_1)), F.abs(F.ln(r2 / last_2))
    if math.isinf(alpha):
        return 1 / r1, 1 / r2
    power = F.lit(1.0 / (alpha + 1))
    return (
        F.pow(F.abs(_inverse(r1, alpha) - _inverse(last_1, alpha)), power),
        F.pow(F.abs(_inverse(r2, alpha) - _inverse(last_2, alpha)), power),
    )


def _divergence(alpha: float, total: Column) -> Column:
    r1, r2 = F.col("rank_1"), F.col("rank_2")
    if alpha == 0:
        return F.try_divide(F.abs(F.ln(r1 / r2)), total)
    if math.isinf(alpha):
        return F.try_divide(F.when(r1 == r2, F.lit(0.0)).otherwise(F.greatest(1 / r1, 1 / r2)), total)
    element = F.pow(F.abs(_inverse(r1, alpha) - _inverse(r2, alpha)), F.lit(1.0 / (alpha + 1)))
    norm = F.lit((alpha + 1) / alpha) * total
    return F.try_divide(element * F.lit(float(alpha + 1)), F.lit(float(alpha)) * norm)


def divergences(
    aligned: DataFrame,
    alphas: Sequence[float] = (0.3,),
    keys: Sequence[str] = EDITION,
    source: DataFrame | None = None,
) -> DataFrame:
    """Divergence of every entity in every pair, for each alpha.

    The normalisers of all pairs and alphas are one aggregate, joined back as
    one row per pair. ``source`` is the panel that bounds the pairs.
    """
    pair = [*keys, "pair"]
    sums = []
    for i, alpha in enumerate(alphas):
        one, two = _present_terms(alpha)
        sums.append((steady_sum(one) + steady_sum(two)).alias(f"_n{i}"))
    norms = aligned.groupBy(*pair).agg(*sums)
    full = attach(aligned, norms, pair)
    each = F.array(
        *[
            F.struct(F.lit(float(a)).alias("alpha"), _divergence(a, F.col(f"_n{i}")).alias("div"))
            for i, a in enumerate(alphas)
        ]
    )
    return full.withColumn("_d", F.explode(each)).select(
        *pair, "prev_date", "date", "_d.alpha", "_d.div", "page_id", "page",
        "rank_1", "rank_2", "prev_rank_1", "prev_rank_2",
    )


def total_divergence(divs: DataFrame, keys: Sequence[str] = EDITION) -> DataFrame:
    """Sum over entities: how unstable the ranks were in each period."""
    return divs.groupBy(*keys, "date", "alpha").agg(steady_sum("div").alias("total_div"))


def rank_cells(aligned: DataFrame, keys: Sequence[str] = EDITION) -> DataFrame:
    """Counts on a grid of log ranks, with an exemplar least on each axis."""
    def cell(rank: str) -> Column:
        return F.round(F.log10(rank) * 100) / 100

    cells = aligned.withColumn("log_rank_1", cell("rank_1")).withColumn("log_rank_2", cell("rank_2"))
    shown = F.struct("page", "rank_1", "rank_2")
    return (
        cells.groupBy(*keys, "prev_date", "date", "log_rank_1", "log_rank_2")
        .agg(
            F.count("*").alias("nb_pages"),
            F.min_by(shown, F.struct("rank_1", "page_id")).alias("_a"),
            F.min_by(shown, F.struct("rank_2", "page_id")).alias("_b"),
        )
        .select(
            *keys, "prev_date", "date", "log_rank_1", "log_rank_2", "nb_pages",
            F.col("_a.page").alias("page_1"), F.col("_a.rank_1").alias("r_1_1"), F.col("_a.rank_2").alias("r_1_2"),
            F.col("_b.page").alias("page_2"), F.col("_b.rank_1").alias("r_2_1"), F.col("_b.rank_2").alias("r_2_2"),
        )
    )


def salient_pages(
    divs: DataFrame, lim: int = 1000, nb_top: int = 40, keys: Sequence[str] = EDITION
) -> DataFrame:
    """Both ends of the signed divergence among the ``lim`` greatest of each pair.

    Positive signs moved up. A star marks entities at the last rank of either
    side. The top rows are cut in every map task before they meet.
    """
    group = [*keys, "date", "alpha"]
    lasts = divs.groupBy(*group).agg(F.max("rank_1").alias("_m1"), F.max("rank_2").alias("_m2"))
    strongest = Window.partitionBy(*group).orderBy(F.col("div").desc(), "page_id")
    top = divs.withColumn("_r", F.row_number().over(strongest)).where(F.col("_r") <= lim)
    sign = F.when(F.col("rank_2") < F.col("rank_1"), 1).otherwise(-1)
    top = top.join(lasts, group).withColumn("div_sign", sign * F.col("div"))
    up = Window.partitionBy(*group).orderBy(F.col("div_sign").desc(), "page_id")
    down = Window.partitionBy(*group).orderBy(F.col("div_sign").asc(), F.col("page_id").desc())
    half = nb_top // 2
    star = (F.col("rank_1") == F.col("_m1")) | (F.col("rank_2") == F.col("_m2"))
    return (
        top.withColumn("_u", F.row_number().over(up))
        .withColumn("_d", F.row_number().over(down))
        .where((F.col("_u") <= half) | (F.col("_d") <= half))
        .select(
            *group, "page_id", "div", "div_sign",
            F.when(star, F.concat("page", F.lit("*"))).otherwise(F.col("page")).alias("page"),
            F.concat(F.col("rank_1").cast("bigint"), F.lit(" <> "), F.col("rank_2").cast("bigint")).alias("ranks"),
            F.when(F.col("div_sign") < 0, F.col("prev_date")).otherwise(F.col("date")).alias("month"),
        )
    )


def grouped_salient_pages(
    divs: DataFrame,
    topics: DataFrame,
    group: Sequence[str],
    m: int = 20,
    ungrouped: bool = False,
    lim: int = 99,
) -> DataFrame:
    """Top ``lim`` entities of each group by divergence, with topic, then the first ``m``.

    ``ungrouped`` takes half of ``m`` from either end of the signed divergence
    instead of the ``m`` greatest. A star marks the last ranks of the whole frame.
    """
    return salient_of_top(top_with_topic(divs, topics, group, lim), group, m, ungrouped)


def top_with_topic(divs: DataFrame, topics: DataFrame, group: Sequence[str], lim: int = 99) -> DataFrame:
    """The first ``lim`` entities of each group that have a topic, with place and sign; a star marks the last ranks of all rows.

    The frame is read for the last ranks and for the top; only the top is written out.
    """
    lasts = divs.join(topics.select("page_id"), "page_id", "left_semi").agg(F.max("rank_1"), F.max("rank_2")).first()
    strongest = Window.partitionBy(*group).orderBy(F.col("div").desc(), "page_id")
    top = divs.join(topics, "page_id").withColumn("divr", F.row_number().over(strongest)).where(F.col("divr") <= lim)
    sign = F.when(F.col("rank_2") < F.col("rank_1"), 1).otherwise(-1)
    star = (F.col("rank_1") == F.lit(lasts[0])) | (F.col("rank_2") == F.lit(lasts[1]))
    return stage(top.withColumn("div_sign", sign * F.col("div")).withColumn(
        "page", F.when(star, F.concat("page", F.lit("*"))).otherwise(F.col("page"))
    ), "topics")


def salient_of_top(top: DataFrame, group: Sequence[str], m: int = 20, ungrouped: bool = False) -> DataFrame:
    """The rows that ``grouped_salient_pages`` shows, of ``top_with_topic``."""
    if not ungrouped:
        return top.where(F.col("divr") <= m)
    up = Window.partitionBy(*group).orderBy(F.col("div_sign").desc(), "page_id")
    down = Window.partitionBy(*group).orderBy(F.col("div_sign").asc(), F.col("page_id").desc())
    return (
        top.withColumn("_u", F.row_number().over(up))
        .withColumn("_d", F.row_number().over(down))
        .where((F.col("_u") <= m // 2) | (F.col("_d") <= m // 2))
        .drop("_u", "_d")
    )


def pair_statistics(
    aligned: DataFrame, divs: DataFrame, panel: DataFrame, keys: Sequence[str] = EDITION
) -> DataFrame:
    """Per pair and side: exclusive entities, views, entities and divergence, with shares."""
    pair = [*keys, "date", "prev_date"]
    gone = F.col("prev_rank_2").isNull()
    come = F.col("prev_rank_1").isNull()
    ranks = aligned.groupBy(*pair).agg(
        F.count_if(gone).cast("double").alias("x1"), F.count_if(come).cast("double").alias("x2"),
        F.count("prev_rank_1").cast("double").alias("p1"), F.count("prev_rank_2").cast("double").alias("p2"),
    )
    fell = F.col("rank_1") > F.col("rank_2")
    shares = divs.groupBy(*pair, "alpha").agg(
        steady_sum(F.when(fell, F.col("div"))).alias("d1"), steady_sum(F.when(~fell, F.col("div"))).alias("d2")
    )
    views = panel.groupBy(*keys, "date").agg(F.sum(WEIGHT).cast("double").alias("v"))
    both = (
        ranks.join(shares, pair)
        .join(views.withColumnRenamed("v", "v2"), [*keys, "date"])
        .join(views.withColumnRenamed("v", "v1").withColumnRenamed("date", "prev_date"), [*keys, "prev_date"])
    )
    cells = []
    for name, c in (("exclusive", "x"), ("views", "v"), ("pages", "p"), ("divergence", "d")):
        total = F.coalesce(f"{c}1", F.lit(0.0)) + F.coalesce(f"{c}2", F.lit(0.0))
        for side, month in ((1, "prev_date"), (2, "date")):
            cells.append(
                F.struct(
                    F.lit(name).alias("category"),
                    F.col(month).alias("month"),
                    F.col(f"{c}{side}").alias("counts"),
                    (F.try_divide(F.col(f"{c}{side}"), total) * 100).alias("share"),
                )
            )
    return both.select(*pair, "alpha", F.explode(F.array(*cells)).alias("_c")).select(*pair, "alpha", "_c.*")
