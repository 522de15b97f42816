"""Core / tail split at the hinge of the cumulative weight curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelytics import PANEL_KEYS, WEIGHT
from panelytics.plans import histogram
from panelytics.plans.calendar import period_table
from panelytics.plans.joins import attach, few

HINGE_COLUMNS = ("hinge_perc", "hinge_rank")


def cumulative_curve(
    panel: DataFrame,
    by: Sequence[str] = PANEL_KEYS,
    tie: Sequence[str] = ("page_id",),
    keep_rank: str | None = None,
) -> DataFrame:
    """Rank, cumulated share of views and share of ranks for every row.

    ``perc_rank`` uses the new rank, or the column ``keep_rank`` of a panel
    that was ranked before it was filtered (then it may exceed 100).
    """
    if keep_rank is not None:
        panel = panel.withColumnRenamed(keep_rank, "_old_rank")
    shown = F.col("rank" if keep_rank is None else "_old_rank")
    ranked = histogram.curve(panel.drop("rank", "fractional_rank"), by, tie=tie)
    return (
        ranked.withColumn("perc_views", F.col("cum_views") / F.col("tot_views") * 100)
        .withColumn("perc_rank", shown / F.col("nb_pages") * 100)
        .withColumn("d_perc_views", slope())
        .drop("next_views", "_old_rank")
    )


def slope() -> Column:
    """Central difference of ``perc_views``; null at both ends of a group.

    The neighbours' cumulated views follow from this row's weight and the
    next one, so no window over the group is needed.
    """
    before = (F.col("cum_views") - F.col(WEIGHT)) / F.col("tot_views") * 100
    after = (F.col("cum_views") + F.col("next_views")) / F.col("tot_views") * 100
    inner = (F.col("rank") > 1) & (F.col("rank") < F.col("nb_pages"))
    return F.when(inner, (after - before) / 2)


def central_difference(
    df: DataFrame, x: str, by: Sequence[str] = PANEL_KEYS, order: str = "rank", run: int = 100_000
) -> DataFrame:
    """(next - previous) / 2 of any column by dense ``order``; ends are dropped.

    Rows are dealt in runs of ``run`` positions, with the border rows copied to the neighbouring run, so one
    shuffle brings neighbours together and one huge group is spread over all tasks.
    """
    spot = F.col(order)
    own = F.floor(spot / run)
    copies = F.array_distinct(F.array(own, F.floor((spot - 1) / run), F.floor((spot + 1) / run)))
    line = Window.partitionBy(*by, "_run").orderBy(order)
    rows = df.withColumn("_run", F.explode(copies))
    near = {"_b": F.lag(F.struct(order, F.col(x).alias("x"))).over(line), "_a": F.lead(F.struct(order, F.col(x).alias("x"))).over(line)}
    met = rows.withColumns(near).where((F.col("_run") == own) & (F.col(f"_b.{order}") == spot - 1) & (F.col(f"_a.{order}") == spot + 1))
    return met.withColumn(f"d_{x}", (F.col("_a.x") - F.col("_b.x")) / 2).drop("_run", "_a", "_b")


# Float noise in ``d_perc_views`` stays far below this.
NOISE = 1e-12
# Positions of a tie block that are written out at a time.
CHUNK = 100_000


def hinge_points(
    panel: DataFrame,
    eps: float = 1,
    by: Sequence[str] = PANEL_KEYS,
    tie: Sequence[str] | None = None,
) -> DataFrame:
    """First rank whose slope is at most 100 * eps / number of rows.

    Groups with fewer than three rows or without such a rank give no row. Only
    the weight histogram is read, see ``flat_points``.
    """
    return flat_points(histogram.panel_blocks(panel, by, WEIGHT, tie), by, [eps]).drop("eps")


def flat_points(
    blocks: DataFrame, by: Sequence[str], eps: Sequence[float], step: Column | None = None, bounds: bool = False
) -> DataFrame:
    """The hinge of every group and slope, from tie blocks alone.

    ``bounds`` adds where the core ends: the weight of the hinge's block (``core_weight``), how many of its ties
    (``block_ties``) are core (``core_ties``), the weight of the block after it (``next_weight``) and the sizes of core and group.

    Inside a block the slope is constant up to float noise and lower only at
    its last position. If the constant is clear of the threshold, the first
    and the last positions decide; a block within the noise is written out in
    full, in chunks that are spread over the tasks. Every position is judged
    by the same float expression as a row would be.
    """
    step = F.lit(1).cast("bigint") if step is None else step
    w, total, nb, ties = F.col(WEIGHT), F.col("tot_views"), F.col("nb_pages"), F.col("_ties")
    threshold = 100 * F.col("eps") / nb
    near = F.abs(w / total * 100 - threshold) <= NOISE
    one = F.lit(1).cast("bigint")
    ends = F.array_distinct(F.array(one, F.least(one + 1, ties), ties))
    spans = F.when(
        near,
        F.transform(
            F.sequence(one, ties, F.lit(CHUNK).cast("bigint")),
            lambda s: F.struct(s.alias("low"), F.least(s + (CHUNK - 1), ties).alias("high")),
        ),
    ).otherwise(F.transform(ends, lambda s: F.struct(s.alias("low"), s.alias("high"))))
    spread = (
        blocks.withColumn("eps", F.explode(F.array(*[F.lit(float(e)) for e in eps])))
        .withColumn("_span", F.explode(spans))
        .repartition(*by, WEIGHT, "_span")
        .withColumn("_j", F.explode(F.sequence("_span.low", "_span.high")))
    )
    j = F.col("_j")
    spot = F.col("_above") + j
    cum = F.col("_mass_above") + j * w
    following = F.when(j < ties, w).otherwise(F.col("_next_block"))
    fall = ((cum + following) / total * 100 - (cum - w) / total * 100) / 2
    rank = F.when((step == 1) | (spot == 1), spot).otherwise((spot - 1) * step)
    flat = spread.where((spot > 1) & (spot < nb) & (fall <= threshold))
    # Ties of weight zero add nothing to the cumulated views, so they are on one side together.
    core_ties = F.when(w == 0, ties).otherwise(j)
    ends_at = [
        w.alias("core_weight"), core_ties.alias("core_ties"), ties.alias("block_ties"),
        F.col("_next_block").alias("next_weight"), (F.col("_above") + core_ties).alias("nb_core"), nb.alias("nb_pages"),
    ]
    point = F.struct(
        (cum / total * 100).alias("hinge_perc"), (rank / (nb * step) * 100).alias("hinge_rank"), *(ends_at if bounds else [])
    )
    return flat.groupBy(*by, "eps").agg(F.min_by(point, spot).alias("_first")).select(*by, "eps", "_first.*")


def hinge_of_curve(curve: DataFrame, eps: float = 1, by: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """The hinge read from the rows of a curve, where ``perc_rank`` is not the new rank."""
    flat = curve.where(F.col("d_perc_views") <= F.lit(100 * eps) / F.col("nb_pages"))
    point = F.struct(F.col("perc_views").alias("hinge_perc"), F.col("perc_rank").alias("hinge_rank"))
    return flat.groupBy(*by).agg(F.min_by(point, "rank").alias("_first")).select(*by, "_first.*")


def core_bounds(panel: DataFrame, eps: float = 1, by: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """One row for each group that has a hinge: the hinge and where its core ends (see ``flat_points``)."""
    return flat_points(histogram.panel_blocks(panel, by, WEIGHT), by, [eps], bounds=True).drop("eps")


def volume_labels(
    panel: DataFrame,
    eps: float = 1,
    by: Sequence[str] = PANEL_KEYS,
    tie: Sequence[str] = ("page_id",),
    everyone: bool = False,
) -> DataFrame:
    """Every row of a group that has a hinge, with ``volume`` core or tail and no ranks.

    With ``everyone`` rows of groups without a hinge stay too, with a null volume.

    A row's weight tells its side, so rows are labelled where they are read; only the ties of the one block
    that the hinge splits are ranked.
    """
    bounds = few(core_bounds(panel, eps, by)).select(*by, "core_weight", "core_ties", "block_ties")
    rows = panel.where(F.col(WEIGHT).isNotNull()).join(bounds, list(by), "left" if everyone else "inner")
    w, end = F.col(WEIGHT), F.col("core_weight")
    split = end.isNotNull() & (w == end) & (F.col("core_ties") < F.col("block_ties"))
    clear = rows.where(~split).withColumn("volume", F.when(w >= end, "core").when(w < end, "tail"))
    ties = histogram.curve(rows.where(split), by, WEIGHT, tie)
    ties = ties.withColumn("volume", F.when(F.col("rank") <= F.col("core_ties"), "core").otherwise("tail"))
    return clear.select(*panel.columns, "volume").unionByName(ties.select(*panel.columns, "volume"))


def label_volumes(
    panel: DataFrame,
    eps: float = 1,
    by: Sequence[str] = PANEL_KEYS,
    tie: Sequence[str] = ("page_id",),
    keep_rank: str | None = None,
) -> DataFrame:
    """Every row of a group that has a hinge, with its rank, its place on the curve and ``volume`` core or tail.

    Where ranks are not needed ``volume_labels`` gives the same labels without ranking the rows.
    """
    curve = cumulative_curve(panel, by, tie, keep_rank)
    points = hinge_points(panel, eps, by, tie) if keep_rank is None else hinge_of_curve(curve, eps, by)
    labelled = attach(curve, points, by)
    core = F.col("perc_views") <= F.col("hinge_perc")
    return labelled.withColumn("volume", F.when(core, "core").otherwise("tail"))


def core(panel: DataFrame, **options) -> DataFrame:
    return label_volumes(panel, **options).where("volume = 'core'")


def tail(panel: DataFrame, **options) -> DataFrame:
    return label_volumes(panel, **options).where("volume = 'tail'")


def hinge_by_slope(panel: DataFrame, eps: Sequence[float], by: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """Hinge for several slopes in one job, keyed by ``eps``."""
    return flat_points(histogram.panel_blocks(panel, by, WEIGHT), by, eps)


def sampled_blocks(panel: DataFrame, steps: Sequence[int], by: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """Weight histogram of the ranks 1, k, 2k, .. for every step k.

    How many sampled ranks a tie block holds is arithmetic, so all steps come
    from the one histogram of the panel.
    """
    ks = F.array(*[F.lit(int(k)).cast("bigint") for k in steps])
    above, ties = F.col("_above"), F.col("_ties")
    taken = (
        histogram.panel_blocks(panel, by, WEIGHT)
        .withColumn("sampling", F.explode(ks))
        .select(*by, WEIGHT, "sampling", above, (sampled_upto(above + ties) - sampled_upto(above)).alias("_taken"))
        .where("_taken > 0")
    )
    group = Window.partitionBy(*by, "sampling")
    down = group.orderBy(F.col(WEIGHT).desc())
    mass = F.col("_taken") * F.col(WEIGHT)
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    return taken.select(
        *by,
        WEIGHT,
        "sampling",
        F.col("_taken").alias("_ties"),
        sampled_upto(above).alias("_above"),
        F.coalesce(F.sum(mass).over(before), F.lit(0)).alias("_mass_above"),
        F.sum("_taken").over(group).alias("nb_pages"),
        F.sum(mass).over(group).alias("tot_views"),
        F.lead(WEIGHT).over(down).alias("_next_block"),
    )


def sampled_upto(rank: Column) -> Column:
    """Sampled ranks among 1..rank for the step in ``sampling``."""
    k = F.col("sampling")
    return F.floor(rank / k) + F.when((k > 1) & (rank >= 1), 1).otherwise(0)


def sampled_curve(
    panel: DataFrame,
    steps: Sequence[int],
    by: Sequence[str] = PANEL_KEYS,
    tie: Sequence[str] = ("page_id",),
) -> DataFrame:
    """Rows of the curve over ranks 1, k, 2k, .. for every step k, keyed by ``sampling``."""
    ks = F.array(*[F.lit(int(k)).cast("bigint") for k in steps])
    ranked = histogram.curve(panel, by, WEIGHT, tie).select(*panel.columns, "rank")
    sampled = ranked.withColumn(
        "sampling", F.explode(F.filter(ks, lambda k: (F.col("rank") % k == 0) | (F.col("rank") == 1)))
    )
    rows = sampled.join(sampled_blocks(panel, steps, by), [*by, WEIGHT, "sampling"])
    into = sampled_upto(F.col("rank")) - F.col("_above")
    return rows.withColumn("cum_views", F.col("_mass_above") + into * F.col(WEIGHT)).select(
        *panel.columns,
        "sampling",
        "rank",
        "cum_views",
        (F.col("cum_views") / F.col("tot_views") * 100).alias("perc_views"),
        (F.col("rank") / (F.col("nb_pages") * F.col("sampling")) * 100).alias("perc_rank"),
    )


def hinge_by_sampling(panel: DataFrame, steps: Sequence[int], by: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """Hinge for several sampling steps in one job, keyed by ``sampling``."""
    return flat_points(sampled_blocks(panel, steps, by), (*by, "sampling"), [1], F.col("sampling")).drop("eps")


def hinge_summary(hinges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and deviation of both hinge coordinates."""
    return hinges.groupBy(*by).agg(
        F.count("*").alias("nb"),
        F.avg("hinge_perc").alias("avg_views"),
        F.stddev_samp("hinge_perc").alias("std_views"),
        F.avg("hinge_rank").alias("avg_rank"),
        F.stddev_samp("hinge_rank").alias("std_rank"),
    )


def volume_sizes(hinges: DataFrame, sizes: DataFrame | None = None, by: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """Core and tail sizes from the hinge coordinate and ``nb_pages`` (of ``sizes``, or as ``core_bounds`` has it)."""
    share = F.col("hinge_rank")
    sized = hinges if "nb_pages" in hinges.columns else hinges.join(sizes, list(by))
    return sized.select(
        *by,
        "nb_pages",
        *HINGE_COLUMNS,
        (share * F.col("nb_pages") / 100).alias("core_pages"),
        ((100 - share) * F.col("nb_pages") / 100).alias("tail_pages"),
    )


def mean_curve(curve: DataFrame, every: int = 50, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Mean cumulated share at equal ``perc_rank`` over periods, with its error.

    ``digits`` rounds the position first, for groups of unlike size.
    """
    spot = F.col("perc_rank") if digits is None else F.round("perc_rank", digits)
    points = curve.where(F.col("rank") % every == 0).withColumn("perc_rank", spot)
    return points.groupBy(*by, "perc_rank").agg(
        F.avg("perc_views").alias("perc_views"),
        (F.stddev_samp("perc_views") * 1.96 / F.sqrt(F.count("*"))).alias("error_views"),
        F.count("*").alias("nb_points"),
    )


def boundary_views(bounds: DataFrame, by: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """Smallest core weight, largest tail weight and tail size per group, from ``core_bounds``."""
    cut = F.col("core_ties") < F.col("block_ties")
    return bounds.select(
        *by,
        F.col("core_weight").alias("min_core_views"),
        F.when(cut, F.col("core_weight")).otherwise(F.col("next_weight")).alias("max_tail_views"),
        (F.col("nb_pages") - F.col("nb_core")).alias("nb_tail_pages"),
    )


def common_share(
    ranked: DataFrame, tops: Sequence[int], keys: Sequence[str] = ("project",), source: DataFrame | None = None
) -> DataFrame:
    """Share of pages present in all periods, among ranks <= n and ranks >= n.

    Per n: pages that occur in every period, over the pages of each period;
    mean and deviation over periods. All n share two aggregations.
    """
    rank = F.col("rank")
    sides = [(n, side, rank <= n if side == "core" else rank >= n) for n in tops for side in ("core", "tail")]

    def long(prefix: str) -> Column:
        return F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).cast("bigint").alias("top_n"),
                        F.lit(side).alias("volume"),
                        F.col(f"{prefix}{i}").alias("nb"),
                    )
                    for i, (n, side, _) in enumerate(sides)
                ]
            )
        ).alias("_l")

    def counts(by: Sequence[str]) -> DataFrame:
        wide = ranked.groupBy(*by).agg(
            *[F.count(F.when(cond, 1)).alias(f"_c{i}") for i, (_, _, cond) in enumerate(sides)]
        )
        return wide.select(*by, long("_c")).select(*by, "_l.*").where("nb > 0")

    # Pages by number of periods: a handful of rows, so the number of all
    # periods can be met by an equi-join.
    occurrences = counts([*keys, "page_id"]).groupBy(*keys, "top_n", "volume", "nb").agg(
        F.count("*").alias("nb_common")
    )
    everywhere = period_table(source if source is not None else ranked).select(
        F.col("nb_periods").alias("nb")
    ).distinct()
    common = occurrences.join(everywhere, "nb").drop("nb")
    share = F.coalesce("nb_common", F.lit(0)) / F.col("nb") * 100
    return (
        counts([*keys, "date"])
        .join(common, [*keys, "top_n", "volume"], "left")
        .groupBy(*keys, "top_n", "volume")
        .agg(
            F.coalesce(F.max("nb_common"), F.lit(0)).alias("nb_common"),
            F.avg(share).alias("avg_share"),
            F.stddev_samp(share).alias("std_share"),
        )
    )
