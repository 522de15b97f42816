"""Set overlap and flux between periods, as rows instead of page sets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelytics import WEIGHT
from panelytics.functions.statistics import error95, steady_avg, steady_error95, steady_std
from panelytics.plans import bitmaps
from panelytics.plans.calendar import month_number, period_table, stored_periods, with_period_idx
from panelytics.plans.joins import attach, stream_past
from panelytics.session import stage

EDITION = ("project",)


def overlap_at_lag(
    binned: DataFrame,
    offset: int = 1,
    slicing: int = 5_000,
    period: str = "date",
    keys: Sequence[str] = (*EDITION, "rank_range"),
    entity: str = "page",
) -> DataFrame:
    """Share of a rank slice that was in the same slice ``offset`` periods before.

    The lag counts the periods in which the slice exists; the base is the fixed slice size. One shuffle by entity makes
    the sets of periods, whose overlap with themselves ``offset`` periods before is counted by bit position.
    """
    rows = binned.select(*keys, F.col(period).alias("date"), entity)
    periods, last = stored_periods(rows, keys)
    words = bitmaps.words_for(last)
    sets = bitmaps.presence_bits(with_period_idx(rows, keys, periods=periods), [*keys, entity], F.col("period_idx"), words)
    hits = sets.select(*keys, bitmaps.both(F.col("bits"), bitmaps.later("bits", offset, words), words).alias("bits"), F.lit(1).alias("n"))
    return (
        periods.where(F.col("period_idx") > offset)
        .join(bitmaps.counts_by_period(hits, keys), [*keys, "period_idx"], "left")
        .select(*keys, F.col("date").alias(period), (F.coalesce("nb", F.lit(0)) / slicing * 100).alias("overlap"))
    )


def overlap_at_lags(
    binned: DataFrame,
    offsets: Sequence[int],
    slicing: int = 5_000,
    period: str = "date",
    keys: Sequence[str] = (*EDITION, "rank_range"),
    entity: str = "page",
) -> DataFrame:
    """Entities in the current slice and in it at every lag, and what each set has besides."""
    rows = binned.select(*keys, F.col(period).alias("date"), entity)
    periods, last = stored_periods(rows, keys)
    words = bitmaps.words_for(last)
    sets = bitmaps.presence_bits(with_period_idx(rows, keys, periods=periods), [*keys, entity], F.col("period_idx"), words)
    sets = sets.withColumns({f"_{o}": bitmaps.later("bits", o, words) for o in offsets})
    now, then = F.col("bits"), {o: F.col(f"_{o}") for o in offsets}
    everywhere = now
    for moved in then.values():
        everywhere = bitmaps.both(everywhere, moved, words)
    sets = sets.withColumn("_all", everywhere)
    kinds = {"nb_common": F.col("_all"), "nb_only_current": bitmaps.without(now, F.col("_all"), words)}
    kinds |= {f"nb_only_lag_{o}": bitmaps.without(moved, F.col("_all"), words) for o, moved in then.items()}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), b.alias("bits")) for k, b in kinds.items()]))
    counts = bitmaps.counts_by_period(sets.select(*keys, F.lit(1).alias("n"), each.alias("_e")).select(*keys, "n", "_e.*"), [*keys, "kind"])
    wide = counts.groupBy(*keys, "period_idx").agg(*[F.max(F.when(F.col("kind") == k, F.col("nb"))).alias(k) for k in kinds])
    return (
        periods.where(F.col("period_idx") > max(offsets))
        .join(wide, [*keys, "period_idx"], "left")
        .select(*keys, F.col("date").alias(period), *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])
        .withColumn("overlap_size", F.col("nb_common") / slicing * 100)
    )


def overlap_with_anchor(
    binned: DataFrame,
    anchor: dt.date,
    last: dt.date,
    slicing: int = 5_000,
    keys: Sequence[str] = (*EDITION, "rank_range"),
    entity: str = "page",
) -> DataFrame:
    """Share of each period's slice that is in the anchor period's slice."""
    rows = binned.where(F.col("date") <= F.lit(last))
    pages = rows.groupBy(*keys, entity).agg(
        F.collect_set("date").alias("dates"), F.bool_or(F.col("date") == F.lit(anchor)).alias("in_anchor")
    )
    return pages.select(*keys, "in_anchor", F.explode("dates").alias("date")).groupBy(*keys, "date").agg(
        (F.count_if("in_anchor") / slicing * 100).alias("overlap_size")
    )


def mark_flux(
    panel: DataFrame,
    keys: Sequence[str] = EDITION,
    entity: str = "page_id",
    source: DataFrame | None = None,
) -> DataFrame:
    """Adds ``flow`` and ``leaves`` to every row of a (core) panel.

    ``flow`` is incoming or staying against the previous existing period, NULL
    in the first one. ``leaves`` tells that the entity is absent in the next
    existing period; NULL in the last one. The window holds one entity.
    """
    idx = with_period_idx(panel, keys, source)
    life = Window.partitionBy(*keys, entity).orderBy("period_idx")
    t = F.col("period_idx")
    was = F.coalesce(F.lag("period_idx").over(life) == t - 1, F.lit(False))
    stays = F.coalesce(F.lead("period_idx").over(life) == t + 1, F.lit(False))
    return idx.withColumn(
        "flow", F.when(t == 1, F.lit(None)).when(was, "staying").otherwise("incoming")
    ).withColumn("leaves", F.when(t < F.col("nb_periods"), ~stays))


def incoming(panel: DataFrame, **options) -> DataFrame:
    return mark_flux(panel, **options).where("flow = 'incoming'")


def staying(panel: DataFrame, **options) -> DataFrame:
    return mark_flux(panel, **options).where("flow = 'staying'")


def outgoing(
    panel: DataFrame, keys: Sequence[str] = EDITION, source: DataFrame | None = None, **options
) -> DataFrame:
    """Rows seen for the last time before an absence, stamped with the period that lacks them.

    ``last_date`` keeps the period they were seen in.
    """
    source = panel if source is None else source
    gone = mark_flux(panel, keys=keys, source=source, **options).where("leaves")
    following = period_table(source, keys).select(
        *keys, (F.col("period_idx") - 1).alias("period_idx"), F.col("date").alias("_next")
    )
    bound = period_table(source, keys).select(*keys, "period_idx")
    return (
        attach(gone, following, [*keys, "period_idx"])
        .withColumnRenamed("date", "last_date")
        .withColumnRenamed("_next", "date")
    )


def flux_sizes(marked: DataFrame, keys: Sequence[str] = EDITION) -> DataFrame:
    """Size and share of what came in and of what leaves after each period."""
    came = F.count_if(F.col("flow") == "incoming")
    left = F.count_if("leaves")
    total = F.count("*")
    return marked.groupBy(*keys, "date").agg(
        total.alias("nb_tot_pages"),
        F.when(F.count("flow") > 0, came).alias("nb_incoming"),
        F.when(F.count("leaves") > 0, left).alias("nb_outgoing"),
        F.when(F.count("flow") > 0, came / total * 100).alias("perc_incoming"),
        F.when(F.count("leaves") > 0, left / total * 100).alias("perc_outgoing"),
    )


def flux_by_lag(
    panel: DataFrame,
    keys: Sequence[str] = EDITION,
    entity: str = "page_id",
    max_lag: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """For every period and lag: share that is new since, and share that is gone.

    Entities are counted by their set of periods. A set meets itself at every lag up to its own span, as one row of bits for
    each lag, and these are summed by position; so the rows before the sum grow with the lags, not with pairs of periods.
    """
    periods, last = stored_periods(panel if source is None else source, keys)
    idx = with_period_idx(panel, keys, periods=periods)
    words = bitmaps.words_for(last)
    sets = bitmaps.presence_bits(idx, [*keys, entity], F.col("period_idx"), words)
    patterns = stage(bitmaps.patterns(sets, keys), "patterns")
    sizes = bitmaps.counts_by_period(patterns, keys).withColumnRenamed("nb", "size")
    t = F.col("period_idx")
    far = F.lit(max_lag if max_lag is not None else 2**31 - 1).cast("bigint")
    none = F.array().cast("array<bigint>")
    lags = F.when(t > 1, F.sequence(F.lit(1).cast("bigint"), F.least(t - 1, far))).otherwise(none)
    span = F.least(bitmaps.span("bits", words), far)
    own = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_span"))).alias("lag")
    spans = patterns.withColumn("_span", span).where("_span > 0").select(*keys, "n", "bits", own)
    shared = spans.withColumn("bits", bitmaps.both(F.col("bits"), bitmaps.later("bits", F.col("lag"), words), words))
    common = bitmaps.counts_by_period(shared, [*keys, "lag"]).withColumnRenamed("nb", "common")
    past = sizes.select(*keys, F.col("period_idx").alias("_then"), F.col("size").alias("past_size"))
    grid = sizes.withColumn("lag", F.explode(lags)).withColumn("_then", F.col("period_idx") - F.col("lag"))
    return (
        grid.join(past, [*keys, "_then"])
        .join(common, [*keys, "period_idx", "lag"], "left")
        .select(
            *keys,
            "period_idx",
            "lag",
            ((F.col("size") - F.coalesce("common", F.lit(0))) / F.col("size") * 100).alias("new"),
            ((F.col("past_size") - F.coalesce("common", F.lit(0))) / F.col("size") * 100).alias("gone"),
        )
    )


def lag_profile(by_lag: DataFrame, value: str, keys: Sequence[str] = EDITION) -> DataFrame:
    """Mean over periods per lag, of the shares above zero."""
    return by_lag.where(F.col(value) > 0).groupBy(*keys, "lag").agg(
        F.avg(value).alias("avg"),
        F.stddev_samp(value).alias("std"),
        F.count("*").alias("nb"),
        error95(value).alias("error"),
    )


def previous_appearances(
    marked: DataFrame, months: int = 89, keys: Sequence[str] = EDITION, entity: str = "page_id"
) -> DataFrame:
    """Incoming rows with the number of earlier months (of ``months``) they were in."""
    past = (
        Window.partitionBy(*keys, entity).orderBy(month_number("date")).rangeBetween(-months, -1)
    )
    return marked.withColumn("nb_prev_times", F.count("*").over(past)).where("flow = 'incoming'")


def with_share(counts: DataFrame, by: Sequence[str], n: str = "nb_pages", name: str = "perc") -> DataFrame:
    """Percentage of each row of a small count table within its group."""
    return counts.withColumn(name, F.col(n) / F.sum(n).over(Window.partitionBy(*by)) * 100)


def flow_views(marked: DataFrame, keys: Sequence[str] = EDITION) -> DataFrame:
    """Views of incoming, staying and all rows per period."""
    parts = F.explode(F.array_compact(F.array(F.col("flow"), F.lit("all"))))
    return marked.select(*keys, "date", WEIGHT, parts.alias("pages")).groupBy(*keys, "date", "pages").agg(
        F.avg(WEIGHT).alias("avg_views"),
        F.stddev_samp(WEIGHT).alias("std_views"),
        F.count("*").alias("nb_pages"),
        error95(WEIGHT).alias("error"),
    )


def flow_topics(
    marked: DataFrame, topics: DataFrame, keys: Sequence[str] = EDITION, entity: str = "page_id"
) -> DataFrame:
    """Topic shares of what comes in and what leaves, per period."""
    came = F.when(F.col("flow") == "incoming", "incoming")
    left = F.when(F.col("leaves"), "outgoing")
    flows = marked.select(*keys, "date", entity, F.explode(F.array_compact(F.array(came, left))).alias("flux"))
    joined = stream_past(flows, topics.select(entity, "topic").distinct(), [entity])
    counts = joined.groupBy(*keys, "flux", "date", "topic").agg(F.count("*").alias("nb_pages"))
    return with_share(counts, [*keys, "flux", "date"])


def share_profile(shares: DataFrame, by: Sequence[str], value: str = "perc") -> DataFrame:
    """Mean share over periods with its 95 % error."""
    return shares.groupBy(*by).agg(
        steady_avg(value).alias("avg_perc"),
        steady_std(value).alias("std_perc"),
        steady_error95(value).alias("error"),
        F.count("*").alias("nb_periods"),
    )


def volume_sets(
    labelled: DataFrame, keys: Sequence[str], source: DataFrame | None, entity: str, periods_by: Sequence[str]
) -> tuple[DataFrame, int]:
    """(keys, entity, bits, nb_periods) of every entity of a volume, and the longs of a set."""
    periods, last = stored_periods(labelled if source is None else source, periods_by)
    idx = with_period_idx(labelled, periods_by, periods=periods)
    words = bitmaps.words_for(last)
    return bitmaps.presence_bits(idx, [*keys, entity, "nb_periods"], F.col("period_idx"), words), words


def always_present(
    labelled: DataFrame, keys: Sequence[str] = (*EDITION, "volume"), source: DataFrame | None = None,
    entity: str = "page_id", periods_by: Sequence[str] = EDITION,
) -> DataFrame:
    """Entities of a volume that it holds in every period."""
    sets, words = volume_sets(labelled, keys, source, entity, periods_by)
    found = sets.withColumn("nb_occurrences", bitmaps.size("bits", words))
    return found.where("nb_occurrences = nb_periods").select(*dict.fromkeys([*periods_by, *keys]), entity, "nb_occurrences", "nb_periods")


def always_present_share(
    labelled: DataFrame, keys: Sequence[str] = (*EDITION, "volume"), source: DataFrame | None = None,
    entity: str = "page_id", periods_by: Sequence[str] = EDITION,
) -> DataFrame:
    """Always-present entities over the entities of each period: mean and deviation."""
    sets, words = volume_sets(labelled, keys, source, entity, periods_by)
    patterns = stage(bitmaps.patterns(sets, [*keys, "nb_periods"]), "patterns")
    common = patterns.groupBy(*keys).agg(F.sum(F.when(bitmaps.size("bits", words) == F.col("nb_periods"), F.col("n"))).alias("nb_common"))
    share = F.coalesce("nb_common", F.lit(0)) / F.col("nb") * 100
    return bitmaps.counts_by_period(patterns, keys).join(common, list(keys), "left").groupBy(*keys).agg(
        F.coalesce(F.max("nb_common"), F.lit(0)).alias("nb_common"),
        F.avg(share).alias("avg_share"),
        F.stddev_samp(share).alias("std_share"),
    )
