"""Which rows belong to the same entity: redirects, missing ids, renames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelytics import PANEL_KEYS, WEIGHT
from panelytics.operators.filters import access_views, with_ids
from panelytics.plans import histogram
from panelytics.session import cut_lineage, stage


def _largest(value: str, weight: str, *tie: str) -> Column:
    """Value on the row with the greatest weight; ties by ``tie`` ascending, nulls last.

    A plain aggregate, so every map task sends one candidate per key.
    """
    order = [(-F.col(weight)).alias("w")]
    for i, c in enumerate(tie):
        order += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"t{i}")]
    return F.min_by(value, F.struct(*order))


def main_ids(counts: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """Per title the id with the most counts (of a reference month)."""
    sums = with_ids(counts).groupBy(*keys, "page", "page_id").agg(F.sum("counts").alias("_views"))
    return sums.groupBy(*keys, "page").agg(_largest("page_id", "_views", "page_id").alias("page_id"))


def back_fill_ids(counts: DataFrame, ids: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """Rows with the id of their title; unmatched titles get NULL.

    Counts are summed per title and period first, so a title that holds a
    large share of the rows is one row by the time it is shuffled to its id.
    """
    fixed = [c for c in counts.columns if c not in ("page_id", "counts")]
    sums = counts.groupBy(*fixed).agg(F.sum("counts").alias("counts"))
    return sums.join(ids, [*keys, "page"], "left")


def collapse_redirects(counts: DataFrame, by: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """Views per entity and period, with redirects under their main title.

    A title belongs to the id of its largest row; an id is shown under the
    title of its largest row. Titles whose largest row lacks an id are
    dropped. Three aggregations, each combined before its shuffle; no window
    and no join.
    """
    sums = counts.groupBy(*by, "page", "page_id").agg(F.sum("counts").alias("_views"))
    titles = sums.groupBy(*by, "page").agg(
        _largest("page_id", "_views", "page_id").alias("page_id"),
        F.sum("_views").alias("_all"),
        F.max("_views").alias("_top"),
    )
    return (
        with_ids(titles)
        .groupBy(*by, "page_id")
        .agg(_largest("page", "_top", "page").alias("page"), F.sum("_all").alias(WEIGHT))
    )


def collapse_by_access(counts: DataFrame, by: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """As ``collapse_redirects``, split in desktop and mobile views.

    The main title is chosen per id *and* access type, so the two sides of an
    entity may carry different titles; a missing side is NULL.
    """
    sums = counts.groupBy(*by, "page", "page_id", "access_type").agg(F.sum("counts").alias("_views"))
    titles = sums.groupBy(*by, "page", "access_type").agg(
        F.min(F.struct((-F.col("_views")).alias("w"), F.col("page_id").isNull().alias("n"), "page_id")).alias("_best"),
        F.sum("_views").alias("_all"),
        F.max("_views").alias("_top"),
    )
    # The id of a title comes from all of its access types: a handful of rows each.
    ids = titles.groupBy(*by, "page").agg(F.min("_best").getField("page_id").alias("page_id"))
    sides = with_ids(titles.join(ids, [*by, "page"])).groupBy(*by, "page_id", "access_type").agg(
        _largest("page", "_top", "page").alias("page"), F.sum("_all").alias("_all")
    )
    return sides.where((F.col("access_type") == "desktop") | F.contains(F.col("access_type"), F.lit("mobile"))).groupBy(
        *by, "page", "page_id"
    ).agg(*access_views("_all"))


def title_totals(counts: DataFrame, by: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """Plain sums per title and id."""
    return counts.groupBy(*by, "page", "page_id").agg(F.sum("counts").alias(WEIGHT))


def ranked_panel(totals: DataFrame, by: Sequence[str] = PANEL_KEYS, tie: Sequence[str] = ("page_id",)) -> DataFrame:
    """Last step of the panel build: rank within edition and period.

    Ranks read the totals twice (counts of equal views, then rows), so the
    aggregation behind them is written out first.
    """
    totals = stage(totals, "totals")
    ranked = histogram.curve(totals, by, WEIGHT, tie)
    return ranked.select(*totals.columns, "rank", "fractional_rank")


def unmatched_ids(panel: DataFrame, known: DataFrame, key: str = "page_id") -> DataFrame:
    """Distinct ids of a panel that a table does not know."""
    return with_ids(panel, key).select(key).distinct().join(known.select(key), key, "left_anti")


def remap_ids(panel: DataFrame, redirects: DataFrame, by: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """Send redirect ids to their targets and sum again.

    ``redirects`` has (redirect, target). A redirect listed under several targets goes to the smallest, so
    no view is counted twice. The title of the new id is that of its largest row; ranks follow from ``ranked_panel``.
    """
    one = redirects.groupBy(F.col("redirect").alias("page_id")).agg(F.min("target").alias("target"))
    moved = panel.join(one, "page_id", "left").withColumn(
        "page_id", F.coalesce("target", "page_id")
    )
    return moved.groupBy(*by, "page_id").agg(
        _largest("page", WEIGHT, "page").alias("page"), F.sum(WEIGHT).alias(WEIGHT)
    )


def redirect_map(pages: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(redirect, target) from page records with a list of redirects.

    A record without redirects maps to itself. ``wanted`` keeps its ids only.
    """
    rows = pages.select(F.col("page_id").alias("target"), F.explode_outer("redirects").alias("_r")).select(
        F.coalesce("_r.pageid", "target").alias("redirect"), "target"
    )
    if wanted is None:
        return rows
    return rows.join(wanted.select(F.col("page_id").alias("redirect")), "redirect", "left_semi")


def life_spans(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First and last title of each id, its first period and the one after its last, and its views (rows, if there are none)."""
    views = F.sum(WEIGHT) if WEIGHT in panel.columns else F.count("*")
    return panel.groupBy(*keys, "page_id").agg(
        views.alias("_views"),
        F.min_by("page", F.struct("date", "page")).alias("first_name"),
        F.max_by("page", F.struct("date", "page")).alias("last_name"),
        F.min("date").alias("first_date"),
        F.add_months(F.max("date"), 1).alias("last_date"),
    )


def heirs(spans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spans with ``_heir``: of the ids that begin with the same title in the same period, the one of most views, then least id."""
    start = [*keys, "first_name", "first_date"]
    first = F.min_by("page_id", F.struct((-F.col("_views")).alias("_v"), "page_id"))
    return spans.join(spans.groupBy(*start).agg(first.alias("_first")), start, "left").withColumn("_heir", F.col("page_id") == F.col("_first")).drop("_first")


def succession_map(panel: DataFrame, keys: Sequence[str] = (), fork: bool = False) -> DataFrame:
    """Follow entities whose id changes while the title goes on.

    Id b succeeds a when a's last title is b's first title and b begins in the
    period after a ends. If several ids begin there, one of them is the heir (``heirs``) and the others begin entities of
    their own, so that every id has one end and views are counted once; with ``fork`` each of them succeeds. Pointers are doubled: every round each id jumps to
    the end its successor already knows, so a chain of n ids takes log2(n)
    rounds. Ends only move forward in time, so the loop stops by itself. Each
    round is checkpointed to the shared folder.
    """
    end = [*keys, "last_name", "last_date"]
    ids = life_spans(panel, keys)
    ids = cut_lineage((ids.withColumn("_heir", F.lit(True)) if fork else heirs(ids, keys)).drop("_views"))
    while True:
        nxt = ids.where("_heir").select(
            *keys,
            F.col("first_name").alias("last_name"),
            F.col("first_date").alias("last_date"),
            F.col("last_name").alias("_name"),
            F.col("last_date").alias("_date"),
        ).distinct()
        step = (
            ids.join(nxt, end, "left")
            .select(
                *keys,
                "page_id",
                "first_name",
                "first_date",
                "_heir",
                F.coalesce("_name", "last_name").alias("last_name"),
                F.coalesce("_date", "last_date").alias("last_date"),
                F.col("_name").isNotNull().alias("_moved"),
            )
            .distinct()
        )
        step = cut_lineage(step)
        ids = step.drop("_moved")
        if step.where("_moved").isEmpty():
            break
    newest = F.max_by("page_id", F.struct("first_date", "page_id"))
    ends = ids.groupBy(*end).agg(newest.alias("last_page_id"), F.min("first_date").alias("first_date"))
    return ids.select(*end, F.col("page_id").alias("page_ids")).join(ends, end).select(
        *end, "last_page_id", "first_date", "page_ids"
    )


def apply_identity(panel: DataFrame, identity: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Replace id and title by the last ones; rows without an entry drop out."""
    names = identity.select(
        *keys,
        F.col("page_ids").alias("page_id"),
        "last_page_id",
        "last_name",
        "first_date",
        "last_date",
    )
    kept = [c for c in panel.columns if c not in ("page_id", "page")]
    return panel.join(names, [*keys, "page_id"]).select(
        *kept, F.col("last_page_id").alias("page_id"), F.col("last_name").alias("page"), "first_date", "last_date"
    )


def pages_of_revisions(scores: DataFrame, mapping: DataFrame) -> DataFrame:
    """Scores of revisions joined to the page of each revision."""
    return scores.join(mapping.select("revision_id", "page_id").distinct(), "revision_id")


def attach_items(panel: DataFrame, meta: DataFrame, editions: DataFrame | None = None) -> DataFrame:
    """Add the item id that an entity has in every edition."""
    items = meta.select(F.split_part("wiki_db", F.lit("wiki"), F.lit(1)).alias("project"), "page_id", "item_id")
    if editions is not None:
        items = items.join(editions, "project", "left_semi")
    return panel.join(items, ["project", "page_id"])

