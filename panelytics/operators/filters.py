"""Row filters and projections over raw counts and panels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelytics.functions.namespaces import NAMESPACE_TERMS, SPECIAL_PAGES
from panelytics.plans.joins import attach


def as_list(values: Sequence[str], name: str) -> list[str]:
    """A bare string would be taken letter by letter; refuse it."""
    if isinstance(values, str):
        raise TypeError(f"{name} must be a list of strings, not one string")
    return list(values)


def edition(project: Column) -> Column:
    """Text before the first dot: ``en.wiki`` gives ``en``."""
    return F.split_part(project, F.lit("."), F.lit(1))


def editions_and_periods(
    counts: DataFrame,
    projects: Sequence[str],
    dates: Sequence[str | dt.date] | None = None,
    site: str = "wikipedia",
) -> DataFrame:
    """Rows of the wanted editions (``<edition>.<site>``) and periods.

    Both tests are on stored columns, so they reach the scan.
    """
    names = [f"{p}.{site}" for p in as_list(projects, "projects")]
    rows = counts.where(F.col("project").isin(names))
    if dates is not None:
        rows = rows.where(F.col("date").isin(as_list(dates, "dates")))
    return rows.select(
        "page",
        F.col("counts").cast("bigint").alias("counts"),
        "date",
        "page_id",
        "access_type",
        edition(F.col("project")).alias("project"),
    )


def known_id(page_id: Column) -> Column:
    """NULL for both kinds of missing id: SQL NULL and the text ``null``."""
    return F.nullif(page_id, F.lit("null"))


def with_ids(df: DataFrame, column: str = "page_id") -> DataFrame:
    """Rows that have an id."""
    has = F.col(column).isNotNull()
    if isinstance(df.schema[column].dataType, T.StringType):
        has &= F.col(column) != "null"
    return df.where(has)


def drop_specials(df: DataFrame, min_count: int = 1, names: Sequence[str] = SPECIAL_PAGES) -> DataFrame:
    """Without service pages and rows below ``min_count``."""
    return df.where(~F.col("page").isin(list(names)) & (F.col("counts") >= min_count))


def in_namespace(page: Column, terms: Sequence[str]) -> Column:
    """True if any term occurs anywhere in the title (case-sensitive)."""
    return reduce(or_, [F.contains(page, F.lit(t)) for t in terms], F.lit(False))


def drop_namespaces(
    df: DataFrame,
    projects: Sequence[str],
    rules: Mapping[str, Sequence[str]] = NAMESPACE_TERMS,
    mode: str = "per_row",
) -> DataFrame:
    """Without titles that are not articles.

    ``per_row`` tests each row by its own edition. ``first_match`` tests all
    rows by the first edition in ``rules`` that is asked for, as older data
    sets were built. Editions without rules pass.
    """
    wanted = as_list(projects, "projects")
    ruled = [p for p in rules if p in wanted]
    if not ruled:
        return df
    page = F.col("page")
    if mode == "first_match":
        return df.where(~in_namespace(page, rules[ruled[0]]))
    if mode != "per_row":
        raise ValueError(f"unknown mode {mode}")
    hit = [(F.col("project") == p) & in_namespace(page, rules[p]) for p in ruled]
    return df.where(~reduce(or_, hit))


def articles(
    counts: DataFrame,
    projects: Sequence[str],
    dates: Sequence[str | dt.date] | None = None,
    site: str = "wikipedia",
    rules: Mapping[str, Sequence[str]] = NAMESPACE_TERMS,
    mode: str = "per_row",
) -> DataFrame:
    """The three filters of the panel build in one pass over the raw counts."""
    rows = editions_and_periods(counts, projects, dates, site)
    return drop_namespaces(drop_specials(rows), projects, rules, mode)


def access_views(counts: str = "counts") -> list[Column]:
    """Conditional sums for desktop and mobile; NULL where a side has no rows."""
    access = F.col("access_type")
    return [
        F.sum(F.when(access == "desktop", F.col(counts))).alias("desktop_views"),
        F.sum(F.when(F.contains(access, F.lit("mobile")), F.col(counts))).alias("mobile_views"),
    ]


def up_to(df: DataFrame, last: str | dt.date) -> DataFrame:
    """Periods up to and including ``last``."""
    return df.where(F.col("date") <= F.lit(last).cast("date"))


def without_periods(df: DataFrame, dates: Sequence[str | dt.date]) -> DataFrame:
    return df.where(~F.col("date").isin([F.lit(d).cast("date") for d in as_list(dates, "dates")]))


def rank_steps(ranked: DataFrame, step: int) -> DataFrame:
    """Systematic sample: rank 1 and every ``step``-th rank."""
    return ranked.where((F.col("rank") % step == 0) | (F.col("rank") == 1))


# Slots of a key: the first five hexadecimal digits of its hash.
SLOTS = 16**5


def key_slot(key: Column, seed: int) -> Column:
    """Slot of a key, from an MD5 that every database has."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 5), 16, 10).cast("bigint")


def key_sample(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """The same keys on every run: a hash of the key decides, not the row order."""
    return df.where(key_slot(F.col(key), seed) < int(fraction * SLOTS))


# Leading bits of the hash that tell the cells of an exact sample.
SAMPLE_CELL_BITS, HASH_DIGITS = 12, 15


def sample_order(key: Column, seed: int) -> Column:
    """The order of an exact sample: fifteen hexadecimal digits of an MD5 that every database has."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, HASH_DIGITS), 16, 10).cast("bigint")


def exact_sample(df: DataFrame, by: Sequence[str], size: Column | int, key: str, seed: int = 0) -> DataFrame:
    """Exactly ``size`` rows of each group (all, if it has fewer), the same ones whatever the layout: those of smallest hash.

    ``size`` may be a column that is constant in its group. Rows are counted in cells of the hash's leading bits; cells before
    the last one are taken whole and only the last one is sorted, so neither the group nor the sample passes one task. Rows of
    equal keys are taken in the order of the key; keys should be unique in a group. Null groups are groups, null keys come last.
    """
    size = F.lit(size) if isinstance(size, int) else size
    order = F.when(F.col(key).isNull(), F.lit(1 << 60)).otherwise(sample_order(F.col(key), seed))
    own = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"_g{i}") for i, c in enumerate(by)]
    group = [f"_g{i}" for i in range(len(by))]
    rows = df.select("*", *own, order.alias("_h"), size.cast("bigint").alias("_k"))
    rows = rows.withColumn("_cell", F.shiftright("_h", 4 * HASH_DIGITS - SAMPLE_CELL_BITS))
    cells = rows.groupBy(*group, "_cell").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    placed = attach(rows, cells.withColumn("_skip", before), [*group, "_cell"])
    whole = placed.where(F.col("_skip") + F.col("_n") <= F.col("_k"))
    last = placed.where((F.col("_skip") < F.col("_k")) & (F.col("_skip") + F.col("_n") > F.col("_k")))
    place = F.row_number().over(Window.partitionBy(*group, "_cell").orderBy("_h", key))
    last = last.withColumn("_place", place).where(F.col("_place") <= F.col("_k") - F.col("_skip"))
    return whole.select(*df.columns).unionByName(last.select(*df.columns))


def fill_views(df: DataFrame, columns: Sequence[str], value: int = 0) -> DataFrame:
    return df.fillna(value, subset=list(columns))
