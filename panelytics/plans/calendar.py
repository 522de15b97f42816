"""The distinct periods of a panel and their positions, as a small table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelytics.plans.joins import attach, few


def period_table(source: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, date, period_idx, nb_periods), positions from 1.

    The windows run over the distinct periods only, which are few by nature:
    months or days since records began, per edition.
    """
    group = Window.partitionBy(*keys)
    return source.select(*keys, "date").where("date is not null").distinct().select(
        *keys,
        "date",
        F.row_number().over(group.orderBy("date")).cast("bigint").alias("period_idx"),
        F.count("*").over(group).alias("nb_periods"),
    )


def stored_periods(source: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """``period_table``, stored once for all who read it in one plan, and its highest position."""
    periods = few(period_table(source, keys))
    return periods, periods.agg(F.max("period_idx")).first()[0] or 0


def with_period_idx(
    panel: DataFrame, keys: Sequence[str] = (), source: DataFrame | None = None, periods: DataFrame | None = None
) -> DataFrame:
    """Adds ``period_idx`` and ``nb_periods``: position among existing periods.

    ``source`` gives the periods where ``panel`` may lack some, or where they
    are cheaper to read elsewhere; ``periods`` gives them ready made and stored.
    """
    if periods is not None:
        return panel.join(periods, [*keys, "date"])
    source = panel if source is None else source
    return attach(panel, period_table(source, keys), [*keys, "date"])


def month_number(date: Column | str = "date") -> Column:
    """Months since year 0; differences of first-of-month dates are whole months."""
    return (F.year(date) * 12 + F.month(date)).cast("bigint")


def months_apart(late: Column | str, early: Column | str) -> Column:
    """Whole months between two first-of-month dates."""
    return month_number(late) - month_number(early)
