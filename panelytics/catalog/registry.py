"""Registry of queries: a Spark function and, where SQL can say it, its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelytics.plans.views import TABLES, VIEWS, Tables, with_needs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` may use views and fragments."""

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return keep


def with_views(sql: str) -> str:
    """Put the views a text uses in front of it as common table expressions."""
    used = with_needs([v for v in VIEWS if re.search(rf"\b{v}\b", sql)])
    heads = [f"{v} AS ({VIEWS[v].strip()})" for v in used]
    text = sql.strip()
    opening = re.match(r"WITH\s+(RECURSIVE\s+)?", text)
    recursive = "RECURSIVE " if opening and opening.group(1) else ""
    if opening:
        rest = text[opening.end():]
        body = f", {rest}" if heads else rest
    else:
        body = f" {text}"
    if not heads and not opening:
        return text
    return f"WITH {recursive}" + ", ".join(heads) + body


def key_slot_sql(key: str, seed: int) -> str:
    """The slot of ``filters.key_slot``."""
    return f"CAST('0x' || substr(md5({key} || ':{seed}'), 1, 5) AS BIGINT)"


def used_tables(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def curve_sql(panel: str, tie: str = "page_id", by: str = "project, date") -> str:
    """Fragment: rk (ranks), pc (curve), gr (slopes), hg (hinges), vol (labels)."""
    return f"""
rk AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY tot_count_views DESC, {tie}) AS rank FROM {panel}),
cv AS (SELECT *, CAST(SUM(tot_count_views) OVER (PARTITION BY {by} ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_views,
              CAST(SUM(tot_count_views) OVER (PARTITION BY {by}) AS BIGINT) AS tot_views,
              COUNT(*) OVER (PARTITION BY {by}) AS nb_pages FROM rk),
pc AS (SELECT *, cum_views / tot_views * 100 AS perc_views, rank / nb_pages * 100 AS perc_rank FROM cv),
gr AS (SELECT *, (lead(perc_views) OVER (PARTITION BY {by} ORDER BY rank)
                - lag(perc_views) OVER (PARTITION BY {by} ORDER BY rank)) / 2 AS d_perc_views FROM pc),
hg AS (SELECT {by}, arg_min(perc_views, rank) AS hinge_perc, arg_min(perc_rank, rank) AS hinge_rank
       FROM gr WHERE d_perc_views <= CAST(100 AS DOUBLE) / nb_pages GROUP BY {by}),
vol AS (SELECT pc.*, hinge_perc, hinge_rank, CASE WHEN perc_views <= hinge_perc THEN 'core' ELSE 'tail' END AS volume
        FROM pc JOIN hg USING ({by}))"""


def labels_sql(panel: str, columns: str) -> str:
    """Fragment ``lb`` with ``columns``, rank and volume only: one window order, no column that is not asked for."""
    return f"""
od AS (SELECT project, date, {columns}, row_number() OVER w AS rank, COUNT(*) OVER (PARTITION BY project, date) AS n,
    CAST(SUM(tot_count_views) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) / CAST(SUM(tot_count_views) OVER (PARTITION BY project, date) AS BIGINT) * 100 AS perc
    FROM {panel} WINDOW w AS (PARTITION BY project, date ORDER BY tot_count_views DESC, page_id)),
sl AS (SELECT project, date, perc, n, (lead(perc) OVER w - lag(perc) OVER w) / 2 AS d FROM od WINDOW w AS (PARTITION BY project, date ORDER BY rank)),
hp AS (SELECT project, date, MIN(perc) AS hinge FROM sl WHERE d <= CAST(100 AS DOUBLE) / n GROUP BY project, date),
lb AS (SELECT od.project, od.date, {columns}, rank, CASE WHEN perc <= hinge THEN 'core' ELSE 'tail' END AS volume
    FROM od JOIN hp ON hp.project = od.project AND hp.date = od.date)"""
