"""Join helpers for a side that is short by nature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from panelytics.session import stage


def attach(rows: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one row per key to many rows without moving the many rows, if the one side is short.

    ``small`` is written to the shared folder, so the planner knows its size from the files. Up to
    ``spark.sql.autoBroadcastJoinThreshold`` it is broadcast and a hot key costs nothing; beyond that it is a shuffle join,
    in which adaptive execution splits hot partitions. No hint, count or memo stands in for the size.
    """
    return rows.join(stage(small, "short"), list(on), how)


def stream_past(rows: DataFrame, lists: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join of many rows with a few rows per key, of which only the latter are held, as a hash table for each partition.

    A sort-merge join would sort the many rows too, in the memory of the task, as many as its partition has. ``lists`` needs a
    bounded number of rows per key; its hash table is the memory of a task, whatever the number of ``rows``.
    """
    return rows.join(lists.hint("shuffle_hash"), list(on))


def few(small: DataFrame) -> DataFrame:
    """A short list, written once so that its size is known where it is joined."""
    return stage(small, "short")
