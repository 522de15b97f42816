"""Stage outputs and small dimension tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelytics import PANEL_KEYS

# Sources that are no pages, with their ids.
PSEUDO_PAGES = {"other-search": "-1", "other-internal": "-2", "other-external": "-3"}


def write_panel(panel: DataFrame, path: str, by: Sequence[str] = PANEL_KEYS, mode: str = "error") -> None:
    """Panel as Parquet by edition and period, so reads prune to what they need.

    Rebalancing gives files of even size: adaptive execution merges small
    periods into one task and splits an edition that dominates the panel.
    """
    panel.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def read_panel(spark: SparkSession, *paths: str) -> DataFrame:
    """One panel or the union of several stage outputs."""
    frames = [spark.read.parquet(p) for p in paths]
    out = frames[0]
    for each in frames[1:]:
        out = out.unionByName(each)
    return out.withColumn("date", F.col("date").cast("date"))


def write_report(df: DataFrame, path: str) -> None:
    """Report rows as gzipped CSV with a header."""
    df.write.option("compression", "gzip").csv(path, header=True)


def pseudo_pages(panel: DataFrame) -> DataFrame:
    """The pseudo-pages for every period of a panel, labelled by their own name."""
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("page_id"), F.lit(p).alias("page"), F.lit(p).alias("volume"))
            for p, i in PSEUDO_PAGES.items()
        ]
    )
    return panel.select("date").distinct().select("date", F.explode(rows).alias("_p")).select("date", "_p.*")


def dimension(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A short table typed in by hand, e.g. published page counts."""
    return spark.createDataFrame(list(rows), schema)


def embeddings(table: DataFrame, key: str = "page_id", column: str = "embedding") -> DataFrame:
    """Array column as an ML vector."""
    return table.select(key, array_to_vector(F.col(column).cast("array<double>")).alias("embed"))
