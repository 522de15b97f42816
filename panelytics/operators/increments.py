"""A panel that grows by months: each addition reads the rows it brings and the months beside them.

A store is a folder of tables by edition and period. ``months`` is the manifest: one row for each period, with its totals and
its hinge. ``weights`` is the histogram of weights, which can be added up over any set of periods. ``volumes`` holds the rows
with their side of the hinge, ``flux`` the sizes of what came and left. Ranks and hinges belong to one period, so they are made
from its own rows; flux compares a period with those beside it, so the periods around an addition are counted again. Partitions are
replaced by dynamic overwrite and read by filters on their keys, so files of other periods are not opened.

Adding a period that is there replaces it; periods may come in any order. The result is that of one build over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelytics import PANEL_KEYS, WEIGHT
from panelytics.operators import hinge, overlap
from panelytics.plans.histogram import weight_blocks
from panelytics.session import stage

EDITION, PERIOD = PANEL_KEYS
MONTHS = "nb_pages bigint, tot_views bigint, nb_core bigint"
FLUX = "nb_tot_pages bigint, nb_incoming bigint, nb_outgoing bigint, perc_incoming double, perc_outgoing double"


def _write(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PANEL_KEYS).parquet(f"{folder}/{name}")


def _read(spark: SparkSession, folder: str, name: str, columns: T.StructType) -> DataFrame:
    """With its schema given, so that no file is opened to learn it."""
    schema = T.StructType([*columns.fields, T.StructField(EDITION, T.StringType()), T.StructField(PERIOD, T.DateType())])
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def _name() -> Column:
    return F.concat_ws("|", EDITION, F.col(PERIOD).cast("string"))


def months(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest."""
    return _read(spark, folder, "months", T.StructType.fromDDL(MONTHS))


def flux(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the flux of every period, as ``overlap.flux_sizes`` gives them."""
    return _read(spark, folder, "flux", T.StructType.fromDDL(FLUX))


def weights(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of each period have each weight."""
    return _read(spark, folder, "weights", T.StructType.fromDDL(f"{WEIGHT} bigint, _n bigint"))


def volumes(spark: SparkSession, folder: str, rows: T.StructType) -> DataFrame:
    """Labelled rows; ``rows`` is the schema of the rows that were added."""
    own = [f for f in rows.fields if f.name not in PANEL_KEYS]
    return _read(spark, folder, "volumes", T.StructType([*own, T.StructField("volume", T.StringType())]))


def hinges(spark: SparkSession, folder: str, eps: float = 1) -> DataFrame:
    """Hinge points of all periods from their histograms; no rows are read."""
    blocks = weight_blocks(weights(spark, folder), PANEL_KEYS, WEIGHT)
    return hinge.flat_points(blocks, PANEL_KEYS, [eps]).drop("eps")


def around(spark: SparkSession, folder: str, added: DataFrame, reach: int) -> list[str]:
    """Names of the added periods and of ``reach`` existing ones on either side; a list of keys, not of rows."""
    life = Window.partitionBy(EDITION).orderBy(PERIOD)
    new = added.select(*PANEL_KEYS).distinct().withColumn("_new", F.lit(True))
    known = months(spark, folder).select(*PANEL_KEYS).join(new, list(PANEL_KEYS), "left")
    near = F.coalesce(F.max("_new").over(life.rowsBetween(-reach, reach)), F.lit(False))
    return [r[0] for r in known.select(_name().alias("name"), near.alias("near")).where("near").select("name").collect()]


def add_periods(spark: SparkSession, folder: str, rows: DataFrame, eps: float = 1) -> None:
    """Add the periods of ``rows`` (whole periods of a panel) to the store, or replace them there."""
    rows = stage(rows.where(F.col(EDITION).isNotNull() & F.col(PERIOD).isNotNull()), "added")
    _write(rows.groupBy(*PANEL_KEYS, WEIGHT).agg(F.count("*").alias("_n")), folder, "weights")
    labelled = stage(hinge.volume_labels(rows, eps, everyone=True), "labelled")
    _write(labelled, folder, "volumes")
    core = F.count_if(F.col("volume") == "core").alias("nb_core")
    totals = labelled.groupBy(*PANEL_KEYS).agg(F.count("*").alias("nb_pages"), F.sum(WEIGHT).alias("tot_views"), core)
    _write(totals, folder, "months")
    changed, needed = (around(spark, folder, totals, reach) for reach in (1, 2))
    known = volumes(spark, folder, rows.schema).where(_name().isin(needed)).where("volume = 'core'")
    marked = overlap.mark_flux(known.select(*PANEL_KEYS, "page_id"), source=months(spark, folder))
    _write(overlap.flux_sizes(marked).where(_name().isin(changed)), folder, "flux")
