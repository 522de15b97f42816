"""Take up monthly count dumps as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelytics.operators.filters import known_id
from panelytics.sources.dumps import COUNT_FILES, COUNT_SCHEMA, month_of_file


def arriving_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of ``read_counts`` as a stream over the files of a folder."""
    rows = spark.readStream.schema(COUNT_SCHEMA).csv(
        folder, sep=" ", quote="", nullValue="\\N", recursiveFileLookup=True
    )
    return rows.withColumn("page_id", known_id(F.col("page_id"))).withColumn("date", month_of_file(COUNT_FILES, 1))


def append_arrivals(counts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what is new to a table by month, then stop.

    The checkpoint in shared storage remembers the files, so each is read
    exactly once, also after a failure.
    """
    return (
        counts.writeStream.format("parquet")
        .partitionBy("date")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )
