"""Scans of text dumps, each with a declared schema and one scan for all files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelytics.operators.filters import known_id

# File name patterns and column orders of the public dumps.
COUNT_FILES = r"pageviews-(\d{4})(\d{2})-user"
TRANSITION_FILES = r"clickstream-(\w+)wiki-(\d{4})-(\d{2})"
COUNT_SCHEMA = "project string, page string, page_id string, access_type string, counts bigint, anonym_user string"
TRANSITION_SCHEMA = "prev string, curr string, type string, count bigint"
QUALITY_SCHEMA = "revision_id bigint, score_label string"
RANKED_QUALITY_SCHEMA = (
    "language string, page_id string, page_name string, revision_id string, wikirank_quality double"
)


def month_of_file(pattern: str, year: int, path: Column | None = None) -> Column:
    """First day of the month a file's path names."""
    path = F.col("_metadata.file_path") if path is None else path
    text = F.concat_ws(
        "-", F.regexp_extract(path, pattern, year), F.regexp_extract(path, pattern, year + 1), F.lit("01")
    )
    return F.to_date(text)


BAD_ROW, FILE = "_bad_row", "_file"


def split_rejects(spark: SparkSession, paths: str | Sequence[str], schema: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """Rows of delimited files that fit a schema, and those that do not: (file, reason, record).

    ``reason`` is ``columns`` for a record with more or fewer of them, ``value`` for one with a value of another type. Of a file
    that breaks off, such as a damaged gzip member, the records before the break are read; the rest of the file is skipped. Both
    frames come from one plan over the same scan, so no record is in both or in neither.
    """
    paths = paths if isinstance(paths, str) else list(paths)
    whole = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField(BAD_ROW, T.StringType())])
    lines = spark.read.option("ignoreCorruptFiles", "true").text(paths).where("value <> ''")
    extra = [c for c in lines.columns if c != "value"]  # partitions of the folder
    own = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_ROW, **options}
    parsed = F.from_csv("value", whole.simpleString()[len("struct<") : -1].replace(":", " "), own)
    rows = lines.select(*extra, F.col("_metadata.file_path").alias(FILE), parsed.alias("_r"))
    parts = F.size(F.split(f"_r.{BAD_ROW}", r"\Q" + options.get("sep", ",") + r"\E", -1))
    reason = F.when(parts != len(whole) - 1, "columns").otherwise("value")
    bad = rows.where(F.col(f"_r.{BAD_ROW}").isNotNull()).select(F.col(FILE).alias("file"), reason.alias("reason"), F.col(f"_r.{BAD_ROW}").alias("record"))
    kept = rows.where(F.col(f"_r.{BAD_ROW}").isNull()).select("_r.*", *extra, FILE).drop(BAD_ROW)
    return kept, bad


def read_counts_and_rejects(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """As ``read_counts``, with records that do not fit in a table of their own instead of as rows of nulls."""
    rows, bad = split_rejects(spark, paths, COUNT_SCHEMA, sep=" ", quote="", nullValue="\\N")
    rows = rows.withColumn("page_id", known_id(F.col("page_id"))).withColumn("date", month_of_file(COUNT_FILES, 1, F.col(FILE)))
    return rows.drop(FILE), bad


def read_counts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Monthly count dumps: space-separated, without header or quoting."""
    rows = spark.read.schema(COUNT_SCHEMA).csv(
        paths if isinstance(paths, str) else list(paths), sep=" ", quote="", nullValue="\\N"
    )
    return rows.withColumn("page_id", known_id(F.col("page_id"))).withColumn("date", month_of_file(COUNT_FILES, 1))


def read_transitions(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Monthly transition dumps: tab-separated, without header or quoting."""
    rows = spark.read.schema(TRANSITION_SCHEMA).csv(
        paths if isinstance(paths, str) else list(paths), sep="\t", quote=""
    )
    path = F.col("_metadata.file_path")
    return rows.withColumn("project", F.regexp_extract(path, TRANSITION_FILES, 1)).withColumn(
        "date", month_of_file(TRANSITION_FILES, 2)
    )


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """Quality labels, one JSON object per line."""
    return spark.read.schema(QUALITY_SCHEMA).json(path)


def read_ranked_quality(spark: SparkSession, path: str, project: str) -> DataFrame:
    """Quality scores of one edition from a tab-separated file of all editions."""
    rows = spark.read.schema(RANKED_QUALITY_SCHEMA).csv(path, sep="\t", header=True, quote="")
    return rows.where(F.col("language") == project)


def read_reference_series(spark: SparkSession, path: str) -> DataFrame:
    """Published monthly totals, summed per month."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    # The text names the month; reading it as an instant would depend on the zone.
    month = F.to_date(F.concat(F.substring("month", 1, 7), F.lit("-01")))
    return rows.groupBy(month.alias("date")).agg(
        F.sum(F.col("`total.total`").cast("bigint")).alias("tot_views")
    )
