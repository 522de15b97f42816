"""Views that give the test tables the shapes of a page-view panel.

The same text runs in Spark and in DuckDB.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelytics import PANEL_KEYS, WEIGHT
from panelytics.operators.hinge import volume_labels
from panelytics.session import stage_folder
from panelytics.sources.tables import write_panel

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "v_counts": """
        SELECT CASE l_returnflag WHEN 'A' THEN 'aa' WHEN 'N' THEN 'nn' ELSE 'rr' END
                 || CASE WHEN l_suppkey % 20 = 3 THEN '.books' ELSE '.wiki' END AS project,
               CASE WHEN l_suppkey = 1 THEN 'Main_Page'
                    WHEN l_suppkey % 25 = 2 THEN 'Talk:' || p_name
                    WHEN l_linenumber % 4 = 0 THEN 'alias_' || p_brand || '_' || CAST(l_partkey % 50 AS STRING)
                    ELSE p_name || '_' || CAST(l_partkey % 20 AS STRING) END AS page,
               CASE WHEN l_linenumber = 7 THEN CAST(NULL AS STRING)
                    WHEN l_suppkey % 10 = 0 THEN 'null'
                    ELSE CAST(l_partkey AS STRING) END AS page_id,
               CASE WHEN l_linestatus = 'O' THEN 'desktop'
                    WHEN l_suppkey % 2 = 0 THEN 'mobile-web' ELSE 'mobile-app' END AS access_type,
               CAST(l_quantity AS BIGINT) - 1 AS counts,
               CAST(date_trunc('month', l_shipdate) AS DATE) AS date
        FROM lineitem JOIN part ON l_partkey = p_partkey
    """,
    "v_panel": """
        SELECT l_returnflag AS project, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
               l_partkey AS page_id, CAST(l_partkey AS STRING) || '_' || p_name AS page,
               CAST(SUM(l_quantity) AS BIGINT) AS tot_count_views
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4
    """,
    "v_panel_all": """
        SELECT 'all' AS project, date, page_id, page, CAST(SUM(tot_count_views) AS BIGINT) AS tot_count_views
        FROM v_panel GROUP BY 1, 2, 3, 4
    """,
    "v_supply": """
        SELECT 'all' AS project, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey AS page_id,
               's' || CAST(l_suppkey AS STRING) AS page, CAST(SUM(l_quantity) AS BIGINT) AS tot_count_views
        FROM lineitem GROUP BY 1, 2, 3, 4
    """,
    "v_daily": """
        SELECT event_type AS project, CAST(ts AS DATE) AS date, user_id AS page_id,
               'u' || CAST(user_id AS STRING) AS page, CAST(COUNT(*) AS BIGINT) AS tot_count_views
        FROM events GROUP BY 1, 2, 3, 4
    """,
    "v_succession": """
        SELECT l_suppkey * 100 + year(l_shipdate) - 1990 AS page_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
               't' || CAST(l_suppkey AS STRING) || '_' ||
                 CAST(CAST(floor((year(l_shipdate) * 12 + month(l_shipdate) + 5) / 12) AS INT) AS STRING) AS page,
               CAST(SUM(l_quantity) AS BIGINT) AS tot_count_views
        FROM lineitem GROUP BY 1, 2, 3
    """,
    "v_redirects": """
        SELECT CAST(p_partkey AS BIGINT) AS redirect, CAST(p_partkey - 1 AS BIGINT) AS target
        FROM part WHERE p_partkey % 10 = 1 AND p_partkey > 1
    """,
    "v_meta": """
        SELECT p_partkey AS page_id, 'Q' || CAST(p_partkey AS STRING) AS item_id,
               make_date(CAST(1993 + p_partkey % 8 AS INT), CAST(1 + p_partkey % 12 AS INT), 1) AS creation_date,
               CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS is_orphan,
               CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS is_bot_created,
               CASE WHEN p_size % 11 = 0 THEN 1 ELSE 0 END AS is_disambiguation,
               CAST(p_partkey % 1000 AS DOUBLE) / 1000 AS pred_qual, p_size AS in_main, p_partkey % 97 AS out_main
        FROM part WHERE p_partkey % 13 <> 0
    """,
    "v_topics": """
        SELECT p_partkey AS page_id, 'type.' || p_type || '*' AS topic, CAST(0.9 AS DOUBLE) AS score FROM part WHERE p_partkey % 17 <> 0
        UNION ALL SELECT p_partkey, 'brand.' || p_brand, CAST(p_partkey % 5 AS DOUBLE) / 10 + CAST(0.5 AS DOUBLE) FROM part WHERE p_partkey % 3 <> 0
        UNION ALL SELECT p_partkey, 'size.' || CAST(p_size AS STRING), CAST(0.2 AS DOUBLE) FROM part
    """,
    "v_quality": """
        SELECT l.doc_id AS revision_id, l.doc_id % 2000 + 1 AS page_id,
               CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'FA' WHEN l.quality = 1 THEN 'B'
                    WHEN l.toxic = 0 THEN 'Start' ELSE 'Stub' END AS score_label FROM labels l
    """,
    "v_editions": """
        SELECT lang AS project, doc_id AS page_id, CAST(n_chars AS BIGINT) AS counts, source FROM documents
    """,
    "v_links": """
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
               CASE l_suppkey % 8 WHEN 0 THEN 'other-search' WHEN 1 THEN 'other-external' WHEN 2 THEN 'other-internal'
                    WHEN 3 THEN 'other-empty' WHEN 4 THEN 'other-other'
                    ELSE CAST(l_orderkey % 2000 + 1 AS STRING) END AS prev,
               CAST(l_partkey AS STRING) AS curr,
               CASE WHEN l_suppkey % 8 < 5 THEN 'external' WHEN l_linestatus = 'O' THEN 'link' ELSE 'other' END AS type,
               CAST(l_quantity AS BIGINT) AS count
        FROM lineitem
    """,
    "v_ref_series": """
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(COUNT(*) AS BIGINT) AS tot_views
        FROM orders GROUP BY 1
    """,
    "v_vec": """
        SELECT vec_id AS page_id, embedding, label FROM embeddings
    """,
}

# Views that read another view.
NEEDS = {"v_panel_all": ("v_panel",)}


def with_needs(names: list[str] | tuple[str, ...]) -> list[str]:
    """Names with what they build on, in an order that can be defined."""
    ordered: list[str] = []
    for name in names:
        for each in (*NEEDS.get(name, ()), name):
            if each not in ordered:
                ordered.append(each)
    return ordered


# Views that stand for stored tables; a session writes each once.
SHARED = (
    "v_counts", "v_panel", "v_panel_all", "v_daily", "v_supply", "v_succession", "v_topics", "v_meta", "v_links",
)

# Of these, panels that are summed where their folders are written.
DEALT = ("v_panel", "v_panel_all")
# A period of an edition goes to this many tasks at most.
PARTS = 8


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows in one shuffle by ``keys`` and a part of the entities, ``_part``, so that sums by more columns than these need no other."""
    return rows.withColumn("_part", F.pmod(F.xxhash64("page_id"), F.lit(PARTS))).repartition(*keys, "_part")


def summed(rows: DataFrame, weight: str) -> DataFrame:
    """The panel of dealt rows: weights summed by edition, period and entity, as the views' SQL does."""
    return rows.groupBy(*PANEL_KEYS, "_part", "page_id", "page").agg(F.sum(weight).cast("bigint").alias(WEIGHT))


_shared: dict[tuple, DataFrame] = {}
#: Seconds that writing each stored frame took, so that a bench can tell it from the query that came first.
STORE_SECONDS: dict[str, float] = {}


class Tables:
    """The tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def shared(self, name: str, build: Callable[[], DataFrame], layout: str = "moved") -> DataFrame:
        """A stage output that many queries read, written once to the shared folder.

        It is the panel a pipeline would store: by edition and period where it has both, so that filters on them
        prune files, and read again with only the columns that a query needs. ``layout`` saves the shuffle for that: rows
        that lie by edition and period already are ``placed`` in their folders, and ``flat`` has no folders.
        """
        slot = (self.spark.sparkContext.applicationId, self.folder, name)
        if slot not in _shared:
            began, inner = time.time(), sum(STORE_SECONDS.values())
            df = build()
            path = stage_folder(self.spark, name.replace(" ", "-"))
            if layout == "flat" or not set(PANEL_KEYS) <= set(df.columns):
                df.write.parquet(path)
            elif layout == "placed":
                df.write.partitionBy(*PANEL_KEYS).parquet(path)
            else:
                write_panel(df, path)
            _shared[slot] = self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
            # Without what frames it builds on took.
            STORE_SECONDS[f"{self.folder}:{name}"] = time.time() - began - (sum(STORE_SECONDS.values()) - inner)
        return _shared[slot]

    def _build(self, name: str) -> DataFrame:
        text = VIEWS[name]
        for each in TABLES:
            if each in text:
                self.table(each).createOrReplaceTempView(each)
        for each in NEEDS.get(name, ()):
            self.view(each).createOrReplaceTempView(each)
        return self.spark.sql(text)

    def _lines(self) -> DataFrame:
        """Order lines with the columns that ``v_panel`` sums."""
        month = F.date_trunc("month", "l_shipdate").cast("date")
        page = F.concat(F.col("l_partkey").cast("string"), F.lit("_"), F.col("p_name"))
        lines = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        return lines.select(F.col("l_returnflag").alias("project"), month.alias("date"), F.col("l_partkey").alias("page_id"), page.alias("page"), "l_quantity")

    def plan(self, name: str) -> DataFrame:
        """A view as a plan, with nothing stored. Panels are summed in one shuffle, all editions in the one that sums each."""
        if name == "v_panel":
            return summed(dealt(self._lines(), *PANEL_KEYS), "l_quantity").drop("_part")
        if name == "v_panel_all":
            each = summed(dealt(self._lines(), "date"), "l_quantity")
            return summed(each.withColumn("project", F.lit("all")), WEIGHT).drop("_part")
        return self._build(name)

    def view(self, name: str) -> DataFrame:
        if name in SHARED:
            return self.shared(name, lambda: self.plan(name), "placed" if name in DEALT else "moved")
        return self._build(name)

    def volumes(self, name: str = "v_panel") -> DataFrame:
        """The panel labelled core / tail, shared by most analyses."""
        keep = ["project", "date", "page_id", "page", "tot_count_views", "volume"]
        layout = "placed" if name in DEALT else "moved"  # labels leave the rows where they were read
        return self.shared(f"volumes of {name}", lambda: volume_labels(self.view(name)).select(*keep), layout)

    def core(self, name: str = "v_panel") -> DataFrame:
        return self.volumes(name).where("volume = 'core'")
