"""Topics, quality, flags and degrees of entities, by volume."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import StandardScaler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelytics.functions.statistics import log2_ratio, steady_avg, steady_error95, steady_std
from panelytics.functions.topics import most_specific, parse_topics
from panelytics.operators.lifetime import with_baseline
from panelytics.operators.overlap import with_share
from panelytics.plans.joins import stream_past

VOLUME = ("project", "volume")

# Quality labels from worst to best.
QUALITY_ORDER = {"Stub": 0, "Start": 1, "B": 2, "C": 3, "GA": 4, "FA": 5}


def parsed_topics(raw: DataFrame) -> DataFrame:
    """One row per topic of a text list, with the first and the most specific one."""
    names = raw.select("page_id", parse_topics(F.col("topics")).alias("_t"))
    return names.select(
        "page_id",
        F.get("_t", F.lit(0)).alias("topics_unique"),
        most_specific(F.col("_t")).alias("topics_specific_unique"),
        F.explode("_t").alias("topics"),
    )


def scored_topics(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Topics of each entity by score, from ``least`` on, and the most specific.

    A list holds one entry per topic of the taxonomy at most.
    """
    kept = rows.where(F.col("score").cast("double") >= least)
    lists = kept.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("score", "topic")), asc=False).alias("_l")
    )
    topics = F.col("_l.topic")
    return lists.select("page_id", topics.alias("topics"), most_specific(topics).alias("topic"))


def edition_metadata(meta: DataFrame, project: str) -> DataFrame:
    """Metadata of one edition with the creation month as ``YYYY-MM``."""
    rows = meta.where(F.col("wiki_db") == f"{project}wiki")
    return rows.withColumn("creation_date", F.substring("page_creation_timestamp", 1, 7))


def topic_counts(panel: DataFrame, topics: DataFrame, by: Sequence[str] = (*VOLUME, "date")) -> DataFrame:
    """Rows per topic; each (entity, topic) counts once."""
    joined = stream_past(panel, topics.select("page_id", "topic").distinct(), ["page_id"])
    return joined.groupBy(*by, "topic").agg(F.count("*").alias("nb_pages"))


def topic_counts_with_baseline(
    panel: DataFrame, topics: DataFrame, by: Sequence[str] = (*VOLUME, "date"), name: str = "all"
) -> DataFrame:
    """``topic_counts`` of the volumes and of the whole panel, which is their sum: rows meet their topics once."""
    counts = with_baseline(topic_counts(panel, topics, by), name)
    return counts.groupBy(*by, "topic").agg(F.sum("nb_pages").alias("nb_pages"))


def topic_shares(counts: DataFrame, by: Sequence[str] = VOLUME) -> DataFrame:
    """Share of each topic per period, then its mean over periods."""
    shares = with_share(counts, [*by, "date"], name="perc_pages")
    return shares.groupBy(*by, "topic").agg(
        steady_avg("perc_pages").alias("mean"), steady_std("perc_pages").alias("std"),
        steady_error95("perc_pages").alias("error"), F.count("*").alias("nb_periods"),
    )


def join_loss(panel: DataFrame, known: DataFrame, by: Sequence[str] = (*VOLUME, "date")) -> DataFrame:
    """Rows whose entity a table knows, and the percentage lost, in one pass."""
    flagged = panel.join(known.select("page_id").distinct().withColumn("_hit", F.lit(1)), "page_id", "left")
    matched, total = F.count("_hit"), F.count("*")
    return flagged.groupBy(*by).agg(
        total.alias("nb_tot"), matched.alias("nb_match"), ((total - matched) / total * 100).alias("loss")
    )


def quality_shares(
    panel: DataFrame, quality: DataFrame, by: Sequence[str] = VOLUME, order: Mapping[str, int] = QUALITY_ORDER
) -> DataFrame:
    """Rows and percentage per quality label, with the rank of the label."""
    counts = panel.join(quality.select("page_id", "score_label"), "page_id").groupBy(*by, "score_label").agg(
        F.count("*").alias("nb_pages")
    )
    ranks = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    return with_share(counts, by, name="percentage").withColumn(
        "score_ordering", F.try_element_at(ranks, F.col("score_label"))
    )


def flag_shares(
    panel: DataFrame, meta: DataFrame, flags: Sequence[str], keys: Sequence[str] = ("project",)
) -> DataFrame:
    """Percentage of rows with each flag by volume and overall, in one rollup."""
    joined = panel.join(meta.select("page_id", *flags), "page_id")
    shares = [(F.count_if(F.col(f) == 1) / F.count("*") * 100).alias(f) for f in flags]
    grouped = joined.rollup(*keys, "volume").agg(F.grouping_id().alias("_level"), F.count("*").alias("nb_pages"), *shares)
    # Level 0 has the volume, level 1 is the whole edition.
    return grouped.where("_level <= 1").withColumn("volume", F.coalesce("volume", F.lit("all"))).drop("_level")


def flag_enrichment(shares: DataFrame, flags: Sequence[str], keys: Sequence[str] = ("project",)) -> DataFrame:
    """log2 of the share in a volume over the overall share, per flag."""
    long = shares.unpivot([*keys, "volume"], list(flags), "feature", "share")
    base = long.where("volume = 'all'").select(*keys, "feature", F.col("share").alias("_base"))
    return long.where("volume <> 'all'").join(base, [*keys, "feature"]).select(
        *keys, "feature", "volume", F.round(log2_ratio(F.col("share"), F.col("_base")), 2).alias("log2_e")
    )


def topic_enrichment(panel: DataFrame, topics: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """log2 of topic share in core and tail over the overall share.

    Topics missing in either volume drop out, as there is no log of zero.
    """
    joined = stream_past(panel, topics.select("page_id", "topic").distinct(), ["page_id"])
    inside = F.count_if(F.col("volume") == "core"), F.count_if(F.col("volume") == "tail")
    counts = joined.groupBy(*keys, "topic").agg(
        F.count("*").alias("nb_tot"), inside[0].alias("nb_high"), inside[1].alias("nb_low")
    )
    group = Window.partitionBy(*keys)
    totals = counts.select(
        "*", *[F.sum(c).over(group).alias(f"_{c}") for c in ("nb_tot", "nb_high", "nb_low")]
    ).where("nb_high > 0 and nb_low > 0")
    base = F.col("nb_tot") / F.col("_nb_tot")
    return totals.select(
        *keys, "topic", "nb_tot", "nb_high", "nb_low",
        F.log2((F.col("nb_high") / F.col("_nb_high")) / base).alias("log2_core"),
        F.log2((F.col("nb_low") / F.col("_nb_low")) / base).alias("log2_tail"),
    )


def degrees(panel: DataFrame, nodes: DataFrame) -> DataFrame:
    """In and out degree of every row in long form."""
    joined = panel.join(nodes.select("page_id", "in_main", "out_main"), "page_id")
    return joined.withColumn(
        "_d",
        F.explode(
            F.array(
                F.struct(F.lit("in").alias("degree_type"), F.col("in_main").cast("bigint").alias("degree")),
                F.struct(F.lit("out").alias("degree_type"), F.col("out_main").cast("bigint").alias("degree")),
            )
        ),
    ).select(*panel.columns, "_d.*")


def standardise(vectors: DataFrame, column: str = "embed") -> DataFrame:
    """Vectors with unit deviation per dimension; means stay."""
    scaler = StandardScaler(inputCol=column, outputCol=f"{column}_norm", withStd=True, withMean=False)
    return scaler.fit(vectors).transform(vectors)


def access_ratio(sides: DataFrame) -> DataFrame:
    """ln(desktop / mobile) for entities seen on both sides."""
    both = sides.where("desktop_views is not null and mobile_views is not null")
    return both.withColumn("views_ratio", F.ln(F.try_divide("desktop_views", "mobile_views")))


def one_sided_topics(sides: DataFrame, topics: DataFrame) -> DataFrame:
    """Entities and views by topic among those seen on one side only."""
    alone = sides.where("desktop_views is null or mobile_views is null").withColumn(
        "side", F.when(F.col("mobile_views").isNull(), "desktop").otherwise("mobile")
    )
    views = F.coalesce("desktop_views", "mobile_views")
    return (
        stream_past(alone, topics.select("page_id", "topic").distinct(), ["page_id"])
        .select("side", "topic", "page", views.alias("_v"))
        .distinct()
        .groupBy("side", "topic")
        .agg(F.count("*").alias("nb_pages"), F.sum("_v").alias("nb_views"))
    )


def high_quality(panel: DataFrame, meta: DataFrame, least: float = 0.7) -> DataFrame:
    """Rows whose predicted quality is above ``least``."""
    return panel.join(meta.select("page_id", "pred_qual").where(F.col("pred_qual") > least), "page_id")

