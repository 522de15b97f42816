"""Queries for ages, metadata, topics, quality and statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelytics.catalog.dynamics import CURVE, FLUX, LABELLED, PREVIOUS, labelled, marked, previous, rounded
from panelytics.catalog.panel import CHAINS
from panelytics.catalog.registry import curve_sql, query
from panelytics.functions.topics import most_specific, topic_code
from panelytics.operators import cohorts, enrich, identity, lifetime, overlap, statistics
from panelytics.plans.joins import stream_past
from panelytics.plans.views import Tables
from panelytics.sources import tables

DESCRIBE = """COUNT(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stddev, MIN(v) AS min,
      round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75,
      round(quantile_cont(v, 0.9), 6) AS p90, MAX(v) AS max"""
DESCRIBED = ("mean", "stddev", "p25", "p50", "p75", "p90")

# ------------------------------------------------------------------- ages

AGES = f"""{FLUX}, ag AS (SELECT fx.*, creation_date, date_diff('month', creation_date, date) AS age FROM fx JOIN v_meta USING (page_id)),
    gd AS (SELECT * FROM (SELECT *, MIN(age) OVER (PARTITION BY project, page_id) AS youngest FROM ag) WHERE youngest >= 0)"""


def aged(t: Tables) -> DataFrame:
    """Core rows with flux flags and ages, without bad creations."""
    return cohorts.drop_bad_creation(cohorts.with_age(marked(t), t.view("v_meta")))


@query(
    "a1_age_in_months",
    "SELECT project, date, page_id, CAST(date_diff('month', creation_date, date) AS DOUBLE) AS age_in_months FROM v_panel JOIN v_meta USING (page_id)",
)
def a1(t: Tables):
    return cohorts.with_age(t.view("v_panel"), t.view("v_meta")).select("project", "date", "page_id", "age_in_months")


@query("a2_bad_creation", f"WITH {AGES} SELECT project, date, page_id FROM gd")
def a2(t: Tables):
    return aged(t).select("project", "date", "page_id")


@query(
    "a3_creation_histogram",
    f"""WITH RECURSIVE {CHAINS}, {AGES},
    h AS (SELECT 'incoming' AS kind, project, date, creation_date FROM gd WHERE flow = 'incoming'
      UNION ALL SELECT 'outgoing', project, date, creation_date FROM gd WHERE leaves
      UNION ALL SELECT 'own', 'all', date, first_date FROM v_succession JOIN im ON page_id = page_ids)
    SELECT kind, project, date, creation_date, COUNT(*) AS nb_pages,
      round(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY kind, project, date) * 100, 6) AS perc FROM h GROUP BY 1, 2, 3, 4""",
)
def a3(t: Tables):
    rows = aged(t)
    came = rows.where("flow = 'incoming'").select(F.lit("incoming").alias("kind"), "project", "date", "creation_date")
    left = rows.where("leaves").select(F.lit("outgoing").alias("kind"), "project", "date", "creation_date")
    panel = t.view("v_succession")
    own = identity.apply_identity(panel, identity.succession_map(panel)).select(
        F.lit("own").alias("kind"), F.lit("all").alias("project"), "date", F.col("first_date").alias("creation_date")
    )
    parts = came.unionByName(left).unionByName(own)
    return rounded(cohorts.creation_histogram(parts, ["kind", "project", "date"]), 6, "perc")


@query(
    "a4_creation_quantiles",
    f"""WITH {AGES}, q AS (SELECT project, date, quantile_disc(age, 0.1) AS a, quantile_disc(age, 0.25) AS b, quantile_disc(age, 0.5) AS c,
        quantile_disc(age, 0.75) AS d, quantile_disc(age, 0.9) AS e FROM gd WHERE flow = 'incoming' GROUP BY 1, 2)
    SELECT project, date, CAST(date - to_months(CAST(a AS INT)) AS DATE) AS p10, CAST(date - to_months(CAST(b AS INT)) AS DATE) AS p25,
      CAST(date - to_months(CAST(c AS INT)) AS DATE) AS p50, CAST(date - to_months(CAST(d AS INT)) AS DATE) AS p75,
      CAST(date - to_months(CAST(e AS INT)) AS DATE) AS p90 FROM q""",
)
def a4(t: Tables):
    return cohorts.creation_quantiles(aged(t).where("flow = 'incoming'"))


@query(
    "a5_newborn_flux",
    f"""WITH {FLUX}, f AS (SELECT project, date, COUNT(*) AS nb_flux, CAST(COUNT_IF(date = creation_date) AS BIGINT) AS nb_newborn
        FROM fx JOIN v_meta USING (page_id) WHERE flow = 'incoming' GROUP BY 1, 2),
    n AS (SELECT project, date, COUNT(*) AS nb_newborn_all FROM v_panel JOIN v_meta USING (page_id) WHERE date = creation_date GROUP BY 1, 2)
    SELECT project, date, nb_flux, nb_newborn, nb_newborn_all, round(nb_newborn / nb_flux * 100, 6) AS perc_flux,
      round(nb_newborn / nb_newborn_all * 100, 6) AS perc_core FROM f JOIN n USING (project, date)""",
)
def a5(t: Tables):
    flux = marked(t).where("flow = 'incoming'")
    return rounded(cohorts.newborn_flux(flux, t.view("v_panel"), t.view("v_meta")), 6, "perc_flux", "perc_core")


def _newborn_sql(months: int) -> str:
    due = f"date = CAST(creation_date + INTERVAL {months} MONTH AS DATE)"
    return f"""WITH {AGES}, c AS (SELECT project, date, COUNT(*) AS nb_core FROM gd WHERE flow = 'incoming' AND {due} GROUP BY 1, 2),
    l AS (SELECT project, date, COUNT(*) AS nb_tail FROM vol JOIN v_meta USING (page_id) WHERE volume = 'tail' AND {due} GROUP BY 1, 2)
    SELECT project, date, nb_core, nb_tail, round(nb_core / (nb_core + nb_tail) * 100, 6) AS perc FROM c JOIN l USING (project, date)"""


def _newborn(t: Tables, months: int) -> DataFrame:
    flux = aged(t).where("flow = 'incoming'")
    tail = t.volumes().where("volume = 'tail'")
    return rounded(cohorts.newborn_volumes(flux, tail, t.view("v_meta"), months), 6, "perc")


@query("a6_newborn_volumes", _newborn_sql(0))
def a6(t: Tables):
    return _newborn(t, 0)


@query("a7_one_month_later", _newborn_sql(1))
def a7(t: Tables):
    return _newborn(t, 1)


def mann_whitney_sql(rows: str, by: str, digits: int = 6) -> str:
    """Fragment ``tt`` with U and z over rows (by, side 1 or 2, v)."""
    return f"""mk AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY v) + (COUNT(*) OVER (PARTITION BY {by}, v) - 1) / 2 AS ar,
        CAST(COUNT(*) OVER (PARTITION BY {by}, v) AS DOUBLE) AS c FROM {rows}),
    mr AS (SELECT {by}, CAST(COUNT_IF(side = 1) AS BIGINT) AS n1, CAST(COUNT_IF(side = 2) AS BIGINT) AS n2,
        SUM(CASE WHEN side = 1 THEN ar END) AS r1, SUM(c * c - 1) AS ties FROM mk GROUP BY {by}),
    mu AS (SELECT *, r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2 AS u1, CAST(n1 AS DOUBLE) * n2 - (r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2) AS u2,
        sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * ((n1 + n2 + 1) - ties / NULLIF(CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1), 0))) AS sd
        FROM mr WHERE n1 > 0 AND n2 > 0),
    tt AS (SELECT {by}, n1, n2, u1, u2, round((u1 - CAST(n1 AS DOUBLE) * n2 / 2 - 0.5) / NULLIF(sd, 0), {digits}) AS z_greater,
        round((u2 - CAST(n1 AS DOUBLE) * n2 / 2 - 0.5) / NULLIF(sd, 0), {digits}) AS z_less,
        round((greatest(u1, u2) - CAST(n1 AS DOUBLE) * n2 / 2 - 0.5) / NULLIF(sd, 0), {digits}) AS z_two_sided FROM mu)"""


Z = ("z_greater", "z_less", "z_two_sided")


@query(
    "a8_old_flux_tests",
    f"""WITH {AGES}, ol AS (SELECT project, i, age FROM gd WHERE flow = 'incoming' AND creation_date <= DATE '1996-12-01'),
    sd2 AS (SELECT project, i AS pair, 2 AS side, age AS v FROM ol UNION ALL SELECT project, i + 6, 1, age FROM ol),
    {mann_whitney_sql('sd2', 'project, pair')}
    SELECT *, round(0.05 / COUNT(*) OVER (PARTITION BY project), 9) AS threshold FROM tt""",
)
def a8(t: Tables):
    flux = aged(t).where("flow = 'incoming'").drop("period_idx", "nb_periods")
    tests = cohorts.old_flux_tests(flux, dt.date(1996, 12, 1), lag=6, source=t.view("v_panel"))
    return rounded(rounded(tests, 6, *Z), 9, "threshold").drop("p_greater", "p_less", "p_two_sided", "significant")


@query(
    "a8_equal_samples",
    f"""WITH {AGES}, ol AS (SELECT project, i, page_id, age FROM gd WHERE flow = 'incoming' AND creation_date <= DATE '1996-12-01'),
    sd1 AS (SELECT project, i AS pair, 2 AS side, page_id, age AS v FROM ol UNION ALL SELECT project, i + 6, 1, page_id, age FROM ol),
    ct AS (SELECT *, row_number() OVER (PARTITION BY project, pair, side ORDER BY substr(md5(page_id || ':2023'), 1, 15), page_id) AS k,
        COUNT_IF(side = 1) OVER (PARTITION BY project, pair) AS c1, COUNT_IF(side = 2) OVER (PARTITION BY project, pair) AS c2 FROM sd1),
    sd2 AS (SELECT project, pair, side, v FROM ct WHERE k <= least(c1, c2)),
    {mann_whitney_sql('sd2', 'project, pair')}
    SELECT *, round(0.05 / COUNT(*) OVER (PARTITION BY project), 9) AS threshold FROM tt""",
)
def a8_equal(t: Tables):
    flux = aged(t).where("flow = 'incoming'").drop("period_idx", "nb_periods")
    tests = cohorts.old_flux_tests(flux, dt.date(1996, 12, 1), lag=6, source=t.view("v_panel"), equal=2023)
    return rounded(rounded(tests, 6, *Z), 9, "threshold").drop("p_greater", "p_less", "p_two_sided", "significant")


@query(
    "a9_from_tail_histogram",
    f"""WITH {PREVIOUS}, h AS (SELECT project, date, creation_date FROM pa JOIN v_meta USING (page_id)
      WHERE nb_prev_times = 0 AND creation_date <> date)
    SELECT project, date, creation_date, COUNT(*) AS nb_pages,
      round(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY project, date) * 100, 6) AS perc FROM h GROUP BY 1, 2, 3""",
)
def a9(t: Tables):
    return rounded(cohorts.from_tail_histogram(previous(t), t.view("v_meta")), 6, "perc")


def volume_ages(t: Tables) -> DataFrame:
    return cohorts.with_age(labelled(t), t.view("v_meta")).withColumn("v", F.col("age_in_months").cast("bigint"))


LABELLED_AGES = f"{LABELLED}, la AS (SELECT lb.*, creation_date, date_diff('month', creation_date, date) AS v FROM lb JOIN v_meta USING (page_id))"


@query("a10_age_summary", f"WITH {LABELLED_AGES} SELECT project, volume, {DESCRIBE} FROM la GROUP BY 1, 2")
def a10(t: Tables):
    return rounded(lifetime.describe(volume_ages(t), "v"), 6, *DESCRIBED)


STABILITY = f"""{CURVE}, oc AS (SELECT project, page_id, COUNT(*) AS nb_app FROM v_panel WHERE date < DATE '2000-01-01' GROUP BY 1, 2),
    st AS (SELECT vol.project, volume, nb_app, date_diff('month', creation_date, date) AS v FROM vol JOIN v_meta USING (page_id) JOIN oc USING (project, page_id)),
    sb AS (SELECT *, CASE WHEN nb_app = 10 THEN 1 ELSE 2 END AS side FROM st WHERE v >= nb_app AND nb_app <= 10)"""


def stability(t: Tables) -> DataFrame:
    return cohorts.stability_ages(
        t.volumes(), t.view("v_panel"), t.view("v_meta"), required=10, before=dt.date(2000, 1, 1)
    )


@query(
    "a11_stability_ages",
    f"""WITH {STABILITY} SELECT project, volume, CASE side WHEN 1 THEN 'stable' ELSE 'unstable' END AS stability, {DESCRIBE}
    FROM sb GROUP BY 1, 2, 3""",
)
def a11(t: Tables):
    rows = stability(t).withColumn("v", F.col("age_in_months").cast("bigint"))
    return rounded(lifetime.describe(rows, "v", ["project", "volume", "stability"]), 6, *DESCRIBED)


@query(
    "a11_stability_tests",
    f"WITH {STABILITY}, {mann_whitney_sql('sb', 'project, volume')} SELECT * FROM tt",
)
def a11_tests(t: Tables):
    return rounded(cohorts.stability_tests(stability(t)), 6, *Z).drop("p_greater", "p_less", "p_two_sided")


@query(
    "a12_age_distribution",
    f"""WITH {LABELLED_AGES} SELECT project, volume, creation_date, COUNT(*) AS nb_pages,
      round(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY project, volume) * 100, 6) AS perc FROM la GROUP BY 1, 2, 3""",
)
def a12(t: Tables):
    return rounded(cohorts.creation_histogram(volume_ages(t), ["project", "volume"]), 6, "perc")


@query(
    "a13_unmatched_profile",
    f"""WITH RECURSIVE {CHAINS}, u AS (SELECT tot_count_views, date_diff('month', first_date, date) AS age FROM v_succession s
        JOIN im ON s.page_id = page_ids WHERE s.page_id NOT IN (SELECT page_id FROM v_meta)),
    l AS (SELECT 'views' AS measure, tot_count_views AS v FROM u UNION ALL SELECT 'age_in_months', age FROM u)
    SELECT measure, {DESCRIBE} FROM l GROUP BY 1""",
)
def a13(t: Tables):
    panel = t.view("v_succession")
    return rounded(
        cohorts.unmatched_profile(panel, t.view("v_meta"), identity.succession_map(panel)), 6, *DESCRIBED
    )


@query(
    "a14_seen_before_creation",
    """SELECT project, date, page_id, page, creation_date, tot_count_views, nb_occ FROM
      (SELECT *, COUNT(*) OVER (PARTITION BY project, page_id) AS nb_occ FROM v_panel) JOIN v_meta USING (page_id) WHERE creation_date > date""",
)
def a14(t: Tables):
    return cohorts.seen_before_creation(t.view("v_panel"), t.view("v_meta"))


# ------------------------------------------------------- topics and flags

# Topics of a page by (score, topic) descending; ``pos`` from 1.
TOPIC_LIST = """tl AS (SELECT page_id, topic, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, topic DESC) AS pos FROM v_topics),
    ts AS (SELECT page_id, arg_min(topic, pos) AS first_topic, arg_min(topic, pos) FILTER (WHERE NOT contains(topic, '*')) AS plain FROM tl GROUP BY 1)"""


def topic_lists(t: Tables) -> DataFrame:
    return t.view("v_topics").groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("score", "topic")), asc=False).alias("l")
    )


@query(
    "e1_topic_parse",
    f"""WITH {TOPIC_LIST} SELECT page_id, lower(topic) AS topics, lower(first_topic) AS topics_unique,
      lower(COALESCE(plain, first_topic)) AS topics_specific_unique FROM tl JOIN ts USING (page_id)""",
)
def e1(t: Tables):
    text = F.array_join(
        F.transform(
            "l",
            lambda e: F.concat(
                F.lit("{'topic': '"), e["topic"], F.lit("', 'score': "), e["score"].cast("string"), F.lit("}")
            ),
        ),
        "\n",
    )
    raw = topic_lists(t).select("page_id", F.concat(F.lit("["), text, F.lit("]")).alias("topics"))
    return enrich.parsed_topics(raw)


@query(
    "e2_most_specific_topic",
    f"WITH {TOPIC_LIST} SELECT page_id, COALESCE(plain, first_topic) AS topic FROM ts",
)
def e2(t: Tables):
    return topic_lists(t).select("page_id", most_specific(F.col("l.topic")).alias("topic"))


@query(
    "e3_scored_topics",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, topic DESC) AS pos FROM v_topics WHERE score >= 0.5)
    SELECT page_id, string_agg(topic, ',' ORDER BY pos) AS topics,
      COALESCE(arg_min(topic, pos) FILTER (WHERE NOT contains(topic, '*')), arg_min(topic, pos)) AS topic FROM k GROUP BY 1""",
)
def e3(t: Tables):
    return enrich.scored_topics(t.view("v_topics")).withColumn("topics", F.array_join("topics", ","))


@query(
    "e4_edition_metadata",
    """SELECT page_id, item_id, strftime(creation_date, '%Y-%m') AS creation_date FROM v_meta WHERE in_main % 2 = 0""",
)
def e4(t: Tables):
    meta = t.view("v_meta").select(
        "page_id", "item_id",
        F.when(F.col("in_main") % 2 == 0, "aawiki").otherwise("nnwiki").alias("wiki_db"),
        F.date_format("creation_date", "yyyy-MM-dd HH:mm:ss").alias("page_creation_timestamp"),
    )
    return enrich.edition_metadata(meta, "aa").select("page_id", "item_id", "creation_date")


TOPIC_COUNTS = f"""{LABELLED}, tc AS (SELECT project, volume, date, topic, COUNT(*) AS nb_pages FROM lb
      JOIN (SELECT DISTINCT page_id, topic FROM v_topics) USING (page_id) GROUP BY ALL)"""


def topic_counts(t: Tables) -> DataFrame:
    return enrich.topic_counts_with_baseline(t.volumes(), t.view("v_topics"))


@query("e5_topic_counts", f"WITH {TOPIC_COUNTS} SELECT * FROM tc")
def e5(t: Tables):
    return topic_counts(t)


@query(
    "e6_topic_shares",
    f"""WITH {TOPIC_COUNTS}, s AS (SELECT *, nb_pages / SUM(nb_pages) OVER (PARTITION BY project, volume, date) * 100 AS p FROM tc)
    SELECT project, volume, topic, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS std,
      round(stddev_samp(p) * 1.96 / sqrt(COUNT(*)), 6) AS error, COUNT(*) AS nb_periods FROM s GROUP BY 1, 2, 3""",
)
def e6(t: Tables):
    return rounded(enrich.topic_shares(topic_counts(t)), 6, "mean", "std", "error")


@query(
    "e7_join_loss",
    f"""WITH {LABELLED}, m AS (SELECT DISTINCT page_id, 1 AS hit FROM v_meta)
    SELECT project, volume, date, COUNT(*) AS nb_tot, COUNT(hit) AS nb_match, round((COUNT(*) - COUNT(hit)) / COUNT(*) * 100, 6) AS loss
    FROM lb LEFT JOIN m USING (page_id) GROUP BY 1, 2, 3""",
)
def e7(t: Tables):
    return rounded(enrich.join_loss(labelled(t), t.view("v_meta")), 6, "loss")


@query(
    "e8_quality_shares",
    f"""WITH {LABELLED} SELECT project, volume, score_label, COUNT(*) AS nb_pages,
      round(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY project, volume) * 100, 6) AS percentage,
      CASE score_label WHEN 'Stub' THEN 0 WHEN 'Start' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'GA' THEN 4 WHEN 'FA' THEN 5 END AS score_ordering
    FROM lb JOIN v_quality USING (page_id) GROUP BY 1, 2, 3""",
)
def e8(t: Tables):
    return rounded(enrich.quality_shares(labelled(t), t.view("v_quality")), 6, "percentage")


FLAGS = ["is_orphan", "is_disambiguation", "is_bot_created"]
FLAG_SHARES = f"""{LABELLED}, fs AS (SELECT project, volume, COUNT(*) AS nb_pages, COUNT_IF(is_orphan = 1) / COUNT(*) * 100 AS is_orphan,
      COUNT_IF(is_disambiguation = 1) / COUNT(*) * 100 AS is_disambiguation, COUNT_IF(is_bot_created = 1) / COUNT(*) * 100 AS is_bot_created
    FROM lb JOIN v_meta USING (page_id) GROUP BY 1, 2)"""


def flag_shares(t: Tables) -> DataFrame:
    return enrich.flag_shares(t.volumes(), t.view("v_meta"), FLAGS)


@query(
    "e9_flag_shares",
    f"""WITH {FLAG_SHARES} SELECT project, volume, nb_pages, round(is_orphan, 6) AS is_orphan,
      round(is_disambiguation, 6) AS is_disambiguation, round(is_bot_created, 6) AS is_bot_created FROM fs""",
)
def e9(t: Tables):
    return rounded(flag_shares(t), 6, *FLAGS)


@query(
    "e10_flag_enrichment",
    f"""WITH {FLAG_SHARES}, l AS (SELECT project, volume, 'is_orphan' AS feature, is_orphan AS s FROM fs
      UNION ALL SELECT project, volume, 'is_disambiguation', is_disambiguation FROM fs
      UNION ALL SELECT project, volume, 'is_bot_created', is_bot_created FROM fs)
    SELECT a.project, a.feature, a.volume, round(log2(a.s / b.s), 2) AS log2_e FROM l a JOIN l b
      ON a.project = b.project AND a.feature = b.feature AND b.volume = 'all' WHERE a.volume <> 'all'""",
)
def e10(t: Tables):
    return enrich.flag_enrichment(flag_shares(t), FLAGS)


@query(
    "e11_topic_enrichment",
    f"""WITH {LABELLED}, c AS (SELECT project, topic, COUNT_IF(volume = 'all') AS nb_tot, COUNT_IF(volume = 'core') AS nb_high, COUNT_IF(volume = 'tail') AS nb_low
      FROM lb JOIN (SELECT DISTINCT page_id, topic FROM v_topics) USING (page_id) GROUP BY 1, 2),
    w AS (SELECT *, SUM(nb_tot) OVER (PARTITION BY project) AS st, SUM(nb_high) OVER (PARTITION BY project) AS sh, SUM(nb_low) OVER (PARTITION BY project) AS sl FROM c)
    SELECT project, topic, CAST(nb_tot AS BIGINT) AS nb_tot, CAST(nb_high AS BIGINT) AS nb_high, CAST(nb_low AS BIGINT) AS nb_low,
      round(log2((nb_high / sh) / (nb_tot / st)), 6) AS log2_core, round(log2((nb_low / sl) / (nb_tot / st)), 6) AS log2_tail
    FROM w WHERE nb_high > 0 AND nb_low > 0""",
)
def e11(t: Tables):
    return rounded(enrich.topic_enrichment(t.volumes(), t.view("v_topics")), 6, "log2_core", "log2_tail")


@query(
    "e12_degrees",
    f"""WITH {LABELLED}, d AS (SELECT project, volume, 'in' AS degree_type, in_main AS v FROM lb JOIN v_meta USING (page_id)
      UNION ALL SELECT project, volume, 'out', out_main FROM lb JOIN v_meta USING (page_id))
    SELECT project, volume, degree_type, {DESCRIBE} FROM d GROUP BY 1, 2, 3""",
)
def e12(t: Tables):
    rows = enrich.degrees(labelled(t), t.view("v_meta"))
    return rounded(lifetime.describe(rows, "degree", ["project", "volume", "degree_type"]), 6, *DESCRIBED)


@query(
    "e13_high_quality_topics",
    f"""WITH {CURVE} SELECT volume, topic, COUNT(*) AS count, ((2 * SUM(CAST(round(pred_qual * 1000000) AS BIGINT)) + COUNT(*)) // (2 * COUNT(*))) / CAST(1000000 AS DOUBLE) AS mean, round(stddev_samp(pred_qual), 6) AS std,
      MIN(pred_qual) AS min, MAX(pred_qual) AS max, round(quantile_cont(pred_qual, 0.25), 6) AS p25, round(quantile_cont(pred_qual, 0.5), 6) AS p50,
      round(quantile_cont(pred_qual, 0.75), 6) AS p75
    FROM vol JOIN v_meta USING (page_id) JOIN (SELECT DISTINCT page_id, topic FROM v_topics) USING (page_id) WHERE pred_qual > 0.7 GROUP BY 1, 2""",
)
def e13(t: Tables):
    best = stream_past(
        enrich.high_quality(t.volumes(), t.view("v_meta")), t.view("v_topics").select("page_id", "topic").distinct(), ["page_id"]
    )
    table = statistics.describe_values(best, "pred_qual", ["volume", "topic"], (0.25, 0.5, 0.75))
    return rounded(table, 6, "std", "p25", "p50", "p75")


@query(
    "e14_standardised_vectors",
    """WITH u AS (SELECT page_id, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM v_vec)
    SELECT page_id, CAST(dim AS INT) AS dim, round(x / stddev_samp(x) OVER (PARTITION BY dim), 5) AS value FROM u""",
)
def e14(t: Tables):
    from pyspark.ml.functions import vector_to_array

    scaled = enrich.standardise(tables.embeddings(t.view("v_vec")))
    return scaled.select("page_id", F.posexplode(vector_to_array("embed_norm")).alias("dim", "value")).select(
        "page_id", (F.col("dim") + 1).alias("dim"), F.round("value", 5).alias("value")
    )


BRANDS = [f"brand.Brand#{i}" for i in range(1, 21)]


@query(
    "e15_topic_codes",
    """SELECT page_id, topic, CASE WHEN topic LIKE 'brand.Brand#%' AND CAST(substr(topic, 13) AS INT) <= 20 THEN CAST(substr(topic, 13) AS INT) - 1 END AS code
    FROM v_topics WHERE topic LIKE 'brand%'""",
)
def e15(t: Tables):
    return t.view("v_topics").where("topic like 'brand%'").select(
        "page_id", "topic", topic_code(F.col("topic"), BRANDS).alias("code")
    )


@query(
    "e16_always_present_topics",
    f"""WITH {curve_sql('v_supply')}, np AS (SELECT project, COUNT(DISTINCT date) AS np FROM v_supply GROUP BY 1),
    lb AS (SELECT project, page_id, volume FROM vol UNION ALL SELECT project, page_id, 'all' FROM vol),
    ap AS (SELECT project, volume, page_id FROM lb JOIN np USING (project) GROUP BY ALL HAVING COUNT(*) >= MAX(np)),
    c AS (SELECT project, volume, topic, COUNT(*) AS nb_pages FROM ap JOIN (SELECT DISTINCT page_id, topic FROM v_topics) USING (page_id) GROUP BY ALL)
    SELECT *, round(nb_pages / SUM(nb_pages) OVER (PARTITION BY project, volume) * 100, 6) AS perc FROM c""",
)
def e16(t: Tables):
    rows = lifetime.with_baseline(t.volumes("v_supply"))
    always = overlap.always_present(rows, source=t.view("v_supply")).select("project", "volume", "page_id")
    counts = enrich.topic_counts(always, t.view("v_topics"), ["project", "volume"])
    return rounded(overlap.with_share(counts, ["project", "volume"]), 6, "perc")


SIDES = """s AS (SELECT project, date, page, page_id, access_type, CAST(SUM(counts) AS BIGINT) AS v FROM v_counts GROUP BY ALL),
    s1 AS (SELECT project, date, page, access_type, v, first_value(page_id) OVER (PARTITION BY project, date, page
        ORDER BY v DESC, page_id ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS page_id FROM s),
    s2 AS (SELECT project, date, page_id, access_type, v, first_value(page) OVER (PARTITION BY project, date, page_id, access_type
        ORDER BY v DESC, page ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS page FROM s1
        WHERE page_id IS NOT NULL AND page_id <> 'null'),
    ac AS (SELECT project, date, page, CAST(page_id AS BIGINT) AS page_id, CAST(SUM(v) FILTER (WHERE access_type = 'desktop') AS BIGINT) AS d,
        CAST(SUM(v) FILTER (WHERE contains(access_type, 'mobile')) AS BIGINT) AS m FROM s2 GROUP BY 1, 2, 3, 4)"""


def sides(t: Tables) -> DataFrame:
    return identity.collapse_by_access(t.view("v_counts")).withColumn("page_id", F.col("page_id").cast("bigint"))


@query(
    "e17_access_ratio",
    f"""WITH {SIDES} SELECT project, date, page, page_id, d AS desktop_views, m AS mobile_views,
      round(CASE WHEN d > 0 AND m > 0 THEN ln(d / m) END, 6) AS views_ratio
    FROM ac WHERE d IS NOT NULL AND m IS NOT NULL""",
)
def e17(t: Tables):
    return rounded(enrich.access_ratio(sides(t)), 6, "views_ratio")


@query(
    "e17_one_sided_topics",
    f"""WITH {SIDES}, o AS (SELECT DISTINCT CASE WHEN m IS NULL THEN 'desktop' ELSE 'mobile' END AS side, topic, page, COALESCE(d, m) AS v
        FROM ac JOIN (SELECT DISTINCT page_id, topic FROM v_topics) USING (page_id) WHERE d IS NULL OR m IS NULL)
    SELECT side, topic, COUNT(*) AS nb_pages, CAST(SUM(v) AS BIGINT) AS nb_views FROM o GROUP BY 1, 2""",
)
def e17_topics(t: Tables):
    return enrich.one_sided_topics(sides(t), t.view("v_topics"))


@query(
    "e18_quality_profile",
    f"""WITH {LABELLED} SELECT project, volume, COUNT(*) AS count, ((2 * SUM(CAST(round(pred_qual * 1000000) AS BIGINT)) + COUNT(*)) // (2 * COUNT(*))) / CAST(1000000 AS DOUBLE) AS mean, round(stddev_samp(pred_qual), 6) AS std,
      MIN(pred_qual) AS min, MAX(pred_qual) AS max, round(quantile_cont(pred_qual, 0.5), 6) AS p50, round(quantile_cont(pred_qual, 0.8), 6) AS p80,
      round(quantile_cont(pred_qual, 0.85), 6) AS p85, round(quantile_cont(pred_qual, 0.9), 6) AS p90
    FROM lb JOIN v_meta USING (page_id) GROUP BY 1, 2""",
)
def e18(t: Tables):
    rows = labelled(t).join(t.view("v_meta").select("page_id", "pred_qual"), "page_id")
    table = statistics.describe_values(rows, "pred_qual", ["project", "volume"], (0.5, 0.8, 0.85, 0.9))
    return rounded(table, 6, "std", "p50", "p80", "p85", "p90")


# -------------------------------------------------------------- statistics

VIEW_STATS = """MAX(tot_count_views) AS max, MIN(tot_count_views) AS min, round(avg(tot_count_views), 6) AS avg, round(stddev_samp(tot_count_views), 6) AS std,
      CAST(SUM(tot_count_views) AS BIGINT) AS sum, COUNT(*) AS nb_pages, round(quantile_cont(tot_count_views, 0.25), 6) AS p25,
      round(quantile_cont(tot_count_views, 0.5), 6) AS p50, round(quantile_cont(tot_count_views, 0.75), 6) AS p75,
      round(quantile_cont(tot_count_views, 0.9), 6) AS p90"""
VIEW_COLUMNS = ("avg", "std", "p25", "p50", "p75", "p90")


@query("t1_monthly_statistics", f"SELECT date, {VIEW_STATS} FROM v_panel_all GROUP BY date")
def t1(t: Tables):
    return rounded(statistics.view_statistics(t.view("v_panel_all")), 6, *VIEW_COLUMNS)


PAIR_LIST = [("A", "N"), ("A", "R")]


@query(
    "t2_edition_statistics",
    f"""WITH s AS (SELECT project, date, {VIEW_STATS} FROM v_panel GROUP BY 1, 2),
    p(lang1, lang2) AS (VALUES ('A', 'N'), ('A', 'R')),
    e AS (SELECT lang1, lang2, lang1 AS project FROM p UNION ALL SELECT lang1, lang2, lang2 FROM p)
    SELECT lang1, lang2, s.* FROM e JOIN s USING (project)""",
)
def t2(t: Tables):
    stats = rounded(statistics.view_statistics(t.view("v_panel"), ["project", "date"]), 6, *VIEW_COLUMNS)
    pairs = tables.dimension(t.spark, PAIR_LIST, "lang1 string, lang2 string")
    members = pairs.withColumn("project", F.explode(F.array("lang1", "lang2")))
    return stats.join(members, "project")


@query(
    "t3_describe_months",
    """WITH s AS (SELECT date, CAST(SUM(tot_count_views) AS DOUBLE) AS views, CAST(COUNT(*) AS DOUBLE) AS nb_pages FROM v_panel_all GROUP BY 1),
    l AS (SELECT 'sum' AS measure, views AS v FROM s UNION ALL SELECT 'nb_pages', nb_pages FROM s)
    SELECT measure, COUNT(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, MIN(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25,
      round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, MAX(v) AS max FROM l GROUP BY 1""",
)
def t3(t: Tables):
    stats = statistics.view_statistics(t.view("v_panel_all"))
    return rounded(statistics.describe_report(stats, ["sum", "nb_pages"]), 6, "mean", "std", "p25", "p50", "p75")


@query(
    "t4_reconcile_series",
    """SELECT date, CAST(SUM(tot_count_views) AS BIGINT) AS tot_views, 'own' AS source FROM v_panel WHERE year(date) > 1995 GROUP BY 1
    UNION ALL SELECT date, tot_views, 'published' FROM v_ref_series""",
)
def t4(t: Tables):
    return statistics.reconcile(t.view("v_panel"), t.view("v_ref_series"), F.year("date") <= 1995)


@query(
    "t5_coverage_ratio",
    """WITH o AS (SELECT project, date, COUNT(*) AS n FROM v_panel WHERE month(date) = 1 GROUP BY 1, 2)
    SELECT project, round(avg(n / tot_views), 6) AS mean_ratio, round(stddev_pop(n / tot_views) * 1.96 / sqrt(COUNT(*)), 6) AS error, COUNT(*) AS nb_periods
    FROM o JOIN v_ref_series USING (date) GROUP BY 1""",
)
def t5(t: Tables):
    own = t.view("v_panel").where(F.month("date") == 1).groupBy("project", "date").agg(F.count("*").alias("nb_own"))
    published = t.view("v_ref_series").select("date", F.col("tot_views").alias("nb_published"))
    both = own.join(published, "date")
    ratio = statistics.coverage_ratio(
        own, both.select("project", "date", "nb_published"), ["project"]
    )
    return rounded(ratio, 6, "mean_ratio", "error")


@query(
    "t6_mean_with_error",
    f"""WITH {CURVE} SELECT project, volume, date, round(avg(tot_count_views), 6) AS avg, round(stddev_samp(tot_count_views), 6) AS std,
      COUNT(*) AS nb, round(stddev_samp(tot_count_views) * 1.96 / sqrt(COUNT(*)), 6) AS error FROM vol GROUP BY 1, 2, 3""",
)
def t6(t: Tables):
    return rounded(
        statistics.mean_with_error(t.volumes(), "tot_count_views", ["project", "volume", "date"]), 6, "avg", "std", "error"
    )


@query(
    "t7_mann_whitney",
    f"""WITH {CURVE}, q AS (SELECT vol.project, CASE volume WHEN 'core' THEN 1 ELSE 2 END AS side, pred_qual AS v FROM vol JOIN v_meta USING (page_id)),
    {mann_whitney_sql('q', 'project')} SELECT * FROM tt""",
)
def t7(t: Tables):
    rows = t.volumes().join(t.view("v_meta").select("page_id", "pred_qual"), "page_id")
    tests = statistics.mann_whitney(
        rows, "pred_qual", F.col("volume") == "core", F.col("volume") == "tail", ["project"], p_values=False
    )
    return rounded(tests, 6, *Z)


def normal_tail_sql(z: str) -> str:
    """P(Z > z) from the series of the error function; beyond six deviations it is 0 or 1 at six decimals."""
    terms = f"list_transform(range(0, 90), lambda k: pow(-1, k) * pow({z} / sqrt(2), 2 * k + 1) / ((2 * k + 1) * gamma(k + 1)))"
    return f"CASE WHEN {z} > 6 THEN 0 WHEN {z} < -6 THEN 1 ELSE 0.5 - list_sum({terms}) / sqrt(pi()) END"


@query(
    "t7_mann_whitney_p",
    f"""WITH {CURVE}, q AS (SELECT vol.project, CASE volume WHEN 'core' THEN 1 ELSE 2 END AS side, in_main AS v FROM vol JOIN v_meta USING (page_id)),
    {mann_whitney_sql('q', 'project', digits=12)}
    SELECT project, n1, n2, u1, u2, round(z_greater, 6) AS z_greater, round(z_less, 6) AS z_less, round(z_two_sided, 6) AS z_two_sided,
      round({normal_tail_sql('z_greater')}, 6) AS p_greater, round({normal_tail_sql('z_less')}, 6) AS p_less,
      round(least(2 * {normal_tail_sql('z_two_sided')}, 1), 6) AS p_two_sided FROM tt""",
)
def t7_p(t: Tables):
    rows = t.volumes().join(t.view("v_meta").select("page_id", "in_main"), "page_id")
    tests = statistics.mann_whitney(
        rows, "in_main", F.col("volume") == "core", F.col("volume") == "tail", ["project"]
    )
    return rounded(tests, 6, *Z, "p_greater", "p_less", "p_two_sided")




TESTED = """n1, n2, u1, u2, round(z_greater, 6) AS z_greater, round(z_less, 6) AS z_less, round(z_two_sided, 6) AS z_two_sided"""


@query(
    "t7_stable_views",
    f"""WITH {curve_sql('v_supply')}, lb AS (SELECT project, date, page_id, tot_count_views, volume FROM vol
      UNION ALL SELECT project, date, page_id, tot_count_views, 'all' FROM vol),
    np AS (SELECT project, COUNT(DISTINCT date) AS np FROM v_supply GROUP BY 1),
    oc AS (SELECT lb.*, CASE WHEN COUNT(*) OVER (PARTITION BY project, volume, page_id) = np THEN 1 ELSE 2 END AS side, tot_count_views AS v
        FROM lb JOIN np USING (project)),
    {mann_whitney_sql('oc', 'project, volume, date')} SELECT project, volume, date, {TESTED} FROM tt""",
)
def t7_stable(t: Tables):
    rows = lifetime.with_baseline(t.volumes("v_supply"))
    tests = cohorts.stable_view_tests(rows, source=t.view("v_supply"))
    return rounded(tests, 6, *Z).drop("p_greater", "p_less", "p_two_sided")


@query(
    "t7_degrees",
    f"""WITH {LABELLED}, d AS (SELECT project, volume, 'in' AS degree_type, in_main AS v FROM lb JOIN v_meta USING (page_id)
      UNION ALL SELECT project, volume, 'out', out_main FROM lb JOIN v_meta USING (page_id)),
    sd AS (SELECT project, degree_type, 'core-tail' AS comparison, CASE volume WHEN 'core' THEN 1 ELSE 2 END AS side, v FROM d WHERE volume <> 'all'
      UNION ALL SELECT project, degree_type, 'tail-all', CASE volume WHEN 'tail' THEN 1 ELSE 2 END, v FROM d WHERE volume <> 'core'),
    {mann_whitney_sql('sd', 'project, degree_type, comparison')} SELECT project, degree_type, comparison, {TESTED} FROM tt""",
)
def t7_degree(t: Tables):
    tests = cohorts.degree_tests(enrich.degrees(labelled(t), t.view("v_meta")))
    return rounded(tests, 6, *Z).drop("p_greater", "p_less", "p_two_sided")
