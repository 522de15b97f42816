"""Queries for matched pairs, transitions and models."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelytics.catalog.dynamics import CURVE, rounded
from panelytics.catalog.registry import curve_sql, key_slot_sql, query
from panelytics.operators import filters, hinge, models, pairs, ranks, transitions
from panelytics.plans.views import Tables
from panelytics.session import stage

# ------------------------------------------------------------ matched pairs

# Items: the same page_id has one item id in every edition.
ITEM_PANEL = "ip AS (SELECT project, date, page_id, item_id, tot_count_views FROM v_panel JOIN v_meta USING (page_id))"
TOTALS = "et AS (SELECT project, COUNT(*) AS nb_articles, CAST(SUM(tot_count_views) AS BIGINT) AS nb_views FROM ip WHERE date = DATE '1998-11-01' GROUP BY 1)"


def pairs_sql(table: str, measures: list[str], precision: float, name: str) -> str:
    tests = " AND ".join(
        f"abs(ln(CAST(a.{m} AS DOUBLE) / b.{m})) <> 0 AND abs(ln(CAST(a.{m} AS DOUBLE) / b.{m})) <= -ln(CAST({precision} AS DOUBLE))"
        for m in measures
    )
    cols = ", ".join(f"a.{m} AS {m}_1, b.{m} AS {m}_2" for m in measures)
    return f"{name} AS (SELECT a.project AS lang1, b.project AS lang2, {cols} FROM {table} a JOIN {table} b ON a.project < b.project AND {tests})"


PRECISION = 0.5
MATCHED = f"{ITEM_PANEL}, {TOTALS}, {pairs_sql('et', ['nb_articles', 'nb_views'], PRECISION, 'mp')}"


def items(t: Tables) -> DataFrame:
    return t.shared(
        "items", lambda: t.view("v_panel").join(t.view("v_meta").select("page_id", "item_id"), "page_id")
    )


def totals(t: Tables) -> DataFrame:
    return pairs.edition_totals(items(t).where("date = date'1998-11-01'"))


def edition_pairs(t: Tables) -> DataFrame:
    return t.shared(
        "edition pairs", lambda: pairs.similar_pairs(totals(t), ["nb_articles", "nb_views"], PRECISION)
    )


@query("m1_edition_totals", f"WITH {ITEM_PANEL}, {TOTALS} SELECT * FROM et")
def m1(t: Tables):
    panel = t.view("v_panel").where("date = date'1998-11-01'")
    known = items(t).select("project", "page", "page_id").distinct()
    return pairs.edition_totals(panel, known)


SOURCES = """so AS (SELECT source || '.' || lang AS project, COUNT(*) AS nb_articles, CAST(SUM(n_chars) AS BIGINT) AS nb_views, avg(n_chars) AS avg_views FROM documents GROUP BY 1)"""


def sources(t: Tables) -> DataFrame:
    """Every source and language as an edition: sizes differ, but not by much."""
    return t.view("v_editions").select(F.concat_ws(".", "source", "project").alias("project"), "counts")


@query(
    "m2_similar_editions",
    f"WITH {SOURCES}, {pairs_sql('so', ['nb_articles', 'nb_views'], 0.7, 'sp')} SELECT * FROM sp",
)
def m2(t: Tables):
    counts = sources(t)
    return pairs.similar_pairs(
        pairs.edition_totals(counts, views="counts"), ["nb_articles", "nb_views"], 0.7
    ).drop("pairs")


@query(
    "m3_pairs_by_mean_views",
    f"""WITH {SOURCES}, {pairs_sql('so', ['nb_articles', 'nb_views'], 0.7, 'sp')}, {pairs_sql('so', ['avg_views'], 0.85, 'av')},
    k AS (SELECT lang1, lang2 FROM av SEMI JOIN sp USING (lang1, lang2))
    SELECT lang1 || '-' || lang2 AS pair, lang1, lang2 FROM k UNION ALL SELECT lang2 || '-' || lang1, lang1, lang2 FROM k""",
)
def m3(t: Tables):
    counts = sources(t)
    matched = pairs.similar_pairs(pairs.edition_totals(counts, views="counts"), ["nb_articles", "nb_views"], 0.7)
    stats = counts.groupBy("project").agg(F.avg("counts").alias("avg_views"))
    found = pairs.pairs_by_mean_views(stats, matched)
    return found.select(F.array_join("pairs", "-").alias("pair"), "lang1", "lang2")


@query(
    "m4_item_panel",
    """WITH c AS (SELECT split_part(project, '.', 1) AS project, date, CAST(page_id AS BIGINT) AS page_id, counts FROM v_counts
        WHERE page_id IS NOT NULL AND page_id <> 'null'),
    s AS (SELECT project, date, page_id, CAST(SUM(CASE WHEN counts > 0 THEN counts ELSE 0 END) AS BIGINT) AS tot_count_views FROM c GROUP BY 1, 2, 3)
    SELECT s.*, item_id, row_number() OVER (PARTITION BY project, date ORDER BY tot_count_views DESC, page_id) AS rank FROM s JOIN v_meta USING (page_id)""",
)
def m4(t: Tables):
    counts = filters.with_ids(t.view("v_counts")).select(
        filters.edition(F.col("project")).alias("project"), "date", F.col("page_id").cast("bigint").alias("page_id"),
        F.when(F.col("counts") > 0, F.col("counts")).alias("counts"),
    )
    meta = t.view("v_meta").select("page_id", "item_id")
    known = counts.select("project", "page_id").distinct().join(meta, "page_id")
    return ranks.rank_rows(stage(pairs.item_panel(counts, known), "items"))


LABELLED_ITEMS = f"{MATCHED}, {curve_sql('ip')}"
MEMBERS = f"""{LABELLED_ITEMS}, co AS (SELECT project, date, item_id, MIN(date) OVER (PARTITION BY project, item_id) AS f FROM vol WHERE volume = 'core'),
    en AS (SELECT a.date, a.item_id, lang1, lang2 FROM co a JOIN mp ON a.project = lang1 JOIN co b ON b.project = lang2 AND b.item_id = a.item_id
        AND b.date = a.date WHERE a.date = a.f AND b.date = b.f),
    me AS (SELECT *, lang1 AS project FROM en UNION ALL SELECT *, lang2 FROM en),
    tb AS (SELECT me.*, CASE WHEN v.item_id IS NULL THEN 0 ELSE 1 END AS was_in_tail FROM me LEFT JOIN vol v ON v.project = me.project
        AND v.item_id = me.item_id AND v.volume = 'tail' AND CAST(v.date + INTERVAL 1 MONTH AS DATE) = me.date),
    tr AS (SELECT * FROM (SELECT *, CAST(SUM(was_in_tail) OVER (PARTITION BY lang1, lang2, item_id, date) AS BIGINT) AS intail FROM tb) WHERE intail = 1),
    pp AS (SELECT tr.*, post.tot_count_views AS views_post_treat, COALESCE(pre.tot_count_views, 0) AS views_pre_treat FROM tr
        JOIN ip post ON post.project = tr.project AND post.item_id = tr.item_id AND post.date = tr.date
        LEFT JOIN ip pre ON pre.project = tr.project AND pre.item_id = tr.item_id AND CAST(pre.date + INTERVAL 1 MONTH AS DATE) = tr.date)"""


def labelled_items(t: Tables) -> DataFrame:
    return t.shared("volumes of items", lambda: hinge.volume_labels(items(t), everyone=True).select(
        "project", "date", "page_id", "item_id", "tot_count_views", "volume"
    ))


def members(t: Tables) -> DataFrame:
    return pairs.pair_members(pairs.pair_entries(labelled_items(t), edition_pairs(t)))


def treated(t: Tables) -> DataFrame:
    return pairs.pre_post_views(pairs.treated_pairs(members(t)))


@query(
    "m5_item_pairs",
    f"""WITH {LABELLED_ITEMS} SELECT a.date, a.item_id, lang1, lang2 FROM vol a JOIN mp ON a.project = lang1
    JOIN vol b ON b.project = lang2 AND b.item_id = a.item_id AND b.date = a.date WHERE a.volume = 'core' AND b.volume = 'core'""",
)
def m5(t: Tables):
    return pairs.pair_items(labelled_items(t).where("volume = 'core'"), edition_pairs(t)).select(
        "date", "item_id", "lang1", "lang2"
    )


@query("m6_first_time_in_core", f"WITH {MEMBERS} SELECT date, item_id, lang1, lang2 FROM en")
def m6(t: Tables):
    return pairs.pair_entries(labelled_items(t), edition_pairs(t)).select("date", "item_id", "lang1", "lang2")


@query("m7_tail_before", f"WITH {MEMBERS} SELECT date, item_id, lang1, lang2, project, was_in_tail FROM tb")
def m7(t: Tables):
    return members(t).select("date", "item_id", "lang1", "lang2", "project", "was_in_tail")


@query("m8_exactly_one_treated", f"WITH {MEMBERS} SELECT date, item_id, lang1, lang2, project, was_in_tail, intail FROM tr")
def m8(t: Tables):
    return pairs.treated_pairs(members(t)).select(
        "date", "item_id", "lang1", "lang2", "project", "was_in_tail", "intail"
    )


@query(
    "m9_pre_post_views",
    f"""WITH {MEMBERS} SELECT date AS treatment_date, CAST(date - INTERVAL 1 MONTH AS DATE) AS previous_date, item_id, lang1, lang2, project,
      was_in_tail, views_post_treat, views_pre_treat FROM pp""",
)
def m9(t: Tables):
    return treated(t).drop("intail")


@query(
    "m10_difference_in_differences",
    f"""WITH {MEMBERS}, l AS (SELECT 0 AS p, was_in_tail AS t, CAST(views_pre_treat AS DOUBLE) AS y FROM pp
        UNION ALL SELECT 1, was_in_tail, CAST(views_post_treat AS DOUBLE) FROM pp),
    a AS (SELECT COUNT(*) AS n, var_pop(y) * COUNT(*) AS tss FROM l),
    c AS (SELECT p, t, COUNT(*) AS n, avg(y) AS m, var_pop(y) * COUNT(*) AS q FROM l GROUP BY 1, 2),
    r AS (SELECT SUM(q) AS rss, MAX(m) FILTER (WHERE p = 0 AND t = 0) AS m00, MAX(m) FILTER (WHERE p = 0 AND t = 1) AS m01,
        MAX(m) FILTER (WHERE p = 1 AND t = 0) AS m10, MAX(m) FILTER (WHERE p = 1 AND t = 1) AS m11,
        MAX(1 / n) FILTER (WHERE p = 0 AND t = 0) AS i00, MAX(1 / n) FILTER (WHERE p = 0 AND t = 1) AS i01,
        MAX(1 / n) FILTER (WHERE p = 1 AND t = 0) AS i10, MAX(1 / n) FILTER (WHERE p = 1 AND t = 1) AS i11 FROM c),
    o AS (SELECT 'intercept' AS term, m00 AS coef, i00 AS s FROM r UNION ALL SELECT 'post', m10 - m00, i00 + i10 FROM r
        UNION ALL SELECT 'treated', m01 - m00, i00 + i01 FROM r UNION ALL SELECT 'post:treated', m11 - m10 - m01 + m00, i00 + i01 + i10 + i11 FROM r)
    SELECT term, round(coef, 6) AS coef, round(sqrt(rss / NULLIF(a.n - 4, 0) * s), 6) AS std_err, round(coef / sqrt(rss / NULLIF(a.n - 4, 0) * s), 6) AS t_value,
      a.n, round(1 - rss / tss, 6) AS r_squared FROM o, r, a""",
)
def m10(t: Tables):
    table = pairs.difference_in_differences(treated(t))
    return rounded(table, 6, "coef", "std_err", "t_value", "r_squared")


@query(
    "m11_edition_coverage",
    """WITH o AS (SELECT project, COUNT(*) AS nb_custom FROM v_panel JOIN v_meta USING (page_id) WHERE date = DATE '1998-11-01' GROUP BY 1),
    k AS (SELECT project, COUNT(*) AS nb_articles FROM (SELECT DISTINCT project, page_id FROM v_panel WHERE page_id IN (SELECT page_id FROM v_meta)) GROUP BY 1)
    SELECT project, nb_custom, nb_articles, round(nb_custom / nb_articles, 6) AS coverage FROM o JOIN k USING (project) WHERE nb_custom / nb_articles > 0.1""",
)
def m11(t: Tables):
    known = items(t).select("project", "page_id").distinct()
    return rounded(pairs.covered_editions(items(t), known, dt.date(1998, 11, 1), least=0.1), 6, "coverage")


@query(
    "m12_pairs_per_date",
    f"WITH {MEMBERS} SELECT date AS treatment_date, COUNT(*) / 2 AS nb_pairs FROM pp GROUP BY 1",
)
def m12(t: Tables):
    return pairs.pairs_per_date(treated(t))


# -------------------------------------------------------------- transitions

LINKS = f"""{curve_sql('v_panel_all')},
    ln AS (SELECT date, prev, curr, CAST(SUM(count) AS BIGINT) AS count FROM v_links WHERE type <> 'other'
        AND prev NOT IN ('other-other', 'other-empty') GROUP BY 1, 2, 3),
    nb AS (SELECT date, CAST(page_id AS VARCHAR) AS page, volume FROM vol),
    pv AS (SELECT * FROM nb UNION ALL SELECT d.date, s.s, s.s FROM (SELECT DISTINCT date FROM v_links) d,
        (VALUES ('other-search'), ('other-internal'), ('other-external')) s(s)),
    sv AS (SELECT ln.*, pv.volume AS volume_prev FROM ln LEFT JOIN pv ON pv.date = ln.date AND pv.page = ln.prev),
    bv AS (SELECT sv.*, nb.volume AS volume_curr FROM sv LEFT JOIN nb ON nb.date = sv.date AND nb.page = sv.curr),
    mx AS (SELECT date, curr, volume_curr, CAST(COALESCE(SUM(count) FILTER (WHERE volume_prev = 'core'), 0) AS BIGINT) AS core,
        CAST(COALESCE(SUM(count) FILTER (WHERE volume_prev = 'tail'), 0) AS BIGINT) AS tail,
        CAST(COALESCE(SUM(count) FILTER (WHERE volume_prev = 'other-external'), 0) AS BIGINT) AS "other-external",
        CAST(COALESCE(SUM(count) FILTER (WHERE volume_prev = 'other-search'), 0) AS BIGINT) AS "other-search"
        FROM bv WHERE volume_prev IS NOT NULL AND volume_curr IS NOT NULL GROUP BY 1, 2, 3),
    mt AS (SELECT *, "other-external" + "other-search" AS "total-external", "other-external" + "other-search" + core + tail AS total FROM mx),
    fr AS (SELECT *, core / NULLIF(total, 0) * 100 AS frac_core, "total-external" / NULLIF(total, 0) * 100 AS frac_external,
        tail / NULLIF(total, 0) * 100 AS frac_tail FROM mt)"""


# The test links are of one edition.
BY = ("date",)


def link_counts(t: Tables) -> DataFrame:
    return transitions.transition_counts(t.view("v_links"), BY)


def link_labels(t: Tables) -> DataFrame:
    return t.volumes("v_panel_all").select("date", F.col("page_id").cast("string").alias("page"), "volume")


def matrix(t: Tables) -> DataFrame:
    return transitions.transition_matrix(link_counts(t), link_labels(t), BY)


@query("g1_transition_counts", f"WITH {LINKS} SELECT * FROM ln")
def g1(t: Tables):
    return link_counts(t)


@query(
    "g2_labelled_transitions",
    f"WITH {LINKS} SELECT * FROM bv WHERE volume_prev IS NOT NULL AND volume_curr IS NOT NULL",
)
def g2(t: Tables):
    return transitions.labelled_transitions(link_counts(t), link_labels(t), BY)


@query(
    "g2_label_loss",
    f"""WITH {LINKS}, n AS (SELECT date, COUNT(*) AS a, CAST(COUNT_IF(volume_prev IS NOT NULL AND volume_curr IS NOT NULL) AS BIGINT) AS b FROM bv GROUP BY 1)
    SELECT date, a AS initial_links, b AS final_links, round(100 - b / a * 100, 6) AS loss FROM n""",
)
def g2_loss(t: Tables):
    return rounded(transitions.label_loss(link_counts(t), link_labels(t), BY), 6, "loss")


@query("g3_transition_matrix", f"WITH {LINKS} SELECT * FROM mt")
def g3(t: Tables):
    return matrix(t)


@query(
    "g4_source_fractions",
    f"""WITH {LINKS} SELECT date, curr, volume_curr, total, round(frac_core, 6) AS frac_core, round(frac_external, 6) AS frac_external,
      round(frac_tail, 6) AS frac_tail FROM fr""",
)
def g4(t: Tables):
    fractions = rounded(transitions.source_fractions(matrix(t)), 6, "frac_core", "frac_external", "frac_tail")
    return fractions.select("date", "curr", "volume_curr", "total", "frac_core", "frac_external", "frac_tail")


@query(
    "g5_fraction_means",
    f"""WITH {LINKS} SELECT date, volume_curr, round(avg(frac_core), 6) AS avg, round(stddev_samp(frac_core) * 1.96 / sqrt(COUNT(*)), 6) AS error,
      COUNT(*) AS nb FROM fr GROUP BY 1, 2""",
)
def g5(t: Tables):
    return rounded(
        transitions.fraction_means(transitions.source_fractions(matrix(t)), "frac_core", (*BY, "volume_curr")), 6, "avg", "error"
    )


@query(
    "g6_fraction_medians",
    f"WITH {LINKS} SELECT date, volume_curr, round(quantile_cont(frac_external, 0.5), 6) AS median FROM fr WHERE frac_external IS NOT NULL GROUP BY 1, 2",
)
def g6(t: Tables):
    fractions = transitions.source_fractions(matrix(t))
    return rounded(transitions.fraction_medians(fractions, "frac_external", (*BY, "volume_curr")), 6, "median")


# ------------------------------------------------------------------- models

AT = dt.date(1998, 11, 1)


def features(t: Tables) -> DataFrame:
    month = t.volumes("v_panel").where(F.col("date") == F.lit(AT))
    return models.feature_table(month, t.view("v_meta"), AT)


def sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    table = models.with_class_weight(models.assembled(features(t)))
    train, test = models.split(t.shared("model features", lambda: table))
    return train, test


@query(
    "x1_feature_table",
    f"""WITH {CURVE} SELECT page_id, CASE volume WHEN 'core' THEN 1 ELSE 0 END AS is_core,
      CAST(date_diff('month', creation_date, DATE '1998-11-01') AS DOUBLE) AS age_in_months, is_orphan, is_bot_created, pred_qual, in_main, out_main
    FROM vol JOIN v_meta USING (page_id) WHERE date = DATE '1998-11-01'""",
)
def x1(t: Tables):
    return features(t)


FEATURES = f"""{CURVE}, ft AS (SELECT page_id, CASE volume WHEN 'core' THEN 1 ELSE 0 END AS is_core,
      CASE WHEN {key_slot_sql('page_id', models.SEED)} < {int(models.TRAIN_SHARE * filters.SLOTS)} THEN 'train' ELSE 'test' END AS part
    FROM vol JOIN v_meta USING (page_id) WHERE date = DATE '1998-11-01'),
    sh AS (SELECT avg(is_core) AS s FROM ft), wt AS (SELECT ft.*, CASE is_core WHEN 1 THEN 0.5 / s ELSE 0.5 / (1 - s) END AS weight FROM ft, sh)"""


@query(
    "x2_weighted_split",
    f"WITH {FEATURES} SELECT part, is_core, COUNT(*) AS nb, round(MAX(weight), 6) AS weight FROM wt GROUP BY 1, 2",
)
def x2(t: Tables):
    train, test = sets(t)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "is_core").agg(F.count("*").alias("nb"), F.round(F.max("weight"), 6).alias("weight"))


_fitted: dict[tuple, tuple] = {}


def _fit(t: Tables, kind: str, fit) -> tuple:
    """Model, predictions and training rows; fitted once per session and folder."""
    slot = (t.spark.sparkContext.applicationId, t.folder, kind)
    if slot not in _fitted:
        train, test = sets(t)
        model = fit(train)
        _fitted[slot] = (model, model.transform(test), train)
    return _fitted[slot]


def forest(t: Tables) -> tuple:
    return _fit(t, "forest", lambda train: models.fit_forest(train, folds=3))


def logistic(t: Tables) -> tuple:
    return _fit(t, "logistic", lambda train: models.fit_logistic(train, folds=3))


@query("x3_random_forest")
def x3(t: Tables):
    _, predicted, _ = forest(t)
    return predicted.select("page_id", "is_core", "prediction")


@query("x4_logistic_regression")
def x4(t: Tables):
    _, predicted, _ = logistic(t)
    return predicted.select("page_id", "is_core", "prediction")


# A fixed rule as predictions, so that SQL can check the measures.
PREDICTED = f"""{CURVE}, pd AS (SELECT CASE volume WHEN 'core' THEN 1 ELSE 0 END AS y, CASE WHEN in_main > 20 THEN 1 ELSE 0 END AS p
    FROM vol JOIN v_meta USING (page_id) WHERE date = DATE '1998-11-01'),
    cf AS (SELECT CAST(COUNT_IF(y = 1 AND p = 1) AS BIGINT) AS tp, CAST(COUNT_IF(y = 1 AND p = 0) AS BIGINT) AS fn,
      CAST(COUNT_IF(y = 0 AND p = 1) AS BIGINT) AS fp, CAST(COUNT_IF(y = 0 AND p = 0) AS BIGINT) AS tn FROM pd),
    rt AS (SELECT *, tp + fn + fp + tn AS n, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0 FROM cf)"""


def rule(t: Tables) -> DataFrame:
    return features(t).withColumn("prediction", (F.col("in_main") > 20).cast("double"))


@query(
    "x5_evaluation",
    f"""WITH {PREDICTED} SELECT round((tp + tn) / n, 6) AS accuracy,
      round((tp + fn) / n * 2 * p1 * r1 / (p1 + r1) + (tn + fp) / n * 2 * p0 * r0 / (p0 + r0), 6) AS f1,
      round((tp + fn) / n * p1 + (tn + fp) / n * p0, 6) AS "weightedPrecision", round((tp + fn) / n * r1 + (tn + fp) / n * r0, 6) AS "weightedRecall" FROM rt""",
)
def x5(t: Tables):
    return rounded(models.evaluate(rule(t)), 6, *models.METRICS)


@query(
    "x6_confusion",
    f"WITH {PREDICTED} SELECT tp, fn, fp, tn, round(r1, 6) AS tpr, round(r0, 6) AS tnr, round(p0, 6) AS npv FROM rt",
)
def x6(t: Tables):
    return rounded(models.confusion(rule(t)), 6, "tpr", "tnr", "npv")


@query("x5_model_evaluation")
def x5_models(t: Tables):
    """The fitted forest and regression on their test rows."""
    rows = [models.evaluate(_fitted_rows(t, k)).withColumn("model", F.lit(k)) for k in ("forest", "logistic")]
    return rows[0].unionByName(rows[1])


@query("x6_model_confusion")
def x6_models(t: Tables):
    rows = [models.confusion(_fitted_rows(t, k)).withColumn("model", F.lit(k)) for k in ("forest", "logistic")]
    return rows[0].unionByName(rows[1])


def _fitted_rows(t: Tables, kind: str) -> DataFrame:
    return (forest if kind == "forest" else logistic)(t)[1]


@query("x7_feature_importance")
def x7(t: Tables):
    by_forest, _, train = forest(t)
    by_logit, _, _ = logistic(t)
    return models.importances(by_forest, train).withColumn("model", F.lit("forest")).unionByName(
        models.importances(by_logit, train).withColumn("model", F.lit("logistic"))
    )


def deviance(t: Tables) -> DataFrame:
    return models.deviance_test(sets(t)[0])[1]


@query("x8_deviance_test")
def x8(t: Tables):
    return deviance(t)


@query(
    "x8_null_deviance",
    f"""WITH {FEATURES}, p AS (SELECT SUM(weight * is_core) / SUM(weight) AS p FROM wt WHERE part = 'train')
    SELECT round(-2 * SUM(weight * (is_core * ln(p) + (1 - is_core) * ln(1 - p))), 4) AS null_deviance, CAST(6 AS BIGINT) AS degrees
    FROM wt, p WHERE part = 'train'""",
)
def x8_null(t: Tables):
    """The part of the test that has a closed form."""
    return deviance(t).select(F.round("null_deviance", 4).alias("null_deviance"), "degrees")
