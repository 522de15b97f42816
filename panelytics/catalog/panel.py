"""Queries for sources, filters, identity resolution and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelytics.catalog.registry import key_slot_sql, query
from panelytics.operators import filters, identity, ranks
from panelytics.plans.views import Tables
from panelytics.session import stage_folder
from panelytics.sources import dumps, tables

# ---------------------------------------------------------------- sources


@query(
    "s1_count_dump_scan",
    """SELECT project, replace(page, ' ', '_') AS page, CASE WHEN page_id = 'null' THEN NULL ELSE page_id END AS page_id,
      access_type, counts, date FROM v_counts""",
)
def s1(t: Tables):
    folder = stage_folder(t.spark, "counts")
    counts = t.view("v_counts")
    text = F.concat_ws(
        " ", "project", F.replace("page", F.lit(" "), F.lit("_")), F.coalesce("page_id", F.lit("null")),
        "access_type", F.col("counts").cast("string"), F.lit("A1"),
    )
    name = F.concat(F.lit("pageviews-"), F.date_format("date", "yyyyMM"), F.lit("-user"))
    counts.select(text.alias("value"), name.alias("dump")).repartition("dump").write.partitionBy("dump").text(
        folder, compression="bzip2"
    )
    return dumps.read_counts(t.spark, folder).select("project", "page", "page_id", "access_type", "counts", "date")


@query(
    "s1_rejected_rows",
    """WITH c AS (SELECT date, counts, CASE WHEN counts % 10 = 3 THEN 'value' WHEN counts % 10 = 7 THEN 'columns' ELSE 'kept' END AS reason FROM v_counts)
    SELECT 'pageviews-' || strftime(date, '%Y%m') || '-user' AS dump, reason, COUNT(*) AS nb,
      CAST(SUM(CASE WHEN reason = 'kept' THEN counts END) AS BIGINT) AS counts FROM c GROUP BY 1, 2""",
)
def s1_rejects(t: Tables):
    """A dump in which counts that end with 3 are no numbers and rows of counts that end with 7 lack a column."""
    folder = stage_folder(t.spark, "damaged")
    last = F.col("counts") % 10
    fields = [
        "project", F.replace("page", F.lit(" "), F.lit("_")), F.coalesce("page_id", F.lit("null")), "access_type",
        F.when(last == 3, F.concat("counts", F.lit("x"))).otherwise(F.col("counts").cast("string")), F.when(last != 7, "A1"),
    ]
    name = F.concat(F.lit("pageviews-"), F.date_format("date", "yyyyMM"), F.lit("-user"))
    t.view("v_counts").select(F.concat_ws(" ", *fields).alias("value"), name.alias("dump")).repartition("dump").write.partitionBy(
        "dump"
    ).text(folder, compression="gzip")
    rows, bad = dumps.read_counts_and_rejects(t.spark, folder)
    kept = rows.select("dump", F.lit("kept").alias("reason"), "counts")
    lost = bad.select(F.regexp_extract("file", "dump=([^/]*)", 1).alias("dump"), "reason", F.lit(None).cast("bigint").alias("counts"))
    return kept.unionByName(lost).groupBy("dump", "reason").agg(F.count("*").alias("nb"), F.sum("counts").alias("counts"))


@query("s2_transition_dump_scan", "SELECT 'aa' AS project, date, prev, curr, type, count FROM v_links")
def s2(t: Tables):
    folder = stage_folder(t.spark, "links")
    text = F.concat_ws("\t", "prev", "curr", "type", F.col("count").cast("string"))
    name = F.concat(F.lit("clickstream-aawiki-"), F.date_format("date", "yyyy-MM"))
    t.view("v_links").select(text.alias("value"), name.alias("dump")).repartition("dump").write.partitionBy(
        "dump"
    ).text(folder, compression="gzip")
    return dumps.read_transitions(t.spark, folder).select("project", "date", "prev", "curr", "type", "count")


@query(
    "s3_panel_store",
    "SELECT project, date, page_id, page, tot_count_views FROM v_panel WHERE project = 'A' AND date >= DATE '1998-01-01'",
)
def s3(t: Tables):
    folder = stage_folder(t.spark, "panel")
    tables.write_panel(t.view("v_panel"), folder)
    panel = tables.read_panel(t.spark, folder)
    return panel.where("project = 'A' and date >= date'1998-01-01'").select(
        "project", "date", "page_id", "page", "tot_count_views"
    )


@query(
    "s4_json_lines_scan",
    "SELECT revision_id, score_label FROM v_quality",
)
def s4(t: Tables):
    folder = stage_folder(t.spark, "quality")
    t.view("v_quality").select(F.to_json(F.struct("revision_id", "page_id", "score_label"))).write.text(
        folder, compression="gzip"
    )
    return dumps.read_quality(t.spark, folder)


@query(
    "s5_delimited_metadata_scan",
    """SELECT lang AS language, CAST(doc_id % 2000 + 1 AS VARCHAR) AS page_id, source AS page_name,
      CAST(doc_id AS VARCHAR) AS revision_id, CAST(n_chars AS DOUBLE) / 100 AS wikirank_quality
    FROM documents WHERE lang = 'fr'""",
)
def s5(t: Tables):
    folder = stage_folder(t.spark, "ranked-quality")
    t.table("documents").select(
        F.col("lang").alias("language"),
        (F.col("doc_id") % 2000 + 1).cast("string").alias("page_id"),
        F.col("source").alias("page_name"),
        F.col("doc_id").cast("string").alias("revision_id"),
        (F.col("n_chars").cast("double") / 100).alias("wikirank_quality"),
    ).write.csv(folder, sep="\t", header=True)
    return dumps.read_ranked_quality(t.spark, folder, "fr")


@query(
    "s6_stage_union",
    "SELECT project, COUNT(*) AS nb_rows, CAST(SUM(tot_count_views) AS BIGINT) AS views FROM v_panel GROUP BY project",
)
def s6(t: Tables):
    panel = t.view("v_panel")
    parts = []
    for low, high in (("1900-01-01", "1996-12-31"), ("1997-01-01", "1998-12-31"), ("1999-01-01", "2999-01-01")):
        folder = stage_folder(t.spark, "batch")
        tables.write_panel(panel.where(F.col("date").between(low, high)), folder, by=["project"])
        parts.append(folder)
    return tables.read_panel(t.spark, *parts).groupBy("project").agg(
        F.count("*").alias("nb_rows"), F.sum("tot_count_views").alias("views")
    )


@query(
    "s7_report_sink",
    """SELECT CAST(date AS VARCHAR) AS date, CAST(COUNT(*) AS VARCHAR) AS nb_pages,
      CAST(CAST(SUM(tot_count_views) AS BIGINT) AS VARCHAR) AS views FROM v_panel GROUP BY date""",
)
def s7(t: Tables):
    folder = stage_folder(t.spark, "report")
    report = t.view("v_panel").groupBy("date").agg(
        F.count("*").alias("nb_pages"), F.sum("tot_count_views").alias("views")
    )
    tables.write_report(report, folder)
    return t.spark.read.csv(folder, header=True)


@query("s8_reference_series", "SELECT date, tot_views FROM v_ref_series")
def s8(t: Tables):
    folder = stage_folder(t.spark, "series")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    t.table("orders").groupBy(day.alias("month")).agg(F.count("*").alias("total.total")).write.csv(
        folder, header=True
    )
    return dumps.read_reference_series(t.spark, folder)


@query(
    "s9_dimension_rows",
    """SELECT date, page_id, page, page AS volume FROM (SELECT DISTINCT date FROM v_panel),
      (VALUES ('-1', 'other-search'), ('-2', 'other-internal'), ('-3', 'other-external')) p(page_id, page)""",
)
def s9(t: Tables):
    return tables.pseudo_pages(t.view("v_panel"))


@query(
    "s10_embedding_load",
    """SELECT page_id, len(embedding) AS dims, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm
    FROM v_vec""",
)
def s10(t: Tables):
    from pyspark.ml.functions import vector_to_array

    vectors = tables.embeddings(t.view("v_vec")).withColumn("a", vector_to_array("embed"))
    square = F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x)
    return vectors.select("page_id", F.size("a").alias("dims"), F.round(F.sqrt(square), 5).alias("norm"))


# ---------------------------------------------------------------- filters


@query(
    "p1_edition_period_filter",
    """SELECT split_part(project, '.', 1) AS project, date, page, page_id, access_type, counts FROM v_counts
    WHERE project IN ('aa.wiki', 'rr.wiki') AND date IN (DATE '1996-03-01', DATE '1999-07-01', DATE '2000-12-01')""",
)
def p1(t: Tables):
    import datetime as dt

    return filters.editions_and_periods(
        t.view("v_counts"), ["aa", "rr"], [dt.date(1996, 3, 1), dt.date(1999, 7, 1), dt.date(2000, 12, 1)], site="wiki"
    )


@query(
    "p2_special_pages",
    "SELECT * FROM v_counts WHERE page NOT IN ('Main_Page', '-', 'Search') AND counts >= 1",
)
def p2(t: Tables):
    return filters.drop_specials(t.view("v_counts"))


RULES = {"aa": ["Talk:", "alias_"], "nn": ["Talk:", "widget", "Brand#1"], "rr": ["bolt_1"]}


@query(
    "p3_namespace_filter",
    """WITH c AS (SELECT split_part(project, '.', 1) AS project, page, page_id, access_type, counts, date FROM v_counts),
    r(project, term) AS (VALUES ('aa', 'Talk:'), ('aa', 'alias_'), ('nn', 'Talk:'), ('nn', 'widget'), ('nn', 'Brand#1'), ('rr', 'bolt_1'))
    SELECT 'per_row' AS mode, c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.project = c.project AND contains(c.page, r.term))
    UNION ALL
    SELECT 'first_match', c.* FROM c WHERE NOT contains(page, 'Talk:') AND NOT contains(page, 'widget') AND NOT contains(page, 'Brand#1')""",
)
def p3(t: Tables):
    counts = t.view("v_counts").withColumn("project", filters.edition(F.col("project")))
    per_row = filters.drop_namespaces(counts, ["aa", "nn", "rr"], RULES)
    first = filters.drop_namespaces(counts, ["rr", "nn"], RULES, mode="first_match")
    return per_row.withColumn("mode", F.lit("per_row")).unionByName(first.withColumn("mode", F.lit("first_match")))


@query(
    "p4_access_split",
    """SELECT project, date, CAST(SUM(CASE WHEN access_type = 'desktop' THEN counts END) AS BIGINT) AS desktop_views,
      CAST(SUM(CASE WHEN contains(access_type, 'mobile') THEN counts END) AS BIGINT) AS mobile_views
    FROM v_counts GROUP BY project, date""",
)
def p4(t: Tables):
    return t.view("v_counts").groupBy("project", "date").agg(*filters.access_views())


@query("p5_missing_ids", "SELECT * FROM v_counts WHERE page_id IS NOT NULL AND page_id <> 'null'")
def p5(t: Tables):
    return filters.with_ids(t.view("v_counts"))


@query(
    "p6_period_predicates",
    """SELECT project, date, page_id, tot_count_views FROM v_panel
    WHERE date <= DATE '1998-06-01' AND date NOT IN (DATE '1996-01-01', DATE '1997-01-01')""",
)
def p6(t: Tables):
    kept = filters.without_periods(filters.up_to(t.view("v_panel"), "1998-06-01"), ["1996-01-01", "1997-01-01"])
    return kept.select("project", "date", "page_id", "tot_count_views")


RANKED = "(SELECT *, row_number() OVER (PARTITION BY project, date ORDER BY tot_count_views DESC, page_id) AS rank FROM {})"


@query(
    "p7_rank_steps",
    f"SELECT project, date, page_id, rank FROM {RANKED.format('v_panel')} WHERE rank % 7 = 0 OR rank = 1",
)
def p7(t: Tables):
    return filters.rank_steps(ranks.rank_rows(t.view("v_panel")), 7).select("project", "date", "page_id", "rank")


@query(
    "p8_key_sample",
    f"SELECT * FROM v_panel WHERE {key_slot_sql('page_id', 2023)} < {int(0.1 * filters.SLOTS)}",
)
def p8(t: Tables):
    return filters.key_sample(t.view("v_panel"), "page_id", 0.1, seed=2023)


@query(
    "p8_exact_sample",
    """SELECT project, date, page_id, page, tot_count_views FROM (SELECT *, row_number() OVER (PARTITION BY project, date
      ORDER BY substr(md5(page_id || ':2023'), 1, 15), page_id) AS k FROM v_panel) WHERE k <= 40""",
)
def p8_exact(t: Tables):
    sampled = filters.exact_sample(t.view("v_panel"), ["project", "date"], 40, "page_id", seed=2023)
    return sampled.select("project", "date", "page_id", "page", "tot_count_views")


@query(
    "p9_null_fill_drop",
    """SELECT project, date, page, page_id, COALESCE(desktop_views, 0) AS desktop_views, mobile_views FROM (
      SELECT project, date, page, page_id,
        CAST(SUM(CASE WHEN access_type = 'desktop' THEN counts END) AS BIGINT) AS desktop_views,
        CAST(SUM(CASE WHEN contains(access_type, 'mobile') THEN counts END) AS BIGINT) AS mobile_views
      FROM v_counts GROUP BY ALL) WHERE page_id IS NOT NULL AND mobile_views IS NOT NULL""",
)
def p9(t: Tables):
    sides = t.view("v_counts").groupBy("project", "date", "page", "page_id").agg(*filters.access_views())
    return filters.fill_views(sides.dropna(subset=["page_id", "mobile_views"]), ["desktop_views"])


@query("p10_distinct", "SELECT DISTINCT project, page, page_id FROM v_counts")
def p10(t: Tables):
    return t.view("v_counts").select("project", "page", "page_id").distinct()


# ---------------------------------------------------------------- identity

MAIN_IDS = """ids AS (SELECT project, page, arg_min(page_id, (-v, page_id)) AS page_id FROM (
      SELECT project, page, page_id, CAST(SUM(counts) AS BIGINT) AS v FROM v_counts
      WHERE date = DATE '1998-12-01' AND page_id IS NOT NULL AND page_id <> 'null' GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("c1_main_id_per_title", f"WITH {MAIN_IDS} SELECT * FROM ids")
def c1(t: Tables):
    return identity.main_ids(t.view("v_counts").where("date = date'1998-12-01'"))


@query(
    "c2_back_fill_ids",
    f"""WITH {MAIN_IDS}, c AS (SELECT project, page, access_type, date, CAST(SUM(counts) AS BIGINT) AS counts FROM v_counts GROUP BY 1, 2, 3, 4)
    SELECT c.*, ids.page_id FROM c LEFT JOIN ids USING (project, page)""",
)
def c2(t: Tables):
    counts = t.view("v_counts")
    return identity.back_fill_ids(counts, identity.main_ids(counts.where("date = date'1998-12-01'")))


COLLAPSE = """s AS (SELECT project, date, page, page_id, CAST(SUM(counts) AS BIGINT) AS v FROM v_counts GROUP BY 1, 2, 3, 4),
    s1 AS (SELECT project, date, page, v, first_value(page_id) OVER (PARTITION BY project, date, page
        ORDER BY v DESC, page_id ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS page_id FROM s),
    s2 AS (SELECT project, date, page_id, v, first_value(page) OVER (PARTITION BY project, date, page_id
        ORDER BY v DESC, page ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS page FROM s1),
    cl AS (SELECT project, date, page, any_value(page_id) AS page_id, CAST(SUM(v) AS BIGINT) AS tot_count_views FROM s2
        WHERE page_id IS NOT NULL AND page_id <> 'null' GROUP BY 1, 2, 3)"""
HASHED = "ORDER BY tot_count_views DESC, COALESCE(substr(md5({0}), 1, 3), ''), {0} NULLS LAST"


@query(
    "c3_redirect_collapse",
    f"""WITH {COLLAPSE} SELECT *, row_number() OVER (PARTITION BY project, date {HASHED.format('page_id')}) AS rank FROM cl""",
)
def c3(t: Tables):
    collapsed = identity.collapse_redirects(t.view("v_counts"))
    return identity.ranked_panel(collapsed).drop("fractional_rank")


@query(
    "c4_collapse_by_access",
    """WITH s AS (SELECT project, date, page, page_id, access_type, CAST(SUM(counts) AS BIGINT) AS v FROM v_counts GROUP BY ALL),
    s1 AS (SELECT project, date, page, access_type, v, first_value(page_id) OVER (PARTITION BY project, date, page
        ORDER BY v DESC, page_id ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS page_id FROM s),
    s2 AS (SELECT project, date, page_id, access_type, v, first_value(page) OVER (PARTITION BY project, date, page_id, access_type
        ORDER BY v DESC, page ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS page FROM s1
        WHERE page_id IS NOT NULL AND page_id <> 'null'),
    d AS (SELECT project, date, page, page_id, CAST(SUM(v) AS BIGINT) AS desktop_views FROM s2 WHERE access_type = 'desktop' GROUP BY ALL),
    m AS (SELECT project, date, page, page_id, CAST(SUM(v) AS BIGINT) AS mobile_views FROM s2 WHERE contains(access_type, 'mobile') GROUP BY ALL)
    SELECT project, date, page, page_id, desktop_views, mobile_views FROM d FULL JOIN m USING (project, date, page, page_id)""",
)
def c4(t: Tables):
    return identity.collapse_by_access(t.view("v_counts"))


@query(
    "c5_title_aggregate",
    f"""WITH a AS (SELECT project, date, page, page_id, CAST(SUM(counts) AS BIGINT) AS tot_count_views FROM v_counts GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY project, date {HASHED.format('page')}, page_id NULLS LAST) AS rank FROM a""",
)
def c5(t: Tables):
    totals = identity.title_totals(t.view("v_counts"))
    return identity.ranked_panel(totals, tie=("page", "page_id")).drop("fractional_rank")


@query(
    "c6_unmatched_ids",
    "SELECT DISTINCT page_id FROM v_panel WHERE page_id NOT IN (SELECT page_id FROM v_meta)",
)
def c6(t: Tables):
    return identity.unmatched_ids(t.view("v_panel"), t.view("v_meta"))


@query(
    "c7_redirect_remap",
    """WITH m AS (SELECT project, date, COALESCE(target, page_id) AS page_id, page, tot_count_views AS v
        FROM v_panel LEFT JOIN v_redirects ON page_id = redirect),
    a AS (SELECT project, date, page_id, arg_min(page, (-v, page)) AS page, CAST(SUM(v) AS BIGINT) AS tot_count_views FROM m GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY project, date ORDER BY tot_count_views DESC, page_id) AS rank FROM a)
    SELECT *, avg(rank) OVER (PARTITION BY project, date, tot_count_views) AS fractional_rank FROM r""",
)
def c7(t: Tables):
    return identity.ranked_panel(identity.remap_ids(t.view("v_panel"), t.view("v_redirects")))


@query(
    "c8_redirect_map",
    """WITH t AS (SELECT p_partkey AS page_id, redirect FROM part LEFT JOIN v_redirects ON p_partkey = target)
    SELECT COALESCE(redirect, page_id) AS redirect, page_id AS target FROM t
    WHERE COALESCE(redirect, page_id) IN (SELECT page_id FROM v_meta)""",
)
def c8(t: Tables):
    lists = t.view("v_redirects").groupBy(F.col("target").alias("page_id")).agg(
        F.collect_list(F.struct(F.col("redirect").alias("pageid"))).alias("redirects")
    )
    pages = t.table("part").select(F.col("p_partkey").alias("page_id")).join(lists, "page_id", "left")
    return identity.redirect_map(pages, t.view("v_meta"))


CHAINS = """sp AS (SELECT page_id, arg_min(page, (date, page)) AS first_name, arg_max(page, (date, page)) AS last_name,
      MIN(date) AS first_date, CAST(MAX(date) + INTERVAL 1 MONTH AS DATE) AS last_date, SUM(tot_count_views) AS v FROM v_succession GROUP BY page_id),
    he AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY first_name, first_date ORDER BY v DESC, page_id) AS k FROM sp) WHERE k = 1),
    ch AS (SELECT page_id, first_date, last_name, last_date FROM sp
      UNION SELECT ch.page_id, ch.first_date, b.last_name, b.last_date FROM ch JOIN he b
        ON ch.last_name = b.first_name AND ch.last_date = b.first_date),
    en AS (SELECT * FROM ch WHERE NOT EXISTS (SELECT 1 FROM sp b WHERE ch.last_name = b.first_name AND ch.last_date = b.first_date)),
    ma AS (SELECT last_name, last_date, arg_max(page_id, (first_date, page_id)) AS last_page_id, MIN(first_date) AS first_date
      FROM en GROUP BY 1, 2),
    im AS (SELECT ma.*, en.page_id AS page_ids FROM en JOIN ma USING (last_name, last_date))"""


@query("c9_succession_chains", f"WITH RECURSIVE {CHAINS} SELECT * FROM im")
def c9(t: Tables):
    return identity.succession_map(t.view("v_succession"))


@query(
    "c10_apply_identity",
    f"""WITH RECURSIVE {CHAINS} SELECT date, last_page_id AS page_id, last_name AS page, tot_count_views, first_date, last_date
    FROM v_succession JOIN im ON page_id = page_ids""",
)
def c10(t: Tables):
    panel = t.view("v_succession")
    return identity.apply_identity(panel, identity.succession_map(panel))


@query(
    "c11_revision_to_page",
    """SELECT revision_id, score_label, doc_id % 2000 + 1 AS page_id FROM v_quality JOIN documents ON doc_id = revision_id""",
)
def c11(t: Tables):
    mapping = t.table("documents").select(
        F.col("doc_id").alias("revision_id"), (F.col("doc_id") % 2000 + 1).alias("page_id")
    )
    return identity.pages_of_revisions(t.view("v_quality").select("revision_id", "score_label"), mapping)


@query(
    "c12_item_ids",
    """SELECT p.project, p.date, p.page_id, p.tot_count_views, m.item_id FROM v_panel p JOIN v_meta m USING (page_id)
    WHERE (p.project = 'A' AND m.in_main % 2 = 0) OR (p.project = 'N' AND m.in_main % 2 = 1)""",
)
def c12(t: Tables):
    meta = t.view("v_meta").withColumn(
        "wiki_db", F.when(F.col("in_main") % 2 == 0, "Awiki").otherwise("Nwiki")
    )
    wanted = tables.dimension(t.spark, [("A",), ("N",)], "project string")
    return identity.attach_items(t.view("v_panel"), meta, wanted).select(
        "project", "date", "page_id", "tot_count_views", "item_id"
    )


# ---------------------------------------------------------------- ranks


@query(
    "k1_ordinal_rank",
    f"SELECT project, date, page_id, tot_count_views, rank FROM {RANKED.format('v_daily')} WHERE rank <= 1500",
)
def k1(t: Tables):
    return ranks.rank_rows(t.view("v_daily"), lim=1500).select(
        "project", "date", "page_id", "tot_count_views", "rank"
    )


@query(
    "k2_fractional_rank",
    f"""SELECT project, date, page_id, avg(rank) OVER (PARTITION BY project, date, tot_count_views) AS fractional_rank
    FROM {RANKED.format('v_daily')}""",
)
def k2(t: Tables):
    return ranks.fractional_rank(t.view("v_daily")).select("project", "date", "page_id", "fractional_rank")


@query(
    "k3_rank_bins",
    f"""SELECT project, date, page_id, rank, least(rank // 50, 11) AS rank_range, length(CAST(rank AS VARCHAR)) - 1 AS decade
    FROM {RANKED.format('v_panel_all')} WHERE rank <= 600""",
)
def k3(t: Tables):
    bins = ranks.rank_bins(t.view("v_panel_all"), lim=600, slicing=50)
    return bins.select(
        "project", "date", "page_id", "rank", "rank_range", ranks.rank_decade(F.col("rank")).alias("decade")
    )


@query(
    "k4_view_bins",
    f"""SELECT project, date, page_id, tot_count_views, least((tot_count_views - 1) // 33, 3) AS freq_bins
    FROM {RANKED.format('v_panel_all')} WHERE rank <= 500""",
)
def k4(t: Tables):
    bins = ranks.view_bins(t.view("v_panel_all"), lim=500, nb_bins=3, min_views=1, max_views=101)
    return bins.select("project", "date", "page_id", "tot_count_views", "freq_bins")


@query(
    "k5_period_rank_bins",
    """WITH d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT date FROM v_panel_all)),
    b AS (SELECT p.*, least(i // (n // 4), ceil((n - 1) / (n // 4)) - 1)::BIGINT AS date_range FROM v_panel_all p JOIN d USING (date)),
    r AS (SELECT *, row_number() OVER (PARTITION BY project, date_range ORDER BY tot_count_views DESC, page_id, date) AS rank FROM b)
    SELECT project, date, page_id, date_range, rank, least(rank // 500, 7) AS rank_range FROM r WHERE rank <= 4000""",
)
def k5(t: Tables):
    bins = ranks.period_rank_bins(t.view("v_panel_all"), lim=4000, slicing=500, nb_bin_dates=4)
    return bins.select("project", "date", "page_id", "date_range", "rank", "rank_range")


@query(
    "k6_zipf_profile",
    f"""SELECT project, rank, round(avg(tot_count_views), 6) AS avg_views, round(stddev_samp(tot_count_views), 6) AS std_views,
      round(stddev_samp(tot_count_views) * 1.96 / sqrt(COUNT(*)), 6) AS error,
      round(1.5e7 * pow(CAST(rank AS DOUBLE), -1.0 / 2), 4) AS law_half, round(1.5e7 * pow(CAST(rank AS DOUBLE), -2.0 / 3), 4) AS law_two_thirds
    FROM {RANKED.format('v_panel')} WHERE rank IN (1, 10, 50, 100, 200) GROUP BY project, rank""",
)
def k6(t: Tables):
    profile = ranks.zipf_profile(ranks.rank_rows(t.view("v_panel")), [1, 10, 50, 100, 200], ["project"])
    return profile.select(
        "project", "rank", *[F.round(c, 6).alias(c) for c in ("avg_views", "std_views", "error")],
        *[F.round(c, 4).alias(c) for c in ("law_half", "law_two_thirds")],
    )


@query(
    "k7_top_pages",
    f"SELECT project, date, page_id, page, tot_count_views, rank FROM {RANKED.format('v_panel')} WHERE rank < 5",
)
def k7(t: Tables):
    return ranks.rank_rows(t.view("v_panel"), lim=4)


@query(
    "panel_build",
    f"""WITH f AS (SELECT split_part(project, '.', 1) AS project, date, page, page_id, counts FROM v_counts
        WHERE project IN ('aa.wiki', 'nn.wiki') AND page NOT IN ('Main_Page', '-', 'Search') AND counts >= 1),
    {COLLAPSE.replace('FROM v_counts', "FROM f WHERE NOT (project = 'aa' AND (contains(page, 'Talk:') OR contains(page, 'alias_'))) AND NOT (project = 'nn' AND (contains(page, 'Talk:') OR contains(page, 'widget') OR contains(page, 'Brand#1')))")}
    SELECT *, row_number() OVER (PARTITION BY project, date {HASHED.format('page_id')}) AS rank FROM cl""",
)
def panel_build(t: Tables):
    rows = filters.articles(t.view("v_counts"), ["aa", "nn"], site="wiki", rules=RULES)
    return identity.ranked_panel(identity.collapse_redirects(rows)).drop("fractional_rank")
