"""The shape of the plans: no single-task exchange, no product joins, pruned scans."""

from __future__ import annotations

import contextlib
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelytics.operators import filters, hinge, identity, overlap, ranks
from panelytics.plans.joins import attach
from panelytics.plans.views import Tables
from panelytics.sources import dumps
from panelytics.streaming.arrivals import append_arrivals, arriving_counts

FOLDER = "/root/testdata/sf0.001"

SPREAD = [
    "core_sizes", "h1_cumulative_curve", "h3_hinge_point", "h4_core_extraction", "k1_ordinal_rank", "k2_fractional_rank",
    "r1_rank_alignment", "r2_rtd_finite", "r8_salient_pages", "o1_overlap_at_lag", "o2_multi_lag_overlap",
    "o4_incoming_pages", "o6_outgoing_pages", "o8_incoming_by_lag", "o10_previous_appearances", "l2_common_unique_shares",
    "l3_run_lengths", "l6_run_quantiles", "a2_bad_creation", "c3_redirect_collapse", "m6_first_time_in_core",
    "m9_pre_post_views", "g3_transition_matrix", "t7_mann_whitney", "e18_quality_profile",
]


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", SPREAD)
def test_no_step_runs_in_one_task_or_forms_products(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "SinglePartition" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "panel")
    rows = [("en", dt.date(2020, 1, 1 + i % 3), i, f"p{i}", 1 + i % 7) for i in range(300)]
    schema = "project string, date date, page_id bigint, page string, tot_count_views bigint"
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


def test_hinge_reads_three_columns(stored):
    text = plan(hinge.hinge_points(stored))
    assert "ReadSchema: struct<project:string,date:date,tot_count_views:bigint>" in text
    assert "page_id" not in text


def test_edition_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "counts")
    schema = "project string, page string, page_id string, access_type string, counts bigint, date date"
    spark.createDataFrame([("en.wikipedia", "A", "1", "desktop", 3, dt.date(2020, 1, 1))], schema).write.parquet(path)
    df = filters.editions_and_periods(spark.read.parquet(path), ["en", "fr"], [dt.date(2020, 1, 1)])
    text = plan(df)
    assert "In(project, [en.wikipedia,fr.wikipedia])" in text and "date" in text.split("PushedFilters")[1]
    assert df.count() == 1


def test_labels_move_no_row_but_ties(stored):
    text = plan(hinge.volume_labels(stored))
    rows = [line for line in text.splitlines() if "Arguments: hashpartitioning" in line and "page_id" in line]
    assert not rows and "BroadcastHashJoin" in text


def test_core_sizes_read_the_histogram_only(stored):
    scan = [line for line in plan(hinge.core_bounds(stored)).splitlines() if "ReadSchema" in line]
    assert scan and all("page_id" not in line for line in scan)


@pytest.mark.parametrize("name", ["p6_period_predicates", "m11_edition_coverage", "x1_feature_table"])
def test_filters_prune_the_stored_panel(spark, name):
    text = plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert any("PartitionFilters" in line and ("date" in line or "project" in line) for line in text.splitlines())


def test_flux_needs_one_shuffle_by_entity(stored):
    text = plan(overlap.mark_flux(stored))
    assert text.count("hashpartitioning(project") - text.count("hashpartitioning(project#") in (0,)
    exchanges = [line for line in text.splitlines() if "Arguments: hashpartitioning" in line and "page_id" in line]
    assert len(exchanges) == 1


def test_redirect_collapse_has_no_join_and_no_window(stored):
    df = identity.collapse_redirects(stored.withColumnRenamed("tot_count_views", "counts"))
    text = plan(df)
    assert "Join" not in text and "Window" not in text


def test_the_size_on_disk_decides_what_is_broadcast(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 10).alias("k"))
    short = str(tmp_path / "short")
    spark.range(10).select(F.col("id").alias("k")).write.parquet(short)
    assert "BroadcastHashJoin" in plan(attach(rows, spark.read.parquet(short), ["k"]))
    # More rows under the same path are seen: nothing is remembered.
    spark.range(10, 200_000).select(F.col("id").alias("k")).write.mode("append").parquet(short)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        many = spark.range(9_000_000).select(F.col("id").alias("k"))
        assert "BroadcastHashJoin" not in plan(attach(many, spark.read.parquet(short), ["k"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_arrivals_are_taken_up_once(spark, tmp_path):
    inbox, table, memory = (str(tmp_path / n) for n in ("in", "table", "memory"))

    def arrive(month: str, rows: list[str]) -> None:
        name = f"{inbox}/pageviews-{month}-user"
        spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(name)

    def take_up() -> None:
        append_arrivals(arriving_counts(spark, inbox), table, memory).awaitTermination()

    arrive("202001", ['en.wikipedia "A"_b 12 desktop 3 A3', "en.wikipedia B null mobile-web 4 B4"])
    take_up()
    arrive("202002", ["fr.wikipedia C 7 desktop 1 A1"])
    take_up()
    take_up()
    got = {(r.project, r.page, r.page_id, r.counts, r.date) for r in spark.read.parquet(table).collect()}
    assert got == {
        ("en.wikipedia", '"A"_b', "12", 3, dt.date(2020, 1, 1)), ("en.wikipedia", "B", None, 4, dt.date(2020, 1, 1)),
        ("fr.wikipedia", "C", "7", 1, dt.date(2020, 2, 1)),
    }
    batch = dumps.read_counts(spark, [f"{inbox}/pageviews-202001-user"])
    assert batch.count() == 2


@pytest.mark.parametrize("name", ["v_panel", "v_panel_all"])
def test_a_panel_is_summed_in_one_shuffle(spark, name):
    """The shuffle that sums the rows also lays them by edition and period, and all editions need no second one."""
    views = Tables(spark, FOLDER)
    moved = [line for line in plan(views.plan(name)).splitlines() if "Arguments: hashpartitioning" in line and "partkey" not in line]
    assert len(moved) == 1 and "_part" in moved[0]
    ours, text = views.plan(name), views._build(name)
    assert ours.columns == text.columns and ours.exceptAll(text).isEmpty() and text.exceptAll(ours).isEmpty()
