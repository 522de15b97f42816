"""A store that grows by months equals one build over all rows, and leaves files of other months alone."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import functions as F

from panelytics.operators import hinge, increments, overlap


def panel(spark, months, seed=0):
    rng = random.Random(seed)
    rows = [(e, m, p, max(1, int(1_000 / (p + 1) ** 1.3 * rng.uniform(0.3, 2)))) for e in "ab" for m in months for p in range(60) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "project string, m int, page_id long, tot_count_views long").select(
        "project", F.add_months(F.lit("2020-01-01").cast("date"), F.col("m")).alias("date"), "page_id", F.col("page_id").cast("string").alias("page"), "tot_count_views"
    )


def of_all(rows):
    labelled = hinge.volume_labels(rows)
    marked = overlap.mark_flux(labelled.where("volume = 'core'").select("project", "date", "page_id"), source=rows)
    return sorted(map(tuple, overlap.flux_sizes(marked).collect())), sorted(map(tuple, labelled.groupBy("project", "date", "volume").count().collect()))


def of_store(spark, folder, schema):
    sizes = increments.flux(spark, folder).select("project", "date", "nb_tot_pages", "nb_incoming", "nb_outgoing", "perc_incoming", "perc_outgoing")
    labelled = increments.volumes(spark, folder, schema)
    return sorted(map(tuple, sizes.collect())), sorted(map(tuple, labelled.groupBy("project", "date", "volume").count().collect()))


def test_months_in_any_order_equal_one_build(spark, tmp_path):
    folder, rows = str(tmp_path / "store"), panel(spark, range(8)).cache()
    old = panel(spark, [3], seed=9)
    month = F.months_between("date", F.lit("2020-01-01").cast("date")).cast("int")
    for part in (rows.where(month.isin(0, 1, 5)), old, rows.where(month == 7), rows.where(month == 6), rows.where(month.isin(2, 3, 4))):
        increments.add_periods(spark, folder, part)
    assert of_store(spark, folder, rows.schema) == of_all(rows)
    hinges = sorted(map(tuple, increments.hinges(spark, folder).select("project", "date", "hinge_perc", "hinge_rank").collect()))
    assert hinges == sorted(map(tuple, hinge.hinge_points(rows).select("project", "date", "hinge_perc", "hinge_rank").collect()))
    totals = {(r.project, r.date): (r.nb_pages, r.tot_views) for r in increments.months(spark, folder).collect()}
    assert totals == {(r.project, r.date): (r.n, r.v) for r in rows.groupBy("project", "date").agg(F.count("*").alias("n"), F.sum("tot_count_views").alias("v")).collect()}


def test_old_files_are_not_opened(spark, tmp_path):
    folder, rows = tmp_path / "store", panel(spark, range(6)).cache()
    last = rows.where("date = date'2020-06-01'")
    increments.add_periods(spark, str(folder), rows.where("date < date'2020-06-01'"))
    broken = [p for t in ("volumes", "weights", "flux") for d in ("2020-01-01", "2020-02-01", "2020-03-01") for p in Path(folder, t).glob(f"project=*/date={d}/*.parquet")]
    assert len(broken) >= 18
    kept = {p: p.read_bytes() for p in broken}
    for p in broken:
        p.write_bytes(b"no parquet")
        Path(p.parent, f".{p.name}.crc").unlink(missing_ok=True)
    increments.add_periods(spark, str(folder), last)
    for p, own in kept.items():
        assert p.read_bytes() == b"no parquet"
        p.write_bytes(own)
    assert of_store(spark, str(folder), rows.schema) == of_all(rows)
