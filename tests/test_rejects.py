"""Damaged dumps: what does not fit is told with its file and reason, what fits is kept."""

from __future__ import annotations

import gzip

from panelytics.sources import dumps


def test_short_long_and_mistyped_rows(spark, tmp_path):
    good = ["en.wiki A 1 desktop 5 A1", "en.wiki B null desktop 7 B2"]
    bad = ["en.wiki C 3 desktop", "en.wiki D 4 desktop five A1", "en.wiki E 5 desktop 6 A1 more", ""]
    (tmp_path / "pageviews-202201-user").write_text("\n".join([good[0], *bad, good[1]]) + "\n")
    rows, rejects = dumps.read_counts_and_rejects(spark, str(tmp_path))
    assert sorted((r.page, r.page_id, r.counts, str(r.date)) for r in rows.collect()) == [("A", "1", 5, "2022-01-01"), ("B", None, 7, "2022-01-01")]
    found = {r.record: (r.reason, r.file.rsplit("/", 1)[1]) for r in rejects.collect()}
    name = "pageviews-202201-user"
    assert found == {bad[0]: ("columns", name), bad[1]: ("value", name), bad[2]: ("columns", name)}


def test_a_broken_member_does_not_stop_the_scan(spark, tmp_path):
    whole = gzip.compress("".join(f"en.wiki P{i} {i} desktop {i} A1\n" for i in range(20_000)).encode())
    (tmp_path / "pageviews-202201-user.gz").write_bytes(whole)
    (tmp_path / "pageviews-202202-user.gz").write_bytes(whole[: len(whole) // 2])
    rows, rejects = dumps.read_counts_and_rejects(spark, str(tmp_path))
    by_month = {str(r.date): r["count"] for r in rows.groupBy("date").count().collect()}
    assert by_month["2022-01-01"] == 20_000 and by_month.get("2022-02-01", 0) < 20_000
    assert rejects.count() <= 1  # the line at the break, if part of it was read
    assert all(r.page == f"P{r.counts}" for r in rows.where("counts is not null").collect())


def test_no_files_rows(spark, tmp_path):
    (tmp_path / "pageviews-202201-user").write_text("")
    rows, rejects = dumps.read_counts_and_rejects(spark, str(tmp_path))
    assert rows.collect() == [] and rejects.collect() == []
