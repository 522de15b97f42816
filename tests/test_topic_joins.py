"""Topics meet panel rows without a sort of the rows, and counts with the baseline equal those of doubled rows."""

from __future__ import annotations

import datetime as dt
from collections import Counter

from panelytics.operators import enrich, lifetime

JAN, FEB = dt.date(2020, 1, 1), dt.date(2020, 2, 1)
TOPICS = [(1, "a"), (1, "b"), (1, "a"), (2, "a"), (None, "a"), (3, None), (4, "c")]
ROWS = [
    ("en", JAN, 1, "core"), ("en", JAN, 2, "tail"), ("en", FEB, 1, "tail"), ("en", FEB, 1, "tail"), ("en", JAN, 3, "core"),
    ("en", JAN, None, "core"), ("en", JAN, 5, "core"), (None, JAN, 2, None), ("de", None, 2, "core"),
]


def frames(spark):
    rows = spark.createDataFrame(ROWS, "project string, date date, page_id bigint, volume string")
    return rows, spark.createDataFrame(TOPICS, "page_id bigint, topic string")


def test_counts_equal_those_of_doubled_rows(spark):
    rows, topics = frames(spark)
    of_page = {k: {t for p, t in TOPICS if p == k} for k in {p for p, _ in TOPICS} - {None}}
    want = Counter(
        (project, volume, date, topic)
        for project, date, page, own in ROWS for topic in of_page.get(page, ()) for volume in (own, "all")
    )
    got = enrich.topic_counts_with_baseline(rows, topics)
    assert got.schema["nb_pages"].dataType.simpleString() == "bigint"
    assert {(r.project, r.volume, r.date, r.topic): r.nb_pages for r in got.collect()} == dict(want)
    doubled = enrich.topic_counts(lifetime.with_baseline(rows), topics)
    assert sorted(map(str, doubled.select(*got.columns).collect())) == sorted(map(str, got.collect()))


def test_rows_are_not_sorted_for_their_topics(spark):
    rows, topics = frames(spark)
    # Both sides are too large to be broadcast, as they are at size.
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame in (enrich.topic_counts(rows, topics), enrich.topic_counts_with_baseline(rows, topics)):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
