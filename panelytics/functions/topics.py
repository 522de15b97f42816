"""Expressions over topic lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_topics(text: Column) -> Column:
    """Names in a text of dicts, ``[{'topic': 'A.B*', 'score': 0.9} ...]``, cleaned."""
    names = F.regexp_extract_all(text, F.lit(r"'topic'\s*:\s*(\"[^\"]*\"|'[^']*')"), F.lit(1))
    return F.transform(names, lambda n: F.trim(F.lower(F.translate(n, "'\"", ""))))


def most_specific(topics: Column) -> Column:
    """First topic without a star, else the first; NULL for an empty list."""
    plain = F.filter(topics, lambda t: ~F.contains(t, F.lit("*")))
    return F.coalesce(F.get(plain, F.lit(0)), F.get(topics, F.lit(0)))


def topic_code(topic: Column, names: Sequence[str]) -> Column:
    """Position of a topic in a list; NULL if it is not there."""
    pairs = [x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]
    return F.try_element_at(F.create_map(*pairs), topic)
