"""PySpark operators for panels of (edition, period, entity, weight) rows."""

PANEL_KEYS = ("project", "date")
WEIGHT = "tot_count_views"
