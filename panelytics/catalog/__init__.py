"""Registered queries over the test tables, one module per family."""

import importlib

FAMILIES = [
    "core_tail",
    "panel",
    "dynamics",
    "profiles",
    "experiments",
]


def load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"panelytics.catalog.{family}")
