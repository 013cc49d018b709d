"""Named queries of the repository, by area."""

import importlib

from .registry import QUERIES, SQL

for _area in ("variance", "direction", "sequences", "relational", "linear", "signals", "reports", "cohorts", "storage"):
    importlib.import_module(f"{__name__}.{_area}")

__all__ = ["QUERIES", "SQL"]
