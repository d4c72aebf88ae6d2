"""Queries over the fixture tables, each with its oracle where SQL can state it."""

import importlib

from boutline.catalog.base import ORACLES, QUERIES

for _m in ("filters", "form", "lookups", "splits", "features", "quality", "evaluation", "drift", "drafts", "ml", "fits", "streams"):
    try:
        importlib.import_module(f"boutline.catalog.{_m}")
    except ModuleNotFoundError as e:
        if e.name != f"boutline.catalog.{_m}":
            raise

__all__ = ["ORACLES", "QUERIES"]
