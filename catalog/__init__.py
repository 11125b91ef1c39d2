"""The registered queries: each pairs a Spark job with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from catalog.registry import ORACLES, QUERIES

for _area in ("profiles", "encoders", "ranks", "labelling", "histories", "feature_tables", "evaluation", "models",
              "places", "files"):
    import_module(f"catalog.{_area}")

__all__ = ["ORACLES", "QUERIES"]
