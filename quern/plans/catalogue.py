"""All queries of the core library."""

from __future__ import annotations

from quern.plans import accessors, image_queries, kind_queries, open_queries, scan_queries  # noqa: F401  (they register)
from quern.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
