"""All queries over the driver's tables, with the SQL that states the same result."""

from __future__ import annotations

from strataloom.plans import capture, etl, graph, library, search
from strataloom.plans.query import ORACLES, QUERIES

FLAGSHIP = "community_candidates"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "capture", "etl", "graph", "library", "search"]
