"""Names, callables and oracle SQL of the library's own queries."""

from __future__ import annotations

from siftwork.plans import action_queries, dedupe_queries, media_queries, page_queries, reconcile_queries  # noqa: F401
from siftwork.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
