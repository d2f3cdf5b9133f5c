"""The registered queries and their SQL."""

from __future__ import annotations

from hyperloom.plans import browse, documents, experiments, functions, retrieval, storage, stream, sync
from hyperloom.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "vsa_search_filtered"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "browse", "documents", "experiments", "functions", "retrieval", "storage", "stream", "sync"]
