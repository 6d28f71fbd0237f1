"""Registered queries, grouped by subject."""

from dossier.plans.catalog import (  # noqa: F401
    functions,
    graph,
    insights,
    quality,
    retrieval,
    sources,
    tables,
)
from dossier.plans.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
