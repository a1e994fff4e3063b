"""All registered queries of the core library with their DuckDB equivalents."""

from __future__ import annotations

from textloom.plans import function_queries, model_queries, more_queries, relation_queries, source_queries, tagging_queries, text_queries  # noqa: F401  they register themselves
from textloom.plans.registry import ORACLES, QUERIES  # noqa: F401
