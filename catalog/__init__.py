"""The driver's queries: the library's operators over domain-shaped views of the given tables."""

from __future__ import annotations

import importlib

MODULES = ["scalar_queries", "mapping_queries", "overlap_queries", "card_queries", "flow_queries"]


def load() -> tuple[dict, dict]:
    """All registered queries and oracle texts."""
    for module in MODULES:
        importlib.import_module(f"catalog.{module}")
    from catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
