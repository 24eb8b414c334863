"""Registered queries: operators bound to fact tables derived from the given tables."""

from classlake.plans import (  # noqa: F401
    entry_queries,
    flow_queries,
    graph_queries,
    member_queries,
    name_queries,
    range_queries,
)
from classlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
