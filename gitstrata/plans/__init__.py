"""Registered queries, by area."""

from gitstrata.plans import commit_queries, finding_queries, history_queries, stream_queries, structure_queries  # noqa: F401
from gitstrata.plans.registry import ORACLES, QUERIES  # noqa: F401
