"""Registered queries over the given tables, each beside its SQL."""

from . import history_queries, notebook_queries, verdict_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
