"""Registered queries: each operator on views of the given tables, with the SQL it must agree with."""

from skyframe.registry.base import QUERIES, SQL

from skyframe.registry import catalog, labelling, sampling, spectral, scoring, analysing, checking  # noqa: E402,F401

__all__ = ["QUERIES", "SQL"]
