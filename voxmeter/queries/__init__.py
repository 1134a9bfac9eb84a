"""Registered queries: each applies an operator to whole tables, with DuckDB SQL for the same rows where SQL can express it."""

from voxmeter.queries import cleaning, reporting, scoring, usage  # noqa: F401
from voxmeter.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
