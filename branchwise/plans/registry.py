"""The registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from branchwise.plans.catalog import queries
from branchwise.plans.oracle import oracle_sql

__all__ = ["queries", "oracle_sql"]
