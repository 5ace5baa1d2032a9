"""Queries over the driver tables, one per operator, each with a DuckDB twin.

Every query reads whole tables from ``sf_dir`` and returns a DataFrame; the SQL twin
computes the same rows so an independent engine can check the Spark result.
"""

from __future__ import annotations

from .registry import QUERIES, SQL, load_all

__all__ = ["QUERIES", "SQL", "load_all"]
