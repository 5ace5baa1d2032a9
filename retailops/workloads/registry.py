"""Registry of driver-table queries and their SQL twins."""

from __future__ import annotations

import datetime as _dt
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Fixed reference dates so results repeat (never the wall clock).
AS_OF = _dt.date(2001, 8, 1)          # orders and line items
EVENTS_AS_OF = _dt.date(2024, 1, 31)  # events

_MODULES = ("sources_q", "columns_q", "joins_q", "aggs_q", "audits_q", "changes_q",
            "history_q", "reports_q", "streaming_q", "filetables_q",
            "stored_q", "sqlcode_q")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its SQL twin."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return deco


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [read_table(spark, sf_dir, n) for n in names]


def load_all() -> tuple[dict, dict]:
    for m in _MODULES:
        try:
            importlib.import_module(f"{__package__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{m}":
                raise
    return QUERIES, SQL
