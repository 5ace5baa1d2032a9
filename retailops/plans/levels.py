"""Level tables kept by signed deltas (D12, I34, I52): a change costs the groups it touches, not a new roll-up.

A change set is the rows as they were and the rows as they are; each becomes a row with a count of -1 or +1 and its
measures under that sign. The deltas are added up to the finest level once and from there to each coarser one, and every
level merges only the groups with a delta. A group whose count reaches zero goes. Sums are decimals, so that a group is
what a full roll-up would give, whatever the order of its changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store
from ..sources.filetables import FileTables

SUM = "decimal(38,6)"


class LevelTables:
    """Tables of the folder ``root``, one per level: ``levels`` from finest to coarsest as (name, keys), the keys of
    each among those of the one before; a null key part is a value of its own."""

    def __init__(self, spark: SparkSession, root: str, levels: Sequence[tuple[str, Sequence[str]]], measures: Sequence[str]):
        self.tables = FileTables(spark, root)
        self.levels, self.measures = [(n, list(k)) for n, k in levels], list(measures)

    def _sum(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"),
                                       *[F.sum(m).cast(SUM).alias(m) for m in self.measures])

    def _signed(self, rows: DataFrame, sign: int) -> DataFrame:
        keys = self.levels[0][1]
        return rows.select(*keys, F.lit(sign).cast("long").alias("n_rows"),
                           *[(F.coalesce(F.col(m), F.lit(0)).cast(SUM) * sign).cast(SUM).alias(m) for m in self.measures])

    def create(self, rows: DataFrame) -> None:
        """All levels from all rows."""
        got = self._signed(rows, 1)
        for name, keys in self.levels:
            got = store(self._sum(got, keys), f"level-{name}")
            self.tables.create(name, got, keys[0])

    def apply(self, before: DataFrame, after: DataFrame) -> int:
        """Rows that were (``before``: deleted, or about to change) and rows that are (``after``); one commit for all levels."""
        delta = self._signed(before, -1).unionByName(self._signed(after, 1))
        changes = {}
        for name, keys in self.levels:
            delta = store(self._sum(delta, keys), f"delta-{name}")
            some = delta.where(" OR ".join(f"{c} <> 0" for c in ("n_rows", *self.measures)))
            hit = some.select(*keys)

            def merge(old, keys=keys, delta=some):
                return self._sum(old.unionByName(delta.select(*old.columns)), keys).where("n_rows <> 0").select(*old.columns)

            changes[name] = (hit, keys, merge)
        return self.tables.change(changes)

    def read(self, name: str) -> DataFrame:
        return self.tables.read(name)
