"""History as a log by absolute period (I21-I23): a weekly roll writes no history.

Rows are kept under the number of their period, in files cut by period; the slot of a row is the current period minus its
own, so a roll moves one number of the commit. Files whose periods have all left the window are taken off the list unread.
A second table holds for each key the last period with a value other than zero, which decides the prune: a key goes
at the roll that finds nothing within its ``n`` weeks, as if every week had been rolled by itself.

For measures per period (sales, receipts). A measure that is carried on from week to week (on hand) belongs to the long or
the array form of ``history``, whose roll repeats it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store
from ..sources.filetables import FileTables
from .history import WEEKS


class HistoryLog:
    """The history in the folder ``root``: ``keys``, per-period ``measures``, ``n`` weeks back from the current period."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], measures: Sequence[str], n: int = WEEKS):
        self.tables, self.keys, self.measures, self.n = FileTables(spark, root), list(keys), list(measures), n

    def create(self, empty: DataFrame, current: int) -> None:
        """A log without rows; ``empty`` gives the types of the keys."""
        keys = empty.select(*self.keys).limit(0)
        log = keys.select(*self.keys, F.lit(0).cast("long").alias("period"),
                          *[F.lit(0.0).alias(m) for m in self.measures])
        self.tables.create("log", log, "period")
        self.tables.create("last", keys.select(*self.keys, F.lit(0).cast("long").alias("last_period")), self.keys[0])
        self._move(current)

    @property
    def current(self) -> int:
        return self.tables.state()[1]["_current"]["period"]

    def _move(self, period: int, drop_below: int | None = None) -> None:
        base, state = self.tables.state()
        state = {**state, "_current": {"period": period}}
        if drop_below is not None:
            files = self.tables.manifest("log", base)
            if not files.where(F.col("hi") < drop_below).isEmpty():
                state["log"] = self.tables._entry("log", state["log"], files.where(F.col("hi") >= drop_below))
        self.tables.commit(base, state)

    def _some(self) -> Column:
        return reduce(lambda a, b: a | b, [F.coalesce(F.col(m), F.lit(0.0)) != 0 for m in self.measures])

    def load(self, changes: DataFrame) -> DataFrame:
        """Values by key and ``period`` replace those of the log (a null measure leaves the old one; several rows of one
        key and period add up). Only files that hold a touched period and key are rewritten. Returns the rejects: periods
        missing, in the future, or older than the window."""
        base, state = self.tables.state()
        current = state["_current"]["period"]
        inside = F.coalesce(F.col("period").between(current - self.n, current), F.lit(False))
        at = ["period", *self.keys]
        new = store(changes.where(inside).dropna(subset=self.keys).groupBy(*at).agg(
            *[F.sum(F.col(m).cast("double")).alias(m) for m in self.measures]), "log-load")

        def put(old: DataFrame) -> DataFrame:
            was = old.select(*at, *[F.col(m).alias(f"_o_{m}") for m in self.measures])
            return was.join(new, at, "full_outer").select(
                *self.keys, "period", *[F.coalesce(F.col(m), F.col(f"_o_{m}"), F.lit(0.0)).alias(m) for m in self.measures])

        # the last period with a value, of the touched keys: from their rows as they are after this load
        mine = self.tables.read("log", base).join(new.select(*self.keys).distinct(), self.keys, "left_semi")
        seen = store(put(mine).where(self._some()).groupBy(*self.keys).agg(F.max("period").alias("_seen")), "log-last")
        keys = new.select(*self.keys).distinct()

        def keep(old: DataFrame) -> DataFrame:
            rest = old.join(keys, self.keys, "left_anti")
            return rest.unionByName(seen.withColumnRenamed("_seen", "last_period"))

        self.tables.change({"log": (new, at, put), "last": (keys, self.keys, keep)}, base)
        return changes.where(~inside)

    def roll(self, weeks: int = 1) -> None:
        """Every value moves ``weeks`` older."""
        if weeks < 1:
            raise ValueError("weeks must be 1 or more")
        period = self.current + weeks
        self._move(period, period - self.n - 1)

    def alive(self) -> DataFrame:
        """The keys that the prune leaves."""
        return self.tables.read("last").where(F.col("last_period") >= self.current - self.n - 1).select(*self.keys)

    def slots(self) -> DataFrame:
        """(keys, slot, measures): the values of the window, slot 0 the current period."""
        current = self.current
        rows = self.tables.read("log").where(F.col("period").between(current - self.n, current))
        return rows.select(*self.keys, (F.lit(current) - F.col("period")).cast("int").alias("slot"), *self.measures)
