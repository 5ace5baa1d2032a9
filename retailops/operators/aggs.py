"""Aggregation, window, sort and set operators.

Aggregates are ``groupBy().agg()`` so Spark combines partially on the map side
before the shuffle; a hot key then costs one partial row per task, not all its rows
in one task. Per-group "window" results (rank 1, group size) are computed the same
way and joined back instead of with ``Window.partitionBy``, which would sort a whole
group inside one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _keys(k) -> list[str]:
    return [k] if isinstance(k, str) else list(k)


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    """One-row count of a (filtered) table."""
    return df.agg(F.count(F.lit(1)).alias(name))


def count_by(df: DataFrame, keys, name: str = "n", order: bool = True) -> DataFrame:
    """Count per group, most frequent first (ties by key)."""
    keys = _keys(keys)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return out.orderBy(F.desc(name), *keys) if order else out


def agg_by(df: DataFrame, keys, measures: Mapping[str, Column]) -> DataFrame:
    """D3: named aggregate columns per group."""
    return df.groupBy(*_keys(keys)).agg(*[c.alias(n) for n, c in measures.items()])


def dup_keys(df: DataFrame, keys, n: int = 1, name: str = "n") -> DataFrame:
    """Keys occurring more than ``n`` times, with their counts."""
    return df.groupBy(*_keys(keys)).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > n)


def dup_rows(df: DataFrame, keys, n: int = 1, name: str | None = None) -> DataFrame:
    """Every row whose key occurs more than ``n`` times.

    Duplicate keys are found by aggregate and joined back (AQE splits a skewed key);
    ``name`` adds the group size column.
    """
    keys = _keys(keys)
    d = dup_keys(df, keys, n, "_dup_n")
    if name:
        return df.join(d, keys, "inner").withColumnRenamed("_dup_n", name)
    return df.join(d.select(*keys), keys, "left_semi")


def count_distinct(df: DataFrame, cols, name: str = "n") -> DataFrame:
    """Number of distinct key tuples (nulls count as a value, as in a derived
    table of ``select distinct``)."""
    return df.select(*_keys(cols)).distinct().agg(F.count(F.lit(1)).alias(name))


def scorecard(df: DataFrame, key: str, filters: Mapping[str, Column], text_name: str | None = None,
              sep: str = " ") -> DataFrame:
    """One row of distinct-key counts under many filters, plus a text line.

    One pass: first reduce to one row per key with a flag per filter (partial
    aggregation on the key), then sum the flags. This avoids the Expand that several
    ``countDistinct`` aggregates would plan (one copy of the data per filter).
    """
    per_key = df.groupBy(key).agg(*[F.max(c.cast("int")).alias(n) for n, c in filters.items()])
    out = per_key.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in filters])
    if text_name:
        parts = []
        for n in filters:
            parts += [F.lit(f"{n}="), F.col(n).cast("string")]
        out = out.withColumn(text_name, F.concat_ws(sep, *[F.concat(parts[i], parts[i + 1])
                                                           for i in range(0, len(parts), 2)]))
    return out


def count_by_distinct(df: DataFrame, fine, coarse, name: str = "n") -> DataFrame:
    """Distinct finer keys, then count them per coarser key."""
    coarse = _keys(coarse)
    return (df.select(*coarse, *_keys(fine)).distinct()
              .groupBy(*coarse).agg(F.count(F.lit(1)).alias(name)))


def fact_totals(base: DataFrame, facts: Mapping[str, tuple[DataFrame, Sequence[str], Column]],
                default=0) -> DataFrame:
    """Several correlated sums as columns, default 0.

    ``facts`` maps output name → (fact table, key columns, value expression). The
    expressions over one fact and key are aggregated together, in one pass (a condition goes
    into the value, ``when(cond, value)``), then left joined; the base never multiplies.
    """
    groups: dict = {}
    for name, (fact, on, value) in facts.items():
        groups.setdefault((id(fact), tuple(on)), (fact, []))[1].append((name, value))
    out = base
    for (_, on), (fact, values) in groups.items():
        out = out.join(fact.groupBy(*on).agg(*[F.sum(v).alias(n) for n, v in values]), list(on), "left")
    for name in facts:
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    return out


def sum_if(df: DataFrame, keys, sums: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Conditional sums side by side, one pass."""
    return df.groupBy(*_keys(keys)).agg(
        *[F.coalesce(F.sum(F.when(c, v)), F.lit(0)).alias(n) for n, (c, v) in sums.items()])


def pct(part, total, scale: int = 2) -> Column:
    """Percentage of a total, null when the total is zero or null."""
    part = F.col(part) if isinstance(part, str) else part
    total = F.col(total) if isinstance(total, str) else total
    return F.round(F.when(total != 0, part * 100.0 / total), scale)


def share_of_total(df: DataFrame, keys, measure: str, name: str = "pct", scale: int = 2) -> DataFrame:
    """Each group's share of the grand total.

    The grand total is the sum of the grouped rows (written once, so the input runs
    once), one row that is broadcast to every group row.
    """
    from ..session import store
    g = store(df.groupBy(*_keys(keys)).agg(F.sum(measure).alias(measure)))
    tot = F.broadcast(g.agg(F.sum(measure).alias("_tot")))
    return g.crossJoin(tot).withColumn(name, pct(measure, "_tot", scale)).drop("_tot")


def with_subtotals(df: DataFrame, key: str, detail_cols: Sequence[str], sum_cols: Sequence[str],
                   kind_col: str = "row_kind") -> DataFrame:
    """Detail rows plus one subtotal row per key in one listing.

    Subtotal rows carry the key, the sums of ``sum_cols``, nulls in the other detail
    columns and ``row_kind='subtotal'``; they are unioned by name with the details.
    """
    from ..session import store
    rows = store(df.select(key, *detail_cols, *sum_cols), "subtotals")  # the input runs once
    det = rows.withColumn(kind_col, F.lit("detail"))
    sub = rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in sum_cols])
    for c in detail_cols:
        sub = sub.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
    sub = sub.withColumn(kind_col, F.lit("subtotal"))
    return det.unionByName(sub.select(*det.columns))


def extent(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Row count and largest key of several tables, one row per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"), F.max(key).cast("long").alias("max_key"))
               .withColumn("table_name", F.lit(name)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).select("table_name", "n_rows", "max_key")


def max_by_key(df: DataFrame, keys, col: str, name: str | None = None) -> DataFrame:
    """Latest (largest) value per group."""
    return df.groupBy(*_keys(keys)).agg(F.max(col).alias(name or col))


# --- windows -------------------------------------------------------------------

def top_rank(df: DataFrame, part, order: str, descending: bool = True) -> DataFrame:
    """Rows ranked first within their partition, ties kept (``rank() = 1``).

    The best value per partition is an aggregate (partial on the map side) joined
    back null-safely; a giant partition never has to be sorted in one task.
    """
    part = _keys(part)
    best = df.groupBy(*part).agg((F.max(order) if descending else F.min(order)).alias("_best"))
    cond = reduce(lambda x, y: x & y, [df[p].eqNullSafe(best[p]) for p in part]) \
        & df[order].eqNullSafe(best["_best"])
    return df.join(best, cond, "left_semi")


def number_rows(df: DataFrame, order: Sequence, name: str = "rn",
                partition_by: Sequence[str] | None = None, start: int = 1) -> DataFrame:
    """Consecutive row numbers over an order (``row_number()``), optionally
    restarting per group of ``partition_by``.

    A window would sort a whole group (or, without groups, the whole table) in one
    task. Instead the rows are range partitioned by (groups, order), so a large
    group spans many tasks, and these slices are written once to the shared folder
    with each row's slice and position. The counts per (group, slice) and the numbers
    are both taken from that one table, so they cannot disagree whatever the
    partitioning, the column pruning or a repeated task does. ``order`` must be a total
    order (tie-break on unique columns) for the numbers to repeat.
    """
    from pyspark.sql import Window

    from ..session import store
    gnames = list(partition_by or [])
    groups = [F.col(g) for g in gnames]
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    # monotonically_increasing_id = (partition id << 33) + position in the sorted partition
    ranged = store(df.repartitionByRange(*groups, *order_cols).sortWithinPartitions(*groups, *order_cols)
                     .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", 33)) \
                   .withColumn("_pos", F.col("_mid") - F.shiftleft("_pid", 33))
    counts = ranged.groupBy(*gnames, "_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_pos").alias("_first"))
    # a group spans few slices, so this window over the counts table (one row per slice) is small per group
    w = Window.partitionBy(*gnames).orderBy("_pid") if gnames else Window.orderBy("_pid")
    offs = counts.select(*[F.col(g).alias(f"_g_{g}") for g in gnames], F.col("_pid").alias("_opid"),
                         (F.sum("_cnt").over(w) - F.col("_cnt")).alias("_off"), "_first")
    cond = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in gnames]
                  + [F.col("_pid") == F.col("_opid")])
    out = ranged.join(offs, cond)
    return (out.withColumn(name, (F.col("_off") + F.col("_pos") - F.col("_first") + F.lit(start)).cast("long"))
               .drop("_pid", "_mid", "_pos", "_off", "_first", "_opid", *[f"_g_{g}" for g in gnames]))


def with_count(df: DataFrame, keys, name: str = "n") -> DataFrame:
    """Group size on every row (``count(*) over (partition by keys)``)."""
    keys = _keys(keys)
    cnt = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    cond = reduce(lambda x, y: x & y, [df[k].eqNullSafe(cnt[k]) for k in keys])
    return df.join(cnt, cond, "inner").drop(*[cnt[k] for k in keys])


# --- sort, limit, sets, sequences ---------------------------------------------

def top_k(df: DataFrame, col: str, k: int, tie_break: Sequence[str] = ()) -> DataFrame:
    """the ``k`` largest rows by a measure (planned as a per-task top-k)."""
    return df.orderBy(F.desc(col), *tie_break).limit(k)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    """G1: SQL ``UNION``: union by name, duplicates removed."""
    return reduce(DataFrame.unionByName, dfs).distinct()


def union_all(*dfs: DataFrame) -> DataFrame:
    """SQL ``UNION ALL`` by name."""
    return reduce(DataFrame.unionByName, dfs)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """SQL ``MINUS``/``EXCEPT``: distinct rows of ``a`` not in ``b``."""
    return a.subtract(b.select(*a.columns))


def sequence_rows(spark: SparkSession, lo: int, hi: int, name: str = "n") -> DataFrame:
    """The integers lo..hi as rows (what a recursive CTE generated)."""
    return spark.range(lo, hi + 1).select(F.col("id").alias(name))
