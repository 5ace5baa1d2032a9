"""Weekly history: calendar, load, roll, widen, level roll-ups.

The working form is long: one row per (key, slot) that holds a value, slot 0 the current
week and slot i the i-th week ago, with a column per measure. A load is one aggregate over
(key, slot) for any number of measures, a roll adds to the slot, a level roll-up is a plain sum, and
the cost follows the values that exist, not 104 columns per measure. The ``*_slots`` functions
work on it. The array form (one array per measure, as a wide table had 104 columns) is
for reports and for tables kept that way: ``from_long`` and ``to_long`` convert, and ``load_history``,
``roll_history``, ``widen_history`` and ``rollup_levels`` work on arrays.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


WEEKS = 104
#: What a task's hash tables hold at most, as rows and as bytes of one table.
TASK_ROWS, TASK_BYTES = 250_000, 128 << 20


# --- calendar ------------------------------------------------------------------

def calendar_from_range(df: DataFrame, date_col: str, fy_start_month: int = 2) -> DataFrame:
    """C14: ``calendar`` between the smallest and largest date of ``date_col``, which one scan of ``df`` finds."""
    b = df.agg(F.min(F.to_date(date_col)).alias("lo"), F.max(F.to_date(date_col)).alias("hi")).first()
    return calendar(df.sparkSession, b["lo"], b["hi"], fy_start_month)


def calendar(spark, lo, hi, fy_start_month: int = 2) -> DataFrame:
    """C14: one row per day from ``lo`` to ``hi``; none where they are None.

    Columns: ``date``, ``fiscal_year`` (year in which the fiscal year ends),
    ``fiscal_period`` (1 = the month ``fy_start_month``), ``fiscal_week`` (weeks begin on
    Sunday; week 1 holds the first day of the fiscal year), ``day_of_week``. Days are generated with
    ``spark.range``, so they spread over tasks and no table is read.
    """
    if lo is None:
        return spark.createDataFrame([], "date date, fiscal_year int, fiscal_period int, fiscal_week int, day_of_week int")
    n = (hi - lo).days + 1
    days = spark.range(n).select(F.date_add(F.lit(lo), F.col("id").cast("int")).alias("date"))
    shifted = F.add_months(F.col("date"), 13 - fy_start_month)
    back = F.add_months(F.col("date"), 1 - fy_start_month)
    first = F.make_date(F.year(back), F.lit(fy_start_month), F.lit(1))
    return days.select(
        "date",
        F.year(shifted).alias("fiscal_year"),
        F.month(back).alias("fiscal_period"),
        # days since the Sunday on or before the fiscal year's first day, in whole weeks
        (F.floor((F.datediff("date", first) + F.dayofweek(first) - 1) / 7) + 1).cast("int").alias("fiscal_week"),
        F.dayofweek("date").alias("day_of_week"))


def month_calendar(spark, lo, hi) -> DataFrame:
    """Every (yr, mo) period from the month of ``lo`` to the month of ``hi``,
    generated with ``spark.range`` (no scan of any fact table)."""
    start = lo.year * 12 + lo.month - 1
    n = hi.year * 12 + hi.month - 1 - start + 1
    m = spark.range(n).select((F.col("id") + F.lit(start)).alias("_m"))
    return m.select(F.floor(F.col("_m") / 12).cast("int").alias("yr"), (F.col("_m") % 12 + 1).cast("int").alias("mo"))


def order_weeks(cal: DataFrame, period_cols: Sequence[str], name: str = "week_order") -> DataFrame:
    """Number the distinct periods (year, week) in time order, starting at 1.

    A calendar is a bounded dimension (one row per period: 53 a year), so the
    distinct periods are numbered with one un-partitioned window; for unbounded
    inputs use ``number_rows``, which spreads the numbering over tasks.
    """
    from pyspark.sql import Window
    periods = cal.select(*period_cols).distinct()
    return periods.withColumn(name, F.row_number().over(Window.orderBy(*period_cols)).cast("long"))


def advance_week(cal: DataFrame, order_col: str = "week_order", flag_col: str = "current_week") -> DataFrame:
    """Move the current-period flag to the next period in order.

    The flag row's order + 1 is a one-row aggregate broadcast to the calendar.
    """
    nxt = F.broadcast(cal.where(F.col(flag_col) == "Y").agg((F.max(order_col) + 1).alias("_next")))
    return (cal.crossJoin(nxt)
               .withColumn(flag_col, F.when(F.col(order_col) == F.col("_next"), F.lit("Y")).otherwise(F.lit("N")))
               .drop("_next"))


# --- arrays <-> long form --------------------------------------------------------

def deal(df: DataFrame, keys: Sequence[str], rows: int, width: int = 1) -> DataFrame:
    """``df`` dealt by its keys into tasks of a bounded size, for ``rows`` rows of ``width`` values.

    The number of tasks follows the rows. Left to the planner it follows the compressed size of the shuffle, and a
    partition of few megabytes can hold millions of rows that a hash table then spreads out.
    """
    per_task = min(TASK_ROWS, TASK_BYTES // (8 * width + 64))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task)), *keys)


def zeros(n: int = WEEKS) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def to_long(df: DataFrame, keys: Sequence[str], measures: Sequence[str], drop_zero: bool = True) -> DataFrame:
    """Array history → ``(keys, measure, week_ago, value)``; week_ago starts at 1."""
    parts = []
    for m in measures:
        x = df.select(*keys, F.posexplode(m).alias("_pos", "value")) \
              .select(*keys, F.lit(m).alias("measure"), (F.col("_pos") + 1).alias("week_ago"), "value")
        parts.append(x)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("value") != 0) if drop_zero else out


def _slot_array(long_df: DataFrame, keys: Sequence[str], slot_col: str, value_col: str,
                lo: int, hi: int, name: str) -> DataFrame:
    """Per key, an array of slots ``lo..hi`` (null where the key has no value).

    Built with ``pivot`` on the listed slot values: Spark first sums per
    (key, slot), then places each slot's value by position (no per-key list is gathered, no map lookups).
    The input is stored and dealt by key into tasks that hold a bounded number of arrays.
    """
    return _pivot_slots(long_df, keys, slot_col, value_col, lo, hi, name, None)


def _pivot_slots(long_df: DataFrame, keys: Sequence[str], slot_col: str, value_col: str,
                 lo: int, hi: int, name: str, fill) -> DataFrame:
    from ..session import store
    slots = list(range(lo, hi + 1))
    x = store(long_df.where(F.col(slot_col).between(lo, hi)).select(*dict.fromkeys([*keys, slot_col, value_col])), "slots")
    p = deal(x, keys, x.count(), len(slots)).groupBy(*keys).pivot(slot_col, slots).agg(F.sum(value_col))
    cell = (lambda i: F.col(str(i)).cast("double")) if fill is None else \
        (lambda i: F.coalesce(F.col(str(i)).cast("double"), F.lit(fill)))
    return p.select(*keys, F.array(*[cell(i) for i in slots]).alias(name))


def from_long(long_df: DataFrame, keys: Sequence[str], slot_col: str, value_col: str,
              name: str, n: int = WEEKS) -> DataFrame:
    """Long ``(keys, slot, value)`` → one array of ``n`` slots per key (slot 1 first),
    zero where a slot has no value; values of the same slot are summed."""
    arr = _pivot_slots(long_df, keys, slot_col, value_col, 1, n, "_a", None)
    return arr.select(*keys, F.transform("_a", lambda x: F.coalesce(x, F.lit(0.0))).alias(name))


# --- history jobs ---------------------------------------------------------------

def roll_history(df: DataFrame, measures: Mapping[str, tuple[str, bool]],
                 prune_also: Sequence[str] = (), weeks: int = 1, n: int = WEEKS) -> DataFrame:
    """Every measure moves ``weeks`` weeks older; all-zero rows are dropped.

    ``measures`` maps history array → (current column, reset_current). At each
    weekly step the current value becomes slot 1 and slot 104 falls off;
    ``reset_current`` sets the current column to 0 (week-to-date sales), otherwise
    it is kept (on hand) and repeats into every new slot. The prune test reads the
    values *before* each shift: every slot of every array, every current column and
    ``prune_also`` (in transit, on order ...), so a row whose only value is in week
    104 survives a one-week roll and goes at the next.

    Several weeks are rolled in one projection (a row that would be pruned at any
    step is exactly one with no non-zero value in the slots that are still inside
    the window at the last step), so the plan does not grow with ``weeks``.
    """
    if not 1 <= weeks <= n:
        raise ValueError("weeks must be between 1 and the history length")
    alive = None
    for h, (cur, _) in measures.items():
        window = F.slice(F.col(h), 1, n - weeks + 1)
        # any non-zero slot <=> max or min differs from 0 (nulls count as zero);
        # array_max/array_min are generated code, unlike a lambda test
        t = (F.coalesce(F.array_max(window), F.lit(0.0)) != 0) | (F.coalesce(F.array_min(window), F.lit(0.0)) != 0) \
            | (F.coalesce(F.col(cur), F.lit(0)) != 0)
        alive = t if alive is None else alive | t
    for c in prune_also:
        alive = alive | (F.coalesce(F.col(c), F.lit(0)) != 0)
    out = df.where(alive)
    for h, (cur, reset) in measures.items():
        c = F.coalesce(F.col(cur), F.lit(0)).cast("double")
        # after k weekly steps the old current sits in slot k; with a reset the k-1
        # newer slots hold the zeroed currents of the steps in between
        head = F.concat(F.array_repeat(F.lit(0.0), weeks - 1), F.array(c)) if reset else F.array_repeat(c, weeks)
        out = out.withColumn(h, F.concat(head, F.slice(F.col(h), 1, n - weeks)) if weeks < n else F.slice(head, 1, n))
        if reset:
            out = out.withColumn(cur, F.lit(0).cast(df.schema[cur].dataType))
    return out


def widen_history(df: DataFrame, arrays: Sequence[str], n: int = WEEKS) -> DataFrame:
    """Pad shorter histories (78 weeks) with zeros up to ``n`` slots."""
    out = df
    for h in arrays:
        pad = F.greatest(F.lit(0), F.lit(n) - F.size(F.col(h)))
        out = out.withColumn(h, F.slice(F.concat(F.col(h), F.array_repeat(F.lit(0.0), pad)), 1, n))
    return out


def weeks_ago(changes: DataFrame, cal: DataFrame, period_cols: Sequence[str], current: Mapping[str, object],
              order_col: str = "week_order") -> DataFrame:
    """Slot of each change = current period's order - the change's period order.

    ``current`` names the current period (e.g. ``{"yr": 2001, "wk": 31}``); its
    order is a one-row lookup broadcast to the changes. Periods missing from the
    calendar give no slot: the inner join drops them and ``unknown_periods``
    returns them for a reject table.
    """
    cond = None
    for k, v in current.items():
        t = F.col(k) == F.lit(v)
        cond = t if cond is None else cond & t
    cur = F.broadcast(cal.where(cond).select(F.max(order_col).alias("_cur")))
    c = cal.select(*period_cols, order_col)
    return (changes.join(c, list(period_cols), "inner").crossJoin(cur)
                   .withColumn("week_ago", F.col("_cur") - F.col(order_col)).drop(order_col, "_cur"))


def unknown_periods(changes: DataFrame, cal: DataFrame, period_cols: Sequence[str]) -> DataFrame:
    return changes.join(cal.select(*period_cols).distinct(), list(period_cols), "left_anti")


def load_history(hist: DataFrame, changes: DataFrame, keys: Sequence[str], slot_col: str,
                 value_col: str, measure: str, current_col: str | None = None, n: int = WEEKS,
                 split_bytes: int = 32 << 20) -> DataFrame:
    """Put each change value into its slot of the key's history.

    Changes are first pivoted to one array of slots 0..n per key (a bounded row
    per key) and stored. When their keys measure at most
    ``split_bytes`` (a daily load against the full history) the untouched history
    rows pass through a broadcast anti join and only touched rows are merged, so
    the history is never shuffled; otherwise one full outer join on the key. Every row of the
    result, touched or not, has an array of ``n`` slots or more (a null or short one is
    filled up with zeros) and a current value (null becomes 0).
    Slot 0 goes to ``current_col`` when given; changes outside 0..n are returned by
    ``out_of_range``. A load replaces the slot's value, as an UPDATE of that slot would.
    """
    from ..session import store
    from .changes import split_by_keys
    ch = store(_slot_array(changes, keys, slot_col, value_col, 0, n, "_c"), "history-load")
    split = split_by_keys(hist, keys, ch, split_bytes)
    old = F.coalesce(F.col(measure), zeros(0).cast("array<double>"))
    cur = F.concat(old, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(n) - F.size(old))))
    base = hist if split is None else split[1]
    j = base.join(ch, list(keys), "full_outer")
    new = F.transform(cur, lambda x, i: F.coalesce(F.get(F.col("_c"), i + 1), x))
    out = j.withColumn(measure, F.when(F.col("_c").isNull(), cur).otherwise(new))
    if current_col:
        out = out.withColumn(current_col, F.coalesce(F.col("_c")[0], F.col(current_col), F.lit(0.0)))
    out = out.drop("_c")
    if split is None:
        return out
    same = split[0].withColumn(measure, cur)
    if current_col:
        same = same.withColumn(current_col, F.coalesce(F.col(current_col), F.lit(0.0)))
    return same.select(*out.columns).unionByName(out)


def out_of_range(changes: DataFrame, slot_col: str, n: int = WEEKS) -> DataFrame:
    """I23 rejects: changes whose slot is missing, in the future or older than ``n`` weeks."""
    return changes.where(F.col(slot_col).isNull() | ~F.col(slot_col).between(0, n))


# --- long form ------------------------------------------------------------------

def load_slots(hist: DataFrame, changes: DataFrame, keys: Sequence[str], measures: Sequence[str],
               slot_col: str = "slot", n: int = WEEKS, split_bytes: int = 32 << 20) -> DataFrame:
    """I23 in long form: put change values into their slots, any number of measures at once.

    Both sides hold ``keys``, the slot and ``measures``; changes of one slot are summed and
    replace the history's value, measure by measure (a null measure of a change leaves the old one,
    so on hand, in transit, on order and the sales of two weeks come in as one load). The history holds one row
    per key and slot. The changes are stored; when their keys measure at most ``split_bytes`` the rows of other keys pass
    through a broadcast anti join and only touched keys are shuffled, otherwise all are, with the same result. What is
    shuffled is counted first, so that a task's share stays bounded.
    Slots outside 0..n come back from ``out_of_range``.
    """
    from ..session import store
    from .changes import split_by_keys
    side = lambda df, new: df.where(F.col(slot_col).between(0, n)).select(
        *keys, F.col(slot_col).cast("int").alias(slot_col), *[F.col(m).cast("double").alias(m) for m in measures],
        F.lit(new).alias("_new"))
    new = store(side(changes, True), "slots-load")
    split = split_by_keys(side(hist, False), keys, new.select(*keys).distinct(), split_bytes)
    base = side(hist, False) if split is None else split[1]
    both = deal(base.unionByName(new), keys, base.count() + new.count(), len(measures))
    merged = both.groupBy(*keys, slot_col).agg(*[
        F.coalesce(F.sum(F.when(F.col("_new"), F.col(m))), F.sum(F.when(~F.col("_new"), F.col(m))), F.lit(0.0)).alias(m)
        for m in measures])
    if split is None:
        return merged
    same = split[0].select(*keys, slot_col, *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in measures])
    return same.unionByName(merged)


def roll_slots(hist: DataFrame, keys: Sequence[str], measures: Mapping[str, bool], weeks: int = 1,
               slot_col: str = "slot", n: int = WEEKS) -> DataFrame:
    """I21 in long form: every value moves ``weeks`` older, all-zero keys are dropped.

    ``measures`` maps a measure to whether its current value is reset (week-to-date sales) or
    kept and repeated into every new slot (on hand). The prune test reads the values before each
    weekly shift, so a key whose only value is in week 104 survives one roll, as a row of zeros in slot
    0, and goes at the next. A key's rows are at most n + 1, so the test is a window over the key; every
    key that survives has a slot-0 row.
    """
    from pyspark.sql import Window
    if not 1 <= weeks <= n:
        raise ValueError("weeks must be between 1 and the history length")
    w = Window.partitionBy(*keys)
    some = reduce(lambda a, b: a | b, [F.coalesce(F.col(m), F.lit(0.0)) != 0 for m in measures])
    x = hist.withColumns({"_alive": F.max(some & (F.col(slot_col) <= n - weeks + 1)).over(w),
                          "_first": F.min(slot_col).over(w)}).where("_alive")

    def row(slot, value):
        return F.struct(F.lit(slot).cast("int").alias(slot_col) if isinstance(slot, int) else slot.cast("int").alias(slot_col),
                        *[value(m).cast("double").alias(m) for m in measures])

    zero = F.lit(0.0)
    fresh = [row(0, lambda m: zero if measures[m] else F.col(m))] + [
        row(i, lambda m, i=i: F.when(F.lit(not measures[m] or i == weeks), F.col(m)).otherwise(zero))
        for i in range(1, weeks + 1)]
    moved = F.array(row(F.col(slot_col) + weeks, F.col))
    start = F.when(F.col("_first") == F.col(slot_col), F.concat(F.array(row(0, lambda m: zero)), moved)).otherwise(moved)
    rows = F.when(F.col(slot_col) == 0, F.array(*fresh)).otherwise(start)
    return (x.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")
             .where(F.col(slot_col) <= n))


def rollup_slots(hist: DataFrame, levels: Sequence[tuple[str, Sequence[str]]], measures: Sequence[str],
                 slot_col: str = "slot") -> dict[str, DataFrame]:
    """D12 in long form: the measures summed per slot at every level, finest first.

    Each level is stored and the next one sums it, so each reads the smallest available input.
    """
    from ..session import store
    out = {}
    for name, keys in levels:
        hist = store(hist.groupBy(*keys, slot_col).agg(*[F.sum(m).alias(m) for m in measures]), f"level-{name}")
        out[name] = hist
    return out


# --- levels on arrays -----------------------------------------------------------

def sum_arrays(col: str, n: int = WEEKS) -> Column:
    """Element-wise sum of a fixed-length array column inside ``agg``.

    Generated as ``n`` ordinary ``sum`` aggregates (partial on the map side),
    so a large group is never gathered into one task.
    """
    return F.array(*[F.coalesce(F.sum(F.col(col)[i]), F.lit(0.0)) for i in range(n)])


def rollup_levels(df: DataFrame, levels: Sequence[tuple[str, Sequence[str]]], arrays: Sequence[str],
                  scalars: Sequence[str] = (), n: int = WEEKS,
                  root: str | None = None) -> dict[str, DataFrame]:
    """The same measures rolled to every hierarchy level.

    ``levels`` runs from finest to coarsest as ``(name, key columns)``; each level
    is computed from the previous (finer) level's table, so each step reads the
    smallest available input. With ``root`` every level is written as a table
    (``root/name``) and the next level reads that table: each level is computed
    once, lineage stays short, and a lost executor re-reads a level instead of
    recomputing the chain.
    """
    out = {}
    cur = df
    for name, keys in levels:
        cur = cur.groupBy(*keys).agg(*[sum_arrays(a, n).alias(a) for a in arrays],
                                     *[F.sum(s).alias(s) for s in scalars])
        if root is not None:
            path = f"{root.rstrip('/')}/{name}"
            cur.write.mode("overwrite").parquet(path)
            cur = df.sparkSession.read.parquet(path)
        out[name] = cur
    return out


def history_day(hist: DataFrame, changes: DataFrame, cal: DataFrame, period_cols: Sequence[str],
                current: Mapping[str, object], keys: Sequence[str], value_col: str, measure: str,
                current_col: str, roll_weeks: int = 0, reset_current: bool = True,
                levels: Sequence[tuple[str, Sequence[str]]] | None = None,
                levels_root: str | None = None) -> dict[str, object]:
    """Section 3.2: one day of history upkeep as one job.

    Changes get their slot from the calendar (periods missing from it, in the future or too
    old come back in ``rejects``), are loaded into the history, the history is rolled by
    ``roll_weeks`` on a roll day, and the level tables are rebuilt from it when
    ``levels`` are given (written under ``levels_root`` when set). Returns
    ``{"history", "rejects", "levels"}``; the caller writes the new history to a
    new path (``replace_table``).
    """
    slotted = weeks_ago(changes, cal, period_cols, current)
    rejects = unknown_periods(changes, cal, period_cols).unionByName(
        out_of_range(slotted, "week_ago").select(*changes.columns))
    new = load_history(hist, slotted, keys, "week_ago", value_col, measure, current_col=current_col)
    if roll_weeks:
        new = roll_history(new, {measure: (current_col, reset_current)}, weeks=roll_weeks)
    lv = rollup_levels(new, levels, [measure], [current_col], root=levels_root) if levels else {}
    return {"history": new, "rejects": rejects, "levels": lv}
