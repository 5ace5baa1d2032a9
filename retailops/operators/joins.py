"""Join operators.

Joins are declared and Catalyst/AQE choose the strategy from sizes: a side is hinted
for broadcast only when its row count has been checked (or it is an aggregate
without grouping, which is one row by construction). Everything else is left to the
sort-merge / shuffled-hash join with AQE's skew splitting, so a key holding a third
of the rows is spread over several tasks instead of one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(on) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def row_bytes(df: DataFrame) -> Column:
    """Approximate bytes of one row: 8 for each plain value, the length of texts and of nested values as JSON."""
    parts = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) + F.lit(8))
        elif kind in ("array", "map", "struct"):
            parts.append(F.coalesce(F.length(F.to_json(F.struct(F.col(f.name)))), F.lit(0)))
        else:
            parts.append(F.lit(8))
    return reduce(lambda x, y: x + y, parts, F.lit(16)).cast("long")


def small_side(df: DataFrame, max_bytes: int = 8 << 20) -> bool:
    """Whether ``df`` measures at most ``max_bytes``: one plain aggregate over all its rows.

    ``df`` runs once for this; callers pass a stored or reduced frame.
    """
    return (df.agg(F.sum(row_bytes(df)).alias("b")).first()["b"] or 0) <= max_bytes


def checked_broadcast(df: DataFrame, max_bytes: int = 8 << 20) -> DataFrame:
    """Broadcast ``df`` only if it measures at most ``max_bytes``.

    Beyond the bound the frame is returned unhinted and the planner shuffles it (AQE still
    converts to a broadcast at run time when the measured shuffle size is small enough); the
    rows are the same either way.
    """
    return F.broadcast(df) if small_side(df, max_bytes) else df


def unique_rows(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df`` with an error raised, as part of the plan, for a key that has several rows.

    Rows with a null key part cannot match anything by equality and pass as they are.
    """
    keys = list(keys)
    whole = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest], F.lit(1).alias("_one"))
    g = df.where(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(row).alias("_row"))
    twice = F.raise_error(F.lit(f"{what}: more than one row per key"))
    g = g.withColumn("_ok", F.when(F.col("_n") > 1, twice.cast("boolean")).otherwise(F.lit(True))).where("_ok")
    one = g.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
    return one.unionByName(df.where(~whole))


def one_row(df: DataFrame) -> DataFrame:
    """Mark an ungrouped aggregate (exactly one row) as broadcastable."""
    return F.broadcast(df)


def star_join(fact: DataFrame, dims: Sequence[tuple]) -> DataFrame:
    """Chain of inner (or given) joins from a fact to its dimensions.

    ``dims`` entries are ``(dim_df, on)`` or ``(dim_df, on, how)``. Catalyst reorders
    and pushes filters; dimension sizes decide broadcast at plan and run time.
    """
    out = fact
    for d in dims:
        dim, on = d[0], d[1]
        how = d[2] if len(d) > 2 else "inner"
        out = out.join(dim, on, how)
    return out


def self_join(df: DataFrame, on: Sequence[tuple[str, str]], left: str = "a", right: str = "b",
              how: str = "inner", extra: Column | None = None) -> DataFrame:
    """Two roles of one table; ``on`` pairs left column with right column."""
    a, b = df.alias(left), df.alias(right)
    cond = reduce(lambda x, y: x & y, [F.col(f"{left}.{l}") == F.col(f"{right}.{r}") for l, r in on])
    if extra is not None:
        cond = cond & extra
    return a.join(b, cond, how)


def has(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows of ``df`` with at least one match in ``other`` (EXISTS / IN)."""
    if isinstance(on, Column):
        return df.join(other, on, "left_semi")
    return df.join(other, _keys(on), "left_semi")


def lacks(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows of ``df`` with no match in ``other`` (NOT EXISTS)."""
    if isinstance(on, Column):
        return df.join(other, on, "left_anti")
    return df.join(other, _keys(on), "left_anti")


def not_in(df: DataFrame, col: str, other: DataFrame, other_col: str | None = None) -> DataFrame:
    """SQL ``col NOT IN (select other_col from other)`` with its null rules.

    Empty subquery: every row. Subquery holding a null: no row. Otherwise rows whose
    ``col`` is not null and not in the set. Built as an ordinary (shuffleable) anti
    join plus a one-row summary, both from one distinct aggregate of ``other``,
    instead of the null-aware anti join, which Spark can only run with the whole
    subquery broadcast.
    """
    oc = other_col or col
    keys = other.select(F.col(oc).alias("_ni_k")).distinct()
    stats = one_row(keys.agg(F.count(F.lit(1)).alias("_ni_n"),
                             F.max(F.col("_ni_k").isNull().cast("int")).alias("_ni_null")))
    kept = df.join(keys.where(F.col("_ni_k").isNotNull()), F.col(col) == F.col("_ni_k"), "left_anti")
    return (kept.crossJoin(stats)
                .where((F.col("_ni_n") == 0) | ((F.col("_ni_null") == 0) & F.col(col).isNotNull()))
                .drop("_ni_n", "_ni_null"))


def asof_join(left: DataFrame, right: DataFrame, keys, at, from_col: str, to_col: str,
              end: str = "exclusive", how: str = "inner", bucket_days: int | None = 31,
              span: tuple | None = None) -> DataFrame:
    """Join each left row to the right rows of the same key in effect at ``at``.

    With ``bucket_days`` (the default) the time axis is cut into buckets: each
    right interval is expanded to the buckets it overlaps, each left row falls in one
    bucket, and the join is on (keys, bucket) with the exact interval test as a residual
    condition. A key with many intervals and many rows then only pairs rows with the few
    intervals of their own bucket, instead of every interval of the key.
    ``bucket_days=None`` joins on the keys alone.

    ``span`` is the pair of dates between which most ``at`` values lie (a calendar's ends).
    Days on both sides are clamped into it before they are cut into buckets, so open-ended
    rows such as 9999-12-31 do not explode, and values outside still meet in its first or last
    bucket: the span changes the cost, never the result. Without it the range of ``at`` is
    read from the left side first, which costs a pass over that column.
    """
    keys = _keys(keys)
    at_col = F.col(at) if isinstance(at, str) else at
    r = right
    l = left.withColumn("_at", at_col)
    cond = [l[k] == F.col(f"_r_{k}") for k in keys]
    rsel = [F.col(k).alias(f"_r_{k}") for k in keys] + [F.col(c) for c in right.columns if c not in keys]
    if bucket_days:
        day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
        if span is None:
            rng = left.select(F.min(F.to_date(at_col)).alias("lo"), F.max(F.to_date(at_col)).alias("hi")).first()
            span = (rng["lo"], rng["hi"])
        if span[0] is None:
            return l.join(r.select(*rsel), F.lit(False), how).drop("_at", *[f"_r_{k}" for k in keys])
        lo_d, hi_d = F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date")
        slot = lambda c: F.floor(day(F.least(F.greatest(F.to_date(c), lo_d), hi_d)) / bucket_days)
        f_slot, t_slot = slot(F.col(from_col)), slot(F.col(to_col))
        r = (r.where(F.col(from_col).isNotNull() & F.col(to_col).isNotNull() & (f_slot <= t_slot))
              .withColumn("_b", F.explode(F.sequence(f_slot, t_slot))))
        rsel.append(F.col("_b").alias("_r_b"))
        l = l.withColumn("_b", F.when(F.col("_at").isNotNull(), slot(F.col("_at"))))
        cond.append(l["_b"] == F.col("_r_b"))
    rr = r.select(*rsel)
    cond.append(rr[from_col] <= l["_at"])
    cond.append(rr[to_col] > l["_at"] if end == "exclusive" else rr[to_col] >= l["_at"])
    out = l.join(rr, reduce(lambda x, y: x & y, cond), how)
    return out.drop("_at", "_b", "_r_b", *[f"_r_{k}" for k in keys])


def fiscal(df: DataFrame, date_col: str, cal: DataFrame, cal_date_col: str = "date") -> DataFrame:
    """C14: attach fiscal period columns by date.

    A calendar has one row per day (73,000 rows for two centuries); it is broadcast
    after its size is measured.
    """
    c = checked_broadcast(cal)
    return df.join(c, F.to_date(df[date_col]) == c[cal_date_col], "left").drop(c[cal_date_col])


def join_on_expr(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column,
                 how: str = "inner", name: str = "_jk") -> DataFrame:
    """Equi join on computed keys (cut, padded, cast or chosen by CASE).

    Both keys are materialised as columns first so the join is a plain equi join
    that can hash-partition.
    """
    l = left.withColumn(name, left_key)
    r = right.withColumn(name, right_key)
    return l.join(r, name, how)


def case_key_join(left: DataFrame, right: DataFrame, rule: Column, right_key: str,
                  how: str = "inner") -> DataFrame:
    """The left join key column is chosen per row by a CASE expression."""
    return join_on_expr(left, right, rule, F.col(right_key), how, "_case_key").drop("_case_key")


def either_key_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_key: str,
                    how: str = "inner") -> DataFrame:
    """C17: ``right.k = left.a OR right.k = left.b`` as an equi join.

    Each left row is expanded to its distinct candidate keys, so a pair that matches
    through both keys still appears once and the planner never falls back to a
    nested-loop join.
    """
    l = left.withColumn("_ek", F.explode(F.array_distinct(F.array(*[F.col(k) for k in left_keys]))))
    out = l.join(right, l["_ek"] == right[right_key], how)
    return out.drop("_ek")


def lookup(df: DataFrame, dim: DataFrame, on, value: str, default=None,
           alias: str | None = None, unique: str = "error") -> DataFrame:
    """``coalesce((select value from dim where key = ...), default)``.

    A key with two rows is an error for the rows that look it up, as for a scalar subquery,
    whether its values differ or not; the check is part of the plan (``raise_error`` on the
    grouped lookup table) so it costs no extra job. ``unique="first"`` takes the smallest
    value instead.
    """
    keys = _keys(on)
    out_name = alias or value
    if unique == "error":
        g = dim.groupBy(*keys).agg(F.min(value).alias("_lv"), F.count(F.lit(1)).alias("_ln"))
        out = df.join(g, keys, "left")
        # only rows that actually hit such a key fail, as a scalar subquery would
        twice = F.raise_error(F.lit(f"lookup {value}: more than one row per key")).cast(dim.schema[value].dataType)
        out = out.withColumn("_lv", F.when(F.col("_ln") > 1, twice).otherwise(F.col("_lv"))).drop("_ln")
    else:
        out = df.join(dim.groupBy(*keys).agg(F.min(value).alias("_lv")), keys, "left")
    dflt = default if isinstance(default, Column) else F.lit(default)
    return out.withColumn(out_name, F.coalesce(F.col("_lv"), dflt) if default is not None
                          else F.col("_lv")).drop("_lv")


def flag(df: DataFrame, other: DataFrame, on, name: str, yes="Y", no="N") -> DataFrame:
    """C19: 'Y'/'N' column telling whether a matching row exists in ``other``."""
    keys = _keys(on)
    hit = other.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return (df.join(hit, keys, "left")
              .withColumn(name, F.when(F.col("_hit"), F.lit(yes)).otherwise(F.lit(no)))
              .drop("_hit"))


def lookup_latest(df: DataFrame, hist: DataFrame, on, order: str, value: str, default=None,
                  alias: str | None = None) -> DataFrame:
    """C20: value of the latest ``hist`` row per key (ties: larger value), with default.

    One grouped ``max(struct(order, value))`` per key: partial aggregation on the
    map side keeps a hot key from reaching one task whole.
    """
    keys = _keys(on)
    latest = hist.groupBy(*keys).agg(F.max(F.struct(F.col(order), F.col(value))).alias("_m"))
    latest = latest.select(*keys, F.col(f"_m.{value}").alias("_lv"))
    out = df.join(latest, keys, "left")
    name = alias or value
    dflt = default if isinstance(default, Column) else F.lit(default)
    return out.withColumn(name, F.coalesce(F.col("_lv"), dflt)).drop("_lv")


def lookup_first(df: DataFrame, hist: DataFrame, on, order: Sequence[str], value: str,
                 default=None, alias: str | None = None) -> DataFrame:
    """Value of the first row by ``order`` per key (ties broken by value)."""
    keys = _keys(on)
    order = _keys(order)
    first = hist.groupBy(*keys).agg(
        F.min(F.struct(*[F.col(o) for o in order], F.col(value).alias("_v"))).alias("_m"))
    first = first.select(*keys, F.col("_m._v").alias("_lv"))
    out = df.join(first, keys, "left")
    name = alias or value
    dflt = default if isinstance(default, Column) else F.lit(default)
    return out.withColumn(name, F.coalesce(F.col("_lv"), dflt)).drop("_lv")


def in_both(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct keys present in both sets (INTERSECT)."""
    return a.select(*cols).intersect(b.select(*cols))


def cross_param(df: DataFrame, params: DataFrame) -> DataFrame:
    """Attach a one-row parameter table to every row (``on 1=1``).

    The parameter table must be one row; it is reduced to one row that is broadcast, so the
    cross join is a projection, never a product of two large sides. Any other number of rows
    raises an error when the result is computed, without a job of its own.
    """
    cols = params.columns
    wrong = F.raise_error(F.lit("parameter table must have exactly one row")).cast("boolean")
    one = (params.agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in cols])
           .withColumn("_ok", F.when(F.col("_n") != 1, wrong).otherwise(F.lit(True))))
    # the test stands in the result's own filter, so pruning the parameters does not lose it
    return df.crossJoin(F.broadcast(one)).where("_ok").drop("_n", "_ok")


def match_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                    right_prefix: str = "r_") -> DataFrame:
    """I31 helper: join on keys where null matches null (``<=>``), still an equi join."""
    r = right.select(*[F.col(c).alias(right_prefix + c) for c in right.columns])
    cond = reduce(lambda x, y: x & y, [left[k].eqNullSafe(r[right_prefix + k]) for k in keys])
    return left.join(r, cond, how)


def coalesced_key_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str, object]],
                       how: str = "left") -> DataFrame:
    """C4: outer join whose key parts default when null on either side
    (``nvl(a.k, x) = nvl(b.k, x)``)."""
    cond = reduce(lambda x, y: x & y, [F.coalesce(left[l], F.lit(d)) == F.coalesce(right[r], F.lit(d))
                                       for l, r, d in pairs])
    return left.join(right, cond, how)


def lookup_map(df: DataFrame, dims: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Several name lookups at once: ``{out_col: (dim, key, value)}``."""
    out = df
    for name, (dim, key, value) in dims.items():
        out = lookup(out, dim.select(key, value), key, value, alias=name)
    return out
