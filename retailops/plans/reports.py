"""Reports and feeds.

Each report is one declarative plan: star joins to dimensions, one aggregate per
fact (one pass with conditional sums where the reference scanned a fact twice),
unions for multi-part listings, and fixed-width formatting as column expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import safe_next_day, safe_prev_day, ts_literal, zero_padded
from ..operators.aggs import count_by_distinct, number_rows, top_rank, with_count
from ..operators.joins import unique_rows
from ..session import store
from ..sources.tables import fits_fixed, format_fixed


def explode_sets(items: DataFrame, components: DataFrame, cost: DataFrame, item_key: str,
                 set_key: str, comp_key: str, qty_col: str, cost_key: str, cost_col: str) -> DataFrame:
    """Items plus their components, each with a unit cost.

    ``components`` lists (set, component, quantity); the sets of ``items`` are
    joined to their components (no pairing of items with each other) and unioned
    with the items themselves; a set's own cost is the sum of its components'.
    Output: ``sku, sku_type ('SET'/'COMP'/'ITEM'), parent_sku, qty, unit_cost``;
    duplicates removed as in SQL ``UNION``.
    """
    c = cost.select(F.col(cost_key).alias("_ck"), F.col(cost_col).alias("_cost"))
    comp = (components.join(items.select(F.col(item_key).alias(set_key)), set_key, "left_semi")
                      .join(c, F.col(comp_key) == F.col("_ck"), "left"))
    comp_rows = comp.select(F.col(comp_key).cast("long").alias("sku"), F.lit("COMP").alias("sku_type"),
                            F.col(set_key).cast("long").alias("parent_sku"), F.col(qty_col).cast("double").alias("qty"),
                            F.col("_cost").cast("double").alias("unit_cost"))
    set_cost = comp.groupBy(set_key).agg(F.sum(F.col(qty_col) * F.col("_cost")).alias("_sc"))
    item_rows = (items.select(F.col(item_key).alias(set_key)).join(set_cost, set_key, "left")
                 .select(F.col(set_key).cast("long").alias("sku"),
                         F.when(F.col("_sc").isNotNull(), F.lit("SET")).otherwise(F.lit("ITEM")).alias("sku_type"),
                         F.lit(None).cast("long").alias("parent_sku"), F.lit(1.0).alias("qty"),
                         F.col("_sc").cast("double").alias("unit_cost")))
    return item_rows.unionByName(comp_rows).distinct()


def feed(df: DataFrame, layout: Sequence[tuple], name: str = "record", order: Sequence | None = None) -> DataFrame:
    """Outbound fixed-width feed: one record per row (see ``format_fixed``).

    Rows with a number wider than its field are left out; ``feed_rejects`` returns them.
    With ``order`` the records come out sorted (a range-partitioned sort, so the
    part files written by ``write_text`` are in order one after another)."""
    df = df.where(fits_fixed(layout))
    out = df.orderBy(*order) if order else df
    return out.select(format_fixed(layout).alias(name))


def feed_rejects(df: DataFrame, layout: Sequence[tuple]) -> DataFrame:
    """The rows that ``feed`` leaves out because a number does not fit its field."""
    return df.where(~fits_fixed(layout))


def item_store_detail(base: DataFrame | None, fact: DataFrame, keys: Sequence[str],
                      sums: Mapping[str, tuple[Column, Column]],
                      flags: Mapping[str, Column]) -> DataFrame:
    """Item x place rows with several fact totals and ever-had flags.

    The fact is read once: one grouped pass computes every conditional total
    (``sum(when(cond, value))``) and every flag (``max(when(cond, 1))``), then a
    left join to the base fills 0 / 'N' where the fact has no row. Without a base (None) the
    rows are the fact's own keys, and nothing is joined.
    """
    aggs = [F.sum(F.when(c, v)).alias(n) for n, (c, v) in sums.items()]
    aggs += [F.max(F.when(c, F.lit(1))).alias(n) for n, c in flags.items()]
    g = fact.groupBy(*keys).agg(*aggs)
    out = g if base is None else base.join(g, list(keys), "left")
    for n in sums:
        out = out.withColumn(n, F.coalesce(F.col(n), F.lit(0.0)))
    for n in flags:
        out = out.withColumn(n, F.when(F.col(n) == 1, F.lit("Y")).otherwise(F.lit("N")))
    return out


def in_stock(df: DataFrame, keys: Sequence[str], in_stock_cond: Column, exclude: Column | None = None,
             item_col: str | None = None, scale: int = 2, items_per: Sequence[str] | None = None,
             adjustments: tuple[DataFrame | Column, str] | None = None,
             lead: tuple[DataFrame, Sequence[str], Sequence[str]] | None = None,
             order: Sequence | None = None) -> DataFrame:
    """In-stock percentage per group (e.g. buyer x source x method x store), one pass.

    Per group: rows in total, in stock and out of stock, the percentage in stock
    and, with ``item_col``, the lowest out-of-stock item (a pointer for the
    buyer). ``exclude`` drops rows from numerator and denominator. Counts come from one pass
    over the full group keys (with ``items_per`` to the item, stored, and from there to the keys); a report that joins in-stock and out-of-stock counts on source
    and store only would merge a source's two replenishment methods, so include the method in
    ``keys`` when it matters.

    * ``items_per`` (a subset of ``keys``, e.g. the source) adds ``n_items``: how many distinct
      items of ``item_col`` it has anywhere;
    * ``adjustments`` is ``(rows, quantity)``, rows carrying ``keys``, or ``(condition, quantity)``
      for rows of ``df`` itself, summed in the same pass: adds ``adj_qty``, 0 where there is none;
    * ``lead`` is ``(details, on, day columns)``: adds ``lead_days``, the sum of the source's
      day columns (order processing and transit);
    * ``order`` sorts the report; by default the worst percentage comes first.
    """
    keys = list(keys)
    x = df if exclude is None else df.where(~exclude)
    own = adjustments is not None and isinstance(adjustments[0], Column)
    n_in, n_out = (F.sum(F.when(c, 1).otherwise(0)).cast("long") for c in (in_stock_cond, ~in_stock_cond))
    parts = {"n_total": F.count(F.lit(1)), "n_in_stock": n_in}
    if own:
        parts["adj_qty"] = F.sum(F.when(adjustments[0], F.col(adjustments[1])))
    counts = None
    if items_per:  # the joined rows run once, to one stored row per group and item; all else is read from those
        x = store(x.groupBy(*keys, item_col).agg(*[c.alias(n) for n, c in parts.items()], n_out.alias("_out")), "in-stock")
        counts = count_by_distinct(x, [item_col], items_per, "n_items")
        parts, out = {n: F.sum(n) for n in parts}, F.col("_out") > 0
    else:
        out = ~in_stock_cond
    if own:
        parts["adj_qty"] = F.coalesce(parts["adj_qty"], F.lit(0.0))
    if item_col:
        parts["min_out_item"] = F.min(F.when(out, F.col(item_col)))
    g = x.groupBy(*keys).agg(*[c.alias(n) for n, c in parts.items()])
    g = g.withColumn("n_out_of_stock", F.col("n_total") - F.col("n_in_stock"))
    g = g.withColumn("pct_in_stock", F.round(F.when(F.col("n_total") > 0, F.col("n_in_stock") * 100.0 / F.col("n_total")), scale))
    if items_per:
        g = g.join(counts, list(items_per), "left")
    if adjustments and not own:
        rows, qty = adjustments
        g = g.join(rows.groupBy(*keys).agg(F.sum(qty).alias("adj_qty")), keys, "left") \
             .withColumn("adj_qty", F.coalesce(F.col("adj_qty"), F.lit(0.0)))
    if lead:
        details, on, days = lead
        total = reduce(lambda a, b: a + b, [F.col(d) for d in days])
        g = g.join(unique_rows(details.select(*on, total.alias("lead_days")), on, "lead time"), list(on), "left")
    return g.orderBy(*(order or ["pct_in_stock", *keys]))


def price_list(intervals: DataFrame, key: Sequence[str], from_col: str, to_col: str, price_col: str,
               as_of, cents_width: int = 9) -> DataFrame:
    """Current and future prices as coded rows: 'C' for the row in effect at
    ``as_of``, 'F' for rows starting after it; price as zero-padded cents, a price of more
    digits or below zero being an error."""
    d = F.lit(as_of)
    code = F.when((F.col(from_col) <= d) & (F.col(to_col) > d), F.lit("C")).when(F.col(from_col) > d, F.lit("F"))
    x = intervals.withColumn("price_code", code).where(F.col("price_code").isNotNull())
    cents = F.round(F.col(price_col) * 100, 0).cast("long")
    below = F.raise_error(F.concat(F.lit("price below zero: "), F.col(price_col).cast("string"))).cast("long")
    cents = zero_padded(F.when(cents < 0, below).otherwise(cents).cast("string"), cents_width, "price")
    return x.select(*key, "price_code", F.col(from_col).alias("eff_from"), cents.alias("price_digits")).distinct()


def price_timeline(intervals: DataFrame, key: Sequence[str], from_col: str, to_col: str) -> DataFrame:
    """I16: intervals with the interval count of their key, the day before the start
    and the day after the end (the open-end sentinel has no day after)."""
    return (with_count(intervals, list(key), "n_intervals")
            .withColumn("day_before", safe_prev_day(from_col))
            .withColumn("day_after", safe_next_day(to_col)))


def missing_changes(model_changes: DataFrame, target_changes: DataFrame, match_keys: Sequence[str],
                    exclude: Column | None = None, include: Column | None = None) -> DataFrame:
    """Changes made at the model place that the target place lacks.

    ``model_changes`` carries the target it is compared with; an anti join on the
    target and the change keys finds what is missing. Rows matching ``exclude``
    are dropped unless they match ``include``.
    """
    miss = model_changes.join(target_changes.select(*match_keys).distinct(), list(match_keys), "left_anti")
    if exclude is not None:
        keep = ~exclude if include is None else (~exclude | include)
        miss = miss.where(keep)
    return miss


def cost_list(current: DataFrame, pending: DataFrame, avg_hist: DataFrame, keys: Sequence[str],
              order_col: str, avg_col: str) -> DataFrame:
    """Current cost rows with the latest average cost (default 0), plus
    pending cost rows (average 0), in one listing."""
    from ..operators.joins import lookup_latest
    cur = lookup_latest(current, avg_hist, list(keys), order_col, avg_col, default=0.0, alias="avg_cost") \
        .withColumn("cost_kind", F.lit("CURRENT"))
    pnd = pending.withColumn("avg_cost", F.lit(0.0)).withColumn("cost_kind", F.lit("PENDING"))
    return cur.unionByName(pnd.select(*cur.columns))


def version_in_force(df: DataFrame, version_key: Sequence[str], from_col: str, horizon,
                     status_col: str | None = None, statuses: Sequence | None = None) -> DataFrame:
    """Per version key, the latest row effective on or before ``horizon``
    (ties kept, as ``rank() = 1``), among rows of the given statuses."""
    x = df.where(F.col(from_col).isNotNull() & (F.col(from_col) <= F.lit(horizon)))
    if status_col and statuses is not None:
        x = x.where(F.col(status_col).isin(list(statuses)))
    return top_rank(x, list(version_key), from_col)


def shelf_totals(positions: DataFrame, keys: Sequence[str], facings: Column, capacity_per_facing: Column,
                 min_fill_pct: float = 50.0) -> DataFrame:
    """Facings, capacity and minimum fill per item x place."""
    x = positions.withColumn("_f", facings).withColumn("_cap", facings * capacity_per_facing)
    g = x.groupBy(*keys).agg(F.sum("_f").cast("long").alias("facings"), F.sum("_cap").cast("long").alias("capacity"))
    return g.withColumn("min_fill", F.ceil(F.col("capacity") * F.lit(min_fill_pct / 100.0)).cast("long"))


def fix_batch(queue: DataFrame, id_col: str, high_water=None) -> tuple[DataFrame, object]:
    """Section 3.3: the highest queued id fixes the batch.

    The high-water mark is read once (one-row aggregate) unless given, and the
    batch is the queued rows up to it: rows queued while the batch runs wait for
    the next run, and re-running with the same mark repeats the same batch.
    Returns ``(batch, high_water)``.
    """
    if high_water is None:
        high_water = queue.agg(F.max(id_col)).first()[0]
    if high_water is None:
        return queue.limit(0), None
    return queue.where(F.col(id_col) <= F.lit(high_water)), high_water


def release_feed(pack_rows: DataFrame, detail_rows: DataFrame, order: Sequence[str], base_ts,
                 layout: Sequence[tuple]) -> DataFrame:
    """Rows released from vendor packs and from detail lines, unioned without
    duplicates, each stamped with a unique time (base + row number seconds) and
    formatted as a fixed-width record."""
    u = pack_rows.unionByName(detail_rows).distinct()
    n = number_rows(u, list(order), name="_rn")
    stamped = n.withColumn("release_ts", ts_literal(base_ts)
                           + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_rn").cast("decimal(18,6)")))
    rec = F.concat(format_fixed(layout), F.date_format("release_ts", "yyyyMMddHHmmss"))
    return stamped.drop("_rn").withColumn("record", rec)


def sectioned_report(sections: Mapping[str, DataFrame], text_col: str = "text") -> DataFrame:
    """A text report whose sections appear only when they have rows.

    Each section contributes a header line with its row count and its detail lines,
    ordered by (section number, line number); counts come from one aggregate per
    section joined to the header row, so an empty section yields nothing.
    """
    parts = []
    for i, (title, df) in enumerate(sections.items(), start=1):
        cnt = df.agg(F.count(F.lit(1)).alias("_n"))
        header = cnt.where(F.col("_n") > 0).select(
            F.lit(i).alias("section_no"), F.lit(0).cast("long").alias("line_no"),
            F.concat(F.lit(f"== {title} ("), F.col("_n").cast("string"), F.lit(") ==")).alias(text_col))
        body = number_rows(df.select(F.col(text_col)), [text_col], name="line_no") \
            .select(F.lit(i).alias("section_no"), "line_no", text_col)
        parts.append(header.unionByName(body))
    return reduce(DataFrame.unionByName, parts)


def classify_hosts(c, rules: Sequence[tuple[str, str]], default: str = "OTHER") -> Column:
    """Site from a host (or any) name by LIKE patterns, first match wins."""
    col = F.col(c) if isinstance(c, str) else c
    expr = None
    for pattern, site in rules:
        expr = F.when(col.like(pattern), F.lit(site)) if expr is None else expr.when(col.like(pattern), F.lit(site))
    return expr.otherwise(F.lit(default))


def release_report(released: DataFrame, places: DataFrame, place_key: str, group_col: str,
                   detail_cols: Sequence[str], qty_col: str, keep: Column | None = None,
                   csv_path: str | None = None) -> DataFrame:
    """Released quantities for every place, with a subtotal per group.

    ``released`` (place key, quantity) is right joined to ``places`` so places with
    nothing released still appear with 0; ``keep`` filters on that defaulted
    quantity (the kept side of the outer join); detail rows and one subtotal row per
    ``group_col`` are listed together and optionally written as CSV.
    """
    from ..operators.aggs import with_subtotals
    from ..sources.tables import write_csv
    j = released.join(places, place_key, "right").withColumn(qty_col, F.coalesce(F.col(qty_col), F.lit(0.0)))
    if keep is not None:
        j = j.where(keep)
    out = with_subtotals(j, group_col, list(detail_cols), [qty_col])
    if csv_path:
        write_csv(out, csv_path)
    return out


def name_of(df: DataFrame, code_col: str, level: str, dims: Mapping[str, tuple[DataFrame, str, str]],
            alias: str = "name") -> DataFrame:
    """Name of a code at a chosen hierarchy level.

    ``dims`` maps a level to ``(dimension, key column, name column)``; the code in
    ``code_col`` is looked up in the level's dimension (null when absent).
    """
    from ..operators.joins import lookup
    dim, key, name = dims[level]
    d = dim.select(F.col(key).alias(code_col), F.col(name).alias(alias))
    return lookup(df, d, code_col, alias)

