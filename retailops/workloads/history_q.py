"""History queries (I21-I24, D12): monthly part x supplier quantities as slot history.

Months of ship dates play the role of weeks: the calendar is the distinct (year,
month) pairs in time order, the current period is the month of AS_OF, and each
(part, supplier) row carries 104 history slots plus the current value.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..plans import history as H
from ..session import store
from .registry import query, tables

KEYS = ["l_partkey", "l_suppkey"]
CURRENT = {"yr": 2001, "mo": 8}
SPLIT = _dt.date(2001, 1, 1)

_SQL_BASE = """m AS (SELECT DISTINCT year(l_shipdate) AS yr, month(l_shipdate) AS mo FROM lineitem),
cal AS (SELECT yr, mo, row_number() OVER (ORDER BY yr, mo) AS week_order FROM m),
cur AS (SELECT week_order AS cur FROM cal WHERE yr = 2001 AND mo = 8),
ch AS (SELECT l_partkey, l_suppkey, year(l_shipdate) AS yr, month(l_shipdate) AS mo, SUM(l_quantity) AS qty FROM lineitem GROUP BY 1, 2, 3, 4),
s AS (SELECT ch.l_partkey, ch.l_suppkey, cur.cur - cal.week_order AS week_ago, ch.qty
      FROM ch JOIN cal ON ch.yr = cal.yr AND ch.mo = cal.mo CROSS JOIN cur WHERE cur.cur - cal.week_order BETWEEN 0 AND 104)"""


def _by_month(spark, d):
    """Line items grouped by (part, supplier, month). There are about as many groups as lines, so the lines are dealt
    before they are added up: a partial sum of a whole file split would hold every line of it in memory."""
    (li,) = tables(spark, d, "lineitem")
    lines = li.select(*KEYS, F.year("l_shipdate").alias("yr"), F.month("l_shipdate").alias("mo"), "l_quantity", "l_extendedprice")
    by = [*KEYS, "yr", "mo"]
    return H.deal(lines, by, li.count()).groupBy(*by)


def _monthly(spark, d):
    """Quantity per (part, supplier, month), stored: line items are read once, and the calendar's
    range comes from this small table."""
    return store(_by_month(spark, d).agg(F.sum("l_quantity").alias("qty")), "monthly")


def _calendar(periods):
    """Month periods between the first and last (yr, mo), in order."""
    m = F.col("yr") * 12 + F.col("mo") - 1
    b = periods.agg(F.min(m).alias("lo"), F.max(m).alias("hi")).first()
    day = lambda x: _dt.date(x // 12, x % 12 + 1, 1)
    return H.order_weeks(H.month_calendar(periods.sparkSession, day(b["lo"]), day(b["hi"])), ["yr", "mo"])


def slotted_months(spark, d):
    """Every monthly quantity with its slot, counted back from the current period."""
    monthly = _monthly(spark, d)
    return H.weeks_ago(monthly, _calendar(monthly), ["yr", "mo"], CURRENT).withColumn("slot", F.col("week_ago").cast("int"))


def loaded_history(spark, d):
    """History as of the end of 2000, then the 2001 months loaded into their slots by calendar distance."""
    slotted = slotted_months(spark, d)
    split_slot = (CURRENT["yr"] * 12 + CURRENT["mo"]) - (SPLIT.year * 12 + SPLIT.month)
    old = F.col("slot") > split_slot
    cols = [*KEYS, "slot", "qty"]
    return H.load_slots(slotted.where(old & F.col("slot").between(0, H.WEEKS)).select(*cols),
                        slotted.where(~old).select(*cols), KEYS, ["qty"])


def _values(hist, keys=KEYS):
    return hist.where(F.col("qty") != 0).select(*keys, F.col("slot").alias("week_ago"), F.round("qty", 2).alias("value"))


@query("i24_calendar_order_advance", """
WITH m AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS yr, CAST(month(l_shipdate) AS INTEGER) AS mo FROM lineitem),
cal AS (SELECT yr, mo, CAST(row_number() OVER (ORDER BY yr, mo) AS BIGINT) AS week_order FROM m)
SELECT yr, mo, week_order,
  CASE WHEN week_order = (SELECT week_order + 1 FROM cal WHERE yr = 2001 AND mo = 8) THEN 'Y' ELSE 'N' END AS current_week FROM cal""")
def i24(spark, d):
    (li,) = tables(spark, d, "lineitem")
    months = li.select(F.year("l_shipdate").alias("yr"), F.month("l_shipdate").alias("mo"))
    cal = _calendar(months).withColumn("current_week", F.when((F.col("yr") == 2001) & (F.col("mo") == 8), "Y").otherwise("N"))
    return H.advance_week(cal)


@query("i23_load_history_by_calendar_distance", f"""
WITH {_SQL_BASE}
SELECT l_partkey, l_suppkey, CAST(week_ago AS INTEGER) AS week_ago, round(qty, 2) AS value FROM s WHERE qty <> 0""")
def i23(spark, d):
    return _values(loaded_history(spark, d))


@query("i23b_load_rejects", f"""
WITH {_SQL_BASE}
SELECT ch.l_partkey, ch.l_suppkey, CAST(ch.yr AS INTEGER) AS yr, CAST(ch.mo AS INTEGER) AS mo, round(ch.qty, 2) AS qty
FROM ch JOIN cal ON ch.yr = cal.yr AND ch.mo = cal.mo CROSS JOIN cur WHERE NOT (cur.cur - cal.week_order BETWEEN 0 AND 104)""")
def i23b(spark, d):
    """Months after the current period: they have no slot and come back as rejects."""
    return H.out_of_range(slotted_months(spark, d), "slot").select(*KEYS, "yr", "mo", F.round("qty", 2).alias("qty"))


@query("i23c_load_several_measures", f"""
WITH {_SQL_BASE},
m3 AS (SELECT l_partkey, l_suppkey, year(l_shipdate) AS yr, month(l_shipdate) AS mo, SUM(l_quantity) AS qty,
         SUM(l_extendedprice) AS amount, CAST(COUNT(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2, 3, 4)
SELECT m3.l_partkey, m3.l_suppkey, CAST(cur.cur - cal.week_order AS INTEGER) AS week_ago, round(m3.qty, 2) AS qty,
  round(CASE WHEN cur.cur - cal.week_order <= 1 THEN m3.amount ELSE 0 END, 2) AS amount,
  CASE WHEN cur.cur = cal.week_order THEN m3.n ELSE 0 END AS n
FROM m3 JOIN cal ON m3.yr = cal.yr AND m3.mo = cal.mo CROSS JOIN cur WHERE cur.cur - cal.week_order BETWEEN 0 AND 104""")
def i23c(spark, d):
    """One load of three measures: quantity for all months, amounts of the current and the previous
    month, line counts of the current month."""
    m = store(_by_month(spark, d).agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("amount"),
                                      F.count(F.lit(1)).cast("double").alias("n")), "monthly")
    x = H.weeks_ago(m, _calendar(m), ["yr", "mo"], CURRENT).withColumn("slot", F.col("week_ago").cast("int"))
    x = x.select(*KEYS, "slot", "qty", F.when(F.col("slot") <= 1, F.col("amount")).alias("amount"),
                 F.when(F.col("slot") == 0, F.col("n")).alias("n"))
    out = H.load_slots(x.where("slot > 1"), x.where("slot <= 1"), KEYS, ["qty", "amount", "n"])
    return out.select(*KEYS, F.col("slot").alias("week_ago"), F.round("qty", 2).alias("qty"),
                      F.round("amount", 2).alias("amount"), "n")


def _rolled(spark, d, times=12):
    return H.roll_slots(loaded_history(spark, d), KEYS, {"qty": True}, weeks=times)


@query("i21_roll_history_12_weeks", f"""
WITH {_SQL_BASE}
SELECT l_partkey, l_suppkey, CAST(week_ago + 12 AS INTEGER) AS week_ago, round(qty, 2) AS value FROM s WHERE week_ago + 12 <= 104 AND qty <> 0""")
def i21(spark, d):
    return _values(_rolled(spark, d))


@query("i21b_roll_prune_count", f"""
WITH {_SQL_BASE}
SELECT CAST(COUNT(*) AS BIGINT) AS n_rows FROM (SELECT l_partkey, l_suppkey FROM s WHERE qty <> 0 GROUP BY 1, 2 HAVING MIN(week_ago) <= 93)""")
def i21b(spark, d):
    return _rolled(spark, d).where("slot = 0").agg(F.count(F.lit(1)).alias("n_rows"))


@query("i21c_roll_60_weeks_values_fall_off", f"""
WITH {_SQL_BASE}
SELECT l_partkey, l_suppkey, CAST(week_ago + 60 AS INTEGER) AS week_ago, round(qty, 2) AS value FROM s WHERE week_ago + 60 <= 104 AND qty <> 0""")
def i21c(spark, d):
    """Sixty weeks at once: what was older than slot 44 falls off the end."""
    return _values(_rolled(spark, d, 60))


@query("i21d_roll_60_weeks_prune", f"""
WITH {_SQL_BASE}
SELECT l_partkey, l_suppkey FROM s WHERE qty <> 0 GROUP BY 1, 2 HAVING MIN(week_ago) <= 45""")
def i21d(spark, d):
    """The keys that sixty weekly prune tests leave."""
    return _rolled(spark, d, 60).where("slot = 0").select(*KEYS)


@query("i22_widen_history_78_to_104", f"""
WITH {_SQL_BASE}
SELECT l_partkey, l_suppkey, CAST(week_ago AS INTEGER) AS week_ago, round(qty, 2) AS value, 104 AS slots
FROM s WHERE week_ago BETWEEN 1 AND 78 AND qty <> 0""")
def i22(spark, d):
    old = H.from_long(loaded_history(spark, d).where(F.col("slot") <= 78), KEYS, "slot", "qty", "qty_hist", n=78)
    wide = H.widen_history(old, ["qty_hist"]).withColumn("slots", F.size("qty_hist"))  # the 78-week layout filled up
    return (H.to_long(wide, [*KEYS, "slots"], ["qty_hist"])
              .select(*KEYS, F.col("week_ago").cast("int").alias("week_ago"), F.round("value", 2).alias("value"), "slots"))


@query("d12_rollup_levels", f"""
WITH {_SQL_BASE},
j AS (SELECT s.*, sp.s_nationkey, n.n_regionkey FROM s JOIN supplier sp ON s.l_suppkey = sp.s_suppkey JOIN nation n ON sp.s_nationkey = n.n_nationkey)
SELECT 'supplier' AS level, CAST(l_suppkey AS BIGINT) AS level_key, CAST(week_ago AS INTEGER) AS week_ago, round(SUM(qty), 2) AS value FROM j GROUP BY 1, 2, 3
UNION ALL SELECT 'nation', CAST(s_nationkey AS BIGINT), CAST(week_ago AS INTEGER), round(SUM(qty), 2) FROM j GROUP BY 1, 2, 3
UNION ALL SELECT 'region', CAST(n_regionkey AS BIGINT), CAST(week_ago AS INTEGER), round(SUM(qty), 2) FROM j GROUP BY 1, 2, 3""")
def d12(spark, d):
    supp, nation = tables(spark, d, "supplier", "nation")
    h = loaded_history(spark, d)
    h = h.join(supp.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey") \
         .join(nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
    levels = H.rollup_slots(h, [("supplier", ["l_suppkey", "s_nationkey", "n_regionkey"]),
                                ("nation", ["s_nationkey", "n_regionkey"]), ("region", ["n_regionkey"])], ["qty"])
    key_of = {"supplier": "l_suppkey", "nation": "s_nationkey", "region": "n_regionkey"}
    out = None
    for name, df in levels.items():
        x = _values(df.select(F.col(key_of[name]).cast("long").alias("level_key"), "slot", "qty"), ["level_key"])
        x = x.withColumn("level", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out.select("level", "level_key", "week_ago", "value")
