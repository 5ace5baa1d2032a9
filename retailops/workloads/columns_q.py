"""Predicate and scalar-helper queries."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..functions import cols as C
from ..operators.joins import not_in
from .registry import AS_OF, EVENTS_AS_OF, query, tables


@query("b1_project_rename", """
SELECT p_partkey AS item, p_brand AS brand, p_retailprice AS price, 'PRD' AS env, 1 AS one
FROM part""")
def b1(spark, d):
    (part,) = tables(spark, d, "part")
    return part.select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"),
                       F.col("p_retailprice").alias("price"), F.lit("PRD").alias("env"),
                       F.lit(1).alias("one"))


@query("b2_conjunctive_filter", """
SELECT p_partkey, p_name, p_size, p_retailprice FROM part
WHERE p_size > 10 AND p_type = 'PROMO' AND p_retailprice < 950""")
def b2(spark, d):
    (part,) = tables(spark, d, "part")
    return (part.where((F.col("p_size") > 10) & (F.col("p_type") == "PROMO") & (F.col("p_retailprice") < 950))
                .select("p_partkey", "p_name", "p_size", "p_retailprice"))


@query("b3_in_not_in_list", """
SELECT p_partkey, p_type, p_brand FROM part
WHERE p_type IN ('SMALL', 'LARGE') AND p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')""")
def b3(spark, d):
    (part,) = tables(spark, d, "part")
    return (part.where(F.col("p_type").isin("SMALL", "LARGE") & ~F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"))
                .select("p_partkey", "p_type", "p_brand"))


@query("b4_between", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(l_shipdate AS DATE) AS ship_date
FROM lineitem
WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'
  AND l_quantity BETWEEN 10 AND 20 AND l_returnflag BETWEEN 'A' AND 'N'""")
def b4(spark, d):
    (li,) = tables(spark, d, "lineitem")
    sd = F.to_date("l_shipdate")
    return (li.where(sd.between(_dt.date(1997, 1, 1), _dt.date(1997, 3, 31))
                     & F.col("l_quantity").between(10, 20) & F.col("l_returnflag").between("A", "N"))
              .select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", sd.alias("ship_date")))


@query("b5_like_patterns", """
SELECT p_partkey, p_name, p_brand FROM part
WHERE (p_name LIKE 'red%' OR p_name LIKE '%bolt%') AND p_brand LIKE 'Brand#1_'
  AND p_name NOT LIKE '%ring'""")
def b5(spark, d):
    (part,) = tables(spark, d, "part")
    n = F.col("p_name")
    return (part.where((n.like("red%") | n.like("%bolt%")) & F.col("p_brand").like("Brand#1_") & ~n.like("%ring"))
                .select("p_partkey", "p_name", "p_brand"))


@query("b6_like_char_class", """
SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[5-7][0-2]$')""")
def b6(spark, d):
    (cust,) = tables(spark, d, "customer")
    return cust.where(F.col("c_name").rlike("[5-7][0-2]$")).select("c_custkey", "c_name")


@query("b7_present_after_left_join", """
SELECT o.o_orderstatus,
       CAST(SUM(CASE WHEN l.l_returnflag IS NOT NULL AND length(trim(l.l_returnflag)) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_present,
       CAST(SUM(CASE WHEN l.l_returnflag IS NOT NULL AND length(trim(l.l_returnflag)) > 0 THEN 0 ELSE 1 END) AS BIGINT) AS n_missing
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey
GROUP BY o.o_orderstatus""")
def b7(spark, d):
    orders, li = tables(spark, d, "orders", "lineitem")
    j = orders.join(li, orders.o_orderkey == li.l_orderkey, "left")
    p = C.is_present("l_returnflag")
    return j.groupBy("o_orderstatus").agg(F.sum(p.cast("long")).alias("n_present"),
                                         F.sum((~p).cast("long")).alias("n_missing"))


@query("b8_null_safe_differs", """
SELECT o.o_orderstatus, CAST(COUNT(*) AS BIGINT) AS n_differ
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey
WHERE l.l_linestatus IS DISTINCT FROM o.o_orderstatus
   OR CAST(l.l_shipdate AS DATE) IS DISTINCT FROM CAST(o.o_orderdate AS DATE)
GROUP BY o.o_orderstatus""")
def b8(spark, d):
    orders, li = tables(spark, d, "orders", "lineitem")
    j = orders.join(li, orders.o_orderkey == li.l_orderkey, "left")
    cond = C.differs([F.col("l_linestatus"), F.to_date("l_shipdate")],
                     [F.col("o_orderstatus"), F.to_date("o_orderdate")])
    return j.where(cond).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_differ"))


@query("b9_any_of_k_mismatch", """
SELECT l.l_returnflag, CAST(COUNT(*) AS BIGINT) AS n_mismatch
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
WHERE round(l.l_extendedprice / l.l_quantity, 2) != p.p_retailprice OR l.l_discount > 0.08 OR l.l_tax > 0.07
GROUP BY l.l_returnflag""")
def b9(spark, d):
    li, part = tables(spark, d, "lineitem", "part")
    j = li.join(part, li.l_partkey == part.p_partkey)
    cond = C.differs([F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2)], ["p_retailprice"],
                     null_safe=False) | (F.col("l_discount") > 0.08) | (F.col("l_tax") > 0.07)
    return j.where(cond).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_mismatch"))


@query("b10_in_effect_on_date", """
WITH firsts AS (SELECT l_orderkey, MIN(CAST(l_shipdate AS DATE)) AS first_ship FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS valid_from, f.first_ship AS valid_to,
       (CAST(o.o_orderdate AS DATE) <= DATE '1998-06-01' AND f.first_ship > DATE '1998-06-01') AS in_effect_excl,
       (CAST(o.o_orderdate AS DATE) <= DATE '1998-06-01' AND f.first_ship >= DATE '1998-06-01') AS in_effect_incl
FROM orders o JOIN firsts f ON o.o_orderkey = f.l_orderkey
WHERE CAST(o.o_orderdate AS DATE) <= DATE '1998-06-01' AND f.first_ship >= DATE '1998-06-01'""")
def b10(spark, d):
    orders, li = tables(spark, d, "orders", "lineitem")
    firsts = li.groupBy("l_orderkey").agg(F.min(F.to_date("l_shipdate")).alias("valid_to"))
    j = orders.join(firsts, orders.o_orderkey == firsts.l_orderkey).select(
        "o_orderkey", F.to_date("o_orderdate").alias("valid_from"), "valid_to")
    on = _dt.date(1998, 6, 1)
    j = j.withColumn("in_effect_excl", C.in_effect("valid_from", "valid_to", on, "exclusive")) \
         .withColumn("in_effect_incl", C.in_effect("valid_from", "valid_to", on, "inclusive"))
    return j.where(F.col("in_effect_incl"))


@query("b11_older_newer_than", """
SELECT o_orderstatus,
  CAST(SUM(CASE WHEN o_orderdate < DATE '2001-08-01' - INTERVAL 90 DAY THEN 1 ELSE 0 END) AS BIGINT) AS n_older_90d,
  CAST(SUM(CASE WHEN o_orderdate < DATE '2001-08-01' - INTERVAL 1 YEAR THEN 1 ELSE 0 END) AS BIGINT) AS n_older_1y,
  CAST(SUM(CASE WHEN o_orderdate >= DATE '2001-08-01' - INTERVAL 6 MONTH THEN 1 ELSE 0 END) AS BIGINT) AS n_newer_6m
FROM orders GROUP BY o_orderstatus""")
def b11(spark, d):
    (orders,) = tables(spark, d, "orders")
    return orders.groupBy("o_orderstatus").agg(
        F.sum(C.older_than("o_orderdate", AS_OF, 90).cast("long")).alias("n_older_90d"),
        F.sum(C.older_than("o_orderdate", AS_OF, 1, "years").cast("long")).alias("n_older_1y"),
        F.sum(C.newer_than("o_orderdate", AS_OF, 6, "months").cast("long")).alias("n_newer_6m"))


PRIORITY_RULE = {"F": ["1-URGENT", "2-HIGH"], "O": ["3-MEDIUM"],
                 "P": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]}


@query("b12_status_dependent_rule", """
SELECT o_orderstatus, CAST(COUNT(*) AS BIGINT) AS n_allowed FROM orders
WHERE CASE WHEN o_orderstatus = 'F' THEN o_orderpriority IN ('1-URGENT', '2-HIGH')
           WHEN o_orderstatus = 'O' THEN o_orderpriority IN ('3-MEDIUM')
           WHEN o_orderstatus = 'P' THEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')
           ELSE FALSE END
GROUP BY o_orderstatus""")
def b12(spark, d):
    (orders,) = tables(spark, d, "orders")
    return (orders.where(C.allowed_by("o_orderpriority", "o_orderstatus", PRIORITY_RULE))
                  .groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_allowed")))


@query("b13_distinct_pairs", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def b13(spark, d):
    (li,) = tables(spark, d, "lineitem")
    return li.select("l_partkey", "l_suppkey").distinct()


@query("b14_outlier_trim", """
SELECT l_returnflag, CAST(COUNT(*) AS BIGINT) AS n, round(SUM(l_extendedprice), 2) AS total
FROM lineitem WHERE l_extendedprice > 1000 AND l_extendedprice < 50000 GROUP BY l_returnflag""")
def b14(spark, d):
    (li,) = tables(spark, d, "lineitem")
    return (li.where((F.col("l_extendedprice") > 1000) & (F.col("l_extendedprice") < 50000))
              .groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"),
                                           F.round(F.sum("l_extendedprice"), 2).alias("total")))


# --- scalar helpers ------------------------------------------------------------

@query("h1_substring_right", """
SELECT p_partkey, substr(p_name, 1, 3) AS head3, right(p_name, 4) AS tail4, substr(p_brand, 7) AS brand_no
FROM part""")
def h1(spark, d):
    (part,) = tables(spark, d, "part")
    return part.select("p_partkey", F.substring("p_name", 1, 3).alias("head3"),
                       C.right("p_name", 4).alias("tail4"), F.expr("substr(p_brand, 7)").alias("brand_no"))


@query("h2_concat", "SELECT c_custkey, c_name || '-' || c_mktsegment AS label FROM customer")
def h2(spark, d):
    (cust,) = tables(spark, d, "customer")
    return cust.select("c_custkey", F.concat("c_name", F.lit("-"), "c_mktsegment").alias("label"))


@query("h3_text_functions", """
SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, replace(p_brand, 'Brand#', 'B') AS short_brand,
       lpad(CAST(p_size AS VARCHAR), 3, '0') AS size3, rpad(p_type, 10, '.') AS type10,
       length(p_name) AS name_len, trim('  ' || p_type || '  ') AS trimmed, repeat(' ', 3) || p_type AS spaced
FROM part""")
def h3(spark, d):
    (part,) = tables(spark, d, "part")
    return part.select(
        "p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"),
        F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("B")).alias("short_brand"),
        F.lpad(F.col("p_size").cast("string"), 3, "0").alias("size3"),
        F.rpad("p_type", 10, ".").alias("type10"), F.length("p_name").cast("long").alias("name_len"),
        F.trim(F.concat(F.lit("  "), "p_type", F.lit("  "))).alias("trimmed"),
        F.concat(F.repeat(F.lit(" "), 3), "p_type").alias("spaced"))


@query("h4_after_last_separator", """
SELECT c_custkey, regexp_extract(c_name, '[^#]*$') AS after_hash,
       regexp_extract(c_mktsegment, '[^O]*$') AS after_o FROM customer""")
def h4(spark, d):
    (cust,) = tables(spark, d, "customer")
    return cust.select("c_custkey", C.after_last("c_name", "#").alias("after_hash"),
                       C.after_last("c_mktsegment", "O").alias("after_o"))


@query("h5_digits", """
SELECT o_orderkey, lpad(replace(CAST(abs(CAST(o_totalprice AS DECIMAL(11,2))) AS VARCHAR), '.', ''), 11, '0') AS price_digits,
       lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS cust_digits FROM orders""")
def h5(spark, d):
    (orders,) = tables(spark, d, "orders")
    return orders.select("o_orderkey", C.digits(F.col("o_totalprice").cast("decimal(11,2)"), 11).alias("price_digits"),
                         C.digits("o_custkey", 9).alias("cust_digits"))


@query("h6_casts", """
SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_txt, TRY_CAST(substr(p_brand, 7) AS INTEGER) AS brand_no,
       TRY_CAST(p_type AS INTEGER) AS type_no, CAST(CAST(p_retailprice AS DECIMAL(9,2)) AS VARCHAR) AS price_txt
FROM part""")
def h6(spark, d):
    (part,) = tables(spark, d, "part")
    return part.select("p_partkey", F.col("p_size").cast("string").alias("size_txt"),
                       F.expr("substr(p_brand, 7)").try_cast("int").alias("brand_no"),
                       F.col("p_type").try_cast("int").alias("type_no"),
                       F.col("p_retailprice").cast("decimal(9,2)").cast("string").alias("price_txt"))


@query("h7_coalesce_nullif_nvl2", """
SELECT coalesce(l.l_returnflag, '-') AS flag,
       CASE WHEN starts_with(o.o_orderpriority, '5') THEN NULL ELSE o.o_orderpriority END AS priority,
       CASE WHEN l.l_orderkey IS NOT NULL THEN 'has' ELSE 'none' END AS has_returns,
       CAST(COUNT(*) AS BIGINT) AS n
FROM orders o LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') l ON o.o_orderkey = l.l_orderkey
GROUP BY 1, 2, 3""")
def h7(spark, d):
    orders, li = tables(spark, d, "orders", "lineitem")
    r = li.where(F.col("l_returnflag") == "R")
    j = orders.join(r, orders.o_orderkey == r.l_orderkey, "left")
    return j.groupBy(F.coalesce("l_returnflag", F.lit("-")).alias("flag"),
                     C.nullif_prefix("o_orderpriority", "5").alias("priority"),
                     C.nvl2("l_orderkey", F.lit("has"), F.lit("none")).alias("has_returns")) \
            .agg(F.count(F.lit(1)).alias("n"))


PRIORITY_LABEL = {"1-URGENT": "now", "2-HIGH": "today", "3-MEDIUM": "week"}
STATUS_LABEL = {"F": "filled", "O": "open", "P": "partial"}


@query("h8_code_label_maps", """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '2-HIGH' THEN 'today' WHEN '3-MEDIUM' THEN 'week' ELSE 'later' END AS urgency,
       CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS status,
       CASE WHEN o_totalprice >= 300000 THEN CASE WHEN o_orderstatus = 'F' THEN 'big done' ELSE 'big open' END ELSE 'small' END AS size_class,
       CAST(COUNT(*) AS BIGINT) AS n
FROM orders GROUP BY 1, 2, 3""")
def h8(spark, d):
    (orders,) = tables(spark, d, "orders")
    nested = F.when(F.col("o_totalprice") >= 300000,
                    F.when(F.col("o_orderstatus") == "F", "big done").otherwise("big open")).otherwise("small")
    return orders.groupBy(C.map_code("o_orderpriority", PRIORITY_LABEL, "later").alias("urgency"),
                          C.map_code("o_orderstatus", STATUS_LABEL).alias("status"),
                          nested.alias("size_class")).agg(F.count(F.lit(1)).alias("n"))


@query("h9_row_max_null_aware", """
SELECT o.o_orderstatus,
       round(SUM(CASE WHEN o.o_totalprice IS NULL OR l.l_extendedprice IS NULL THEN NULL ELSE greatest(o.o_totalprice / 10, l.l_extendedprice) END), 2) AS sum_max,
       CAST(SUM(CASE WHEN l.l_extendedprice IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey
GROUP BY o.o_orderstatus""")
def h9(spark, d):
    orders, li = tables(spark, d, "orders", "lineitem")
    j = orders.join(li, orders.o_orderkey == li.l_orderkey, "left")
    m = C.row_max(F.col("o_totalprice") / 10, F.col("l_extendedprice"))
    return j.groupBy("o_orderstatus").agg(F.round(F.sum(m), 2).alias("sum_max"),
                                         F.sum(m.isNull().cast("long")).alias("n_null"))


@query("h10_date_arithmetic", """
SELECT o_orderkey,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS DATE) AS plus_10d,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 WEEK AS DATE) AS plus_3w,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS plus_2m,
  CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR AS DATE) AS minus_1y,
  o_orderdate + INTERVAL 90 MINUTE AS plus_90min
FROM orders""")
def h10(spark, d):
    (orders,) = tables(spark, d, "orders")
    od = F.to_date("o_orderdate")
    return orders.select("o_orderkey", C.shift(od, 10).alias("plus_10d"), C.shift(od, 3, "weeks").alias("plus_3w"),
                         C.shift(od, 2, "months").alias("plus_2m"), C.shift(od, -1, "years").alias("minus_1y"),
                         C.shift("o_orderdate", 90, "minutes").alias("plus_90min"))


@query("h11_days_minutes_between", """
SELECT e.event_id,
  date_diff('day', CAST(e.ts AS DATE), DATE '2024-01-31') AS days_to_asof,
  CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(e.ts)) / 60000000) AS BIGINT) AS minutes_to_asof
FROM events e""")
def h11(spark, d):
    (ev,) = tables(spark, d, "events")
    asof_ts = C.ts_literal(_dt.datetime(2024, 1, 31))
    return ev.select("event_id", C.days_between(F.lit(EVENTS_AS_OF), F.to_date("ts")).cast("long").alias("days_to_asof"),
                     C.minutes_between(asof_ts, "ts").alias("minutes_to_asof"))


@query("h12_day_of_week_week_start", """
SELECT DISTINCT CAST(ts AS DATE) AS day, dayofweek(ts) + 1 AS dow, dayofmonth(ts) AS dom, dayofyear(ts) AS doy,
       CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS DATE) AS sunday_on_or_before
FROM events""")
def h12(spark, d):
    (ev,) = tables(spark, d, "events")
    day = F.to_date("ts")
    return ev.select(day.alias("day"), F.dayofweek(day).cast("long").alias("dow"), F.dayofmonth(day).cast("long").alias("dom"),
                     F.dayofyear(day).cast("long").alias("doy"), C.week_start(day).alias("sunday_on_or_before")).distinct()


@query("h13_nth_weekday", """
WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS yr FROM orders)
SELECT yr,
  CAST(make_date(yr, 11, 1) + CAST(((5 - (dayofweek(make_date(yr, 11, 1)) + 1) + 7) % 7 + 21) AS INTEGER) AS DATE) AS thanksgiving,
  CAST(make_date(yr, 5, 1) + CAST(((1 - (dayofweek(make_date(yr, 5, 1)) + 1) + 7) % 7 + 7) AS INTEGER) AS DATE) AS mothers_day
FROM y""")
def h13(spark, d):
    (orders,) = tables(spark, d, "orders")
    y = orders.select(F.year("o_orderdate").alias("yr")).distinct()
    return y.select("yr", C.nth_weekday(F.col("yr"), 11, 5, 4).alias("thanksgiving"),
                    C.nth_weekday(F.col("yr"), 5, 1, 2).alias("mothers_day"))


@query("h14_still_open_local_time", """
SELECT n.n_regionkey,
  (strftime(e.ts + to_minutes(CAST((n.n_regionkey - 2) * 60 AS BIGINT)), '%H:%M:%S') <
      CASE WHEN n.n_nationkey % 2 = 0 THEN '18:00:00' ELSE '22:00:00' END
   AND strftime(e.ts + to_minutes(CAST((n.n_regionkey - 2) * 60 AS BIGINT)), '%H:%M:%S') < '21:00:00') AS open_now,
  CAST(COUNT(*) AS BIGINT) AS n
FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY 1, 2""")
def h14(spark, d):
    ev, cust, nation = tables(spark, d, "events", "customer", "nation")
    j = ev.join(cust, ev.user_id == cust.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    close = F.when(F.col("n_nationkey") % 2 == 0, F.lit("18:00:00")).otherwise(F.lit("22:00:00"))
    return j.groupBy("n_regionkey", C.still_open("ts", F.col("n_regionkey") - 2, close).alias("open_now")) \
            .agg(F.count(F.lit(1)).alias("n"))


@query("h15_valid_yyyymmdd", """
SELECT o_orderkey, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) + (o_orderkey % 5) * 7 AS ymd,
       CAST(try_strptime(CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) + (o_orderkey % 5) * 7 AS VARCHAR), '%Y%m%d') AS DATE) AS ymd_date
FROM orders""")
def h15(spark, d):
    (orders,) = tables(spark, d, "orders")
    ymd = (F.year("o_orderdate") * 10000 + F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate")
           + (F.col("o_orderkey") % 5) * 7)
    return orders.select("o_orderkey", ymd.cast("long").alias("ymd"), C.valid_date(ymd).alias("ymd_date"))


@query("h16_elapsed_text", """
SELECT event_id,
  lpad(CAST(CAST(floor(floor(CAST(floor(value * 100) AS BIGINT) * 37 / 100) / 3600) AS BIGINT) AS VARCHAR), 2, '0') || ':' ||
  lpad(CAST(CAST(floor((CAST(floor(CAST(floor(value * 100) AS BIGINT) * 37 / 100) AS BIGINT) % 3600) / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' ||
  lpad(CAST(CAST(floor(CAST(floor(value * 100) AS BIGINT) * 37 / 100) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '.' ||
  lpad(CAST((CAST(floor(value * 100) AS BIGINT) * 37) % 100 AS VARCHAR), 2, '0') AS elapsed
FROM events""")
def h16(spark, d):
    (ev,) = tables(spark, d, "events")
    hs = F.floor(F.col("value") * 100).cast("long")
    return ev.select("event_id", C.elapsed_text(hs * 37).alias("elapsed"))


@query("h17_int_div_mod_cents", """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) // 7 AS qty_div7, CAST(l_quantity AS BIGINT) % 7 AS qty_mod7,
       CAST(round(l_extendedprice * 100, 0) AS BIGINT) AS price_cents
FROM lineitem""")
def h17(spark, d):
    (li,) = tables(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", C.int_div("l_quantity", F.lit(7)).alias("qty_div7"),
                     (F.col("l_quantity").cast("long") % 7).alias("qty_mod7"),
                     C.cents("l_extendedprice").alias("price_cents"))


@query("h18_letter_suffix_code", """
WITH s AS (SELECT c_custkey, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ0?', CAST(c_custkey % 28 AS INTEGER) + 1, 1) AS letter FROM customer)
SELECT c_custkey, letter,
  CASE WHEN letter IN ('0', ' ', '') OR letter IS NULL THEN '00'
       WHEN regexp_matches(letter, '^[A-Z]$') THEN lpad(CAST(ascii(letter) - 64 AS VARCHAR), 2, '0')
       ELSE 'XX' END AS code2
FROM s""")
def h18(spark, d):
    (cust,) = tables(spark, d, "customer")
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ0?"), (F.col("c_custkey") % 28 + 1).cast("int"), F.lit(1))
    return cust.select("c_custkey", letter.alias("letter")).withColumn("code2", C.letter_code("letter"))


# --- product codes ---------------------------------------------------------------

_CODE14_SQL = "lpad(CAST(p_partkey * 1000003 + 40000000000 AS VARCHAR), 14, '0')"


def _code14():
    return F.lpad((F.col("p_partkey") * 1000003 + 40000000000).cast("string"), 14, "0")


_SWAP_SQL = "substr({c},1,1) || substr({c},3,1) || substr({c},2,1) || substr({c},4,10)"
_CHECK_SQL = ("CAST((10 - ((" + " + ".join(
    f"CAST(substr({{c}},{i},1) AS INTEGER) * {3 if i % 2 else 1}" for i in range(1, 14)) + ") % 10)) % 10 AS VARCHAR)")


@query("i2_code_conversion_round_trip", f"""
WITH a AS (SELECT p_partkey, {_CODE14_SQL} AS code14 FROM part),
b AS (SELECT p_partkey, code14, {_SWAP_SQL.format(c='code14')} AS code13 FROM a),
c AS (SELECT p_partkey, code14, code13, {_SWAP_SQL.format(c='code13')} AS g FROM b)
SELECT p_partkey, code14, code13, g || {_CHECK_SQL.format(c='g')} AS back14,
       substr(g, 1, 13) = substr(code14, 1, 13) AS prefix_round_trip
FROM c""")
def i2(spark, d):
    (part,) = tables(spark, d, "part")
    x = part.select("p_partkey", _code14().alias("code14"))
    x = x.withColumn("code13", C.to_short_code("code14")).withColumn("back14", C.to_long_code("code13"))
    return x.withColumn("prefix_round_trip", F.substring("back14", 1, 13) == F.substring("code14", 1, 13))


@query("i3_check_digit_zero_prefixes", f"""
WITH a AS (SELECT p_partkey, substr(lpad(CAST(p_partkey * 7919 + CASE WHEN p_partkey % 10 = 0 THEN 40000000000 WHEN p_partkey % 10 = 1 THEN 41000000000 ELSE 0 END AS VARCHAR), 13, '0'), 1, 13) AS g FROM part)
SELECT p_partkey, g,
  CASE WHEN starts_with(g, '00400') OR starts_with(g, '00410') THEN '0' ELSE {_CHECK_SQL.format(c='g')} END AS check_digit
FROM a""")
def i3(spark, d):
    (part,) = tables(spark, d, "part")
    bump = F.when(F.col("p_partkey") % 10 == 0, F.lit(40000000000)).when(F.col("p_partkey") % 10 == 1, F.lit(41000000000)) \
            .otherwise(F.lit(0))
    g = F.substring(F.lpad((F.col("p_partkey") * 7919 + bump).cast("string"), 13, "0"), 1, 13)
    x = part.select("p_partkey", g.alias("g"))
    return x.withColumn("check_digit", C.check_digit("g", zero_prefixes=("00400", "00410")))


@query("i4_maker_ids_not_registered", f"""
WITH codes AS (SELECT p_partkey, p_size, {_SWAP_SQL.format(c=_CODE14_SQL)} AS code13 FROM part),
ids AS (SELECT p_partkey, p_size, '0' || substr(code13, 2, 7) AS maker_id FROM codes),
registry AS (SELECT DISTINCT maker_id FROM ids WHERE p_size <= 25)
SELECT p_partkey, maker_id FROM ids WHERE maker_id NOT IN (SELECT maker_id FROM registry)""")
def i4(spark, d):
    (part,) = tables(spark, d, "part")
    ids = part.select("p_partkey", "p_size", C.maker_id(C.to_short_code(_code14())).alias("maker_id"))
    registry = ids.where(F.col("p_size") <= 25).select("maker_id").distinct()
    return not_in(ids, "maker_id", registry).select("p_partkey", "maker_id")
