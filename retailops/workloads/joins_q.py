"""Join queries over the driver tables."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..functions.cols import in_year
from ..operators import joins as J
from ..plans.history import calendar
from .registry import query, tables


@query("c1_star_join", """
SELECT r.r_name, o.o_orderstatus, CAST(COUNT(*) AS BIGINT) AS n_lines, round(SUM(l.l_extendedprice), 2) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name, o.o_orderstatus""")
def c1(spark, d):
    li, orders, cust, nation, region = tables(spark, d, "lineitem", "orders", "customer", "nation", "region")
    j = J.star_join(li, [(orders, F.col("l_orderkey") == F.col("o_orderkey")),
                         (cust, F.col("o_custkey") == F.col("c_custkey")),
                         (nation, F.col("c_nationkey") == F.col("n_nationkey")),
                         (region, F.col("n_regionkey") == F.col("r_regionkey"))])
    return j.groupBy("r_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_lines"),
                                                  F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query("c2_left_outer_join", """
SELECT n.n_nationkey, n.n_name, CAST(COUNT(c.c_custkey) AS BIGINT) AS n_customers
FROM nation n LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) c ON n.n_nationkey = c.c_nationkey
GROUP BY n.n_nationkey, n.n_name""")
def c2(spark, d):
    nation, cust = tables(spark, d, "nation", "customer")
    rich = cust.where(F.col("c_acctbal") > 9000)
    j = nation.join(rich, nation.n_nationkey == rich.c_nationkey, "left")
    return j.groupBy("n_nationkey", "n_name").agg(F.count("c_custkey").alias("n_customers"))


@query("c3_right_join_filter_kept_side", """
SELECT n.n_name, c.c_custkey
FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9900) c
RIGHT JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE coalesce(c.c_acctbal, 0) < 9950""")
def c3(spark, d):
    cust, nation = tables(spark, d, "customer", "nation")
    c = cust.where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9900))
    j = c.join(nation, c.c_nationkey == nation.n_nationkey, "right")
    return j.where(F.coalesce(F.col("c_acctbal"), F.lit(0)) < 9950).select("n_name", "c_custkey")


@query("c4_coalesced_key_outer_join", """
WITH r AS (SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier UNION ALL SELECT NULL, avg(s_acctbal) FROM supplier),
l AS (SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_suppkey END AS k FROM lineitem)
SELECT l.k IS NULL AS uses_default, CAST(COUNT(*) AS BIGINT) AS n_lines, round(SUM(r.bal), 2) AS total_bal
FROM l LEFT JOIN r ON coalesce(l.k, -1) = coalesce(r.k, -1) GROUP BY 1""")
def c4(spark, d):
    """Line -> supplier settings, where a line without a supplier key and the
    settings row without a key (the default row) both default to -1 and match."""
    li, supp = tables(spark, d, "lineitem", "supplier")
    settings = supp.select(F.col("s_suppkey").alias("rk"), F.col("s_acctbal").alias("bal")).unionByName(
        supp.agg(F.lit(None).cast("long").alias("rk"), F.avg("s_acctbal").alias("bal")))
    lines = li.select(F.when(F.col("l_returnflag") == "N", None).otherwise(F.col("l_suppkey")).alias("lk"))
    j = J.coalesced_key_join(lines, settings, [("lk", "rk", -1)], "left")
    return j.groupBy(F.col("lk").isNull().alias("uses_default")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("bal"), 2).alias("total_bal"))


@query("c5_one_row_parameter_table", """
WITH p AS (SELECT avg(l_extendedprice) AS avg_price FROM lineitem)
SELECT l.l_returnflag, CAST(COUNT(*) AS BIGINT) AS n_above_avg
FROM lineitem l CROSS JOIN p WHERE l.l_extendedprice > p.avg_price GROUP BY l.l_returnflag""")
def c5(spark, d):
    (li,) = tables(spark, d, "lineitem")
    params = li.agg(F.avg("l_extendedprice").alias("avg_price"))
    j = J.cross_param(li, params)
    return j.where(F.col("l_extendedprice") > F.col("avg_price")).groupBy("l_returnflag") \
            .agg(F.count(F.lit(1)).alias("n_above_avg"))


@query("c6_self_join_two_roles", """
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey AS part_a, b.l_partkey AS part_b
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""")
def c6(spark, d):
    """Each line with the next line of the same order (one table, two roles)."""
    (li,) = tables(spark, d, "lineitem")
    j = J.self_join(li.select("l_orderkey", "l_linenumber", "l_partkey"), [("l_orderkey", "l_orderkey")],
                    extra=F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1)
    return j.select(F.col("a.l_orderkey").alias("l_orderkey"), F.col("a.l_linenumber").alias("l_linenumber"),
                    F.col("a.l_partkey").alias("part_a"), F.col("b.l_partkey").alias("part_b"))


@query("c6b_dimension_in_two_roles", """
SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, CAST(COUNT(*) AS BIGINT) AS n_lines
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation cn ON c.c_nationkey = cn.n_nationkey JOIN nation sn ON s.s_nationkey = sn.n_nationkey
GROUP BY 1, 2""")
def c6b(spark, d):
    """The nation table in two roles: the customer's nation and the supplier's nation of each line."""
    li, orders, cust, supp, nation = tables(spark, d, "lineitem", "orders", "customer", "supplier", "nation")
    cn = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation"))
    sn = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"))
    j = J.star_join(li.select("l_orderkey", "l_suppkey"), [
        (orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")),
        (cust.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")),
        (supp.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")),
        (cn, "c_nationkey"), (sn, "s_nationkey")])
    return j.groupBy("customer_nation", "supplier_nation").agg(F.count(F.lit(1)).alias("n_lines"))


@query("c7_semi_join_exists", """
SELECT c_custkey, c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' AND o.o_totalprice > 450000)""")
def c7(spark, d):
    cust, orders = tables(spark, d, "customer", "orders")
    p = orders.where((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 450000))
    return J.has(cust, p, cust.c_custkey == p.o_custkey).select("c_custkey", "c_name")


@query("c8_anti_join_not_exists", """
SELECT c_custkey, c_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""")
def c8(spark, d):
    cust, orders = tables(spark, d, "customer", "orders")
    f = orders.where(F.col("o_orderstatus") == "F")
    return J.lacks(cust, f, cust.c_custkey == f.o_custkey).select("c_custkey", "c_name")


@query("c9_null_aware_not_in", """
SELECT s_suppkey, s_name FROM supplier
WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R')""")
def c9(spark, d):
    supp, li = tables(spark, d, "supplier", "lineitem")
    sub = li.where((F.col("l_quantity") >= 50) & (F.col("l_returnflag") == "R"))
    return J.not_in(supp, "s_suppkey", sub, "l_suppkey").select("s_suppkey", "s_name")


@query("c9b_not_in_with_null", """
SELECT s_suppkey FROM supplier
WHERE s_suppkey NOT IN (SELECT CASE WHEN l_quantity = 50 THEN NULL ELSE l_suppkey END FROM lineitem WHERE l_returnflag = 'R')""")
def c9b(spark, d):
    supp, li = tables(spark, d, "supplier", "lineitem")
    sub = li.where(F.col("l_returnflag") == "R").select(
        F.when(F.col("l_quantity") == 50, None).otherwise(F.col("l_suppkey")).alias("k"))
    return J.not_in(supp, "s_suppkey", sub, "k").select("s_suppkey")


@query("c10_left_join_is_null", """
SELECT p.p_partkey, p.p_name FROM part p
LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.09) l ON p.p_partkey = l.l_partkey
WHERE l.l_partkey IS NULL""")
def c10(spark, d):
    part, li = tables(spark, d, "part", "lineitem")
    big = li.where((F.col("l_quantity") >= 49) & (F.col("l_discount") >= 0.09))
    return J.lacks(part, big, part.p_partkey == big.l_partkey).select("p_partkey", "p_name")


@query("c11_anti_inside_semi", """
SELECT c_custkey, c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
              AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey))""")
def c11(spark, d):
    cust, orders, li = tables(spark, d, "customer", "orders", "lineitem")
    lineless = J.lacks(orders, li.select("l_orderkey"), orders.o_orderkey == li.l_orderkey)
    return J.has(cust, lineless, cust.c_custkey == lineless.o_custkey).select("c_custkey", "c_name")


@query("c12_equi_plus_inequality", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, CAST(l.l_shipdate AS DATE) AS ship_date, CAST(o.o_orderdate AS DATE) AS order_date
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_shipdate < o.o_orderdate""")
def c12(spark, d):
    li, orders = tables(spark, d, "lineitem", "orders")
    j = li.join(orders, (li.l_orderkey == orders.o_orderkey) & (li.l_shipdate < orders.o_orderdate))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("ship_date"),
                    F.to_date("o_orderdate").alias("order_date"))


def _monthly_price_intervals(li):
    """Effective-dated price rows per part: one per month with sales, [month start, next month)."""
    m = F.trunc(F.col("l_shipdate"), "month")
    return (li.groupBy(F.col("l_partkey").alias("p_key"), m.alias("valid_from"))
              .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))
              .withColumn("valid_to", F.add_months("valid_from", 1)))


@query("c13_asof_interval_join", """
WITH iv AS (
  SELECT l_partkey AS p_key, CAST(date_trunc('month', l_shipdate) AS DATE) AS valid_from,
         avg(l_extendedprice / l_quantity) AS unit_price
  FROM lineitem GROUP BY 1, 2)
SELECT l.l_returnflag, CAST(COUNT(*) AS BIGINT) AS n_priced, round(SUM(iv.unit_price * l.l_quantity), 2) AS priced_value
FROM lineitem l JOIN iv ON l.l_partkey = iv.p_key
  AND CAST(l.l_shipdate AS DATE) >= iv.valid_from AND CAST(l.l_shipdate AS DATE) < CAST(iv.valid_from + INTERVAL 1 MONTH AS DATE)
GROUP BY l.l_returnflag""")
def c13(spark, d):
    (li,) = tables(spark, d, "lineitem")
    iv = _monthly_price_intervals(li)
    lines = li.select("l_partkey", "l_returnflag", "l_quantity", F.to_date("l_shipdate").alias("ship_date"))
    j = J.asof_join(lines.withColumnRenamed("l_partkey", "p_key"), iv, ["p_key"], "ship_date", "valid_from", "valid_to",
                    span=("1995-01-01", "2002-12-31"))
    return j.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_priced"),
                                        F.round(F.sum(F.col("unit_price") * F.col("l_quantity")), 2).alias("priced_value"))


CENTURY = (_dt.date(1970, 1, 1), _dt.date(2069, 12, 31))  # the calendar is reference data, not derived from the fact


@query("c14_date_to_fiscal_period", """
WITH d AS (SELECT CAST(l_shipdate AS DATE) AS dt FROM lineitem)
SELECT CAST(year(dt + INTERVAL 11 MONTH) AS INTEGER) AS fiscal_year,
       CAST(month(dt - INTERVAL 1 MONTH) AS INTEGER) AS fiscal_period,
       CAST(COUNT(*) AS BIGINT) AS n_lines
FROM d GROUP BY 1, 2""")
def c14(spark, d):
    (li,) = tables(spark, d, "lineitem")
    cal = calendar(spark, *CENTURY, fy_start_month=2)
    j = J.fiscal(li, "l_shipdate", cal)
    return j.groupBy("fiscal_year", "fiscal_period").agg(F.count(F.lit(1)).alias("n_lines"))


@query("c14b_fiscal_week", """
WITH d AS (SELECT CAST(l_shipdate AS DATE) AS dt FROM lineitem),
f AS (SELECT dt, make_date(CAST(year(dt - INTERVAL 1 MONTH) AS INTEGER), 2, 1) AS first FROM d)
SELECT CAST(year(dt + INTERVAL 11 MONTH) AS INTEGER) AS fiscal_year,
       CAST(floor((date_diff('day', first, dt) + dayofweek(first)) / 7.0) + 1 AS INTEGER) AS fiscal_week,
       CAST(COUNT(*) AS BIGINT) AS n_lines
FROM f GROUP BY 1, 2""")
def c14b(spark, d):
    (li,) = tables(spark, d, "lineitem")
    j = J.fiscal(li, "l_shipdate", calendar(spark, *CENTURY, fy_start_month=2))
    return j.groupBy("fiscal_year", "fiscal_week").agg(F.count(F.lit(1)).alias("n_lines"))


@query("c15_computed_key_join", """
SELECT c.c_mktsegment, CAST(COUNT(*) AS BIGINT) AS n_orders
FROM orders o JOIN customer c ON o.o_custkey = CAST(substr(c.c_name, 10) AS BIGINT)
GROUP BY c.c_mktsegment""")
def c15(spark, d):
    orders, cust = tables(spark, d, "orders", "customer")
    j = J.join_on_expr(orders, cust, F.col("o_custkey"), F.expr("substr(c_name, 10)").cast("long"))
    return j.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"))


@query("c16_case_chosen_key_join", """
SELECT n.n_name, CAST(COUNT(*) AS BIGINT) AS n_lines
FROM lineitem l JOIN nation n
  ON n.n_nationkey = CASE WHEN l.l_returnflag = 'R' THEN l.l_suppkey % 25 ELSE l.l_partkey % 25 END
GROUP BY n.n_name""")
def c16(spark, d):
    li, nation = tables(spark, d, "lineitem", "nation")
    rule = F.when(F.col("l_returnflag") == "R", F.col("l_suppkey") % 25).otherwise(F.col("l_partkey") % 25)
    j = J.case_key_join(li, nation, rule.cast("int"), "n_nationkey")
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_lines"))


@query("c17_either_key_join", """
SELECT n.n_name, CAST(COUNT(*) AS BIGINT) AS n_lines
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON n.n_nationkey = c.c_nationkey OR n.n_nationkey = s.s_nationkey
GROUP BY n.n_name""")
def c17(spark, d):
    li, orders, cust, supp, nation = tables(spark, d, "lineitem", "orders", "customer", "supplier", "nation")
    base = J.star_join(li.select("l_orderkey", "l_suppkey"), [
        (orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")),
        (cust.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")),
        (supp.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))])
    j = J.either_key_join(base, nation, ["c_nationkey", "s_nationkey"], "n_nationkey")
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_lines"))


@query("c18_lookup_with_default", """
SELECT coalesce((SELECT c.c_mktsegment FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0), 'NONE') AS segment,
       CAST(COUNT(*) AS BIGINT) AS n_orders
FROM orders o GROUP BY 1""")
def c18(spark, d):
    orders, cust = tables(spark, d, "orders", "customer")
    dim = cust.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment"))
    j = J.lookup(orders, dim, "o_custkey", "c_mktsegment", default="NONE", alias="segment")
    return j.groupBy("segment").agg(F.count(F.lit(1)).alias("n_orders"))


@query("c19_existence_flag", """
SELECT o.o_orderkey,
       CASE WHEN r.l_orderkey IS NOT NULL THEN 'YES' ELSE 'NO' END AS has_returns
FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') r ON o.o_orderkey = r.l_orderkey""")
def c19(spark, d):
    orders, li = tables(spark, d, "orders", "lineitem")
    r = li.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.flag(orders.select("o_orderkey"), r, "o_orderkey", "has_returns", "YES", "NO")


@query("c20_lookup_latest", """
WITH latest AS (
  SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS latest_price FROM orders GROUP BY o_custkey)
SELECT c.c_custkey, coalesce(l.latest_price, 0) AS latest_price
FROM customer c LEFT JOIN latest l ON c.c_custkey = l.o_custkey""")
def c20(spark, d):
    cust, orders = tables(spark, d, "customer", "orders")
    hist = orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_totalprice")
    j = J.lookup_latest(cust.select("c_custkey"), hist, "c_custkey", "o_orderdate", "o_totalprice", default=0.0,
                        alias="latest_price")
    return j


@query("c21_lookup_first", """
WITH firsts AS (
  SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, coalesce(f.first_part, -1) AS first_part
FROM orders o LEFT JOIN firsts f ON o.o_orderkey = f.l_orderkey""")
def c21(spark, d):
    orders, li = tables(spark, d, "orders", "lineitem")
    hist = li.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return J.lookup_first(orders.select("o_orderkey"), hist, "o_orderkey", ["l_linenumber"], "l_partkey",
                          default=-1, alias="first_part")


@query("c22_keys_in_both", """
SELECT l_partkey, l_suppkey FROM lineitem WHERE year(l_shipdate) = 1996
INTERSECT
SELECT l_partkey, l_suppkey FROM lineitem WHERE year(l_shipdate) = 1997""")
def c22(spark, d):
    (li,) = tables(spark, d, "lineitem")
    a = li.where(in_year("l_shipdate", 1996))
    b = li.where(in_year("l_shipdate", 1997))
    return J.in_both(a, b, ["l_partkey", "l_suppkey"])
