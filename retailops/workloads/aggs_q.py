"""Aggregate, window, sort and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cols import in_year
from ..operators import aggs as A
from .registry import query, tables


@query("d1_count_filtered", """
SELECT CAST(COUNT(*) AS BIGINT) AS n FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'""")
def d1(spark, d):
    (li,) = tables(spark, d, "lineitem")
    return A.count_rows(li.where((F.col("l_quantity") > 25) & (F.col("l_returnflag") == "R")))


@query("d2_count_by_most_frequent", """
SELECT p_brand, CAST(COUNT(*) AS BIGINT) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand""")
def d2(spark, d):
    (part,) = tables(spark, d, "part")
    return A.count_by(part, "p_brand")


@query("d3_sum_min_max_by_group", """
SELECT l_returnflag, l_linestatus, round(SUM(l_quantity), 2) AS sum_qty, round(SUM(l_extendedprice), 2) AS sum_price,
       MIN(l_discount) AS min_disc, MAX(l_discount) AS max_disc, round(AVG(l_quantity), 4) AS avg_qty,
       CAST(COUNT(*) AS BIGINT) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def d3(spark, d):
    (li,) = tables(spark, d, "lineitem")
    return A.agg_by(li, ["l_returnflag", "l_linestatus"], {
        "sum_qty": F.round(F.sum("l_quantity"), 2), "sum_price": F.round(F.sum("l_extendedprice"), 2),
        "min_disc": F.min("l_discount"), "max_disc": F.max("l_discount"),
        "avg_qty": F.round(F.avg("l_quantity"), 4), "n": F.count(F.lit(1))})


@query("d4_duplicate_keys", """
SELECT l_orderkey, l_linenumber, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def d4(spark, d):
    (li,) = tables(spark, d, "lineitem")
    return A.dup_keys(li, ["l_orderkey", "l_linenumber"])


@query("d5_duplicate_rows_detail", """
WITH k AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, CAST(k.n AS BIGINT) AS n
FROM lineitem l JOIN k ON l.l_orderkey = k.l_orderkey AND l.l_linenumber = k.l_linenumber""")
def d5(spark, d):
    (li,) = tables(spark, d, "lineitem")
    x = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return A.dup_rows(x, ["l_orderkey", "l_linenumber"], name="n")


@query("d6_count_distinct", """
SELECT CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1998)""")
def d6(spark, d):
    (orders,) = tables(spark, d, "orders")
    return A.count_distinct(orders.where(in_year("o_orderdate", 1998)), "o_custkey")


@query("d7_scorecard", """
WITH j AS (SELECT l.l_orderkey, o.o_orderstatus, l.l_returnflag, l.l_extendedprice FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
s AS (SELECT
  CAST(COUNT(DISTINCT CASE WHEN o_orderstatus = 'F' THEN l_orderkey END) AS BIGINT) AS status_f,
  CAST(COUNT(DISTINCT CASE WHEN o_orderstatus = 'O' THEN l_orderkey END) AS BIGINT) AS status_o,
  CAST(COUNT(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS BIGINT) AS has_return,
  CAST(COUNT(DISTINCT CASE WHEN l_extendedprice > 90000 THEN l_orderkey END) AS BIGINT) AS big_line
  FROM j)
SELECT *, 'status_f=' || status_f || ' status_o=' || status_o || ' has_return=' || has_return || ' big_line=' || big_line AS summary FROM s""")
def d7(spark, d):
    li, orders = tables(spark, d, "lineitem", "orders")
    j = li.join(orders, li.l_orderkey == orders.o_orderkey)
    return A.scorecard(j, "l_orderkey", {
        "status_f": F.col("o_orderstatus") == "F", "status_o": F.col("o_orderstatus") == "O",
        "has_return": F.col("l_returnflag") == "R", "big_line": F.col("l_extendedprice") > 90000}, text_name="summary")


@query("d8_distinct_then_count", """
SELECT c_mktsegment, CAST(COUNT(*) AS BIGINT) AS n FROM (
  SELECT DISTINCT c.c_mktsegment, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderstatus = 'O') GROUP BY c_mktsegment""")
def d8(spark, d):
    orders, cust = tables(spark, d, "orders", "customer")
    j = orders.where(F.col("o_orderstatus") == "O").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return A.count_by_distinct(j, "c_custkey", "c_mktsegment")


@query("d9_fact_totals_default_zero", """
SELECT p.p_partkey,
  round(coalesce((SELECT SUM(l_quantity) FROM lineitem l WHERE l.l_partkey = p.p_partkey), 0), 2) AS sold_qty,
  round(coalesce((SELECT SUM(l_quantity) FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_returnflag = 'R'), 0), 2) AS returned_qty,
  round(coalesce((SELECT SUM(l_quantity) FROM lineitem l WHERE l.l_partkey = p.p_partkey AND year(l.l_shipdate) = 2001), 0), 2) AS qty_2001
FROM part p""")
def d9(spark, d):
    part, li = tables(spark, d, "part", "lineitem")
    li = li.withColumnRenamed("l_partkey", "p_partkey")
    qty = F.col("l_quantity")
    out = A.fact_totals(part.select("p_partkey"), {
        "sold_qty": (li, ["p_partkey"], qty),
        "returned_qty": (li, ["p_partkey"], F.when(F.col("l_returnflag") == "R", qty)),
        "qty_2001": (li, ["p_partkey"], F.when(in_year("l_shipdate", 2001), qty))}, default=0.0)
    return out.select("p_partkey", *[F.round(c, 2).alias(c) for c in ("sold_qty", "returned_qty", "qty_2001")])


@query("d10_conditional_sums", """
SELECT l_suppkey,
  round(coalesce(SUM(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0), 2) AS qty_a,
  round(coalesce(SUM(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 0), 2) AS qty_n,
  round(coalesce(SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0), 2) AS qty_r
FROM lineitem GROUP BY l_suppkey""")
def d10(spark, d):
    (li,) = tables(spark, d, "lineitem")
    out = A.sum_if(li, "l_suppkey", {f"qty_{f.lower()}": (F.col("l_returnflag") == f, F.col("l_quantity"))
                                     for f in ("A", "N", "R")})
    return out.select("l_suppkey", *[F.round(c, 2).alias(c) for c in ("qty_a", "qty_n", "qty_r")])


@query("d11_share_of_total", """
WITH g AS (SELECT r.r_name, SUM(l.l_extendedprice) AS revenue
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name)
SELECT r_name, round(revenue, 2) AS revenue, round(CASE WHEN t.tot <> 0 THEN revenue * 100.0 / t.tot END, 2) AS pct
FROM g CROSS JOIN (SELECT SUM(revenue) AS tot FROM g) t""")
def d11(spark, d):
    li, supp, nation, region = tables(spark, d, "lineitem", "supplier", "nation", "region")
    j = li.join(supp, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")) \
          .join(region, F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("l_extendedprice", "revenue")
    out = A.share_of_total(j, "r_name", "revenue")
    return out.select("r_name", F.round("revenue", 2).alias("revenue"), "pct")


@query("d13_detail_with_subtotals", """
SELECT n_name, s_suppkey, round(s_acctbal, 2) AS s_acctbal, 'detail' AS row_kind
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT n_name, NULL, round(SUM(s_acctbal), 2), 'subtotal' FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def d13(spark, d):
    supp, nation = tables(spark, d, "supplier", "nation")
    j = supp.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    out = A.with_subtotals(j, "n_name", ["s_suppkey"], ["s_acctbal"])
    return out.withColumn("s_acctbal", F.round("s_acctbal", 2))


@query("d14_extent_check", """
SELECT 'orders' AS table_name, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(MAX(o_orderkey) AS BIGINT) AS max_key FROM orders
UNION ALL SELECT 'lineitem', COUNT(*), MAX(l_orderkey) FROM lineitem
UNION ALL SELECT 'customer', COUNT(*), MAX(c_custkey) FROM customer
UNION ALL SELECT 'part', COUNT(*), MAX(p_partkey) FROM part""")
def d14(spark, d):
    orders, li, cust, part = tables(spark, d, "orders", "lineitem", "customer", "part")
    return A.extent({"orders": orders.select(F.col("o_orderkey").alias("k")),
                     "lineitem": li.select(F.col("l_orderkey").alias("k")),
                     "customer": cust.select(F.col("c_custkey").alias("k")),
                     "part": part.select(F.col("p_partkey").alias("k"))}, "k")


@query("d15_latest_value_per_group", """
SELECT o_custkey, CAST(MAX(o_orderdate) AS DATE) AS last_order FROM orders GROUP BY o_custkey""")
def d15(spark, d):
    (orders,) = tables(spark, d, "orders")
    return A.max_by_key(orders.select("o_custkey", F.to_date("o_orderdate").alias("d")), "o_custkey", "d", "last_order")


@query("e1_top_rank_ties_kept", """
SELECT p_brand, p_partkey, p_retailprice FROM (
  SELECT p_brand, p_partkey, p_retailprice, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS rk FROM part)
WHERE rk = 1""")
def e1(spark, d):
    (part,) = tables(spark, d, "part")
    return A.top_rank(part.select("p_brand", "p_partkey", "p_retailprice"), "p_brand", "p_retailprice")


@query("e2_row_numbers", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority,
       CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders""")
def e2(spark, d):
    (orders,) = tables(spark, d, "orders")
    return A.number_rows(orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice",
                                                                       "o_orderpriority", "rn")


@query("e2b_row_numbers_per_group", """
SELECT n_nationkey, n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS BIGINT) AS rn FROM nation""")
def e2b(spark, d):
    (nation,) = tables(spark, d, "nation")
    out = A.number_rows(nation, ["n_name"], partition_by=["n_regionkey"])
    return out.select("n_nationkey", "n_regionkey", F.col("rn").cast("long").alias("rn"))


@query("e3_group_size_on_row", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(COUNT(*) OVER (PARTITION BY l_orderkey) AS BIGINT) AS n FROM lineitem""")
def e3(spark, d):
    (li,) = tables(spark, d, "lineitem")
    return A.with_count(li.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")


@query("f1_multi_key_mixed_sort", """
SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey""")
def f1(spark, d):
    (cust,) = tables(spark, d, "customer")
    return cust.select("c_mktsegment", "c_acctbal", "c_custkey").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")


@query("f2_first_n_rows", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def f2(spark, d):
    (orders,) = tables(spark, d, "orders")
    return orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("f3_top_k", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10""")
def f3(spark, d):
    (li,) = tables(spark, d, "lineitem")
    return A.top_k(li.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 10,
                   ["l_orderkey", "l_linenumber"])


@query("g1_union_distinct", """
SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier""")
def g1(spark, d):
    cust, supp = tables(spark, d, "customer", "supplier")
    return A.union_distinct(cust.select(F.col("c_nationkey").alias("nationkey")),
                            supp.select(F.col("s_nationkey").alias("nationkey")))


@query("g2_union_all", """
SELECT c_name AS name, c_acctbal AS balance, 'customer' AS kind FROM customer
UNION ALL SELECT s_name, s_acctbal, 'supplier' FROM supplier""")
def g2(spark, d):
    cust, supp = tables(spark, d, "customer", "supplier")
    return A.union_all(cust.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind")),
                       supp.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind")))


@query("g3_set_difference", """
SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 1996
EXCEPT SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 1997""")
def g3(spark, d):
    (li,) = tables(spark, d, "lineitem")
    return A.minus(li.where(in_year("l_shipdate", 1996)).select("l_partkey"),
                   li.where(in_year("l_shipdate", 1997)).select("l_partkey"))


@query("g4_sequence_gaps", """
WITH b AS (SELECT MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders),
s AS (SELECT unnest(range(lo, hi + 1)) AS n FROM b)
SELECT n FROM s WHERE n NOT IN (SELECT l_orderkey FROM lineitem)""")
def g4(spark, d):
    orders, li = tables(spark, d, "orders", "lineitem")
    b = orders.agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")).first()
    seq = A.sequence_rows(spark, int(b["lo"]), int(b["hi"]))
    return seq.join(li.select(F.col("l_orderkey").alias("n")), "n", "left_anti")
