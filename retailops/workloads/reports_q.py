"""Report and feed queries."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..functions.cols import in_year, newer_than
from ..operators import joins as J
from ..plans import reports as R
from ..sources.tables import format_fixed
from .joins_q import _monthly_price_intervals
from .registry import AS_OF, EVENTS_AS_OF, query, tables

SENTINEL = _dt.date(9999, 12, 31)


@query("i10_set_explosion_with_cost", """
WITH items AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'),
comp AS (SELECT l.l_orderkey, l.l_partkey, l.l_quantity, p.p_retailprice FROM lineitem l JOIN items i ON l.l_orderkey = i.o_orderkey
         LEFT JOIN part p ON l.l_partkey = p.p_partkey),
sc AS (SELECT l_orderkey, SUM(l_quantity * p_retailprice) AS sc FROM comp GROUP BY 1)
SELECT DISTINCT * FROM (
  SELECT CAST(i.o_orderkey AS BIGINT) AS sku, CASE WHEN sc.sc IS NOT NULL THEN 'SET' ELSE 'ITEM' END AS sku_type,
         CAST(NULL AS BIGINT) AS parent_sku, 1.0 AS qty, round(sc.sc, 2) AS unit_cost
  FROM items i LEFT JOIN sc ON i.o_orderkey = sc.l_orderkey
  UNION ALL SELECT l_partkey, 'COMP', l_orderkey, l_quantity, round(p_retailprice, 2) FROM comp)""")
def i10(spark, d):
    orders, li, part = tables(spark, d, "orders", "lineitem", "part")
    items = orders.where(F.col("o_orderstatus") == "F").select("o_orderkey")
    out = R.explode_sets(items, li, part, "o_orderkey", "l_orderkey", "l_partkey", "l_quantity", "p_partkey", "p_retailprice")
    return out.withColumn("unit_cost", F.round("unit_cost", 2)).distinct()


@query("i11_outbound_fixed_width_feed", """
SELECT l.l_orderkey, l.l_linenumber,
  lpad(CAST(l.l_partkey AS VARCHAR), 8, '0') || lpad(CAST(l.l_suppkey AS VARCHAR), 5, '0') || rpad(coalesce(n.n_name, 'UNKNOWN'), 10, ' ')
  || lpad(CAST(CAST(l.l_quantity AS BIGINT) AS VARCHAR), 5, '0') || lpad(CAST(CAST(round(l.l_extendedprice * 100, 0) AS BIGINT) AS VARCHAR), 11, '0')
  || strftime(l.l_shipdate, '%Y%m%d') AS record
FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey""")
def i11(spark, d):
    li, supp, nation = tables(spark, d, "lineitem", "supplier", "nation")
    x = J.lookup(li, supp.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey", "s_nationkey")
    x = J.lookup(x, nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey", "n_name", default="UNKNOWN")
    layout = [("l_partkey", 8, "num"), ("l_suppkey", 5, "num"), ("n_name", 10, "text"), ("l_quantity", 5, "num"),
              (F.round(F.col("l_extendedprice") * 100, 0), 11, "num")]
    return x.select("l_orderkey", "l_linenumber",
                    F.concat(format_fixed(layout), F.date_format("l_shipdate", "yyyyMMdd")).alias("record"))


@query("i11b_feed_overflow_rejects", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE length(CAST(CAST(round(l_extendedprice * 100, 0) AS BIGINT) AS VARCHAR)) > 6""")
def i11b(spark, d):
    """Rows whose price has more digits than a six-digit field."""
    (li,) = tables(spark, d, "lineitem")
    layout = [("l_orderkey", 18, "num"), (F.round(F.col("l_extendedprice") * 100, 0), 6, "num")]
    return R.feed_rejects(li, layout).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("i13_item_place_detail", """
WITH j AS (SELECT l.*, s.s_nationkey FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey)
SELECT l_partkey, s_nationkey,
  round(coalesce(SUM(CASE WHEN l_shipdate >= DATE '2001-08-01' - INTERVAL 365 DAY AND l_shipdate < DATE '2001-08-01' THEN l_quantity END), 0), 2) AS sales_365d,
  round(coalesce(SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0), 2) AS on_order,
  CASE WHEN MAX(CASE WHEN l_shipdate < DATE '2001-08-01' THEN 1 END) = 1 THEN 'Y' ELSE 'N' END AS ever_sold,
  CASE WHEN MAX(CASE WHEN l_returnflag = 'R' THEN 1 END) = 1 THEN 'Y' ELSE 'N' END AS ever_returned
FROM j GROUP BY l_partkey, s_nationkey""")
def i13(spark, d):
    li, supp = tables(spark, d, "lineitem", "supplier")
    j = li.join(supp.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    before = F.col("l_shipdate") < F.lit(AS_OF)
    out = R.item_store_detail(None, j, ["l_partkey", "s_nationkey"],
                              {"sales_365d": (newer_than("l_shipdate", AS_OF, 365) & before, F.col("l_quantity")),
                               "on_order": (F.col("l_linestatus") == "O", F.col("l_quantity"))},
                              {"ever_sold": before, "ever_returned": F.col("l_returnflag") == "R"})
    return out.withColumn("sales_365d", F.round("sales_365d", 2)).withColumn("on_order", F.round("on_order", 2))


@query("i14_in_stock_pct", """
WITH j AS (SELECT l.*, o.o_orderpriority AS method, s.s_suppkey, s.s_nationkey, c.c_nationkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey),
raw AS (SELECT s_suppkey, method, c_nationkey, CAST(COUNT(*) AS BIGINT) AS n_total,
    CAST(SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_in_stock,
    MIN(CASE WHEN NOT (l_linestatus = 'F') THEN l_partkey END) AS min_out_item,
    CAST(SUM(CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END) AS BIGINT) AS n_out_of_stock,
    round(SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 2) AS pct_in_stock
  FROM j GROUP BY 1, 2, 3),
items AS (SELECT s_suppkey, CAST(COUNT(DISTINCT l_partkey) AS BIGINT) AS n_items FROM j GROUP BY 1),
adj AS (SELECT s_suppkey, method, c_nationkey, SUM(l_quantity) AS q FROM j
  WHERE l_returnflag = 'R' AND l_shipdate >= DATE '2001-08-01' - INTERVAL 730 DAY GROUP BY 1, 2, 3)
SELECT raw.*, items.n_items, round(coalesce(adj.q, 0), 2) AS adj_qty,
  CAST(3 + s.s_nationkey % 5 + s.s_suppkey % 7 AS BIGINT) AS lead_days
FROM raw JOIN items ON raw.s_suppkey = items.s_suppkey JOIN supplier s ON raw.s_suppkey = s.s_suppkey
LEFT JOIN adj ON raw.s_suppkey = adj.s_suppkey AND raw.method = adj.method AND raw.c_nationkey = adj.c_nationkey
ORDER BY raw.s_suppkey, pct_in_stock, n_out_of_stock DESC, raw.c_nationkey, raw.method""")
def i14(spark, d):
    """Source x method x place: suppliers as sources, order priority as replenishment method, the customer's
    nation as place; returns of the last two years stand for adjustments, and days derived from the
    supplier for its order processing and transit."""
    li, orders, cust, supp = tables(spark, d, "lineitem", "orders", "customer", "supplier")
    j = J.star_join(li, [(orders, F.col("l_orderkey") == F.col("o_orderkey")),
                         (cust, F.col("o_custkey") == F.col("c_custkey")),
                         (supp, F.col("l_suppkey") == F.col("s_suppkey"))]) \
         .withColumnRenamed("o_orderpriority", "method")
    adj = (F.col("l_returnflag") == "R") & newer_than("l_shipdate", AS_OF, 730)
    lead = supp.select("s_suppkey", (F.lit(3) + F.col("s_nationkey") % 5).cast("long").alias("process_days"),
                       (F.col("s_suppkey") % 7).cast("long").alias("transit_days"))
    out = R.in_stock(j, ["s_suppkey", "method", "c_nationkey"], F.col("l_linestatus") == "F", item_col="l_partkey",
                     items_per=["s_suppkey"], adjustments=(adj, "l_quantity"),
                     lead=(lead, ["s_suppkey"], ["process_days", "transit_days"]),
                     order=["s_suppkey", "pct_in_stock", F.desc("n_out_of_stock"), "c_nationkey", "method"])
    return out.withColumn("adj_qty", F.round("adj_qty", 2))


_IV_SQL = """iv AS (SELECT l_partkey AS p_key, CAST(date_trunc('month', l_shipdate) AS DATE) AS valid_from,
   avg(l_extendedprice / l_quantity) AS unit_price FROM lineitem GROUP BY 1, 2)"""


@query("i15_current_and_future_price_list", f"""
WITH {_IV_SQL}
SELECT DISTINCT p_key, CASE WHEN valid_from <= DATE '2001-08-01' AND CAST(valid_from + INTERVAL 1 MONTH AS DATE) > DATE '2001-08-01' THEN 'C' ELSE 'F' END AS price_code,
       valid_from AS eff_from, lpad(CAST(CAST(round(unit_price * 100, 0) AS BIGINT) AS VARCHAR), 9, '0') AS price_digits
FROM iv WHERE CAST(valid_from + INTERVAL 1 MONTH AS DATE) > DATE '2001-08-01'""")
def i15(spark, d):
    (li,) = tables(spark, d, "lineitem")
    iv = _monthly_price_intervals(li)
    return R.price_list(iv, ["p_key"], "valid_from", "valid_to", "unit_price", AS_OF)


@query("i16_price_timeline", f"""
WITH {_IV_SQL},
last AS (SELECT p_key, MAX(valid_from) AS last_from FROM iv GROUP BY p_key),
t AS (SELECT iv.p_key, iv.valid_from,
        CASE WHEN iv.valid_from = last.last_from THEN DATE '9999-12-31' ELSE CAST(iv.valid_from + INTERVAL 1 MONTH AS DATE) END AS valid_to
      FROM iv JOIN last ON iv.p_key = last.p_key)
SELECT p_key, valid_from, valid_to, CAST(COUNT(*) OVER (PARTITION BY p_key) AS BIGINT) AS n_intervals,
       CAST(valid_from - 1 AS DATE) AS day_before,
       CASE WHEN valid_to >= DATE '9999-12-31' THEN valid_to ELSE CAST(valid_to + 1 AS DATE) END AS day_after
FROM t""")
def i16(spark, d):
    (li,) = tables(spark, d, "lineitem")
    iv = _monthly_price_intervals(li).select("p_key", "valid_from", "valid_to")
    last = iv.groupBy("p_key").agg(F.max("valid_from").alias("_last"))
    iv = iv.join(last, "p_key").withColumn(
        "valid_to", F.when(F.col("valid_from") == F.col("_last"), F.lit(SENTINEL)).otherwise(F.col("valid_to"))).drop("_last")
    return R.price_timeline(iv, ["p_key"], "valid_from", "valid_to")


@query("i17_missing_changes_vs_model", """
WITH ch AS (SELECT DISTINCT s.s_nationkey AS nation, l.l_partkey AS p_key, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS month
            FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey),
model AS (SELECT n_regionkey, MIN(n_nationkey) AS model_nation FROM nation GROUP BY n_regionkey),
targets AS (SELECT n.n_nationkey AS target_nation, m.model_nation FROM nation n JOIN model m ON n.n_regionkey = m.n_regionkey
            WHERE n.n_nationkey <> m.model_nation),
mc AS (SELECT t.target_nation, ch.p_key, ch.month FROM ch JOIN targets t ON ch.nation = t.model_nation)
SELECT mc.target_nation, mc.p_key, mc.month FROM mc JOIN part p ON mc.p_key = p.p_partkey
WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.nation = mc.target_nation AND ch.p_key = mc.p_key AND ch.month = mc.month)
  AND (p.p_type <> 'PROMO' OR p.p_brand = 'Brand#1')""")
def i17(spark, d):
    li, supp, nation, part = tables(spark, d, "lineitem", "supplier", "nation", "part")
    ch = (li.join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.col("s_nationkey").alias("nation"), F.col("l_partkey").alias("p_key"),
                    F.trunc("l_shipdate", "month").alias("month")).distinct())
    model = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("model_nation"))
    targets = (nation.join(model, "n_regionkey").where(F.col("n_nationkey") != F.col("model_nation"))
                     .select(F.col("n_nationkey").alias("target_nation"), "model_nation"))
    mc = ch.join(targets, F.col("nation") == F.col("model_nation")).select("target_nation", "p_key", "month")
    tc = ch.select(F.col("nation").alias("target_nation"), "p_key", "month")
    mc = mc.join(part.select(F.col("p_partkey").alias("p_key"), "p_type", "p_brand"), "p_key")
    miss = R.missing_changes(mc, tc, ["target_nation", "p_key", "month"],
                             exclude=F.col("p_type") == "PROMO", include=F.col("p_brand") == "Brand#1")
    return miss.select("target_nation", "p_key", "month")


@query("i18_cost_list", """
WITH m AS (SELECT l_partkey, l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_extendedprice / l_quantity) AS cost
           FROM lineitem GROUP BY 1, 2, 3),
cur AS (SELECT * FROM m WHERE month = DATE '2001-07-01'),
pnd AS (SELECT * FROM m WHERE month >= DATE '2001-08-01'),
hist AS (SELECT l_partkey, l_suppkey, arg_max(cost, (month, cost)) AS avg_cost FROM m WHERE month < DATE '2001-07-01' GROUP BY 1, 2)
SELECT c.l_partkey, c.l_suppkey, c.month, round(c.cost, 8) AS cost, round(coalesce(h.avg_cost, 0), 8) AS avg_cost, 'CURRENT' AS cost_kind
FROM cur c LEFT JOIN hist h ON c.l_partkey = h.l_partkey AND c.l_suppkey = h.l_suppkey
UNION ALL SELECT l_partkey, l_suppkey, month, round(cost, 8), 0.0, 'PENDING' FROM pnd""")
def i18(spark, d):
    (li,) = tables(spark, d, "lineitem")
    m = li.groupBy("l_partkey", "l_suppkey", F.trunc("l_shipdate", "month").alias("month")) \
          .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("cost"))
    cur = m.where(F.col("month") == F.lit(_dt.date(2001, 7, 1)))
    pnd = m.where(F.col("month") >= F.lit(AS_OF))
    hist = m.where(F.col("month") < F.lit(_dt.date(2001, 7, 1))).withColumnRenamed("cost", "hist_cost")
    out = R.cost_list(cur, pnd, hist, ["l_partkey", "l_suppkey"], "month", "hist_cost")
    # unit costs are averages of price / quantity: rounded to 8 places, where such
    # small-denominator fractions do not tie (cents would tie on halves)
    return out.select("l_partkey", "l_suppkey", "month", F.round("cost", 8).alias("cost"),
                      F.round("avg_cost", 8).alias("avg_cost"), "cost_kind")


@query("i19_version_in_force", """
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS version_date FROM (
  SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS rk FROM orders
  WHERE o_orderdate <= DATE '2000-08-01' AND o_orderstatus IN ('F', 'O')) WHERE rk = 1""")
def i19(spark, d):
    (orders,) = tables(spark, d, "orders")
    x = orders.select("o_custkey", "o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("version_date"))
    v = R.version_in_force(x, ["o_custkey"], "version_date", _dt.date(2000, 8, 1), "o_orderstatus", ["F", "O"])
    return v.select("o_custkey", "o_orderkey", "version_date")


@query("i20_shelf_totals_plans_in_force", """
WITH v AS (SELECT o_orderkey FROM (
  SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS rk FROM orders
  WHERE o_orderdate <= DATE '2000-08-01' AND o_orderstatus IN ('F', 'O')) WHERE rk = 1),
pos AS (SELECT l.l_partkey, CAST(l.l_quantity AS BIGINT) AS f, p.p_size % 5 + 1 AS cpf FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
        WHERE l.l_orderkey IN (SELECT o_orderkey FROM v))
SELECT l_partkey, CAST(SUM(f) AS BIGINT) AS facings, CAST(SUM(f * cpf) AS BIGINT) AS capacity,
       CAST(ceil(SUM(f * cpf) * 0.5) AS BIGINT) AS min_fill FROM pos GROUP BY l_partkey""")
def i20(spark, d):
    orders, li, part = tables(spark, d, "orders", "lineitem", "part")
    v = R.version_in_force(orders, ["o_custkey"], "o_orderdate", _dt.date(2000, 8, 1), "o_orderstatus", ["F", "O"])
    pos = li.join(v.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi") \
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
    return R.shelf_totals(pos, ["l_partkey"], F.col("l_quantity").cast("long"), F.col("p_size") % 5 + 1)


@query("i41_release_feed", """
WITH rel AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '2001-01-01'),
x AS (SELECT l.l_orderkey, l.l_partkey, CASE WHEN p.p_type = 'PROMO' THEN l.l_quantity * 6 ELSE l.l_quantity END AS qty,
             CASE WHEN p.p_type = 'PROMO' THEN 'PACK' ELSE 'DETAIL' END AS source
      FROM lineitem l JOIN rel ON l.l_orderkey = rel.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
u AS (SELECT DISTINCT * FROM x),
n AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, qty, source) AS rn FROM u)
SELECT l_orderkey, l_partkey, qty, source, TIMESTAMP '2001-08-01 00:00:00' + to_seconds(rn) AS release_ts,
  lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || lpad(CAST(l_partkey AS VARCHAR), 8, '0') || lpad(CAST(CAST(qty AS BIGINT) AS VARCHAR), 6, '0')
  || rpad(source, 6, ' ') || strftime(TIMESTAMP '2001-08-01 00:00:00' + to_seconds(rn), '%Y%m%d%H%M%S') AS record
FROM n""")
def i41(spark, d):
    orders, li, part = tables(spark, d, "orders", "lineitem", "part")
    rel = orders.where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit(_dt.date(2001, 1, 1))))
    rel, _ = R.fix_batch(rel, "o_orderkey")  # the highest queued release fixes this batch
    lines = li.join(rel.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi") \
              .join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    promo = F.col("p_type") == "PROMO"
    packs = lines.where(promo).select("l_orderkey", "l_partkey", (F.col("l_quantity") * 6).alias("qty"), F.lit("PACK").alias("source"))
    details = lines.where(~promo).select("l_orderkey", "l_partkey", F.col("l_quantity").alias("qty"), F.lit("DETAIL").alias("source"))
    layout = [("l_orderkey", 8, "num"), ("l_partkey", 8, "num"), ("qty", 6, "num"), ("source", 6, "text")]
    return R.release_feed(packs, details, ["l_orderkey", "l_partkey", "qty", "source"], _dt.datetime(2001, 8, 1), layout)


@query("i42_released_allocation_report", """
WITH rel AS (SELECT s.s_nationkey, SUM(l.l_quantity) AS qty FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
             JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE o.o_orderstatus = 'F' AND year(l.l_shipdate) = 2001 GROUP BY 1),
d AS (SELECT r.r_name, n.n_name, coalesce(rel.qty, 0) AS qty FROM rel RIGHT JOIN nation n ON rel.s_nationkey = n.n_nationkey
      JOIN region r ON n.n_regionkey = r.r_regionkey WHERE coalesce(rel.qty, 0) < 1800)
SELECT r_name, n_name, round(qty, 2) AS qty, 'detail' AS row_kind FROM d
UNION ALL SELECT r_name, NULL, round(SUM(qty), 2), 'subtotal' FROM d GROUP BY r_name""")
def i42(spark, d):
    li, orders, supp, nation, region = tables(spark, d, "lineitem", "orders", "supplier", "nation", "region")
    rel = (li.join(orders.where(F.col("o_orderstatus") == "F"), F.col("l_orderkey") == F.col("o_orderkey"))
             .where(in_year("l_shipdate", 2001)).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
             .groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum("l_quantity").alias("qty")))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    out = R.release_report(rel, places, "n_nationkey", "r_name", ["n_name"], "qty", keep=F.col("qty") < 1800)
    return out.withColumn("qty", F.round("qty", 2))


@query("i43_sectioned_status_report", """
WITH s1 AS (SELECT 'ORDER ' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS text FROM orders o
            WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)),
s2 AS (SELECT 'SUPPLIER ' || s_name AS text FROM supplier WHERE s_acctbal < 0),
s3 AS (SELECT 'PART ' || p_name AS text FROM part WHERE p_retailprice > 2000),
s4 AS (SELECT 'CUSTOMER ' || c_name AS text FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey))
SELECT 1 AS section_no, CAST(0 AS BIGINT) AS line_no, '== ORDERS WITHOUT LINES (' || CAST((SELECT COUNT(*) FROM s1) AS VARCHAR) || ') ==' AS text WHERE (SELECT COUNT(*) FROM s1) > 0
UNION ALL SELECT 1, row_number() OVER (ORDER BY text), text FROM s1
UNION ALL SELECT 2, 0, '== SUPPLIERS IN DEBT (' || CAST((SELECT COUNT(*) FROM s2) AS VARCHAR) || ') ==' WHERE (SELECT COUNT(*) FROM s2) > 0
UNION ALL SELECT 2, row_number() OVER (ORDER BY text), text FROM s2
UNION ALL SELECT 3, 0, '== PARTS ABOVE 2000 (' || CAST((SELECT COUNT(*) FROM s3) AS VARCHAR) || ') ==' WHERE (SELECT COUNT(*) FROM s3) > 0
UNION ALL SELECT 3, row_number() OVER (ORDER BY text), text FROM s3
UNION ALL SELECT 4, 0, '== CUSTOMERS WITHOUT ORDERS (' || CAST((SELECT COUNT(*) FROM s4) AS VARCHAR) || ') ==' WHERE (SELECT COUNT(*) FROM s4) > 0
UNION ALL SELECT 4, row_number() OVER (ORDER BY text), text FROM s4""")
def i43(spark, d):
    orders, li, supp, part, cust = tables(spark, d, "orders", "lineitem", "supplier", "part", "customer")
    s1 = J.lacks(orders, li, F.col("o_orderkey") == F.col("l_orderkey")) \
        .select(F.concat(F.lit("ORDER "), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("text"))
    s2 = supp.where(F.col("s_acctbal") < 0).select(F.concat(F.lit("SUPPLIER "), "s_name").alias("text"))
    s3 = part.where(F.col("p_retailprice") > 2000).select(F.concat(F.lit("PART "), "p_name").alias("text"))
    s4 = J.lacks(cust, orders, F.col("c_custkey") == F.col("o_custkey")).select(F.concat(F.lit("CUSTOMER "), "c_name").alias("text"))
    return R.sectioned_report({"ORDERS WITHOUT LINES": s1, "SUPPLIERS IN DEBT": s2, "PARTS ABOVE 2000": s3,
                               "CUSTOMERS WITHOUT ORDERS": s4})


@query("i44_open_allocations_by_store", """
SELECT n.n_name, CAST(COUNT(*) AS BIGINT) AS n_open, round(SUM(o.o_totalprice), 2) AS open_value
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderstatus = 'O' GROUP BY n.n_name""")
def i44(spark, d):
    orders, cust, nation = tables(spark, d, "orders", "customer", "nation")
    j = J.star_join(orders.where(F.col("o_orderstatus") == "O"), [(cust, F.col("o_custkey") == F.col("c_custkey")),
                                                                (nation, F.col("c_nationkey") == F.col("n_nationkey"))])
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_open"), F.round(F.sum("o_totalprice"), 2).alias("open_value"))


@query("i49_name_lookups_by_level", """
SELECT s.s_suppkey, n.n_name AS nation_name, r.r_name AS region_name
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def i49(spark, d):
    supp, nation, region = tables(spark, d, "supplier", "nation", "region")
    levels = {"nation": (nation, "n_nationkey", "n_name"), "region": (region, "r_regionkey", "r_name")}
    x = supp.select("s_suppkey", F.col("s_nationkey").alias("code"))
    x = R.name_of(x, "code", "nation", levels, alias="nation_name")
    x = J.lookup(x, nation.select(F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("region_code")),
                 "code", "region_code")
    x = R.name_of(x.drop("code").withColumnRenamed("region_code", "code"), "code", "region", levels, alias="region_name")
    return x.select("s_suppkey", "nation_name", "region_name")


@query("i50_vendor_listing", """
SELECT s.s_suppkey, s.s_name, n.n_name, r.r_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey WHERE s.s_acctbal > 0""")
def i50(spark, d):
    supp, nation, region = tables(spark, d, "supplier", "nation", "region")
    j = J.star_join(supp.where(F.col("s_acctbal") > 0), [(nation, F.col("s_nationkey") == F.col("n_nationkey")),
                                                         (region, F.col("n_regionkey") == F.col("r_regionkey"))])
    return j.select("s_suppkey", "s_name", "n_name", "r_name")


SITE_RULES = [("p%", "PAYMENTS"), ("s%", "ACCOUNTS"), ("v%", "WEB"), ("c%", "WEB")]


@query("i51_events_by_site", """
SELECT CASE WHEN event_type LIKE 'p%' THEN 'PAYMENTS' WHEN event_type LIKE 's%' THEN 'ACCOUNTS'
            WHEN event_type LIKE 'v%' THEN 'WEB' WHEN event_type LIKE 'c%' THEN 'WEB' ELSE 'OTHER' END AS site,
       CAST(COUNT(*) AS BIGINT) AS n
FROM events WHERE ts >= DATE '2024-01-31' - INTERVAL 7 DAY GROUP BY 1 ORDER BY n DESC, site""")
def i51(spark, d):
    from ..operators.aggs import count_by
    (ev,) = tables(spark, d, "events")
    recent = ev.where(newer_than("ts", EVENTS_AS_OF, 7))
    return count_by(recent.withColumn("site", R.classify_hosts("event_type", SITE_RULES)), "site")
