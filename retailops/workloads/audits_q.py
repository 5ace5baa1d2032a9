"""Audit queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cols import in_year, older_than
from ..operators.joins import star_join
from ..plans.audits import audit_missing
from .registry import AS_OF, query, tables


def stranded_orders(spark, d):
    """Flagship (I5): orders older than 90 days before AS_OF that have no line item,
    with customer, nation and region, sorted by order key."""
    orders, li, cust, nation, region = tables(spark, d, "orders", "lineitem", "customer", "nation", "region")
    old = orders.where(older_than("o_orderdate", AS_OF, 90))
    stranded = audit_missing(old, must_lack=[(li.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))])
    out = star_join(stranded, [
        (cust, F.col("o_custkey") == F.col("c_custkey")),
        (nation, F.col("c_nationkey") == F.col("n_nationkey")),
        (region, F.col("n_regionkey") == F.col("r_regionkey")),
    ])
    return (out.select("o_orderkey", "o_custkey", "c_name", "n_name", "r_name",
                       F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice", "o_orderstatus")
               .orderBy("o_orderkey"))


query("i5_stranded_orders", """
SELECT o.o_orderkey, o.o_custkey, c.c_name, n.n_name, r.r_name,
       CAST(o.o_orderdate AS DATE) AS o_orderdate, o.o_totalprice, o.o_orderstatus
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE o.o_orderdate < DATE '2001-08-01' - INTERVAL 90 DAY
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
ORDER BY o.o_orderkey
""")(stranded_orders)


# --- I1: code table decode ---------------------------------------------------------

_CT_SQL = """ct AS (
  SELECT 'F026' AS tbl_id, substr(p_type, 1, 2) || lpad(CAST(p_size AS VARCHAR), 2, '0') AS tbl_elem_id,
         rpad(p_brand, 25, ' ') || CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) % 2 = 0 AND p_retailprice > 990 THEN 'Y' ELSE 'N' END AS tbl_elem_text
  FROM part)"""


def _code_table_from_part(part):
    """A generic code table (table id, element id, fixed-position text) made from part:
    element = type prefix + size, flag 'Y' at position 26 when the brand number is
    even and the price is above 990."""
    flag = F.when((F.expr("substr(p_brand, 7)").cast("int") % 2 == 0) & (F.col("p_retailprice") > 990), "Y").otherwise("N")
    return part.select(F.lit("F026").alias("tbl_id"),
                       F.concat(F.substring("p_type", 1, 2), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("tbl_elem_id"),
                       F.concat(F.rpad("p_brand", 25, " "), flag).alias("tbl_elem_text"))


@query("i1_code_table_decode", f"""
WITH {_CT_SQL},
codes AS (SELECT DISTINCT tbl_elem_id AS code FROM ct WHERE tbl_id = 'F026' AND substr(tbl_elem_text, 26, 1) = 'Y')
SELECT p.p_type, CAST(COUNT(*) AS BIGINT) AS n_lines
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
JOIN codes c ON substr(p.p_type, 1, 2) || lpad(CAST(p.p_size AS VARCHAR), 2, '0') = c.code
GROUP BY p.p_type""")
def i1(spark, d):
    from ..plans.audits import code_table
    li, part = tables(spark, d, "lineitem", "part")
    codes = code_table(_code_table_from_part(part), "F026", 26)
    p = part.withColumn("code", F.concat(F.substring("p_type", 1, 2), F.lpad(F.col("p_size").cast("string"), 2, "0")))
    j = li.join(p.join(codes, "code", "left_semi"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_type").agg(F.count(F.lit(1)).alias("n_lines"))


@query("i6_items_lacking_recent_sales", """
SELECT p.p_partkey, p.p_brand, CAST(coalesce((SELECT COUNT(*) FROM lineitem l WHERE l.l_partkey = p.p_partkey), 0) AS BIGINT) AS n_children
FROM part p
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_shipdate >= DATE '2001-08-01' - INTERVAL 365 DAY
                  AND l.l_shipdate < DATE '2001-08-01')""")
def i6(spark, d):
    from ..functions.cols import newer_than
    from ..plans.audits import child_count
    part, li = tables(spark, d, "part", "lineitem")
    recent = li.where(newer_than("l_shipdate", AS_OF, 365) & (F.col("l_shipdate") < F.lit(AS_OF)))
    lacking = audit_missing(part.select("p_partkey", "p_brand"), must_lack=[(recent, F.col("p_partkey") == F.col("l_partkey"))])
    return child_count(lacking, li.select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


_SYS_SQL = """a AS (SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS n_orders, MIN(o_orderpriority) AS top_priority FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
b AS (SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS n_orders, MIN(o_orderpriority) AS top_priority FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)"""


def _two_systems(orders):
    def side(status):
        return (orders.where(F.col("o_orderstatus") == status).groupBy("o_custkey")
                      .agg(F.count(F.lit(1)).alias("n_orders"), F.min("o_orderpriority").alias("top_priority")))
    return side("F"), side("O")


@query("i7_two_system_field_compare", f"""
WITH {_SYS_SQL}
SELECT a.o_custkey, a.n_orders AS a_n_orders, a.top_priority AS a_top_priority, b.n_orders AS b_n_orders, b.top_priority AS b_top_priority,
       CASE WHEN a.n_orders IS NOT DISTINCT FROM b.n_orders THEN 'Y' ELSE 'N' END AS n_orders_match,
       CASE WHEN a.top_priority IS NOT DISTINCT FROM b.top_priority THEN 'Y' ELSE 'N' END AS top_priority_match
FROM a JOIN b ON a.o_custkey = b.o_custkey
WHERE a.n_orders IS DISTINCT FROM b.n_orders OR a.top_priority IS DISTINCT FROM b.top_priority""")
def i7(spark, d):
    from ..plans.audits import compare
    (orders,) = tables(spark, d, "orders")
    a, b = _two_systems(orders)
    return compare(a, b, ["o_custkey"], ["n_orders", "top_priority"])


@query("i8_two_way_reconcile", f"""
WITH {_SYS_SQL}
SELECT o_custkey, 'B' AS missing_from FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b)
UNION ALL
SELECT o_custkey, 'A' FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)""")
def i8(spark, d):
    from ..plans.audits import reconcile
    (orders,) = tables(spark, d, "orders")
    a, b = _two_systems(orders)
    return reconcile(a, b, ["o_custkey"])


@query("i9_coverage_audit", """
WITH sr AS (SELECT l.*, n.n_regionkey FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey),
expected AS (SELECT DISTINCT l_partkey, n_regionkey FROM sr WHERE year(l_shipdate) = 2000),
actual AS (SELECT l_partkey, n_regionkey, MAX(CASE WHEN l_linestatus IN ('O') THEN 1 ELSE 0 END) AS ok, MIN(l_linestatus) AS l_linestatus
           FROM sr WHERE year(l_shipdate) = 2001 GROUP BY 1, 2)
SELECT e.l_partkey, e.n_regionkey, a.l_linestatus,
       CASE WHEN a.ok IS NULL THEN 'MISSING' WHEN a.ok = 0 THEN 'BAD STATUS' END AS problem
FROM expected e LEFT JOIN actual a ON e.l_partkey = a.l_partkey AND e.n_regionkey = a.n_regionkey
WHERE a.ok IS NULL OR a.ok = 0""")
def i9(spark, d):
    from ..plans.audits import coverage_audit
    li, supp, nation = tables(spark, d, "lineitem", "supplier", "nation")
    sr = li.join(supp, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    expected = sr.where(in_year("l_shipdate", 2000)).select("l_partkey", "n_regionkey").distinct()
    actual = sr.where(in_year("l_shipdate", 2001)).select("l_partkey", "n_regionkey", "l_linestatus")
    return coverage_audit(expected, actual, ["l_partkey", "n_regionkey"], "l_linestatus", ["O"])


ERROR_TEMPLATES = {
    "00320": "CASE {part} NOT YET ON FILE",
    "00337": "SUPPLIER {supp} MUST BE LEVEL 1 OR 2",
}


@query("i12_error_report", """
WITH errs AS (
  SELECT l_orderkey, l_linenumber,
         CASE l_returnflag WHEN 'R' THEN '00320' WHEN 'A' THEN '00337' ELSE '00999' END AS err_cd,
         lpad(CAST(l_partkey AS VARCHAR), 8, '0') || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') || strftime(l_shipdate, '%Y%m%d') AS meta_data
  FROM lineitem WHERE l_discount >= 0.09),
p AS (SELECT *, rtrim(substr(meta_data, 1, 8)) AS part, rtrim(substr(meta_data, 9, 5)) AS supp,
             try_strptime(rtrim(substr(meta_data, 14, 8)), '%Y%m%d')::DATE AS ship FROM errs)
SELECT p.l_orderkey, p.l_linenumber, p.err_cd, p.part, p.supp, p.ship,
       CASE p.err_cd WHEN '00320' THEN 'CASE ' || p.part || ' NOT YET ON FILE'
                     WHEN '00337' THEN 'SUPPLIER ' || p.supp || ' MUST BE LEVEL 1 OR 2'
                     ELSE p.err_cd END AS message,
       coalesce(s.s_name, 'UNKNOWN') AS supplier_name
FROM p LEFT JOIN supplier s ON CAST(p.supp AS BIGINT) = s.s_suppkey""")
def i12(spark, d):
    from ..operators.joins import lookup
    from ..plans.audits import error_report
    from ..sources.tables import format_fixed
    li, supp = tables(spark, d, "lineitem", "supplier")
    code = F.when(F.col("l_returnflag") == "R", "00320").when(F.col("l_returnflag") == "A", "00337").otherwise("00999")
    errs = li.where(F.col("l_discount") >= 0.09).select(
        "l_orderkey", "l_linenumber", code.alias("err_cd"),
        F.concat(format_fixed([("l_partkey", 8, "num"), ("l_suppkey", 5, "num")]),
                 F.date_format("l_shipdate", "yyyyMMdd")).alias("meta_data"))
    layout = [("part", 1, 8), ("supp", 9, 5), ("ship", 14, 8, "string")]
    rep = error_report(errs, "meta_data", layout, "err_cd", ERROR_TEMPLATES)
    rep = rep.withColumn("ship", F.try_to_date("ship", "yyyyMMdd")).withColumn("supp_key", F.col("supp").try_cast("long"))
    dim = supp.select(F.col("s_suppkey").alias("supp_key"), "s_name")
    rep = lookup(rep, dim, "supp_key", "s_name", default="UNKNOWN", alias="supplier_name")
    return rep.select("l_orderkey", "l_linenumber", "err_cd", "part", "supp", "ship", "message", "supplier_name")


@query("i40_worklist_duplicates_and_no_stock", """
WITH wl AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'O'),
dups AS (SELECT l_orderkey, l_linenumber FROM wl GROUP BY 1, 2 HAVING COUNT(*) > 1)
SELECT w.l_orderkey, w.l_linenumber, w.l_partkey, 'DUPLICATE' AS problem FROM wl w JOIN dups d USING (l_orderkey, l_linenumber)
UNION ALL
SELECT w.l_orderkey, w.l_linenumber, w.l_partkey, 'NO STOCK' FROM wl w
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = w.l_partkey AND p.p_size > 5)""")
def i40(spark, d):
    from ..operators.aggs import dup_rows
    li, part = tables(spark, d, "lineitem", "part")
    wl = li.where(F.col("l_linestatus") == "O").select("l_orderkey", "l_linenumber", "l_partkey")
    dups = dup_rows(wl, ["l_orderkey", "l_linenumber"]).withColumn("problem", F.lit("DUPLICATE"))
    stocked = part.where(F.col("p_size") > 5)
    nostock = audit_missing(wl, must_lack=[(stocked, F.col("l_partkey") == F.col("p_partkey"))]) \
        .withColumn("problem", F.lit("NO STOCK"))
    return dups.unionByName(nostock)


@query("i45_candidate_item_picker", """
SELECT p.p_partkey, p.p_name FROM part p
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND year(l.l_shipdate) = 2001)
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_returnflag = 'R' AND l.l_quantity > 45)
ORDER BY p.p_partkey LIMIT 10""")
def i45(spark, d):
    part, li = tables(spark, d, "part", "lineitem")
    sold = li.where(in_year("l_shipdate", 2001))
    returned = li.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))
    picked = audit_missing(part.select("p_partkey", "p_name"),
                           must_lack=[(returned, F.col("p_partkey") == F.col("l_partkey"))],
                           must_have=[(sold, F.col("p_partkey") == F.col("l_partkey"))])
    return picked.orderBy("p_partkey").limit(10)


@query("i5b_authorized_items_without_activity", f"""
WITH {_CT_SQL},
codes AS (SELECT DISTINCT tbl_elem_id AS code FROM ct WHERE tbl_id = 'F026' AND substr(tbl_elem_text, 26, 1) = 'Y'),
j AS (SELECT l.*, s.s_nationkey FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey),
auth AS (SELECT DISTINCT j.l_partkey, j.s_nationkey, p.p_type FROM j JOIN part p ON j.l_partkey = p.p_partkey
         WHERE substr(p.p_type, 1, 2) || lpad(CAST(p.p_size AS VARCHAR), 2, '0') IN (SELECT code FROM codes))
SELECT a.l_partkey, a.s_nationkey, a.p_type FROM auth a
WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.l_partkey = a.l_partkey AND j.s_nationkey = a.s_nationkey AND j.l_linestatus = 'O')
  AND NOT EXISTS (SELECT 1 FROM j WHERE j.l_partkey = a.l_partkey AND j.s_nationkey = a.s_nationkey
                  AND j.l_shipdate >= DATE '2001-08-01' - INTERVAL 365 DAY AND j.l_shipdate < DATE '2001-08-01')""")
def i5b(spark, d):
    """Authorised item x place pairs (part x supplier nation seen in line items) of the
    item types flagged in the code table, with nothing on order (no open line) and
    no stock movement in the last year: chained anti joins on the pair key."""
    from ..functions.cols import newer_than
    from ..plans.audits import code_table
    li, supp, part = tables(spark, d, "lineitem", "supplier", "part")
    j = li.join(supp.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    codes = code_table(_code_table_from_part(part), "F026", 26)
    eligible = part.withColumn("code", F.concat(F.substring("p_type", 1, 2), F.lpad(F.col("p_size").cast("string"), 2, "0"))) \
                   .join(codes, "code", "left_semi").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    auth = j.select("l_partkey", "s_nationkey").distinct().join(eligible, "l_partkey")
    keys = ["l_partkey", "s_nationkey"]
    on_order = j.where(F.col("l_linestatus") == "O").select(*keys)
    moved = j.where(newer_than("l_shipdate", AS_OF, 365) & (F.col("l_shipdate") < F.lit(AS_OF))).select(*keys)
    return audit_missing(auth, must_lack=[(on_order, keys), (moved, keys)]).select("l_partkey", "s_nationkey", "p_type")
