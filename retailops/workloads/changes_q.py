"""Change-set, sync and purge queries.

Roles on the driver tables: orders are header (work) lines, line items their
details, events the change feed (signup = insert, view/click/purchase = update,
error = delete). Header status: F → 30 approved, O → 10 available, P → 50 unapproved.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..functions.cols import in_year, older_than
from ..plans import changes as X
from .registry import AS_OF, query, tables

def _op():
    return F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 3).otherwise(2)


_OP_SQL = "CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 3 ELSE 2 END"
def _status():
    return F.when(F.col("o_orderstatus") == "F", 30).when(F.col("o_orderstatus") == "O", 10).otherwise(50)


_STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 10 ELSE 50 END"


def _user_state(spark, d):
    cust, ev = tables(spark, d, "customer", "events")
    target = cust.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("balance"),
                         F.lit("none").alias("last_type"))
    changes = ev.select("user_id", _op().alias("op"), F.col("event_id").alias("seq"),
                        F.col("value").alias("balance"), F.col("event_type").alias("last_type"))
    return target, changes


_CH_SQL = f"""ch AS (SELECT user_id, {_OP_SQL} AS op, event_id AS seq, value AS balance, event_type AS last_type FROM events),
tgt AS (SELECT c_custkey AS user_id, c_acctbal AS balance, 'none' AS last_type FROM customer),
red AS (SELECT user_id,
    arg_max(balance, seq) FILTER (WHERE op <> 3) AS u_balance,
    arg_max(last_type, seq) FILTER (WHERE op <> 3) AS u_type,
    max(CASE WHEN op <> 3 THEN 1 END) AS has_up,
    max(CASE WHEN op = 3 THEN 1 ELSE 0 END) AS has_del,
    arg_max(op = 3, seq) AS last_del
  FROM ch GROUP BY user_id),
m AS (SELECT coalesce(t.user_id, r.user_id) AS user_id, t.user_id IS NOT NULL AS in_t, r.has_up, r.has_del, r.last_del,
        CASE WHEN r.has_up = 1 THEN r.u_balance ELSE t.balance END AS balance,
        CASE WHEN r.has_up = 1 THEN r.u_type ELSE t.last_type END AS last_type
      FROM tgt t FULL OUTER JOIN red r ON t.user_id = r.user_id)"""


@query("i25_apply_changes_last_wins", f"""
WITH {_CH_SQL}
SELECT user_id, balance, last_type FROM m WHERE last_del IS NULL OR NOT last_del""")
def i25(spark, d):
    target, changes = _user_state(spark, d)
    return X.apply_changes(target, changes, "user_id", mode="last")


@query("i25b_apply_changes_delete_first", f"""
WITH {_CH_SQL}
SELECT user_id, balance, last_type FROM m WHERE has_up = 1 OR (in_t AND coalesce(has_del, 0) = 0)""")
def i25b(spark, d):
    target, changes = _user_state(spark, d)
    return X.apply_changes(target, changes, "user_id", mode="delete_first")


@query("i25c_apply_changes_delete_last", f"""
WITH {_CH_SQL}
SELECT user_id, balance, last_type FROM m WHERE coalesce(has_del, 0) = 0""")
def i25c(spark, d):
    target, changes = _user_state(spark, d)
    return X.apply_changes(target, changes, "user_id", mode="delete_last")


@query("i26_merge_upsert", """
WITH src AS (SELECT user_id AS c_custkey, arg_max(value, event_id) AS c_acctbal FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM src)
UNION ALL SELECT c_custkey, c_acctbal FROM src""")
def i26(spark, d):
    cust, ev = tables(spark, d, "customer", "events")
    src = (ev.where(F.col("event_type") == "purchase").groupBy(F.col("user_id").alias("c_custkey"))
             .agg(F.max(F.struct("event_id", "value")).alias("m")).select("c_custkey", F.col("m.value").alias("c_acctbal")))
    return X.merge_upsert(cust.select("c_custkey", "c_acctbal"), src, "c_custkey")


@query("i27_set_sync", """
SELECT s.p_partkey, s.p_brand, s.p_type, coalesce(t.note, 'new') AS note
FROM (SELECT p_partkey, p_brand, p_type FROM part WHERE p_retailprice > 950) s
LEFT JOIN (SELECT p_partkey, 'kept' AS note FROM part WHERE p_size > 10) t ON s.p_partkey = t.p_partkey""")
def i27(spark, d):
    (part,) = tables(spark, d, "part")
    target = part.where(F.col("p_size") > 10).select("p_partkey", F.lower("p_brand").alias("p_brand"),
                                                   F.lit("?").alias("p_type"), F.lit("kept").alias("note"))
    source = part.where(F.col("p_retailprice") > 950)
    return X.sync_set(target, source, "p_partkey", ["p_brand", "p_type"], {"note": "new"})


_DRIFT_SQL = """a AS (SELECT l_partkey, MIN(l_suppkey) AS supp, MAX(l_quantity) AS max_qty FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1),
b AS (SELECT l_partkey, MIN(l_suppkey) AS supp, MAX(l_quantity) AS max_qty FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1)"""


def _drift_sides(li):
    def side(y):
        return li.where(in_year("l_shipdate", y)).groupBy("l_partkey").agg(
            F.min("l_suppkey").alias("supp"), F.max("l_quantity").alias("max_qty"))
    return side(1996), side(1997)


@query("i28_attribute_drift", f"""
WITH {_DRIFT_SQL}
SELECT a.l_partkey, a.supp, a.max_qty, b.supp AS new_supp, b.max_qty AS new_max_qty,
       CASE WHEN b.l_partkey IS NULL THEN 'MISSING' ELSE 'CHANGED' END AS drift
FROM a LEFT JOIN b ON a.l_partkey = b.l_partkey
WHERE b.l_partkey IS NULL OR a.supp IS DISTINCT FROM b.supp OR a.max_qty IS DISTINCT FROM b.max_qty""")
def i28(spark, d):
    (li,) = tables(spark, d, "lineitem")
    a, b = _drift_sides(li)
    return X.drift(a, b, "l_partkey", ["supp", "max_qty"])


@query("i28b_update_from", f"""
WITH {_DRIFT_SQL}
SELECT a.l_partkey, CASE WHEN b.l_partkey IS NOT NULL THEN b.supp ELSE a.supp END AS supp,
       CASE WHEN b.l_partkey IS NOT NULL THEN b.max_qty ELSE a.max_qty END AS max_qty
FROM a LEFT JOIN b ON a.l_partkey = b.l_partkey""")
def i28b(spark, d):
    (li,) = tables(spark, d, "lineitem")
    a, b = _drift_sides(li)
    return X.update_from(a, b, "l_partkey", ["supp", "max_qty"])


@query("i29_hierarchy_resync_collisions", """
WITH lines AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'O'),
j AS (SELECT l.*, coalesce(p.p_brand, '?') AS l_brand, coalesce(p.p_type, '?') AS l_type FROM lines l LEFT JOIN part p ON l.l_partkey = p.p_partkey),
c AS (SELECT *, COUNT(*) OVER (PARTITION BY l_orderkey, l_brand, l_type) AS n FROM j)
SELECT l_orderkey, l_linenumber, l_partkey, l_brand, l_type, CASE WHEN n = 1 THEN 'line' ELSE 'audit' END AS target,
       CAST(n AS BIGINT) AS collisions FROM c""")
def i29(spark, d):
    li, part = tables(spark, d, "lineitem", "part")
    lines = li.where(F.col("l_linestatus") == "O").select("l_orderkey", "l_linenumber", "l_partkey",
                                                          F.lit("?").alias("l_brand"), F.lit("?").alias("l_type"))
    items = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("l_brand"), F.col("p_type").alias("l_type"))
    ok, clash = X.resync_hierarchy(lines, items, "l_partkey", ["l_brand", "l_type"], ["l_orderkey", "l_brand", "l_type"])
    return ok.withColumn("target", F.lit("line")).withColumn("collisions", F.lit(1).cast("long")) \
             .unionByName(clash.withColumn("target", F.lit("audit")).select(*ok.columns, "target", "collisions"))


@query("i30_wildcard_delete", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus FROM lineitem),
p AS (SELECT s_suppkey AS l_suppkey, CAST(NULL AS VARCHAR) AS l_returnflag, CAST(NULL AS VARCHAR) AS l_linestatus FROM supplier WHERE s_acctbal < 0
      UNION ALL SELECT DISTINCT CAST(NULL AS BIGINT), l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'
      UNION ALL SELECT s_suppkey, 'A', NULL FROM supplier WHERE s_acctbal > 9900)
SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE (p.l_suppkey IS NULL OR p.l_suppkey = t.l_suppkey)
  AND (p.l_returnflag IS NULL OR p.l_returnflag = t.l_returnflag) AND (p.l_linestatus IS NULL OR p.l_linestatus = t.l_linestatus))""")
def i30(spark, d):
    li, supp = tables(spark, d, "lineitem", "supplier")
    t = li.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus")
    none_s = F.lit(None).cast("string")
    p = (supp.where(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("l_suppkey"), none_s.alias("l_returnflag"), none_s.alias("l_linestatus"))
         .unionByName(li.where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
                      .select(F.lit(None).cast("long").alias("l_suppkey"), "l_returnflag", "l_linestatus").distinct())
         .unionByName(supp.where(F.col("s_acctbal") > 9900).select(F.col("s_suppkey").alias("l_suppkey"), F.lit("A").alias("l_returnflag"),
                                                                  none_s.alias("l_linestatus"))))
    return X.delete_matching(t, p, ["l_suppkey", "l_returnflag", "l_linestatus"])


_IDS_SQL = """ids AS (SELECT l_shipdate, l_partkey AS style, CASE WHEN l_returnflag <> 'N' THEN l_suppkey END AS color,
  CASE WHEN l_linestatus = 'O' THEN l_linenumber END AS size, CASE WHEN l_quantity > 45 THEN CAST(l_quantity AS INTEGER) END AS dim FROM lineitem)"""


def _ids(li):
    return li.select("l_shipdate", F.col("l_partkey").alias("style"),
                     F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("color"),
                     F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")).alias("size"),
                     F.when(F.col("l_quantity") > 45, F.col("l_quantity").cast("int")).alias("dim"))


@query("i31_line_grain", f"""
WITH {_IDS_SQL}
SELECT CASE WHEN dim IS NOT NULL THEN 'DIM' WHEN size IS NOT NULL THEN 'SIZE' WHEN color IS NOT NULL THEN 'COLOR'
            WHEN style IS NOT NULL THEN 'STYLE' END AS grain, CAST(COUNT(*) AS BIGINT) AS n FROM ids GROUP BY 1""")
def i31(spark, d):
    (li,) = tables(spark, d, "lineitem")
    return _ids(li).groupBy(X.grain("style", "color", "size", "dim").alias("grain")).agg(F.count(F.lit(1)).alias("n"))


@query("i31b_match_lines_null_safe", f"""
WITH {_IDS_SQL},
a AS (SELECT DISTINCT style, color, size FROM ids WHERE year(l_shipdate) = 1996),
b AS (SELECT DISTINCT style, color, size FROM ids WHERE year(l_shipdate) = 1997)
SELECT a.style, a.color, a.size FROM a JOIN b ON a.style IS NOT DISTINCT FROM b.style
  AND a.color IS NOT DISTINCT FROM b.color AND a.size IS NOT DISTINCT FROM b.size""")
def i31b(spark, d):
    (li,) = tables(spark, d, "lineitem")
    ids = _ids(li)
    a = ids.where(in_year("l_shipdate", 1996)).select("style", "color", "size").distinct()
    b = ids.where(in_year("l_shipdate", 1997)).select("style", "color", "size").distinct()
    return X.match_lines(a, b, ["style", "color", "size"]).select("style", "color", "size")


@query("i32_assign_surrogate_keys", """
WITH new_rows AS (SELECT c_custkey, c_name, c_acctbal FROM customer c WHERE NOT EXISTS (
   SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND year(o.o_orderdate) = 2001))
SELECT c_custkey, c_name, c_acctbal, CAST((SELECT MAX(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS o_orderkey FROM new_rows""")
def i32(spark, d):
    cust, orders = tables(spark, d, "customer", "orders")
    o2001 = orders.where(in_year("o_orderdate", 2001))
    new_rows = cust.join(o2001, cust.c_custkey == o2001.o_custkey, "left_anti").select("c_custkey", "c_name",
                                                                                          "c_acctbal")
    return X.assign_keys(new_rows, orders, "o_orderkey", ["c_custkey"])


@query("i33_pack_quantities", """
WITH j AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey AS sku, CAST(l.l_quantity AS BIGINT) AS qty, p.p_size % 6 + 1 AS qpp,
                  CASE WHEN l.l_linestatus = 'O' THEN CAST(l.l_quantity AS BIGINT) END AS ordered,
                  CASE WHEN p.p_type = 'PROMO' THEN 'VP' || CAST(p.p_partkey AS VARCHAR) END AS vendor_pack
           FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
SELECT l_orderkey, l_linenumber,
  round(CAST(CASE WHEN vendor_pack IS NOT NULL THEN qty ELSE coalesce(qty, 0) / CAST(qpp AS DOUBLE) END AS DOUBLE), 6) AS nbr_packs,
  CASE WHEN vendor_pack IS NULL AND qpp > 1 THEN CAST(sku AS VARCHAR) || '_' || CAST(qpp AS VARCHAR) ELSE coalesce(vendor_pack, CAST(sku AS VARCHAR)) END AS pack_id,
  round(CAST(CASE WHEN vendor_pack IS NOT NULL THEN coalesce(ordered, 0) ELSE coalesce(ordered, 0) / CAST(qpp AS DOUBLE) END AS DOUBLE), 6) AS on_order_packs,
  round(CAST(CASE WHEN vendor_pack IS NOT NULL THEN qty * qpp ELSE coalesce(qty, 0) END AS DOUBLE), 6) AS extended_qty
FROM j""")
def i33(spark, d):
    li, part = tables(spark, d, "lineitem", "part")
    j = li.join(part, li.l_partkey == part.p_partkey).select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("sku"), F.col("l_quantity").cast("long").alias("qty"),
        (F.col("p_size") % 6 + 1).alias("qpp"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("long")).alias("ordered"),
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("VP"), F.col("p_partkey").cast("string"))).alias("vendor_pack"))
    out = X.pack_quantities(j, "qty", "qpp", "vendor_pack", "sku", on_order="ordered")
    return out.select("l_orderkey", "l_linenumber", F.round("nbr_packs", 6).alias("nbr_packs"), "pack_id",
                      F.round("on_order_packs", 6).alias("on_order_packs"), F.round("extended_qty", 6).alias("extended_qty"))


def _headers(orders, li, old_cut=None):
    """Header lines from orders; qty = total quantity of lines (shipped before
    ``old_cut`` when given, i.e. the total as last summed)."""
    src = li if old_cut is None else li.where(F.col("l_shipdate") < F.lit(old_cut))
    tot = src.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("qty"))
    return (orders.select("o_orderkey", "o_custkey", _status().alias("status_code"))
                  .join(tot, "o_orderkey", "left").withColumn("qty", F.coalesce("qty", F.lit(0.0))))


@query("i34_roll_up_lines_discrepancy", f"""
WITH old AS (SELECT l_orderkey, SUM(l_quantity) AS q FROM lineitem WHERE l_shipdate < DATE '2001-01-01' GROUP BY 1),
h AS (SELECT o_orderkey, o_custkey, {_STATUS_SQL} AS status_code, coalesce(old.q, 0) AS qty FROM orders LEFT JOIN old ON o_orderkey = l_orderkey),
tot AS (SELECT l_orderkey, SUM(l_quantity) AS new_q FROM lineitem GROUP BY 1),
hh AS (SELECT h.*, coalesce(tot.new_q, 0) AS new_q FROM h LEFT JOIN tot ON h.o_orderkey = tot.l_orderkey),
bad AS (SELECT DISTINCT o_custkey FROM hh WHERE status_code IN (30, 50) AND qty <> new_q)
SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM bad) THEN 25 ELSE status_code END AS status_code,
       round(new_q, 2) AS qty FROM hh""")
def i34(spark, d):
    orders, li = tables(spark, d, "orders", "lineitem")
    h = _headers(orders, li, _dt.date(2001, 1, 1))
    details = li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("qty"))
    out = X.roll_up_lines(h, details, "o_orderkey", "o_custkey", "qty")
    return out.withColumn("qty", F.round("qty", 2))


@query("i35_deferred_changes", """
WITH latest AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey),
ch AS (SELECT e.event_id, e.event_type, l.o_orderkey FROM events e JOIN latest l ON e.user_id = l.o_custkey),
busy AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
SELECT event_type, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM busy) THEN 'deferred' ELSE 'now' END AS batch,
       CAST(COUNT(*) AS BIGINT) AS n FROM ch GROUP BY 1, 2""")
def i35(spark, d):
    """Each event changes its customer's latest order; changes to orders in progress wait."""
    ev, orders = tables(spark, d, "events", "orders")
    latest = (orders.groupBy(F.col("o_custkey").alias("user_id"))
                    .agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
                    .select("user_id", F.col("m.o_orderkey").alias("o_orderkey")))
    ch = ev.join(latest, "user_id").select("event_id", "event_type", "o_orderkey")
    lines = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", X.IN_PROGRESS).otherwise(X.AVAILABLE).alias("status_code"))
    now, deferred = X.split_deferred(ch, lines, "o_orderkey")
    both = now.withColumn("batch", F.lit("now")).unionByName(deferred.withColumn("batch", F.lit("deferred")))
    return both.groupBy("event_type", "batch").agg(F.count(F.lit(1)).alias("n"))


@query("i36_worklist_rebuild", """
WITH lines AS (SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN l_returnflag = 'A' THEN 40 WHEN l_linestatus = 'F' THEN 30 ELSE 10 END AS status_code,
    CASE WHEN l_linenumber = 1 THEN 'OBS' WHEN l_linenumber = 2 THEN 'OTH' END AS trouble FROM lineitem),
feed AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_shipdate < DATE '2001-06-01'),
cleaned AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'),
m AS (SELECT l.*, f.l_orderkey IS NOT NULL AS fed FROM lines l LEFT JOIN feed f ON f.l_orderkey IS NOT DISTINCT FROM l.l_orderkey
         AND f.l_linenumber IS NOT DISTINCT FROM l.l_linenumber AND f.l_partkey IS NOT DISTINCT FROM l.l_partkey),
gone AS (SELECT * FROM m WHERE status_code <> 40 AND NOT fed)
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN status_code <> 40 AND l_orderkey IN (SELECT l_orderkey FROM gone) THEN 10 ELSE status_code END AS status_code,
  CASE WHEN status_code <> 40 AND trouble = 'OBS' THEN NULL ELSE trouble END AS trouble
FROM m WHERE (status_code = 40 AND l_orderkey NOT IN (SELECT o_orderkey FROM cleaned)) OR (status_code <> 40 AND fed)""")
def i36(spark, d):
    li, orders = tables(spark, d, "lineitem", "orders")
    status = (F.when(F.col("l_returnflag") == "A", X.RELEASED).when(F.col("l_linestatus") == "F", X.APPROVED)
               .otherwise(X.AVAILABLE))
    lines = li.select("l_orderkey", "l_linenumber", "l_partkey", status.alias("status_code"),
                      F.when(F.col("l_linenumber") == 1, "OBS").when(F.col("l_linenumber") == 2, "OTH").alias("trouble"))
    feed = li.where(F.col("l_shipdate") < F.lit(_dt.date(2001, 6, 1)))
    cleaned = orders.where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("l_orderkey"))
    return X.rebuild_lines(lines, feed, ["l_orderkey", "l_linenumber", "l_partkey"], "l_orderkey", results=cleaned,
                           trouble_col="trouble")


_PURGE_SQL = """ra AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < DATE '2001-08-01' - INTERVAL 730 DAY),
rb AS (SELECT o_orderkey FROM orders WHERE o_totalprice < 5000),
rc AS (SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)),
keys AS (SELECT o_orderkey, MIN(rule) AS rule FROM (SELECT o_orderkey, 'A' AS rule FROM ra UNION ALL SELECT o_orderkey, 'B' FROM rb
         UNION ALL SELECT o_orderkey, 'C' FROM rc) GROUP BY o_orderkey)"""


def _purge_rules(orders, li):
    days = X.purge_days(730)
    return {"A": orders.where((F.col("o_orderstatus") == "F") & older_than("o_orderdate", AS_OF, days)),
            "B": orders.where(F.col("o_totalprice") < 5000),
            "C": orders.join(li, orders.o_orderkey == li.l_orderkey, "left_anti")}


@query("i37_aged_purge_cascade", f"""
WITH {_PURGE_SQL}
SELECT 'orders' AS name, CAST(COUNT(*) AS BIGINT) AS n FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM keys)
UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM keys)
UNION ALL SELECT 'rule_' || rule, COUNT(*) FROM keys GROUP BY rule""")
def i37(spark, d):
    orders, li = tables(spark, d, "orders", "lineitem")
    keys = X.purge_keys(_purge_rules(orders, li), "o_orderkey")
    left = X.purge({"orders": (orders, "o_orderkey"), "lineitem": (li, "l_orderkey")}, keys, "o_orderkey")
    parts = [df.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(n)) for n, df in left.items()]
    rules = keys.groupBy(F.concat(F.lit("rule_"), F.col("rule")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return parts[0].unionByName(parts[1]).unionByName(rules).select("name", "n")


@query("i38_drop_orphans", """
WITH live AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
SELECT l_orderkey, l_linenumber FROM lineitem l
WHERE EXISTS (SELECT 1 FROM live WHERE live.o_orderkey = l.l_orderkey) AND l.l_orderkey >= (SELECT MIN(o_orderkey) FROM live)""")
def i38(spark, d):
    li, orders = tables(spark, d, "lineitem", "orders")
    live = orders.where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("l_orderkey"))
    return X.drop_orphans(li.select("l_orderkey", "l_linenumber"), live, "l_orderkey", min_live_key="l_orderkey")


@query("i39_stuck_status_repair", f"""
WITH lines AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 MINUTE * (o_orderkey % 180) AS stamp,
   CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 60 ELSE {_STATUS_SQL} END AS status_code FROM orders),
res AS (SELECT DISTINCT o_orderkey, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linestatus = 'F'),
m AS (SELECT l.*, r.o_orderkey IS NOT NULL AS has FROM lines l LEFT JOIN res r ON l.o_orderkey = r.o_orderkey AND l.o_custkey = r.o_custkey)
SELECT o_orderkey, CASE WHEN status_code = 60 AND stamp < TIMESTAMP '2001-07-31 02:00:00' - INTERVAL 1 HOUR THEN CASE WHEN has THEN 30 ELSE 10 END
                        ELSE status_code END AS status_code
FROM m""")
def i39(spark, d):
    """Allocation = customer, line = order; stamped some minutes into the order's day."""
    orders, li = tables(spark, d, "orders", "lineitem")
    stamp = F.to_date("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("o_orderkey").cast("int") % 180)
    lines = orders.select("o_orderkey", "o_custkey", stamp.alias("stamp"),
                          F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), X.STUCK)
                           .otherwise(_status()).alias("status_code"))
    res = li.where(F.col("l_linestatus") == "F").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return X.repair_status(lines, res, ["o_custkey", "o_orderkey"], "stamp", "2001-07-31 02:00:00").select(
        "o_orderkey", "status_code")


_REF_SQL = """ref AS (SELECT p_partkey, 20010100 + p_size AS effective_date, 20011200 + CAST(floor(p_retailprice) AS BIGINT) % 40 AS expiration_date FROM part),
parsed AS (SELECT *, try_strptime(CAST(effective_date AS VARCHAR), '%Y%m%d')::DATE AS effective_date_date,
                     try_strptime(CAST(expiration_date AS VARCHAR), '%Y%m%d')::DATE AS expiration_date_date FROM ref)"""


def _reference_rows(part):
    return part.select("p_partkey", (F.lit(20010100) + F.col("p_size")).alias("effective_date"),
                       (F.lit(20011200) + F.floor("p_retailprice").cast("long") % 40).alias("expiration_date"))


@query("i46_reference_load_validated", f"""
WITH {_REF_SQL}
SELECT * FROM parsed WHERE effective_date_date IS NOT NULL AND expiration_date_date IS NOT NULL""")
def i46(spark, d):
    (part,) = tables(spark, d, "part")
    loaded, _, _ = X.load_reference(_reference_rows(part), ["effective_date", "expiration_date"])
    return loaded


@query("i46b_reference_load_report", f"""
WITH {_REF_SQL}
SELECT CAST(COUNT(*) AS BIGINT) AS n_read,
  CAST(SUM(CASE WHEN effective_date_date IS NOT NULL AND expiration_date_date IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_loaded,
  CAST(SUM(CASE WHEN effective_date_date IS NULL OR expiration_date_date IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_rejected
FROM parsed""")
def i46b(spark, d):
    (part,) = tables(spark, d, "part")
    _, _, report = X.load_reference(_reference_rows(part), ["effective_date", "expiration_date"])
    return report


@query("i47_keyed_insert_update_delete", """
SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation
WHERE NOT (n_name LIKE '%7')
UNION ALL SELECT 100 + r_regionkey, r_name || '_HQ', r_regionkey FROM region""")
def i47(spark, d):
    nation, region = tables(spark, d, "nation", "region")
    out = X.update_where(nation, F.col("n_regionkey") == 1, {"n_name": F.lower("n_name")})
    out = X.delete_where(out, F.col("n_name").like("%7"))
    new = region.select((F.lit(100) + F.col("r_regionkey")).alias("n_nationkey"),
                        F.concat("r_name", F.lit("_HQ")).alias("n_name"), F.col("r_regionkey").alias("n_regionkey"))
    return X.append(out, new)


@query("i48_row_count_check", f"""
WITH {_PURGE_SQL},
after AS (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM keys))
SELECT CAST((SELECT COUNT(*) FROM orders) AS BIGINT) AS n_before, CAST((SELECT COUNT(*) FROM after) AS BIGINT) AS n_after,
       CAST((SELECT COUNT(*) FROM orders) - (SELECT COUNT(*) FROM after) AS BIGINT) AS n_diff, (SELECT COUNT(*) FROM after) > 0 AS non_empty,
       CAST((SELECT COUNT(*) FROM keys) AS BIGINT) AS n_expected,
       (SELECT COUNT(*) FROM orders) - (SELECT COUNT(*) FROM after) = (SELECT COUNT(*) FROM keys) AS diff_ok""")
def i48(spark, d):
    orders, li = tables(spark, d, "orders", "lineitem")
    keys = X.purge_keys(_purge_rules(orders, li), "o_orderkey")
    after = X.purge({"orders": (orders, "o_orderkey")}, keys, "o_orderkey")["orders"]
    return X.count_check(orders, after, keys)


@query("i52_detail_delete_header_upkeep", f"""
WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem),
ch AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40),
lft AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.l_orderkey = d.l_orderkey AND ch.l_linenumber = d.l_linenumber)),
touched AS (SELECT DISTINCT d.l_orderkey FROM d JOIN ch ON d.l_orderkey = ch.l_orderkey AND d.l_linenumber = ch.l_linenumber),
tot_all AS (SELECT l_orderkey, SUM(l_quantity) AS q FROM d GROUP BY 1),
newt AS (SELECT l_orderkey, SUM(l_quantity) AS q FROM lft GROUP BY 1),
h AS (SELECT o.o_orderkey, o.o_custkey, {_STATUS_SQL} AS status_code, coalesce(t.q, 0) AS qty,
             o.o_orderkey IN (SELECT l_orderkey FROM touched) AS t, n.q AS new_q
      FROM orders o LEFT JOIN tot_all t ON o.o_orderkey = t.l_orderkey LEFT JOIN newt n ON o.o_orderkey = n.l_orderkey),
h2 AS (SELECT *, CASE WHEN t THEN coalesce(new_q, 0) ELSE qty END AS q2 FROM h),
bad AS (SELECT DISTINCT o_custkey FROM h2 WHERE t AND status_code IN (30, 50))
SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM bad) THEN 25 ELSE status_code END AS status_code,
       round(q2, 2) AS qty
FROM h2 WHERE NOT t OR new_q IS NOT NULL""")
def i52(spark, d):
    orders, li = tables(spark, d, "orders", "lineitem")
    h = _headers(orders, li)
    details = li.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    changes = li.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)) \
                .select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    new_h, _ = X.delete_details(h, details, changes, ["o_orderkey", "l_linenumber"], "o_orderkey", "o_custkey",
                                "qty", "l_quantity")
    return new_h.withColumn("qty", F.round("qty", 2))


@query("i53_first_receipt_release", f"""
WITH r AS (SELECT l_orderkey AS o_orderkey, l_partkey AS style, l_suppkey AS receiver, CAST(l_linenumber % 3 AS BIGINT) AS shape,
    CASE WHEN l_returnflag <> 'N' THEN l_linestatus END AS color, CASE WHEN l_quantity > 45 THEN 'VP' || l_suppkey END AS pack
  FROM lineitem WHERE l_shipdate <= DATE '2001-08-01'),
one AS (SELECT DISTINCT o_orderkey, style, shape, pack, CASE WHEN pack IS NULL THEN color END AS color
  FROM (SELECT o_orderkey, style, shape, pack, CASE WHEN pack IS NULL THEN color END AS color, receiver, COUNT(*) AS n
        FROM r WHERE coalesce(receiver, 0) <> 0 GROUP BY 1, 2, 3, 4, 5, 6) WHERE n = 1),
li AS (SELECT l.l_orderkey AS o_orderkey, l.l_linenumber, l.l_partkey AS style, CAST(l.l_linenumber % 3 AS BIGINT) AS shape,
    CASE WHEN l_returnflag <> 'N' THEN l_linestatus END AS color, CASE WHEN l_quantity > 45 THEN 'VP' || l_suppkey END AS pack,
    {_STATUS_SQL} AS status_code FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT li.o_orderkey, li.l_linenumber, li.status_code AS was, li.status_code = 50 AS approved_first, 40 AS status_code FROM li
WHERE status_code IN (30, 50) AND EXISTS (SELECT 1 FROM one WHERE one.o_orderkey = li.o_orderkey AND one.style = li.style
  AND one.shape = li.shape AND one.pack IS NOT DISTINCT FROM li.pack
  AND one.color IS NOT DISTINCT FROM CASE WHEN li.pack IS NULL THEN li.color END)""")
def i53(spark, d):
    """Shipped line items are the receipts: the supplier stands for the receiver, the line number's class for
    the shape, and line status and large quantities for colours and vendor packs that may be null."""
    orders, li = tables(spark, d, "orders", "lineitem")
    rows = li.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("style"),
                     F.col("l_suppkey").alias("receiver"), (F.col("l_linenumber") % 3).cast("long").alias("shape"),
                     F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")).alias("color"),
                     F.when(F.col("l_quantity") > 45, F.concat(F.lit("VP"), F.col("l_suppkey").cast("string"))).alias("pack"),
                     "l_shipdate")
    receipts = rows.where(F.col("l_shipdate") <= F.lit(AS_OF))
    lines = rows.join(orders.select("o_orderkey", _status().alias("status_code")), "o_orderkey")
    out = X.first_receipts(receipts, lines, ["o_orderkey", "style", "shape"], "color", "pack", "receiver")
    return out.select("o_orderkey", "l_linenumber", "was", "approved_first", "status_code")


# --- null key parts and null values, derived from the driver tables ------------------

_NULLS_SQL = """t AS (SELECT p_partkey % 500 AS k, CASE WHEN p_size % 5 <> 0 THEN p_partkey END AS part, p_brand AS v,
    CASE WHEN p_size % 3 <> 0 THEN 'own' END AS note FROM part WHERE p_size > 10),
s AS (SELECT p_partkey % 500 AS k, CASE WHEN p_size % 5 <> 0 THEN p_partkey END AS part,
    CASE WHEN p_size % 7 <> 0 THEN lower(p_brand) END AS v FROM part WHERE p_retailprice > 950)"""


def _null_sides(spark, d):
    (p,) = tables(spark, d, "part")
    key = [(F.col("p_partkey") % 500).alias("k"), F.when(F.col("p_size") % 5 != 0, F.col("p_partkey")).alias("part")]
    t = p.where(F.col("p_size") > 10).select(*key, F.col("p_brand").alias("v"),
                                             F.when(F.col("p_size") % 3 != 0, F.lit("own")).alias("note"))
    s = p.where(F.col("p_retailprice") > 950).select(*key, F.when(F.col("p_size") % 7 != 0, F.lower("p_brand")).alias("v"))
    return t, s


@query("i26b_merge_null_key_parts", f"""
WITH {_NULLS_SQL}
SELECT k, part, v FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = t.k AND s.part = t.part)
UNION ALL SELECT k, part, v FROM s""")
def i26b(spark, d):
    t, s = _null_sides(spark, d)
    return X.merge_upsert(t.drop("note"), s, ["k", "part"])


@query("i27b_set_sync_keeps_nulls", f"""
WITH {_NULLS_SQL}
SELECT s.k, s.part, s.v, CASE WHEN t.k IS NOT NULL THEN t.note ELSE 'new' END AS note
FROM s LEFT JOIN t ON s.k = t.k AND s.part = t.part""")
def i27b(spark, d):
    t, s = _null_sides(spark, d)
    return X.sync_set(t, s, ["k", "part"], ["v"], {"note": "new"})


@query("i28c_update_from_null_key_parts", f"""
WITH {_NULLS_SQL}
SELECT t.k, t.part, CASE WHEN s.k IS NOT NULL THEN s.v ELSE t.v END AS v, t.note
FROM t LEFT JOIN s ON s.k = t.k AND s.part = t.part""")
def i28c(spark, d):
    t, s = _null_sides(spark, d)
    return X.update_from(t, s, ["k", "part"], ["v"])


@query("i29b_resync_null_key_parts", """
WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p.p_brand, '?') AS l_brand,
    CASE WHEN l_returnflag <> 'N' THEN l_linestatus END AS color FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey),
c AS (SELECT *, COUNT(*) OVER (PARTITION BY l_orderkey, l_brand, color) AS n FROM j)
SELECT l_orderkey, l_linenumber, l_brand, color, CASE WHEN n = 1 THEN 'line' ELSE 'audit' END AS target FROM c""")
def i29b(spark, d):
    """The colour is part of the new key and null for many lines: no line falls out of both outputs."""
    li, part = tables(spark, d, "lineitem", "part")
    lines = li.select("l_orderkey", "l_linenumber", "l_partkey", F.lit("?").alias("l_brand"),
                      F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")).alias("color"))
    items = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("l_brand"))
    ok, clash = X.resync_hierarchy(lines, items, "l_partkey", ["l_brand"], ["l_orderkey", "l_brand", "color"])
    both = ok.withColumn("target", F.lit("line")).unionByName(clash.drop("collisions").withColumn("target", F.lit("audit")))
    return both.select("l_orderkey", "l_linenumber", "l_brand", "color", "target")
