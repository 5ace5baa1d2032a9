"""Queries over tables changed file by file (I25, I26, I37, I47): the driver tables are put under a commit log in the
shared folder, changed there, and read through the newest commit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import changes as X
from ..session import scratch_path
from ..sources.filetables import FileTables
from .changes_q import _CH_SQL, _user_state
from .registry import query, tables


@query("i25d_apply_changes_by_file", f"""
WITH {_CH_SQL}
SELECT user_id, balance, last_type FROM m WHERE last_del IS NULL OR NOT last_del""")
def i25d(spark, d):
    target, changes = _user_state(spark, d)
    t = FileTables(spark, scratch_path(spark, "user-files"))
    t.create("users", target, cluster="user_id")
    t.apply_changes("users", changes, "user_id", mode="last")
    return t.read("users")


@query("i26c_merge_by_file", """
WITH src AS (SELECT user_id AS c_custkey, arg_max(value, event_id) AS c_acctbal FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM src)
UNION ALL SELECT c_custkey, c_acctbal FROM src""")
def i26c(spark, d):
    cust, ev = tables(spark, d, "customer", "events")
    src = (ev.where(F.col("event_type") == "purchase").groupBy(F.col("user_id").alias("c_custkey"))
             .agg(F.max_by("value", "event_id").alias("c_acctbal")))
    t = FileTables(spark, scratch_path(spark, "customer-files"))
    t.create("customer", cust.select("c_custkey", "c_acctbal"), cluster="c_custkey")
    t.merge_upsert("customer", src, "c_custkey")
    return t.read("customer")


@query("i47b_update_reads_old_row", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 0 ELSE l_quantity END AS l_quantity,
  CASE WHEN l_quantity > 45 THEN l_linestatus ELSE l_returnflag END AS l_returnflag,
  CASE WHEN l_quantity > 45 THEN l_returnflag ELSE l_linestatus END AS l_linestatus
FROM lineitem WHERE NOT (l_orderkey <= 100 AND l_linenumber = 2)""")
def i47b(spark, d):
    """The update sets the column of its own condition and exchanges two columns; the delete touches few files."""
    (li,) = tables(spark, d, "lineitem")
    t = FileTables(spark, scratch_path(spark, "lineitem-files"))
    t.create("lineitem", li.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"),
             cluster="l_orderkey")
    t.update_where("lineitem", F.col("l_quantity") > 45,
                   {"l_quantity": F.lit(0), "l_returnflag": F.col("l_linestatus"), "l_linestatus": F.col("l_returnflag")})
    t.delete_where("lineitem", (F.col("l_orderkey") <= 100) & (F.col("l_linenumber") == 2))
    return t.read("lineitem")


_GRAPH_SQL = """cust AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0),
ord AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM cust) OR o_orderstatus = 'P')"""


@query("i37c_purge_graph", f"""
WITH {_GRAPH_SQL},
o2 AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ord))
SELECT 'customer' AS table_name, c_custkey::BIGINT AS k1, 0::BIGINT AS k2 FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM cust)
UNION ALL SELECT 'orders', o_orderkey::BIGINT, o_custkey::BIGINT FROM o2
UNION ALL SELECT 'lineitem', l_orderkey::BIGINT, l_linenumber::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM ord)
UNION ALL SELECT 'events', event_id::BIGINT, user_id::BIGINT FROM events
  WHERE user_id NOT IN (SELECT c_custkey FROM cust WHERE c_custkey > 10)
UNION ALL SELECT 'open_customers', o_custkey::BIGINT, n::BIGINT FROM
  (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) WHERE o_custkey IN (SELECT o_custkey FROM o2)""")
def i37c(spark, d):
    """Customers in debt and open orders go; their orders, those orders' lines, and the customers' events (for keys
    above 10) go with them; the count of orders per customer loses the customers without an order left."""
    cust, orders, li, ev = tables(spark, d, "customer", "orders", "lineitem", "events")
    t = FileTables(spark, scratch_path(spark, "purge-files"))
    t.create("customer", cust.select("c_custkey", "c_acctbal"), cluster="c_custkey")
    t.create("orders", orders.select("o_orderkey", "o_custkey", "o_orderstatus"), cluster="o_orderkey")
    t.create("lineitem", li.select("l_orderkey", "l_linenumber"), cluster="l_orderkey")
    t.create("events", ev.select("event_id", "user_id"), cluster="user_id")
    t.create("open_customers", orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), cluster="o_custkey")
    X.purge_graph(
        t, {"customer": cust.where("c_acctbal < 0").select("c_custkey"),
            "orders": orders.where("o_orderstatus = 'P'").select("o_orderkey")},
        [("customer", "orders", [("c_custkey", "o_custkey")], None),
         ("orders", "lineitem", [("o_orderkey", "l_orderkey")], None),
         ("customer", "events", [("c_custkey", "user_id")], F.col("c_custkey") > 10)],
        [("orders", "open_customers", [("o_custkey", "o_custkey")])])
    keys = {"customer": ("c_custkey", F.lit(0)), "orders": ("o_orderkey", "o_custkey"), "lineitem": ("l_orderkey", "l_linenumber"),
            "events": ("event_id", "user_id"), "open_customers": ("o_custkey", "n")}
    out = None
    for name, (k1, k2) in keys.items():
        k2 = F.col(k2) if isinstance(k2, str) else k2
        part = t.read(name).select(F.lit(name).alias("table_name"), F.col(k1).cast("long").alias("k1"),
                                   k2.cast("long").alias("k2"))
        out = part if out is None else out.unionByName(part)
    return out
