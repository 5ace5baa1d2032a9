"""Queries over stored upkeep: nested sets, the history log, level tables kept by deltas, copies compared by digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import audits, digests, nested
from ..plans.historylog import HistoryLog
from ..plans.keyblocks import KeyBlocks
from ..plans.levels import LevelTables
from ..session import scratch_path
from .history_q import _SQL_BASE, CURRENT, KEYS, _monthly
from .registry import query, tables

_SETS_SQL = """p AS (SELECT p_partkey::BIGINT AS k, (p_size % 3 + 1)::BIGINT AS q FROM part),
e AS (SELECT a.k AS set_sku, b.k AS sku, a.q AS qty FROM p a JOIN p b ON b.k IN (2 * a.k, 2 * a.k + 1, 3 * a.k) WHERE a.k > 0)"""


def _sets(part):
    """A part's components are the parts of twice its key, that plus one, and three times its key."""
    p = part.select(F.col("p_partkey").cast("long").alias("set_sku"), (F.col("p_size") % 3 + 1).cast("long").alias("qty"))
    k = F.col("set_sku")
    return p.where("set_sku > 0").select("set_sku", F.explode(F.array_distinct(F.array(2 * k, 2 * k + 1, 3 * k))).alias("sku"), "qty").join(
        p.select(k.alias("sku")), "sku", "left_semi").select("set_sku", "sku", "qty")


@query("i10b_nested_sets", f"""
WITH RECURSIVE {_SETS_SQL},
r AS (SELECT set_sku, sku, qty, 1 AS depth FROM e
      UNION ALL SELECT r.set_sku, e.sku, r.qty * e.qty, depth + 1 FROM r JOIN e ON r.sku = e.set_sku)
SELECT set_sku, sku, sum(qty)::BIGINT AS qty, min(depth)::INT AS depth FROM r GROUP BY set_sku, sku""")
def i10b(spark, d):
    (part,) = tables(spark, d, "part")
    return nested.explode_nested(_sets(part), "set_sku", "sku", "qty")[0]


@query("i10c_set_cycles", """
WITH RECURSIVE p AS (SELECT p_partkey::BIGINT AS k FROM part),
e AS (SELECT k AS set_sku, CASE WHEN k % 5 = 4 THEN k - 4 ELSE k + 1 END AS sku FROM p WHERE k % 5 <> 4 OR k % 10 = 9),
r AS (SELECT set_sku, sku FROM e UNION SELECT r.set_sku, e.sku FROM r JOIN e ON r.sku = e.set_sku)
SELECT e.set_sku, e.sku, 1::BIGINT AS qty FROM e JOIN r ON r.set_sku = e.sku AND r.sku = e.set_sku""")
def i10c(spark, d):
    """Every second run of five parts is closed to a circle."""
    (part,) = tables(spark, d, "part")
    k = F.col("set_sku")
    e = part.select(F.col("p_partkey").cast("long").alias("set_sku")).where((k % 5 != 4) | (k % 10 == 9)).select(
        "set_sku", F.when(k % 5 == 4, k - 4).otherwise(k + 1).alias("sku"), F.lit(1).cast("long").alias("qty"))
    return nested.explode_nested(e, "set_sku", "sku", "qty")[1]


def _log(spark, d, roll=0):
    monthly = _monthly(spark, d).withColumn("period", (F.col("yr") * 12 + F.col("mo")).cast("long"))
    log = HistoryLog(spark, scratch_path(spark, "history-log"), KEYS, ["qty"])
    log.create(monthly, CURRENT["yr"] * 12 + CURRENT["mo"])
    log.load(monthly.where("yr < 2001"))
    log.load(monthly.where("yr >= 2001"))
    if roll:
        log.roll(roll)
    return log


@query("i21e_log_roll_60_weeks", f"""
WITH {_SQL_BASE}
SELECT l_partkey, l_suppkey, CAST(week_ago + 60 AS INTEGER) AS week_ago, round(qty, 2) AS value FROM s WHERE week_ago + 60 <= 104 AND qty <> 0""")
def i21e(spark, d):
    """As i21c: the roll moves one number, values older than the window are passed over."""
    return _log(spark, d, 60).slots().where("qty <> 0").select(
        *KEYS, F.col("slot").alias("week_ago"), F.round("qty", 2).alias("value"))


@query("i21f_log_prune_60_weeks", f"""
WITH {_SQL_BASE}
SELECT l_partkey, l_suppkey FROM s WHERE qty <> 0 GROUP BY 1, 2 HAVING MIN(week_ago) <= 45""")
def i21f(spark, d):
    """As i21d: the keys that sixty weekly prune tests leave, by the last period of each."""
    return _log(spark, d, 60).alive()


_LEVEL_SQL = """j AS (SELECT l_suppkey, s_nationkey, n_regionkey, CASE WHEN l_linenumber = 1 THEN l_quantity + 1 ELSE l_quantity END AS q
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE NOT (l_returnflag = 'R' AND l_linenumber <> 1))"""


@query("d12b_levels_by_deltas", f"""
WITH {_LEVEL_SQL}
SELECT 'supplier' AS level, l_suppkey::BIGINT AS level_key, count(*)::BIGINT AS n_rows, round(sum(q), 2) AS quantity FROM j GROUP BY 2
UNION ALL SELECT 'nation', s_nationkey::BIGINT, count(*)::BIGINT, round(sum(q), 2) FROM j GROUP BY 2
UNION ALL SELECT 'region', n_regionkey::BIGINT, count(*)::BIGINT, round(sum(q), 2) FROM j GROUP BY 2""")
def d12b(spark, d):
    """Levels of all lines; then first lines get one more each, and returned other lines go."""
    li, supp, nation = tables(spark, d, "lineitem", "supplier", "nation")
    rows = li.join(supp, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    keys = [("supplier", ["l_suppkey", "s_nationkey", "n_regionkey"]), ("nation", ["s_nationkey", "n_regionkey"]),
            ("region", ["n_regionkey"])]
    t = LevelTables(spark, scratch_path(spark, "levels"), keys, ["l_quantity"])
    t.create(rows)
    first = F.col("l_linenumber") == 1
    t.apply(rows.where(first | (F.col("l_returnflag") == "R")),
            rows.where(first).withColumn("l_quantity", F.col("l_quantity") + 1))
    return reduce(DataFrame.unionByName, [t.read(n).select(
        F.lit(n).alias("level"), F.col(k[0]).cast("long").alias("level_key"), "n_rows",
        F.round(F.col("l_quantity").cast("double"), 2).alias("quantity")) for n, k in keys])


_COPY_SQL = """b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 991 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
  FROM orders WHERE o_orderkey % 997 <> 0)"""


def _copies(spark, d):
    """Orders, and a copy that lacks some and holds other prices for some."""
    (orders,) = tables(spark, d, "orders")
    a = orders.select("o_orderkey", "o_custkey", "o_totalprice")
    price = F.when(F.col("o_orderkey") % 991 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return a, a.where(F.col("o_orderkey") % 997 != 0).withColumn("o_totalprice", price)


@query("i7b_compare_by_digest", f"""
WITH {_COPY_SQL}
SELECT a.o_orderkey, a.o_custkey AS a_o_custkey, a.o_totalprice AS a_o_totalprice, b.o_custkey AS b_o_custkey,
  b.o_totalprice AS b_o_totalprice, 'Y' AS o_custkey_match, 'N' AS o_totalprice_match
FROM orders a JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_totalprice <> b.o_totalprice""")
def i7b(spark, d):
    a, b = _copies(spark, d)
    fields = ["o_custkey", "o_totalprice"]
    return digests.by_digest(lambda x, y: audits.compare(x, y, ["o_orderkey"], fields), a, b, ["o_orderkey"], fields)


@query("i8b_reconcile_by_digest", f"""
WITH {_COPY_SQL}
SELECT o_orderkey, 'B' AS missing_from FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)""")
def i8b(spark, d):
    a, b = _copies(spark, d)
    return digests.by_digest(lambda x, y: audits.reconcile(x, y, ["o_orderkey"]), a, b, ["o_orderkey"])


@query("i32b_reserved_key_blocks", """
WITH c AS (SELECT c_custkey AS entity, 1 AS batch FROM customer UNION ALL SELECT s_suppkey, 2 FROM supplier)
SELECT batch, CAST((SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY batch, entity) AS BIGINT) AS new_key FROM c""")
def i32b(spark, d):
    """Keys for two batches of new rows, the first run twice: customers get one range, suppliers the next."""
    cust, supp, orders = tables(spark, d, "customer", "supplier", "orders")
    blocks = KeyBlocks(spark, scratch_path(spark, "key-blocks"), orders.agg(F.max("o_orderkey")).first()[0] + 1)
    first = cust.select(F.col("c_custkey").alias("entity"), F.lit(1).alias("batch"))
    blocks.assign(first, "customers", "new_key")
    out = blocks.assign(supp.select(F.col("s_suppkey").alias("entity"), F.lit(2).alias("batch")), "suppliers", "new_key")
    return blocks.assign(first, "customers", "new_key").unionByName(out).select("batch", "new_key")
