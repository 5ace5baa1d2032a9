"""Source and sink queries.

Writes go under the session's shared checkpoint folder (``spark.checkpoint.dir``),
each to a fresh path, and the query returns what was read back.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import tables as S
from ..sources.fixedwidth import register_fixed_width
from .registry import query, tables


@query("a1_read_table", "SELECT * FROM part")
def a1(spark, d):
    return S.read_table(spark, d, "part")


@query("a2_read_remote_join_locally", """
SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'P'""")
def a2(spark, d):
    (orders,) = tables(spark, d, "orders")
    remote_cust = S.read_remote(spark, d, "customer")  # second system: another root (or JDBC options)
    j = orders.where(F.col("o_orderstatus") == "P").join(remote_cust, F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_orderkey", "c_name")


@query("a3_snapshot", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_returnflag = 'R'""")
def a3(spark, d):
    (li,) = tables(spark, d, "lineitem")
    q = li.where(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return S.snapshot(q, scratch_path(spark, "a3"))


@query("a4_stage_then_join", """
WITH sold AS (SELECT l_partkey, SUM(l_quantity) AS qty FROM lineitem GROUP BY l_partkey)
SELECT p.p_partkey, p.p_brand, round(s.qty, 2) AS qty FROM part p JOIN sold s ON p.p_partkey = s.l_partkey""")
def a4(spark, d):
    li, part = tables(spark, d, "lineitem", "part")
    st = S.stage({"sold": li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty")),
                  "items": part.select("p_partkey", "p_brand")})
    j = st["items"].join(st["sold"], F.col("p_partkey") == F.col("l_partkey"))
    return j.select("p_partkey", "p_brand", F.round("qty", 2).alias("qty"))


@query("a5_full_refresh", """
SELECT 'nation' AS table_name, CAST(COUNT(*) AS BIGINT) AS n_rows FROM nation
UNION ALL SELECT 'region', COUNT(*) FROM region
UNION ALL SELECT 'supplier', COUNT(*) FROM supplier""")
def a5(spark, d):
    dst = scratch_path(spark, "a5")
    names = ["nation", "region", "supplier"]
    S.refresh(spark, d, dst, names)
    parts = [S.read_table(spark, dst, n).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(n))
             for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", "n_rows")


@query("a6_refresh_limited_to_keys", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')""")
def a6(spark, d):
    (orders,) = tables(spark, d, "orders")
    dst = scratch_path(spark, "a6")
    keys = orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    S.refresh(spark, d, dst, ["lineitem"], keep={"lineitem": (keys, ["l_orderkey"])})
    return S.read_table(spark, dst, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")


@query("a7_dated_archive_retention", """
SELECT *, DATE '2001-08-02' AS snapshot FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT *, DATE '2001-08-03' FROM orders WHERE o_orderstatus = 'P'""")
def a7(spark, d):
    """Orders archived under three daily stamps, retention 1 day: the oldest expires."""
    (orders,) = tables(spark, d, "orders")
    root = scratch_path(spark, "a7")
    day = _dt.date(2001, 8, 1)
    for i, status in enumerate(["F", "O", "P"]):
        out = S.archive(orders.where(F.col("o_orderstatus") == status), root, day + _dt.timedelta(days=i), keep_days=1)
    return out


@query("a8_backup_generations", """
SELECT *, 3 AS gen FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT *, 4 FROM orders WHERE o_orderstatus = 'F'""")
def a8(spark, d):
    """Four backups of the rows a purge would delete, keeping the last two generations."""
    (orders,) = tables(spark, d, "orders")
    root = scratch_path(spark, "a8")
    for status in ["F", "O", "P", "F"]:
        out = S.backup_generations(orders.where(F.col("o_orderstatus") == status), root, n=2)
    return out


@query("a9_csv_report_sink", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def a9(spark, d):
    (part,) = tables(spark, d, "part")
    path = scratch_path(spark, "a9")
    S.write_csv(part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), path)
    schema = "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double"
    return spark.read.schema(schema).option("header", True).csv(path)


FIXED_LAYOUT = [("p_partkey", 8, "num"), ("p_size", 3, "num"), ("price_cents", 9, "num"), ("p_type", 10, "text")]
PARSE_LAYOUT = [("key", 1, 8, "long"), ("size", 9, 3, "int"), ("cents", 12, 9, "long"), ("ptype", 21, 10)]


@query("a10_a11_fixed_width_round_trip", """
WITH f AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') || lpad(CAST(p_size AS VARCHAR), 3, '0')
          || lpad(CAST(CAST(round(p_retailprice * 100, 0) AS BIGINT) AS VARCHAR), 9, '0') || rpad(p_type, 10, ' ') AS record FROM part)
SELECT record, CAST(substr(record, 1, 8) AS BIGINT) AS key, CAST(substr(record, 9, 3) AS INTEGER) AS size,
       CAST(substr(record, 12, 9) AS BIGINT) AS cents, rtrim(substr(record, 21, 10)) AS ptype FROM f""")
def a10(spark, d):
    (part,) = tables(spark, d, "part")
    rec = part.select(S.format_fixed([("p_partkey", 8, "num"), ("p_size", 3, "num"),
                                      (F.round(F.col("p_retailprice") * 100, 0), 9, "num"),
                                      ("p_type", 10, "text")]).alias("record"))
    return S.parse_fixed(rec, "record", PARSE_LAYOUT, keep=["record"])


@query("a10b_fixed_width_source", """
SELECT p_partkey AS key, p_size AS size, CAST(round(p_retailprice * 100, 0) AS BIGINT) AS cents, p_type AS ptype FROM part""")
def a10b(spark, d):
    """The same records written and read through the data source."""
    (part,) = tables(spark, d, "part")
    register_fixed_width(spark)
    opts = {"path": scratch_path(spark, "a10b"), "layout": "key:1:8:long;size:9:3:int;cents:12:9:long;ptype:21:10"}
    rows = part.select(F.col("p_partkey").cast("long").alias("key"), F.col("p_size").cast("int").alias("size"),
                       F.round(F.col("p_retailprice") * 100, 0).cast("long").alias("cents"), F.col("p_type").alias("ptype"))
    rows.write.format("fixed_width").options(**opts).mode("append").save()
    return spark.read.format("fixed_width").options(**opts).load()


@query("a12_literal_rows_joined", """
WITH labels(p_brand, label) AS (VALUES ('Brand#1', 'house'), ('Brand#2', 'value'), ('Brand#3', 'premium'))
SELECT l.label, CAST(COUNT(*) AS BIGINT) AS n_parts FROM part p JOIN labels l ON p.p_brand = l.p_brand GROUP BY l.label""")
def a12(spark, d):
    (part,) = tables(spark, d, "part")
    labels = S.rows(spark, [("Brand#1", "house"), ("Brand#2", "value"), ("Brand#3", "premium")],
                    "p_brand string, label string")
    return part.join(F.broadcast(labels), "p_brand").groupBy("label").agg(F.count(F.lit(1)).alias("n_parts"))


# A long literal key list, built by rule: every fourth part key below 2,000 (500 keys).
KEY_LIST = list(range(0, 2000, 4))


@query("a13_long_literal_key_list", f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN ({", ".join(str(k) for k in KEY_LIST)})""")
def a13(spark, d):
    (li,) = tables(spark, d, "lineitem")
    return S.keys_in(li.select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", KEY_LIST)


@query("a14_seeded_sample", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
ORDER BY md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50""")
def a14(spark, d):
    """A repeatable sample of 50 line items (same rows under any partitioning)."""
    (li,) = tables(spark, d, "lineitem")
    return S.sample_rows(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), 50, seed=42)
