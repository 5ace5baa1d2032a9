"""Queries written in SQL only, with the session's functions and a column list built at run time (section 2.10)."""

from __future__ import annotations

from ..functions.sqlcode import register_functions, select_columns
from .registry import SQL, query, tables

_CODE14 = "lpad(CAST(p_partkey * 1000003 + 40000000000 AS STRING), 14, '0')"


def _twin(name):
    from . import columns_q  # noqa: F401  (its twins are registered on import)
    return SQL[name]


@query("i2b_code_conversion_in_sql", _twin("i2_code_conversion_round_trip"))
def i2b(spark, d):
    (part,) = tables(spark, d, "part")
    register_functions(spark)
    return spark.sql(f"""
WITH c AS (SELECT p_partkey, {_CODE14} AS code14 FROM {{part}})
SELECT p_partkey, code14, item_short_code(code14) AS code13, item_long_code(item_short_code(code14)) AS back14,
  substr(item_long_code(item_short_code(code14)), 1, 13) = substr(code14, 1, 13) AS prefix_round_trip FROM c""", part=part)


@query("i3b_check_digit_in_sql", _twin("i3_check_digit_zero_prefixes"))
def i3b(spark, d):
    (part,) = tables(spark, d, "part")
    register_functions(spark)
    return spark.sql("""
WITH a AS (SELECT p_partkey, substr(lpad(CAST(p_partkey * 7919 + CASE p_partkey % 10 WHEN 0 THEN 40000000000 WHEN 1 THEN 41000000000
  ELSE 0 END AS STRING), 13, '0'), 1, 13) AS g FROM {part})
SELECT p_partkey, g, CASE WHEN g LIKE '00400%' OR g LIKE '00410%' THEN '0' ELSE item_check_digit(g) END AS check_digit
FROM a""", part=part)


@query("h13b_nth_weekday_in_sql", _twin("h13_nth_weekday"))
def h13b(spark, d):
    (orders,) = tables(spark, d, "orders")
    register_functions(spark)
    return spark.sql("""
WITH y AS (SELECT DISTINCT year(o_orderdate) AS yr FROM {orders})
SELECT yr, nth_weekday(yr, 11, 5, 4) AS thanksgiving, nth_weekday(yr, 5, 1, 2) AS mothers_day FROM y""", orders=orders)


@query("i34b_status_rules_in_sql", """
SELECT CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'AVAILABLE' ELSE 'UNAPPROVED' END AS status,
  o_orderstatus = 'F' AND o_totalprice <= 100000 AS may_release, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2""")
def i34b(spark, d):
    (orders,) = tables(spark, d, "orders")
    register_functions(spark)
    return spark.sql("""
WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 10 ELSE 50 END AS st, CAST(o_totalprice > 100000 AS INT) AS n_open FROM {orders})
SELECT status_name(st) AS status, may_release(st, n_open) AS may_release, count(*) AS n FROM s GROUP BY 1, 2""",
                     orders=orders)


@query("u1_dynamic_column_list", """
SELECT lower(trim(CAST(o_orderkey AS VARCHAR))) AS o_orderkey, lower(trim(o_orderstatus)) AS o_orderstatus,
  lower(trim(o_orderpriority)) AS o_orderpriority FROM orders""")
def u1(spark, d):
    """The columns whose names start with o_order, but for the date, cleaned by one expression each."""
    (orders,) = tables(spark, d, "orders")
    orders.drop("o_orderdate").createOrReplaceTempView("orders_now")
    return select_columns(spark, "orders_now", "o_order%", "lower(trim({c}))")
