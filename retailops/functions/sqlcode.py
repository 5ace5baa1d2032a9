"""User code for SQL (section 2.10): functions that Spark SQL can call, and statements with column lists built at run time.

The functions are SQL functions of the session: the optimizer puts their bodies into the query, so a call costs what the
expression costs and filters through it reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Thirteen digits under the weights 3, 1, 3, ... from the left (fixed values of the code layout).
_WEIGHTED = " + ".join(f"try_cast(substr(g, {i}, 1) AS INT) * {3 if i % 2 else 1}" for i in range(1, 14))
# Work-line status names (fixed values of the allocation system).
_STATUS = {10: "AVAILABLE", 20: "IN PROGRESS", 25: "DISCREPANCY", 30: "APPROVED", 40: "RELEASED", 50: "UNAPPROVED"}

FUNCTIONS = {
    "item_check_digit": f"(g STRING) RETURNS STRING RETURN CAST(pmod(10 - pmod({_WEIGHTED}, 10), 10) AS STRING)",
    "item_swap_2_3": "(c STRING) RETURNS STRING RETURN substr(c, 1, 1) || substr(c, 3, 1) || substr(c, 2, 1) || substr(c, 4, 10)",
    "item_short_code": "(c STRING) RETURNS STRING RETURN item_swap_2_3(lpad(rtrim(c), 14, '0'))",
    "item_long_code": "(c STRING) RETURNS STRING RETURN item_swap_2_3(c) || item_check_digit(item_swap_2_3(c))",
    "nth_weekday": ("(yr INT, mo INT, dow INT, n INT) RETURNS DATE RETURN date_add(make_date(yr, mo, 1), "
                    "CAST(pmod(dow - dayofweek(make_date(yr, mo, 1)), 7) + 7 * (n - 1) AS INT))"),
    "status_name": "(s INT) RETURNS STRING RETURN CASE s " + " ".join(
        f"WHEN {k} THEN '{v}'" for k, v in _STATUS.items()) + " END",
    "may_release": "(s INT, n_open INT) RETURNS BOOLEAN RETURN s = 30 AND coalesce(n_open, 0) = 0",
}


def register_functions(spark: SparkSession, names: Sequence[str] | None = None) -> list[str]:
    """Make the functions callable from this session's SQL; one that calls another comes after it."""
    made = [n for n in FUNCTIONS if names is None or n in names]
    for n in made:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {n}{FUNCTIONS[n]}")
    return made


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def select_columns(spark: SparkSession, table: str, like: str, expression: str = "{c}") -> DataFrame:
    """Select the columns of ``table`` whose names match the SQL pattern ``like``, each through ``expression``.

    The column list is built from the table at run time and kept in a session variable; the statement is put together and
    run by EXECUTE IMMEDIATE. No matching column is an error.
    """
    import re
    pattern = re.compile("".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in like) + r"\Z", re.S)
    names = [c for c in spark.table(table).columns if pattern.match(c)]
    if not names:
        raise ValueError(f"{table} has no column like {like!r}")
    listed = ", ".join(f"{expression.replace('{c}', quoted(c))} AS {quoted(c)}" for c in names)
    spark.sql("DECLARE OR REPLACE VARIABLE column_list STRING")
    spark.sql("SET VAR column_list = :listed", args={"listed": listed})
    spark.sql("DECLARE OR REPLACE VARIABLE statement STRING")
    spark.sql("SET VAR statement = 'SELECT ' || column_list || ' FROM ' || :t", args={"t": quoted(table)})
    return spark.sql("EXECUTE IMMEDIATE statement")
