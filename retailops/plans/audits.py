"""Audits and reconciliations.

An audit is a set of rows that should not exist; each is one declarative plan of
filters, equi joins and semi/anti joins, so the whole audit is a handful of shuffles
however many tables take part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import differs
from ..operators.joins import lacks, has


def code_table(df: DataFrame, table_id: str, pos: int, flag: str = "Y",
               id_col: str = "tbl_id", elem_col: str = "tbl_elem_id", text_col: str = "tbl_elem_text",
               id_len: int | None = None, filters: Column | None = None) -> DataFrame:
    """Element ids of a generic code table whose text has ``flag`` at ``pos``.

    Returns one column ``code`` (the first ``id_len`` characters of the element id
    when given). The result is small by nature (one row per code), but its size is
    left to the planner: it broadcasts it when the statistics allow.
    """
    cond = (F.col(id_col) == F.lit(table_id)) & (F.substring(F.col(text_col), pos, 1) == F.lit(flag))
    if filters is not None:
        cond = cond & filters
    code = F.col(elem_col) if id_len is None else F.substring(F.col(elem_col), 1, id_len)
    return df.where(cond).select(code.alias("code")).distinct()


def audit_missing(base: DataFrame, must_lack: Sequence[tuple[DataFrame, object]],
                  must_have: Sequence[tuple[DataFrame, object]] = ()) -> DataFrame:
    """Rows of ``base`` that lack every related row listed in ``must_lack``
    (and have the ones in ``must_have``): chained anti and semi joins."""
    out = base
    for other, on in must_have:
        out = has(out, other, on)
    for other, on in must_lack:
        out = lacks(out, other, on)
    return out


def child_count(base: DataFrame, child: DataFrame, on: Sequence[str], name: str = "n_children") -> DataFrame:
    """Number of child rows per base row, 0 when none (grouped, then left joined)."""
    cnt = child.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    return base.join(cnt, list(on), "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long"))


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str],
            a_prefix: str = "a_", b_prefix: str = "b_", only_mismatches: bool = True,
            null_safe: bool = True) -> DataFrame:
    """Field-by-field comparison of two systems on a shared key.

    Output: keys, both values of each field, a ``<field>_match`` flag ('Y'/'N'), and
    by default only rows where any field differs.
    """
    aa = a.select(*keys, *[F.col(f).alias(a_prefix + f) for f in fields])
    bb = b.select(*keys, *[F.col(f).alias(b_prefix + f) for f in fields])
    j = aa.join(bb, list(keys), "inner")
    for f in fields:
        same = F.col(a_prefix + f).eqNullSafe(F.col(b_prefix + f)) if null_safe \
            else (F.col(a_prefix + f) == F.col(b_prefix + f))
        j = j.withColumn(f + "_match", F.when(same, F.lit("Y")).otherwise(F.lit("N")))
    if only_mismatches:
        j = j.where(differs([a_prefix + f for f in fields], [b_prefix + f for f in fields], null_safe))
    return j


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], a_name: str = "A", b_name: str = "B",
              side_col: str = "missing_from") -> DataFrame:
    """I8: keys present on one side only, tagged with the side that lacks them.

    Two anti joins on the distinct keys, unioned; each is a shuffle on the key.
    """
    ka = a.select(*keys).distinct()
    kb = b.select(*keys).distinct()
    only_a = lacks(ka, kb, list(keys)).withColumn(side_col, F.lit(b_name))
    only_b = lacks(kb, ka, list(keys)).withColumn(side_col, F.lit(a_name))
    return only_a.unionByName(only_b)


def coverage_audit(expected: DataFrame, actual: DataFrame, keys: Sequence[str], status_col: str,
                   ok_statuses: Sequence, label_col: str = "problem") -> DataFrame:
    """Expected (item, place, division) rows against what the other system holds.

    Each expected key is classified: 'MISSING' (no actual row), 'BAD STATUS' (row
    with a status outside ``ok_statuses``), else dropped as fine.
    """
    act = actual.groupBy(*keys).agg(F.max(F.col(status_col).isin(list(ok_statuses)).cast("int")).alias("_ok"),
                                    F.min(status_col).alias(status_col))
    j = expected.join(act, list(keys), "left")
    label = (F.when(F.col("_ok").isNull(), F.lit("MISSING"))
              .when(F.col("_ok") == 0, F.lit("BAD STATUS")))
    return j.withColumn(label_col, label).where(F.col(label_col).isNotNull()).drop("_ok")


def error_report(errs: DataFrame, payload_col: str, layout: Sequence[tuple], code_col: str,
                 templates: Mapping[str, str], default_template: str = "{code}") -> DataFrame:
    """Parse the fixed-position payload, then a code-specific message.

    ``templates`` maps an error code to a message where ``{field}`` stands for a
    parsed field; the message is a CASE over codes built from ``concat``, no UDF.
    """
    from ..sources.tables import parse_fixed
    parsed = parse_fixed(errs, payload_col, layout, keep=errs.columns)
    import re

    def render(t: str) -> Column:
        pieces = re.split(r"(\{[a-z0-9_]+\})", t)
        cols = []
        for p in pieces:
            if not p:
                continue
            if p.startswith("{") and p.endswith("}"):
                nm = p[1:-1]
                cols.append(F.coalesce(F.col(code_col if nm == "code" else nm).cast("string"), F.lit("")))
            else:
                cols.append(F.lit(p))
        return F.concat(*cols)
    msg = None
    for code, t in templates.items():
        msg = F.when(F.col(code_col) == F.lit(code), render(t)) if msg is None \
            else msg.when(F.col(code_col) == F.lit(code), render(t))
    msg = render(default_template) if msg is None else msg.otherwise(render(default_template))
    return parsed.withColumn("message", msg)
