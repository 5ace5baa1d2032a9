"""Sets within sets (I10, G4): components of components, by iteration to a fixed point.

Each round joins only the rows found in the round before with the set table, multiplies the quantities, and adds up the
ways that meet at one component of one set, so a round holds a row for each pair of a set and a component at its depth,
however many ways lead there. Every round's table is stored: lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store


def set_cycles(sets: DataFrame, set_key: str, comp_key: str) -> DataFrame:
    """The distinct (set, component) pairs that lie on a cycle: the component holds the set, at some depth.

    Pairs whose component is no set, or whose set is no component, are peeled off round by round; what is left is closed
    under composition, new pairs only, and a pair is on a cycle if its reverse is in the closure.
    """
    core = store(sets.select(F.col(set_key).alias("a"), F.col(comp_key).alias("b")).dropna().distinct(), "sets-core")
    n = core.count()
    while n:
        core = store(core.join(core.select(F.col("a").alias("b")).distinct(), "b", "left_semi").join(
            core.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b"), "sets-core")
        before, n = n, core.count()
        if n == before:
            break
    reach = new = core
    while not new.isEmpty():
        step = new.join(core.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select(
            "a", F.col("c").alias("b")).distinct()
        new = store(step.join(reach, ["a", "b"], "left_anti"), "sets-reach")
        reach = store(reach.unionByName(new), "sets-closure")
    back = reach.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return core.join(back, ["a", "b"], "left_semi").select(F.col("a").alias(set_key), F.col("b").alias(comp_key))


def explode_nested(sets: DataFrame, set_key: str, comp_key: str, qty_col: str,
                   roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every set with all its components at every depth, and the rejected rows.

    Returns (``set_key``, ``comp_key``, ``qty_col``: how many of the component the set holds over all ways, ``depth``: the
    shortest way) and the rows of ``sets`` on a cycle, which are not followed. ``roots`` (its column ``set_key``) limits the
    sets that are exploded; by default all are. Several rows of one set and component add up; a row with a null key
    is neither exploded nor rejected.
    """
    on_cycle = store(set_cycles(sets, set_key, comp_key), "sets-cycles")
    edges = sets.dropna(subset=[set_key, comp_key]).join(on_cycle, [set_key, comp_key], "left_anti")
    edges = store(edges.groupBy(set_key, comp_key).agg(F.sum(qty_col).alias(qty_col)), "sets-edges")
    new = edges if roots is None else edges.join(roots.select(set_key).distinct(), set_key, "left_semi")
    inner = edges.select(F.col(set_key).alias(comp_key), F.col(comp_key).alias("_next"), F.col(qty_col).alias("_times"))
    levels = []
    while not levels or not new.isEmpty():
        levels.append(new.withColumn("depth", F.lit(len(levels) + 1)))
        new = store(new.join(inner, comp_key).groupBy(set_key, F.col("_next").alias(comp_key)).agg(
            F.sum(F.col(qty_col) * F.col("_times")).alias(qty_col)), "sets-level")
    found = reduce(DataFrame.unionByName, levels).groupBy(set_key, comp_key).agg(
        F.sum(qty_col).alias(qty_col), F.min("depth").alias("depth"))
    return found, sets.join(on_cycle, [set_key, comp_key], "left_semi").select(*sets.columns)
