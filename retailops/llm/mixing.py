"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Token weights are summed to one cell per (source, language, topic) before anything else, so all
later work is on the cells. Raking scales the cells to each marginal in turn until all marginals
agree with their targets; each document is then kept with its cell's probability, scaled so that the
expected tokens equal the budget (a cell that would need more than all its tokens is taken whole, and
the others make up for it).

DataFrame operations only. Nulls and edges: a null source, language or topic is a value of its own; null and
empty texts have no tokens and are drawn with their cell's probability; repeated rows with one id share their draw;
rows with a null id draw by their text; an empty table gives an empty result; columns of the input are all
kept, and one named as an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table, text_or_empty


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from the text's shape: the first class that fits."""
    return (F.when(text.rlike(r"(?i)\blicen[cs]ed?\b"), "licensing").when(text.contains(" | "), "listing")
            .when(text.rlike(r"[#$%&*]{3}"), "noise").when(text.rlike(r"[0-9]{4}"), "records").otherwise("prose"))


def cells_of(docs: DataFrame, dims: Sequence[str], weight: str) -> DataFrame:
    return docs.groupBy(*dims).agg(F.sum(F.col(weight)).cast("double").alias("tokens"))


def by_key(cells: DataFrame, sums: DataFrame, dim: str) -> DataFrame:
    """``cells`` with the columns that ``sums`` holds for their value of ``dim``; nulls meet nulls."""
    key = sums.withColumnRenamed(dim, "_key")
    return cells.join(key, cells[dim].eqNullSafe(key["_key"])).drop("_key")


def targets_of(cells: DataFrame, dim: str, given: Mapping[str, float] | None, power: float) -> DataFrame:
    """(dim, target): given shares, others none; without them shares in proportion to tokens ** power.

    Only values that hold tokens take part; the shares sum to 1.
    """
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("_sum"))
    want = F.when(F.col("_sum") > 0, F.pow("_sum", F.lit(power))).otherwise(F.lit(0.0))
    if given is not None:
        want = F.lit(0.0)
        for value, share in given.items():
            want = F.when(F.col(dim).eqNullSafe(F.lit(value)) & (F.col("_sum") > 0),
                          F.lit(float(share))).otherwise(want)
    sums = sums.select(dim, want.alias("_want"))
    total = sums.agg(F.sum("_want")).first()[0] or 1.0
    return sums.select(dim, (F.col("_want") / F.lit(total)).alias(f"target_{dim}"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], sweeps: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """The cells with ``share``: their target part of all tokens, marginals fitted to ``tolerance``.

    A sweep scales the cells to each marginal in turn; marginals are aggregated and joined back, so a language that
    holds most cells costs a partial sum in each task. The cells are written after each sweep, and the largest
    deviation of a marginal, one number, decides on the next. Where no exact fit exists it ends after ``sweeps``.
    """
    dims = list(targets)
    for d in dims:
        cells = by_key(cells, targets[d], d)
    total = cells.agg(F.sum("tokens")).first()[0] or 1.0
    cells = stage_table(cells.withColumn("share", F.col("tokens") / F.lit(total)), "mixing-cells")
    last = F.lit(0.0)
    for _ in range(sweeps):
        worst = last
        for d in dims:
            have = cells.groupBy(d).agg(F.sum("share").alias("_have"))
            cells = by_key(cells, have, d)
            worst = F.greatest(worst, F.abs(F.col("_have") - F.col(f"target_{d}")))
            cells = cells.withColumns({
                "_off": worst, "share": F.when(F.col("_have") > 0, F.col("share") * F.col(f"target_{d}")
                                               / F.col("_have")).otherwise(F.lit(0.0))}).drop("_have")
            worst = F.col("_off")
        cells = stage_table(cells, "mixing-cells")
        if (cells.agg(F.max("_off")).first()[0] or 0.0) < tolerance:
            break
        cells = cells.drop("_off")
    return cells.drop("_off")


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """Adds ``probability``: min(1, c * share / tokens), c such that the expected tokens are ``budget`` of all.

    Each round takes the cells whole that would pass 1 and finds c from the others by one-row sums; a
    cell once whole stays whole, so the rounds end.
    """
    rate = F.when(F.col("tokens") > 0, F.col("share") / F.col("tokens")).otherwise(F.lit(0.0))
    want = (cells.agg(F.sum("tokens")).first()[0] or 0.0) * budget
    c, before = want, -1.0
    while c != before:
        whole = rate * F.lit(c) >= 1
        r = cells.agg(F.sum(F.when(whole, F.col("tokens"))).alias("whole"),
                      F.sum(F.when(~whole, F.col("share"))).alias("open")).first()
        if not r.open:
            break
        before, c = c, max(c, (want - (r.whole or 0.0)) / r.open)
    return cells.withColumn("probability", F.least(F.lit(1.0), rate * F.lit(c)))


def draw(*cols: Column, seed: int = 17) -> Column:
    """A repeatable number in [0, 1) from the columns."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def mix(docs: DataFrame, budget: float = 0.5, power: float = 0.7, topic: Column | None = None,
        targets: Mapping[str, Mapping[str, float]] | None = None, seed: int = 17, id_col: str = "doc_id",
        text_col: str = "text", dims: Sequence[str] = ("source", "lang", "topic")) -> DataFrame:
    """``docs`` with topic, tokens, probability, weight and sampled for every row.

    ``targets`` gives shares by dimension; a dimension without them gets tokens ** ``power``. ``budget`` is the part of
    all tokens to draw; ``weight`` is 1 / probability, null where a cell has no share.
    """
    text = text_or_empty(text_col)
    docs = docs.withColumns({"topic": topic_of(text) if topic is None else topic, "tokens": token_count(text)})
    cells = stage_table(cells_of(docs, dims, "tokens"), "mixing-cells")
    fitted = rake(cells, {d: targets_of(cells, d, (targets or {}).get(d), power) for d in dims})
    chance = calibrate(fitted, budget).select(*(F.col(d).alias(f"_{d}") for d in dims), "probability")
    docs = docs.drop("probability", "weight", "sampled")
    same = [docs[d].eqNullSafe(chance[f"_{d}"]) for d in dims]
    on = same[0]
    for x in same[1:]:
        on = on & x
    key = F.coalesce(F.col(id_col).cast("string"), F.sha2(text, 256))
    out = docs.join(chance, on, "left").drop(*(f"_{d}" for d in dims))
    return out.withColumns({"weight": F.when(F.col("probability") > 0, 1 / F.col("probability")),
                            "sampled": draw(key, seed=seed) < F.col("probability")})
