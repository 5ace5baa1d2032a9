"""Two large copies compared by digests (I7, I8, I48): only buckets that differ are joined.

A table's rows are dealt into buckets by a hash of the key; a bucket's digest is its row count and two sums of row hashes,
which do not depend on the order of the rows. Digests form a tree, each node the sum of its ``fan`` children, stored with
the table it describes. Two tables are compared from the root: only children of nodes that differ are looked at, and only
the rows of leaf buckets that differ are joined. Equal copies cost the digests alone, which are kept from the day the
copy was made. Rows that differ and give the same two 64-bit sums would be passed over; that is a matter of chance.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import checked_broadcast
from ..session import store
from .history import deal


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def digest_tree(df: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None, buckets: int = 4096,
                fan: int = 16, path: str | None = None) -> DataFrame:
    """(level, node, n_rows, sum1, sum2): the digests of ``df``, level 0 the leaf buckets; stored at ``path`` if given.

    ``cols`` are the columns that count besides the keys (none: the keys alone). Compare only columns of one type and
    name; null is a value. The table is read once; the sums are partial on the map side.
    """
    row = [*keys, *(cols or [])]
    nulls = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in row])
    one, two = (F.xxhash64(F.lit(seed), nulls, *row).cast("decimal(38,0)") for seed in (1, 2))

    def add(rows, node):
        return rows.groupBy(node.alias("node")).agg(F.sum("n_rows").alias("n_rows"), F.sum("sum1").cast("decimal(38,0)").alias("sum1"),
                                                    F.sum("sum2").cast("decimal(38,0)").alias("sum2"))

    level = add(df.select(bucket_of(keys, buckets).alias("_b"), F.lit(1).cast("long").alias("n_rows"), one.alias("sum1"),
                          two.alias("sum2")), F.col("_b"))
    level = store(level, "digest-leaves")
    out, size, at = level.withColumn("level", F.lit(0)), buckets, 0
    while size > 1:
        size, at = -(-size // fan), at + 1
        level = add(level, F.floor(F.col("node") / fan).cast("int"))
        out = out.unionByName(level.withColumn("level", F.lit(at)))
    out = out.select("level", "node", "n_rows", "sum1", "sum2")
    if path:
        out.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)
    return store(out, "digests")


def differing_buckets(a: DataFrame, b: DataFrame, fan: int = 16) -> DataFrame:
    """The leaf buckets (``node``) in which two trees of the same shape differ, found from the root downwards."""
    top = a.agg(F.max("level")).first()[0]
    other = b.agg(F.max("level")).first()[0]
    top = max(top or 0, other or 0)
    nodes = None
    for level in range(top, -1, -1):
        x, y = (t.where(F.col("level") == level).drop("level") for t in (a, b))
        if nodes is not None:
            child = F.floor(F.col("node") / fan).cast("int")
            x, y = (t.withColumn("_up", child).join(nodes, "_up", "left_semi").drop("_up") for t in (x, y))
        y = y.select(F.col("node").alias("_n"), *[F.col(c).alias(f"_{c}") for c in ("n_rows", "sum1", "sum2")])
        same = (F.col("n_rows").eqNullSafe(F.col("_n_rows")) & F.col("sum1").eqNullSafe(F.col("_sum1"))
                & F.col("sum2").eqNullSafe(F.col("_sum2")))
        found = x.join(y, F.col("node") == F.col("_n"), "full_outer").where(~same).select(
            F.coalesce("node", "_n").alias("node" if level == 0 else "_up"))
        nodes = store(found, "digest-differs")
    return nodes


def only_differing(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None,
                   buckets: int = 4096, fan: int = 16, trees: tuple[DataFrame, DataFrame] | None = None,
                   ) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables that stand in buckets that differ; ``trees`` are their stored digests, if there are.

    Both come dealt by key in the same way, into tasks of a bounded number of rows, which the digests tell beforehand.
    """
    ta, tb = trees or (digest_tree(a, keys, cols, buckets, fan), digest_tree(b, keys, cols, buckets, fan))
    nodes = differing_buckets(ta, tb, fan).select(F.col("node").alias("_b"))
    leaves = ta.where("level = 0").unionByName(tb.where("level = 0"))
    rows = leaves.join(nodes, F.col("node") == F.col("_b"), "left_semi").agg(F.sum("n_rows")).first()[0] or 0

    def part(df):
        some = df.withColumn("_b", bucket_of(keys, buckets)).join(checked_broadcast(nodes), "_b", "left_semi").drop("_b")
        return deal(some, keys, int(rows))

    return part(a), part(b)


def by_digest(compare: Callable[..., DataFrame], a: DataFrame, b: DataFrame, keys: Sequence[str],
              cols: Sequence[str] | None = None, buckets: int = 4096, fan: int = 16,
              trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``compare(a, b)`` over the buckets that differ. ``compare`` must return nothing for equal rows, as
    ``compare`` with mismatches only and ``reconcile`` do; then the rows are those of the whole comparison."""
    return compare(*only_differing(a, b, keys, cols, buckets, fan, trees))
