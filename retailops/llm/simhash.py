"""SimHash near duplicates: fingerprints linked at a small bit distance through BK-trees.

Every pair of fingerprints within ``radius`` bits agrees on at least one of ``radius + 1``
bit blocks, so each (block, value) bucket is a shard of its own. A task builds the BK-trees of its
shards (children keyed by their Hamming distance to the parent) and sends the shard's
fingerprints down the edges whose key lies within the radius of the distance at hand. A shard
of more than ``max_shard`` fingerprints is cut into pieces; each piece's tree of bounded size is
dealt to all pieces of queries, so no task holds an unbounded shard. A task reports a spanning
forest of the links it found, never all pairs of a group.

Nulls and edges: a null text has no words and fingerprint zero, as the empty text; rows with a
null id take part and get the smallest id of their component, null if it has none; repeated rows are
kept; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_counts, map_arrow, ranges, space_words, stage_table, text_or_empty

WORDS_AT_ONCE = 1 << 16


def simhash(words: list[bytes], k: int) -> int:
    """64-bit fingerprint, signed: a bit is set if over half the shingle hashes have it."""
    from xxhash import xxh64_intdigest

    n = len(words) - k + 1 if len(words) >= k else min(len(words), 1)
    if n == 0:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, WORDS_AT_ONCE):
        part = words[at:at + min(WORDS_AT_ONCE, n - at) + k - 1]
        shingles = zip(*(part[i:] for i in range(k))) if len(words) >= k else [part]
        h = np.array([xxh64_intdigest(b" ".join(s), 42) for s in shingles], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; ``fp`` is the fingerprint as a signed long."""
    def run(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "fp": [simhash(space_words(t), k) for t in b["text"]]}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")),
                     run, "doc_id long, fp long")


def build_trees(tree: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees over ``fp`` (unsigned), one for each value of ``tree`` (sorted), inserted in row order.

    Returns the root row of each row's tree, and the edges as sorted keys ``parent * 65 + distance``
    with the child rows in the same order. Each round places one level of all trees.
    """
    n = len(fp)
    first = np.r_[True, tree[1:] != tree[:-1]] if n else np.zeros(0, bool)
    root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
    rows = np.flatnonzero(~first)
    at, keys, children = root[rows], [], []
    while rows.size:
        key = at * 65 + np.bitwise_count(fp[rows] ^ fp[at])
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        keys.append(key[new])
        children.append(rows[new])
        at = rows[new][np.cumsum(new) - 1][~new]
        rows = rows[~new]
    if not keys:
        return root, np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key)
    return root, key[order], child[order]


def search_trees(fp: np.ndarray, queries: np.ndarray, roots: np.ndarray, keys: np.ndarray, children: np.ndarray,
                 radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, tree row) at ``radius`` bits or fewer: follows only edges keyed within the radius."""
    found_q, found_t = [], []
    q, node = queries, roots
    while q.size:
        d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
        hit = (d <= radius) & (q != node)
        found_q.append(q[hit])
        found_t.append(node[hit])
        lo = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0))
        hi = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), side="right")
        row, edge = ranges(lo, hi - lo)
        q, node = q[row], children[edge]
    return (np.concatenate(found_q), np.concatenate(found_t)) if found_q else (queries[:0], queries[:0])


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i] in place; a class is labelled by its smallest row."""
    while a.size:
        la, lb = label[a], label[b]
        apart = la != lb
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while not np.array_equal(up := label[label], label):
            label[:] = up


def shard_forest(cell: np.ndarray, fp: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int,
                 visits: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within each cell, as (fingerprint, smaller row's fingerprint)."""
    label = np.arange(len(fp))
    rows = np.flatnonzero(in_tree)
    root, keys, children = build_trees(cell[rows], fp[rows])
    keys = rows[keys // 65] * 65 + keys % 65 if keys.size else keys
    children = rows[children]
    cells, at, size = np.unique(cell[rows], return_index=True, return_counts=True)
    ask = np.flatnonzero(asks)
    place = np.searchsorted(cells, cell[ask])
    load = np.cumsum(size[place])
    start = 0
    while start < len(ask):
        done = load[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(load, done + visits, side="right")))
        part = slice(start, stop)
        join_labels(label, *search_trees(fp, ask[part], rows[root[at[place[part]]]], keys, children, radius))
        start = stop
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def links(classes: DataFrame, radius: int = 2, max_shard: int = 2048) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` whose closure is the whole link relation."""
    blocks = radius + 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = [F.lit(i).cast("long") * F.lit(1 << 40).cast("long") + F.shiftrightunsigned(
        F.shiftleft("fp", 64 - cuts[i + 1]), 64 - cuts[i + 1] + cuts[i]) for i in range(blocks)]
    if 64 // blocks > 39:  # one block: the bucket key is a hash, and a shared bucket costs time only
        keys = [F.xxhash64(F.lit(i), k) for i, k in enumerate(keys)]
    rows = classes.select("fp", F.explode(F.array(*keys)).alias("shard"))
    sizes = rows.groupBy("shard").count().where(F.col("count") > 1)
    sizes = stage_table(sizes.select("shard", F.ceil(F.col("count") / max_shard).cast("int").alias("pieces")),
                        "simhash-shards")
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    rows = (rows.join(sizes, "shard").withColumn("piece", piece)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
            .select("shard", F.least("piece", "other").alias("tree"), F.greatest("piece", "other").alias("ask"),
                    "piece", "fp"))

    def run(batches):
        held: list[np.ndarray] = []

        def flush(part):
            new = np.r_[True, (part[1:, :3] != part[:-1, :3]).any(1)]
            # bits are counted on unsigned numbers: numpy counts those of the absolute value otherwise
            a, b = shard_forest(np.cumsum(new) - 1, part[:, 4].astype(np.uint64), part[:, 3] == part[:, 1],
                                part[:, 3] == part[:, 2], radius)
            return {"a": a.view(np.int64), "b": b.view(np.int64)}

        for b in batches:
            new = np.array([b[c] for c in ("shard", "tree", "ask", "piece", "fp")], np.int64).T.reshape(-1, 5)
            held.append(new)
            if sum(map(len, held)) >= 1 << 16:
                part = np.concatenate(held)
                ends = np.flatnonzero((part[1:, :3] != part[:-1, :3]).any(1))
                if ends.size:
                    yield flush(part[:ends[-1] + 1])
                    part = part[ends[-1] + 1:]
                held = [part]
        if held and len(part := np.concatenate(held)):
            yield flush(part)

    dealt = rows.repartition(bucket_counts(classes.sparkSession), "shard", "tree", "ask")
    return map_arrow(dealt.sortWithinPartitions("shard", "tree", "ask", "fp"), run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of edges (a, b), root being the smallest node.

    Alternating large-star and small-star steps; each step's table is written, so a lost executor
    costs one step. Minima are aggregated and joined back, so a node with many neighbours is not
    gathered in one place.
    """
    def both(e):
        return e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def least(e):
        return e.groupBy("a").agg(F.min("b").alias("m"))

    def large(e):
        e = both(e)
        m = least(e).select("a", F.least("a", "m").alias("m"))
        return e.where("b > a").join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e):
        e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
        m = least(e)
        far = e.join(m, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return far.unionAll(m.select("a", F.col("m").alias("b")))

    def sign(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stage_table(edges.where("a <> b").select("a", "b").distinct(), "components")
    before = None
    while True:
        edges = stage_table(small(large(edges)).distinct(), "components")
        if (now := sign(edges)) == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 2, max_shard: int = 2048, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over links."""
    fps = stage_table(fingerprints(docs, k, id_col, text_col), "simhash")
    classes = stage_table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = connected(links(classes, radius, max_shard))
    of = roots.select(F.col("node").alias("fp"), "root").unionAll(
        roots.select(F.col("root").alias("fp"), "root").distinct())
    least = of.join(classes, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    moved = stage_table(of.join(least, "root").select("fp", F.col("component_id").alias("linked")), "simhash-moved")
    labels = classes.join(moved, "fp", "left").select("fp", F.coalesce("linked", "least").alias("component_id"))
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")
