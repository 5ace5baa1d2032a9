"""Source divergence audit: how far the term shares of the sources of a language lie apart.

Every language keeps the terms found in at least ``least`` of its documents. Its term ids are dealt by hash into
blocks of some ``leaves`` ids; within a block they go by falling count, so that the rare tails of different sources
look alike. For each block a task builds one segment tree per source over the counts of the block's ids, hash-consed:
equal leaves, and nodes of equal children, are one node, whatever source or place they stand in. Two sources are
compared by a simultaneous walk of their trees, which keeps a price for each pair of nodes and so prices equal pairs
once; the same walk against the language's own tree finds the terms that a source uses more than its language. A
source's tree over all ids is the row of its block trees, and Spark adds up the blocks. Sources are dealt in tiles too,
so that a task holds two tiles of sources and one block of terms, whatever a language has of either.

Nulls and edges: null text, lang and source count as ''; a source without kept terms, and a language without any, take
part with counts of zero; repeated rows count each time; a very long text is one document like any other; equal values
rank by the UTF-8 bytes of the item; an empty table gives an empty result; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_TABLE, map_arrow, stage_table, text_or_empty

UNIT, PRIOR = 1_000_000_000, 5
# As WORD_TABLE, but digits part terms too.
LETTERS = bytes(32 if 48 <= b <= 57 else t for b, t in enumerate(WORD_TABLE))
PARTIAL = "lang string, source string, part string, item string, value long"


def term_counts(docs: DataFrame, flush: int = 1 << 19) -> DataFrame:
    """(lang, source, term, tf, df) of the terms in each group's documents, added up in the tasks first."""
    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out():
            rows = [(lang, source, t.decode("utf-8", "replace"), n, in_docs[t])
                    for (lang, source), (in_all, in_docs) in held.items() for t, n in in_all.items()]
            held.clear()
            return dict(zip(("lang", "source", "term", "tf", "df"), zip(*rows) if rows else [()] * 5))

        for b in batches:
            for lang, source, text in zip(b["lang"], b["source"], b["text"]):
                words = text.encode("utf-8", "replace").translate(LETTERS).split()
                in_all, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                in_all.update(words)
                in_docs.update(set(words))
                if len(in_all) > flush:
                    yield out()
            if sum(len(c) for c, _ in held.values()) > flush:
                yield out()
        yield out()

    rows = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"),
                       text_or_empty().alias("text"))
    return map_arrow(rows, run, "lang string, source string, term string, tf long, df long").groupBy(
        "lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * kept)), exact for counts of any size."""
    if count.size and int(count.max()) > 9_000_000_000:
        return np.array([1 + UNIT * (int(c) + PRIOR) // (int(n) + PRIOR * kept) for c, n in zip(count, total)], np.int64)
    return 1 + UNIT * (count + PRIOR) // (total + PRIOR * kept)


class Forest:
    """Hash-consed segment trees, one per row of ``counts`` (trees x leaves, -1 where a leaf stands for no term)."""

    def __init__(self, counts: np.ndarray):
        self.values, at = np.unique(counts, return_inverse=True)
        at = at.reshape(counts.shape)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []  # of the nodes of each level above the leaves
        while at.shape[1] > 1:
            n = int(at.max()) + 1
            nodes, up = np.unique(at[:, ::2] * n + at[:, 1::2], return_inverse=True)
            self.children.append((nodes // n, nodes % n))
            at = up.reshape(at.shape[0], -1)
        self.roots = at[:, 0]

    def walk(self, a: np.ndarray, b: np.ndarray, leaf: Callable, join: Callable):
        """Simultaneous walk of the trees a[i] and b[i] for all i, each pair of nodes visited once for each i.

        ``leaf(i, counts of a, counts of b)`` prices pairs of leaves, ``join`` makes a node's price of its children's.
        Returns the price of every pair, and per level from the top the prices and where the children's prices stand.
        """
        pair, x, y = np.arange(len(a)), self.roots[a], self.roots[b]
        below = []
        for left, right in reversed(self.children):
            n = int(max(left.max(), right.max())) + 1
            keys = np.concatenate([(pair * n + left[x]) * n + left[y], (pair * n + right[x]) * n + right[y]])
            keys, to = np.unique(keys, return_inverse=True)
            below.append(to)
            pair, x, y = keys // (n * n), keys // n % n, keys % n
        price = leaf(pair, self.values[x], self.values[y])
        prices = [price]
        for to in reversed(below):
            price = join(price[to[:len(to) // 2]], price[to[len(to) // 2:]])
            prices.append(price)
        return price, prices[::-1], below


def compare_block(terms: list[bytes], totals: np.ndarray, counts: np.ndarray, sizes: np.ndarray, whole: int,
                  left: np.ndarray, right: np.ndarray, alone: np.ndarray, top: int, at_once: int = 1 << 20):
    """One block of a language: ``counts`` (sources x terms), ``sizes`` the sources' totals over all blocks.

    Returns (a, b, distance) for the pairs left[i], right[i], and (source, term, excess) for the sources ``alone``: the
    ``top`` terms of the block with the largest excess over the language's share.
    """
    kept, n_terms = whole[1], len(terms)
    order = sorted(range(n_terms), key=lambda t: (-totals[t], terms[t]))
    width = 1 << max(0, n_terms - 1).bit_length()
    grid = np.full((len(sizes) + 1, width), -1, np.int64)
    grid[:-1, :n_terms] = counts[:, order]
    grid[-1, :n_terms] = totals[order]
    sizes = np.append(sizes, whole[0])
    forest = Forest(grid)
    distance = np.zeros(len(left), np.int64)
    step = max(1, at_once // width)
    for i in range(0, len(left), step):
        a, b = left[i:i + step], right[i:i + step]

        def apart(pair, c, d):
            return np.where(c < 0, 0, np.abs(share(np.maximum(c, 0), sizes[a[pair]], kept)
                                             - share(np.maximum(d, 0), sizes[b[pair]], kept)))

        distance[i:i + step] = forest.walk(a, b, apart, np.add)[0]
    found = []
    place = np.empty(n_terms, np.int64)  # of a leaf's term among all terms by their bytes
    place[sorted(range(n_terms), key=lambda i: terms[order[i]])] = np.arange(n_terms)
    for i in range(0, len(alone), step):
        a = alone[i:i + step]
        b = np.full(len(a), len(sizes) - 1)

        def over(pair, c, d):
            return np.where(c <= 0, 0, share(np.maximum(c, 0), sizes[a[pair]], kept)
                            - share(np.maximum(d, 0), sizes[b[pair]], kept))

        _, prices, below = forest.walk(a, b, over, np.maximum)
        tree, node, leaf = np.arange(len(a)), np.arange(len(a)), np.zeros(len(a), np.int64)
        for price, to in zip(prices, below):  # only into subtrees that hold a term above the language's share
            on = price[node] > 0
            tree, node, leaf = tree[on], node[on], leaf[on]
            half = len(to) // 2
            tree, leaf = np.concatenate([tree, tree]), np.concatenate([2 * leaf, 2 * leaf + 1])
            node = np.concatenate([to[:half][node], to[half:][node]])
        excess = prices[-1][node]
        on = excess > 0
        tree, leaf, excess = tree[on], leaf[on], excess[on]
        by = np.lexsort((place[leaf], -excess, tree))
        tree, leaf, excess = tree[by], leaf[by], excess[by]
        rank = np.arange(len(tree)) - np.searchsorted(tree, tree)
        found += [(int(a[t]), order[x], int(e)) for t, x, e in zip(tree[rank < top], leaf[rank < top], excess[rank < top])]
    return distance, found


def audit(docs: DataFrame, least: int = 30, top: int = 50, leaves: int = 1024, tile: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: the distance of a source from each other source of its language over all kept terms. Part ``term``:
    the ``top`` terms by which a source's share exceeds its language's.
    """
    counts = stage_table(term_counts(docs), "divergence-counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("tf").alias("total"), F.sum("df").alias("df")).where(
        F.col("df") >= least).select("lang", "term", "total")
    vocabulary = stage_table(vocabulary, "divergence-terms")
    kept = stage_table(counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "tf"),
                       "divergence-kept")
    groups = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source")).distinct()
    sizes = groups.join(kept.groupBy("lang", "source").agg(F.sum("tf").alias("size")), ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("size", F.lit(0)).alias("size"))
    sizes = stage_table(sizes, "divergence-sources")
    langs = sizes.groupBy("lang").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).join(
        vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("whole")), "lang", "left").select(
        "lang", "tiles", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("whole", F.lit(0)).alias("whole"),
        F.greatest(F.lit(1), F.ceil(F.col("kept") / leaves)).cast("int").alias("blocks"))
    langs = stage_table(langs, "divergence-langs")

    def number(n):
        return F.sequence(F.lit(0), F.col(n) - 1)

    none = F.lit(None).cast("string")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    own = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile")
    # what a task of (lang, block, first tile, second tile) gets: its sources, its terms, and its counts
    heads = sizes.join(langs, "lang").select("lang", "tiles", F.explode(number("blocks")).alias("block"), own, "source",
                                             none.alias("term"), F.col("size").alias("n"))
    terms = vocabulary.join(langs, "lang").select("lang", "tiles", block, F.explode(number("tiles")).alias("tile"),
                                                  none.alias("source"), "term", F.col("total").alias("n"))
    cells = kept.join(langs, "lang").select("lang", "tiles", block, own, "source", "term", F.col("tf").alias("n"))
    rows = heads.unionByName(terms).unionByName(cells).withColumn("other", F.explode(number("tiles"))).select(
        "lang", "block", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "source",
        "term", "n").join(langs.select("lang", "kept", "whole"), "lang")

    def run(key, table):
        lang, _, a, b = (k.as_py() for k in key)
        r = table.to_pydict()
        sources = {s: (t, n) for s, w, t, n in zip(r["source"], r["term"], r["tile"], r["n"]) if w is None}
        names = sorted(sources)
        totals = {w.encode(): n for s, w, n in zip(r["source"], r["term"], r["n"]) if s is None}
        words = sorted(totals)
        at, column = {s: i for i, s in enumerate(names)}, {w: i for i, w in enumerate(words)}
        grid = np.zeros((len(names), len(words)), np.int64)
        for s, w, n in zip(r["source"], r["term"], r["n"]):
            if s is not None and w is not None:
                grid[at[s], column[w.encode()]] = n
        tiles = np.array([sources[s][0] for s in names], np.int64)
        left, right = np.nonzero((tiles[:, None] == a) & (tiles[None, :] == b))
        if a == b:
            left, right = left[left < right], right[left < right]
        alone = np.arange(len(names)) if a == b else np.zeros(0, np.int64)
        distance, found = compare_block(words, np.array([totals[w] for w in words], np.int64), grid,
                                        np.array([sources[s][1] for s in names], np.int64),
                                        (r["whole"][0], r["kept"][0]), left, right, alone, top)
        out = [(names[i], "pair", names[j], d) for i, j, d in zip(left, right, distance.tolist())]
        out += [(j, part, i, d) for i, part, j, d in out]
        out += [(names[i], "term", words[t].decode(), e) for i, t, e in found]
        cols = list(zip(*out)) if out else [()] * 4
        types = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.table([pa.array([lang] * len(out), pa.string()), *map(pa.array, cols, types)],
                        names=["lang", "source", "part", "item", "value"])

    partial = stage_table(rows.groupBy("lang", "block", "a", "b").applyInArrow(run, PARTIAL), "divergence-blocks")
    pairs = partial.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    over = partial.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(over)
