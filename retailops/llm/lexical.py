"""Ranked lexical search by pair-bound MaxScore.

The index is cut into blocks of documents. A block stores, for every term of the queries' vocabulary, the list of its
documents with their impacts, the largest score and the ``top``-th largest; and for pairs of terms the intersection list
with the joint scores, their largest and ``top``-th largest. Terms outside the vocabulary cannot add to a score and have
no list. At query time the bounds are combined: a matching of the query's terms into stored pairs replaces the sum of two
term maxima by what both can give together, max(one, other, joint). Units that cannot reach the threshold together
are not essential: their lists propose no document. A task carries the threshold of each query from block to block; the
``top``-th largest of a list is a threshold before anything is scored.

The vocabulary and the queries go to the tasks in groups of about ``at_once`` query terms, one run over the documents
for each group, so a broadcast is bounded whatever the number of queries.

Nulls and edges: null and empty texts have no terms, and a query without terms no answers; every row of ``items`` is a
query of its own, ids null or repeated; repeated documents are ranked one by one; equal scores go by ascending doc_id,
a null id last; a very long text is one document; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, plain_words, stage_table, text_or_empty

SCALE, FLAT, SLOPE = 1_000_000_000, 1000, 20
BLOCK = ("doc_ids array<bigint>, terms binary, ends binary, docs binary, impacts binary, tops binary, floors binary, "
         "pairs binary, pair_ends binary, pair_docs binary, joints binary, pair_tops binary, pair_floors binary")
NONE = np.zeros(0, np.int64)


# Rows of the index are large: a row group, which is written and read as one, is one block however many a task makes. A
# dictionary would copy the values of a block, and statistics keep its smallest and largest until the file ends.
ONE_BLOCK = {"parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false",
             "parquet.column.statistics.enabled": "false"}


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within it, what is written reads Arrow batches of so many rows: texts, and blocks even more, are large rows.

    Column chunks are read piece by piece: vectored reads of local files copy whole chunks outside the heap, and each
    thread keeps the memory of its largest.
    """
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "parquet.hadoop.vectored.io.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(number, item_id, terms): the distinct terms of each item that has any; ``number`` tells the rows apart."""
    def run(batches):
        for b in batches:
            yield {"number": b["number"], "item_id": b["item_id"],
                   "terms": [[w.decode("utf-8", "replace") for w in sorted(set(plain_words(t)))] for t in b["text"]]}

    rows = items.select(F.monotonically_increasing_id().alias("number"), F.col(id_col).cast("long").alias("item_id"),
                        text_or_empty(text_col).alias("text"))
    return map_arrow(rows, run, "number long, item_id long, terms array<string>").where(F.size("terms") > 0)


def postings(docs: DataFrame, codes: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, codes, tfs): for each document with terms, their number and the vocabulary terms it holds, as packed
    32-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        of = shared.value.get
        for b in batches:
            out = {"doc_id": [], "n": [], "codes": [], "tfs": []}
            for i, t in zip(b["doc_id"], b["text"]):
                if words := plain_words(t):
                    held = Counter(map(of, words))
                    held.pop(None, None)
                    out["doc_id"].append(i)
                    out["n"].append(len(words))
                    out["codes"].append(np.array(list(held), np.int32).tobytes())
                    out["tfs"].append(np.array(list(held.values()), np.int32).tobytes())
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, n long, codes binary, tfs binary")


def document_counts(held: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of the ``size`` vocabulary terms; counted in the tasks, then added up."""
    def run(batches):
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["code", "df"])

    df = np.zeros(size, np.int64)
    for code, n in held.select("codes").mapInArrow(run, "code int, df long").groupBy("code").agg(F.sum("df")).collect():
        df[code] = n
    return df


def length_terms(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 50 + (50 * n * documents) div total, exact for any length."""
    if n.size and int(n.max()) * 50 * documents >= 1 << 63:
        return np.array([50 + 50 * int(x) * documents // total for x in n], np.int64)
    return 50 + 50 * n * documents // total


def bounds(scores: np.ndarray, ends: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest and the ``top``-th largest score of each list, 0 where a list has none."""
    starts = np.r_[0, ends[:-1]]
    high = np.array([scores[s:e].max(initial=0) for s, e in zip(starts, ends)], np.int64)
    low = np.array([np.partition(scores[s:e], e - s - top)[e - s - top] if e - s >= top else 0
                    for s, e in zip(starts, ends)], np.int64)
    return high, low


class Lists:
    """Documents and scores of each key, keys ascending; absent keys have empty lists."""

    def __init__(self, keys, ends, docs, scores, tops, floors):
        self.at = {int(k): i for i, k in enumerate(keys)}
        self.ends, self.docs, self.scores, self.tops, self.floors = ends, docs, scores, tops, floors

    def length(self, key: int) -> int:
        i = self.at[key]
        return int(self.ends[i] - (self.ends[i - 1] if i else 0))

    def of(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        i = self.at[key]
        part = slice(self.ends[i - 1] if i else 0, self.ends[i])
        return self.docs[part], self.scores[part]


def build_block(ids: list, docs: np.ndarray, codes: np.ndarray, impacts: np.ndarray, weights: np.ndarray,
                wanted: np.ndarray, top: int) -> dict:
    """One block as a row: term lists, and intersection lists of the pairs ``wanted`` (first < second, sorted keys)."""
    order = np.lexsort((docs, codes))
    docs, codes, impacts = docs[order].astype(np.int32), codes[order], impacts[order].astype(np.int32)
    scores = weights[codes] * impacts
    terms, first = np.unique(codes, return_index=True)
    ends = np.append(first[1:], len(codes)).astype(np.int64)
    lists = Lists(terms, ends, docs, scores, None, None)
    pairs, sizes, pair_docs, joints = [], [], [NONE.astype(np.int32)], [NONE]
    for key in wanted[np.isin(wanted // len(weights), terms) & np.isin(wanted % len(weights), terms)].tolist():
        (da, sa), (db, sb) = lists.of(key // len(weights)), lists.of(key % len(weights))
        if len(da) > len(db):
            da, sa, db, sb = db, sb, da, sa
        at = np.minimum(np.searchsorted(db, da), len(db) - 1)
        both = db[at] == da
        if both.any():
            pairs.append(key)
            sizes.append(int(both.sum()))
            pair_docs.append(da[both])
            joints.append(sa[both] + sb[at[both]])
    joint, pair_ends = np.concatenate(joints), np.cumsum(sizes, dtype=np.int64)
    tops, floors = bounds(scores, ends, top)
    pair_tops, pair_floors = bounds(joint, pair_ends, top)
    raw = {"terms": terms.astype(np.int64), "ends": ends, "docs": docs, "impacts": impacts, "tops": tops,
           "floors": floors, "pairs": np.array(pairs, np.int64), "pair_ends": pair_ends,
           "pair_docs": np.concatenate(pair_docs), "joints": joint, "pair_tops": pair_tops, "pair_floors": pair_floors}
    return {"doc_ids": pa.array([ids], pa.list_(pa.int64())), **{k: [v.tobytes()] for k, v in raw.items()}}


def build_index(held: DataFrame, weights: np.ndarray, wanted: np.ndarray, documents: int, total: int, top: int = 50,
                block_docs: int = 4096, block_postings: int = 1 << 19) -> DataFrame:
    """A row for each block of documents (see ``build_block``) of ``postings``."""
    shared = held.sparkSession.sparkContext.broadcast((weights, wanted))

    def run(batches):
        w, pairs = shared.value
        ids, lengths, codes, tfs, n = [], [], [], [], 0

        def out():
            size = [len(c) // 4 for c in codes]
            m = np.repeat(length_terms(np.array(lengths, np.int64), documents, total), size)
            tf = np.frombuffer(b"".join(tfs), np.int32).astype(np.int64)
            return build_block(ids, np.repeat(np.arange(len(ids)), size), np.frombuffer(b"".join(codes), np.int32),
                               SCALE * tf // (FLAT * tf + SLOPE * m), w, pairs, top)

        for b in batches:
            for i, length, c, t in zip(b["doc_id"], b["n"], b["codes"], b["tfs"]):
                if c:
                    ids.append(i)
                    lengths.append(length)
                    codes.append(c)
                    tfs.append(t)
                    n += len(c) // 4
                if n >= block_postings or len(ids) >= block_docs:
                    yield out()
                    ids, lengths, codes, tfs, n = [], [], [], [], 0
        if ids:
            yield out()

    return map_arrow(held, run, BLOCK)


def read_block(b: dict, at: int, weights: np.ndarray) -> tuple[list, Lists, Lists]:
    def raw(name, kind=np.int64):
        return np.frombuffer(b[name][at], kind)

    ends, terms = raw("ends"), raw("terms")
    scores = np.repeat(weights[terms], np.diff(np.r_[0, ends])) * raw("impacts", np.int32)
    return (b["doc_ids"][at], Lists(terms, ends, raw("docs", np.int32), scores, raw("tops"), raw("floors")),
            Lists(raw("pairs"), raw("pair_ends"), raw("pair_docs", np.int32), raw("joints"), raw("pair_tops"),
                  raw("pair_floors")))


def neighbours(terms: list[int], singles: Lists, size: int) -> list[tuple[int, int, int]]:
    """(key, a, b) of the query's neighbouring terms that both stand in the block.

    For these, and for no others, a missing intersection list says that no document of the block holds both.
    """
    return [(min(a, b) * size + max(a, b), a, b) for a, b in zip(terms, terms[1:]) if a in singles.at and b in singles.at]


def units(terms: list[int], singles: Lists, pairs: Lists | None, size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(bound, terms) of a matching of the block's terms into pairs, the pairs that save most matched first.

    Ordered by bound per posting, so that the units that need propose no document hold the longest lists.
    """
    high = {t: int(singles.tops[singles.at[t]]) for t in terms if t in singles.at}
    saved = []
    for key, a, b in neighbours(terms, singles, size) if pairs else ():
        joint = max(high[a], high[b], int(pairs.tops[pairs.at[key]]) if key in pairs.at else 0)
        saved.append((high[a] + high[b] - joint, joint, a, b))
    got, used = [], set()
    for gain, joint, a, b in sorted(saved, reverse=True):
        if gain > 0 and a not in used and b not in used:
            got.append((joint, (a, b)))
            used |= {a, b}
    got += [(high[t], (t,)) for t in high if t not in used]
    return sorted(got, key=lambda u: (u[0] / sum(singles.length(t) for t in u[1]), u))


def search_block(terms: list[int], n_docs: int, singles: Lists, pairs: Lists | None, size: int, least: int,
                 scored: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores): all documents of the block whose score is above 0 and at least ``least``, and no wrong score.

    ``terms``: the whole query, in the order whose neighbours have intersection lists; without ``pairs`` term maxima alone
    are added up. ``scored`` gets the number of proposed documents.
    """
    order = units(terms, singles, pairs, size)
    reach = np.cumsum([u[0] for u in order])
    cut = int(np.searchsorted(reach, least)) if least > 0 else 0  # units before the cut stay below ``least`` together
    total = np.zeros(n_docs, np.int64)
    for _, own in order[cut:]:
        for t in own:
            docs, scores = singles.of(t)
            total[docs] += scores
    found = np.flatnonzero(total)
    if scored is not None:
        scored.append(len(found))
    total = total[found]
    for i in range(cut - 1, -1, -1):
        on = total + reach[i] >= least
        found, total = found[on], total[on]
        if not len(found):
            break
        for t in order[i][1]:
            docs, scores = singles.of(t)
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            total = total + np.where(docs[at] == found, scores[at], 0)
    on = (total >= least) & (total > 0)
    return found[on], total[on]


def best(ids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` highest scores, equal ones by ascending id (the largest long stands for a null id)."""
    if len(ids) > top:
        order = np.lexsort((ids, -scores))[:top]
        ids, scores = ids[order], scores[order]
    return ids, scores


LAST = np.iinfo(np.int64).max


def search_index(index: DataFrame, queries: list[tuple[int, list[int]]], weights: np.ndarray, top: int) -> DataFrame:
    """(number, doc_id, score): the ``top`` documents of each query in each task's blocks."""
    shared = index.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches):
        asked, w = shared.value
        got = [(NONE, NONE)] * len(asked)
        least = [0] * len(asked)
        for b in batches:
            for at in range(len(b["doc_ids"])):
                names, singles, pairs = read_block(b, at, w)
                names = np.array([LAST if x is None else x for x in names], np.int64)
                for q, (_, terms) in enumerate(asked):
                    near = neighbours(terms, singles, len(w))
                    floor = max([least[q], *(int(singles.floors[singles.at[t]]) for t in terms if t in singles.at),
                                 *(int(pairs.floors[pairs.at[k]]) for k, _, _ in near if k in pairs.at)])
                    docs, scores = search_block(terms, len(names), singles, pairs, len(w), floor)
                    if len(docs):
                        got[q] = best(np.r_[got[q][0], names[docs]], np.r_[got[q][1], scores], top)
                        least[q] = max(floor, int(got[q][1].min()) if len(got[q][1]) >= top else 0)
        for (number, _), (found, scores) in zip(asked, got):
            yield {"number": [number] * len(found), "doc_id": [None if x == LAST else x for x in found.tolist()],
                   "score": scores}

    return map_arrow(index, run, "number long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = 50, at_once: int = 1 << 20, block_docs: int = 4096) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0."""
    asked = stage_table(item_terms(items), "lexical-items")
    size = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = max(1, math.ceil(size / at_once))
    ranked = None
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("number"), F.lit(groups)) == g).select("number", "terms").collect()
        codes = {t.encode(): i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
        with batches_of(docs.sparkSession, 1000):
            held = stage_table(postings(docs, codes), "lexical-postings")
        documents, total = held.agg(F.count("*"), F.sum("n")).first()
        df = document_counts(held, len(codes)).tolist()
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df], np.int64)
        # neighbours by weight are the pairs that may have an intersection list
        queries = [(r["number"], sorted((codes[t.encode()] for t in r["terms"]), key=lambda c: (-weights[c], c)))
                   for r in rows]
        wanted = np.unique(np.array([min(a, b) * len(codes) + max(a, b) for _, q in queries for a, b in zip(q, q[1:])],
                                    np.int64))
        with batches_of(docs.sparkSession, 1000):
            index = stage_table(build_index(held, weights, wanted, documents, total or 1, top, block_docs), "lexical-index",
                                **ONE_BLOCK)
        with batches_of(docs.sparkSession, 1):
            part = stage_table(search_index(index, queries, weights, top), "lexical-found")
        ranked = part if ranked is None else ranked.unionAll(part)
    by = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = ranked.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.join(asked.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
