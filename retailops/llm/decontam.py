"""Benchmark decontamination with a distributed positional inverted index.

The training texts are cut into segments (some MB of text each). A segment stores, for every term that
may stand in the test set, the sorted list of its token positions, as one row of arrays in a table of the
shared folder. Terms are 64-bit hashes (XXH64; two given terms share one with a chance of 2 ** -64), so no dictionary
is sent anywhere: a bitmap of hash beginnings, at most 4 MB, leaves out terms that the test set cannot
hold, and a term that it lets through by chance costs a list and changes nothing. The test windows are broadcast in blocks of
bounded size, long items in pieces; blocks share the one index. A window starts from the list of the term
that is rarest in the whole corpus (of equals, the first in the window); the other lists, shifted by their offset, are
intersected in the order of rarity. Proximity search asks instead for every term of the window within the window's length plus
``slop`` of that rarest term, in the same text; how texts fall into segments makes no difference.

Nulls and edges: null and empty texts have no words; an item shorter than a window is one window, one
without words none; repeated rows keep their own results, items of one id are one; rows with a null id are kept; an empty
table gives an empty result; a very long text is a segment of its own, a very long item several pieces of one block or more;
ties in rarity go to the first term; other columns are not read.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, plain_words, ranges, stage_table, text_or_empty

SEGMENT = "segment string, ids array<bigint>, words array<int>, starts binary, terms binary, list_ends binary, positions binary"
PIECE = 4096  # windows of one item that go together
MOST_BITS = 25  # of a hash in the bitmap of the test set's terms


def ids_and_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))


def item_terms(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, keys): the hashed words of each item that has any, long ones in pieces that overlap by a window less one."""
    def run(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            for i, t in zip(b["id"], b["text"]):
                keys = np.array([xxh64_intdigest(w) for w in plain_words(t)], np.uint64).view(np.int64)
                for at in range(0, max(1, len(keys) - width + 1), PIECE) if len(keys) else ():
                    yield {"id": [i], "keys": [keys[at:at + PIECE + width - 1]]}

    return map_arrow(ids_and_texts(items, id_col, text_col), run, "id long, keys array<bigint>")


def term_bitmap(keys: DataFrame) -> tuple[int, bytes]:
    """(bits, bitmap): which beginnings of ``bits`` bits the hashes ``key`` have; 16 places a hash while 4 MB allow."""
    bits = min(MOST_BITS, max(16, (16 * keys.count()).bit_length()))
    slot = F.shiftrightunsigned("key", 64 - bits)
    parts = keys.groupBy(F.shiftright(slot, 15).cast("int").alias("part")).agg(
        F.collect_set(slot.bitwiseAND(32767).cast("int")).alias("on"))

    def run(batches):
        for b in batches:
            for part, on in zip(b["part"], b["on"]):
                marks = np.zeros(32768, np.uint8)
                marks[on] = 1
                yield {"part": [part], "bits": [np.packbits(marks).tobytes()]}

    out = np.zeros(1 << bits - 3, np.uint8)
    for r in map_arrow(parts, run, "part int, bits binary").collect():  # at most 1,024 rows of 4 KB
        out[r.part << 12:(r.part + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return bits, out.tobytes()


class Windows:
    """The distinct windows of a block of items as arrays of places in ``vocabulary`` (sorted hashes), short ones padded with -1.

    ``counts`` are the terms' occurrences in the corpus; windows with a term that has none are left out.
    """

    def __init__(self, rows: list[tuple[int, list[int]]], width: int, vocabulary: np.ndarray, counts: np.ndarray):
        self.width, self.vocabulary = width, vocabulary
        mats, owner = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int64)]
        for at, (_, keys) in enumerate(rows):
            t = np.searchsorted(vocabulary, np.array(keys, np.int64)).astype(np.int32)
            m = (np.lib.stride_tricks.sliding_window_view(t, width) if len(t) >= width
                 else np.pad(t, (0, width - len(t)), constant_values=-1)[None])
            m = m[np.where(m < 0, 1, counts[m]).min(1) > 0]
            mats.append(m)
            owner.append(np.full(len(m), at))
        every, owner = np.concatenate(mats), np.concatenate(owner)
        self.words, which = np.unique(every, axis=0, return_inverse=True) if len(every) else (every, owner)
        pairs = np.unique(np.stack([which.ravel(), owner], 1), axis=0)
        self.owners = pairs[:, 1]
        self.owner_at = np.r_[0, np.cumsum(np.bincount(pairs[:, 0], minlength=len(self.words)))].astype(np.int64)
        self.length = (self.words >= 0).sum(1)
        rarity = np.where(self.words < 0, np.iinfo(np.int64).max, np.r_[counts, 0][self.words])
        self.order = np.argsort(rarity, axis=1, kind="stable").astype(np.int16)  # offsets, rarest term first
        self.items = [r[0] for r in rows]


def build_index(docs: DataFrame, bitmap: tuple[int, bytes], id_col: str = "doc_id", text_col: str = "text",
                segment_chars: int = 4 << 20) -> DataFrame:
    """Segments of token postings for the terms that ``bitmap`` lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def segment(ids, texts, bits, marks):
        from xxhash import xxh64_intdigest

        numbers = defaultdict(itertools.count().__next__)  # a new word gets the next number
        code = numbers.__getitem__
        counts, starts, flat, at = [], [], [], 0
        for t in texts:
            words = plain_words(t)
            flat.append(np.fromiter(map(code, words), np.int32, len(words)))
            counts.append(len(words))
            starts.append(at)
            at += len(words)
        codes = np.concatenate(flat)
        keys = np.array([xxh64_intdigest(w) for w in numbers], np.uint64)
        slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(keys.view(np.int64), kind="stable")
        order = order[(marks[slot[order] >> 3] >> (7 - (slot[order] & 7))) & 1 == 1]
        place = np.full(len(keys), -1, np.int32)  # the term's place among the kept, by hash
        place[order] = np.arange(len(order), dtype=np.int32)
        codes = place[codes]
        pos = np.flatnonzero(codes >= 0).astype(np.int32)
        codes = codes[pos]
        pos = pos[np.argsort(codes, kind="stable")]  # positions stay sorted within a term
        return {"segment": [uuid.uuid4().hex], "ids": pa.array([ids], pa.list_(pa.int64())), "words": [counts],
                "starts": [np.array(starts, np.int64).tobytes()], "terms": [keys.view(np.int64)[order].tobytes()],
                "list_ends": [np.cumsum(np.bincount(codes, minlength=len(order))).astype(np.int64).tobytes()],
                "positions": [pos.tobytes()]}

    def run(batches):
        bits, marks = shared.value
        marks = np.frombuffer(marks, np.uint8)
        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b["id"], b["text"]):
                ids.append(i)
                texts.append(t)
                size += len(t) + 64
                if size >= segment_chars:
                    yield segment(ids, texts, bits, marks)
                    ids, texts, size = [], [], 0
        if ids:
            yield segment(ids, texts, bits, marks)

    return map_arrow(ids_and_texts(docs, id_col, text_col), run, SEGMENT)


def corpus_counts(index: DataFrame) -> DataFrame:
    """(key, n): the occurrences of every term of the index."""
    def run(batches):
        for b in batches:
            for terms, ends in zip(b["terms"], b["list_ends"]):
                yield {"key": np.frombuffer(terms, np.int64), "n": np.diff(np.frombuffer(ends, np.int64), prepend=0)}

    return map_arrow(index.select("terms", "list_ends"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def search(w: Windows, terms: np.ndarray, ends: np.ndarray, pos: np.ndarray, starts: np.ndarray, counts: np.ndarray,
           slop: int | None = None, visits: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(window, start position) of all places in a segment, or (window, text) of all texts with a place of the window's
    rarest term where every other term lies within the window's length plus ``slop``."""
    none = np.zeros(0, np.int64)
    if not len(w.words) or not len(terms):
        return none, none
    n_terms = len(w.vocabulary)
    code = np.minimum(np.searchsorted(w.vocabulary, terms), n_terms - 1)
    own = np.flatnonzero(w.vocabulary[code] == terms)
    first = np.r_[0, ends[:-1]]
    row, at = ranges(first[own], (ends - first)[own])
    pos = pos[at].astype(np.int64)
    pad = w.width + 1
    stride = int(starts[-1] + counts[-1]) + 2 * pad + 1  # no reach within a text meets the next term's list
    posting = code[own][row] * stride + pad + pos  # sorted over all lists
    size = np.zeros(n_terms + 1, np.int64)  # the last stands for padding
    size[code[own]] = (ends - first)[own]
    start = np.r_[0, np.cumsum(size[:-1])]
    size[-1] = np.iinfo(np.int64).max
    live = np.flatnonzero(size[w.words].min(1) > 0)
    rarest = w.words[live, w.order[live, 0]]
    load = np.cumsum(size[rarest])
    win_out, at_out = [none], [none]
    lo = 0
    while lo < len(live):
        hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + visits, side="right")))
        row, at = ranges(start[rarest[lo:hi]], size[rarest[lo:hi]])
        win, at = live[lo:hi][row], pos[at]
        if slop is None:
            at = at - w.order[win, 0]
        for k in range(1, w.width):
            off = w.order[win, k]
            term = w.words[win, off].astype(np.int64)
            base = term * stride + pad
            text = np.searchsorted(starts, at, side="right") - 1
            if slop is None:  # texts follow each other without a gap: the place must fit its text
                want = base + at + off
                i = np.minimum(np.searchsorted(posting, want), len(posting) - 1)
                ok = posting[i] == want
            else:
                reach = w.length[win] + slop
                least = np.maximum(at - reach, starts[text])
                most = np.minimum(at + reach, starts[text] + counts[text] - 1)
                i = np.minimum(np.searchsorted(posting, base + least), len(posting) - 1)
                ok = (posting[i] >= base + least) & (posting[i] <= base + most)
            ok |= term < 0
            win, at = win[ok], at[ok]
        text = np.searchsorted(starts, at, side="right") - 1
        if slop is None:
            ok = (at >= 0) & (at + w.length[win] <= starts[text] + counts[text])
            win, at = win[ok], at[ok]
        else:
            win, at = np.unique(np.stack([win, text]), axis=1)
        win_out.append(win)
        at_out.append(at)
        lo = hi
    return np.concatenate(win_out), np.concatenate(at_out)


def by_text(text: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each text that occurs in ``text``, their order kept."""
    order = np.argsort(text, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(text[order])) + 1) if order.size else []


def matches(index: DataFrame, w: Windows, slop: int | None = None) -> DataFrame:
    """One row per text: its segment and row number there, id, n_words, the items found, the disjoint word ranges that
    matches cover, and the items found in proximity (none without ``slop``)."""
    shared = index.sparkSession.sparkContext.broadcast(vars(w))  # plain values: workers need no copy of the class

    def run(batches):
        win = SimpleNamespace(**shared.value)

        def owners(found):
            _, at = ranges(win.owner_at[found], win.owner_at[found + 1] - win.owner_at[found])
            return [win.items[i] for i in np.unique(win.owners[at])]

        for b in batches:
            for segment, ids, counts, starts, terms, ends, pos in zip(*(b[c] for c in (
                    "segment", "ids", "words", "starts", "terms", "list_ends", "positions"))):
                starts = np.frombuffer(starts, np.int64)
                lists = (np.frombuffer(terms, np.int64), np.frombuffer(ends, np.int64), np.frombuffer(pos, np.int32),
                         starts, np.array(counts, np.int64))
                items, covered, near = ([[] for _ in ids] for _ in range(3))
                found, at = search(win, *lists)
                order = np.argsort(at, kind="stable")
                found, at = found[order], at[order]
                text = np.searchsorted(starts, at, side="right") - 1
                for own in by_text(text):
                    d, f = text[own[0]], found[own]
                    items[d] = owners(f)
                    a = at[own] - starts[d]
                    z = np.maximum.accumulate(a + win.length[f])
                    new = np.r_[True, a[1:] > z[:-1]]
                    covered[d] = [{"a": x, "z": y} for x, y in zip(a[new].tolist(), z[np.r_[new[1:], True]].tolist())]
                if slop is not None:
                    found, text = search(win, *lists, slop)
                    for own in by_text(text):
                        near[text[own[0]]] = owners(found[own])
                yield {"segment": [segment] * len(ids), "row_no": list(range(len(ids))), "id": ids,
                       "n_words": counts, "items": items, "covered": covered, "near": near}

    return map_arrow(index, run, "segment string, row_no int, id long, n_words long, items array<long>, "
                                 "covered array<struct<a:int,z:int>>, near array<long>")


def covered_words(covered):
    """How many words the ranges cover together."""
    def step(acc, r):
        return F.struct((acc["n"] + F.greatest(r["z"] - F.greatest(r["a"], acc["to"]), F.lit(0))).alias("n"),
                        F.greatest(acc["to"], r["z"]).alias("to"))

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(F.array_sort(covered), zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int | None = None,
                  block_words: int = 1_000_000, segment_chars: int = 4 << 20, id_col: str = "doc_id",
                  item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items, near): one row per text of ``docs``; ``near`` holds the items with a window in
    proximity, exact matches included, where ``slop`` is given.

    Test windows are searched for in blocks of about ``block_words`` words over one stored index; with several blocks,
    the result of each is stored before the next is sent.
    """
    rows = stage_table(item_terms(benchmark, width, item_col, text_col), "decontam-items")
    bitmap = term_bitmap(rows.select(F.explode("keys").alias("key")).distinct())
    index = stage_table(build_index(docs, bitmap, id_col, text_col, segment_chars), "decontam-index")
    counts = stage_table(corpus_counts(index), "decontam-counts")
    blocks = int((rows.agg(F.sum(F.size("keys"))).first()[0] or 0) // block_words) + 1
    part = F.pmod(F.xxhash64("id", "keys"), F.lit(blocks))
    got = []
    for i in range(blocks):
        own = rows.where(part == i)
        known = (own.select(F.explode("keys").alias("key")).distinct().join(counts, "key", "left")
                 .select("key", F.coalesce("n", F.lit(0)).alias("n")).toArrow())
        key, n = known["key"].to_numpy(), known["n"].to_numpy()
        order = np.argsort(key)
        windows = Windows([(r.id, r["keys"]) for r in own.collect()], width, key[order], n[order])
        found = matches(index, windows, slop)
        got.append(found if blocks == 1 else stage_table(found, "decontam-block"))
    out = got[0]
    for more in got[1:]:
        out = out.unionAll(more)
    if blocks > 1:
        out = out.groupBy("segment", "row_no").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"),
            *(F.flatten(F.collect_list(c)).alias(c) for c in ("items", "covered", "near")))
    return out.select(F.col("id").alias("doc_id"), "n_words", covered_words(F.col("covered")).alias("n_hit"),
                      F.array_distinct("items").alias("items"), F.array_distinct("near").alias("near"))
