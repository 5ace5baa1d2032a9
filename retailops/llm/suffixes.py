"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix starts at every word that has a whole window of ``width`` words before the text's end; a window is repeated if
another suffix, anywhere, begins with the same words. Suffixes that cannot repeat are left out first, losing
none: the smallest hash among the ``k``-word runs of a window is its anchor, which depends on the window's words alone, so
equal windows have equal anchors. Neighbouring windows share an anchor and make one record; an anchor seen once, anywhere,
ends its windows' part. Records of one anchor whose words are all equal are repeated as a whole. What is left, anchors
with records of different words, goes to the trees.

The prefix of a suffix that ends with its anchor, longer or shorter as the anchor lies in it, is the key by which
suffixes are dealt to tasks, one group for each anchor. A group of more than ``max_group`` records is split by longer
prefixes of its suffixes, nine words at a time, until each part fits or the prefix is the whole window. A task builds the
suffix trees of its groups top-down: a node's suffixes are split by their next word, a leaf leaves the tree. The
internal nodes at a depth of ``width`` words hold the repeated windows.

Texts are known by two hashes of 96 bits together; words, runs and records by 64 bits each within their anchor.

Nulls and edges: null and empty texts have no words; texts shorter than a window keep all; rows that repeat, ids null or
repeated too, have each their result, and a text that occurs twice is repeated as a whole; a very long text is read in
slices into an array of hashes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_counts, map_arrow, ranges, stage_table, text_or_empty

ODD = 0xD6E8FEB86659FD93
SLICE = 1 << 20
STEP = 9


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").split()


def word_hashes(text: str) -> np.ndarray:
    """XXH64 of each word; a long text is read slice by slice, so that its words are never held together."""
    from xxhash import xxh64_intdigest

    raw, parts, at = text.encode("utf-8", "replace"), [], 0
    while at < len(raw):
        end = at + SLICE
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        parts.append(np.array([xxh64_intdigest(w) for w in raw[at:end].split()], np.uint64))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % (1 << 64)))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_length(width: int) -> int:
    """Words of an anchor: eight, but for narrow and very wide windows, whose starts must fit the bits of a long."""
    return max(min(8, width), width - 59)


def anchored(hashes: list[np.ndarray], width: int):
    """Records of texts: (text, first window, windows, offset of the anchor from the first window, anchor, content)."""
    k = run_length(width)
    size = np.array([len(h) for h in hashes])
    h = np.concatenate([*hashes, np.zeros(width, np.uint64)])
    n = len(h) - width
    runs, m = np.zeros(len(h) - k + 1, np.uint64), 1
    for j in range(k):
        runs += h[j:len(h) - k + 1 + j] * np.uint64(m)
        m = m * 0x9E3779B97F4A7C15 % (1 << 64)
    runs = mix(runs)
    least, held = np.arange(len(runs)), 1  # where the smallest run of the next ``held`` stands, the leftmost of equal ones
    while held < width - k + 1:
        step = min(held, width - k + 1 - held)
        a, b = least[:len(least) - step], least[step:]
        least, held = np.where(runs[b] < runs[a], b, a), held + step
    text = np.repeat(np.arange(len(size)), size)
    start = np.flatnonzero(np.arange(n) + width <= np.repeat(np.cumsum(size), size))
    at, of = least[start], text[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.r_[first, len(start)])
    s, of, at = start[first], of[first], at[first]
    sums = np.r_[np.uint64(0), np.cumsum(h * powers(ODD, len(h)), dtype=np.uint64)]
    shape = mix(((at - s) * 64 + windows).astype(np.uint64))
    content = mix((sums[s + windows - 1 + width] - sums[s]) * powers(pow(ODD, -1, 1 << 64), len(h))[s] + shape)
    return of, s - (np.cumsum(size) - size)[of], windows, at - s, runs[at], content


def in_groups(batches, columns: list[str], words_at_once: int = 1 << 18):
    """Lists of rows from Arrow batches, each with about so many bytes of text."""
    rows, size = [], 0
    for b in batches:
        for row in zip(*(b[c] for c in columns)):
            rows.append(row)
            size += len(row[-1])
            if size >= 6 * words_at_once:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


KEY = ("d1", "d2")


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The texts under two hashes."""
    t = text_or_empty(text_col)
    return docs.select(F.xxhash64(t).alias("d1"), F.hash(t).alias("d2"), t.alias("text"))


def records(texts: DataFrame, width: int) -> DataFrame:
    """A row for each record of each text (see ``anchored``)."""
    def run(batches):
        for rows in in_groups(batches, ["d1", "d2", "text"]):
            of, s, n, off, anchor, content = anchored([word_hashes(r[2]) for r in rows], width)
            d1, d2 = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
            yield {"d1": d1[of], "d2": d2[of].astype(np.int32), "s": s, "n": n, "off": off,
                   "anchor": anchor.view(np.int64), "content": content.view(np.int64)}

    return map_arrow(texts, run, "d1 long, d2 int, s long, n int, off int, anchor long, content long")


def maybe_in(rows: DataFrame, col: Column, keys: DataFrame, most_words: int = 1 << 19) -> DataFrame:
    """``rows`` whose value is, or by chance seems, one of ``keys`` (its only column).

    The keys become a bitmap of at most 64 * ``most_words`` bits, whose broadcast is bounded by that, whatever the
    number of keys; with too many keys it lets more rows through, never fewer. A join has the last word.
    """
    bits = 64 * min(most_words, 1 << max(4, math.ceil(math.log2(max(1, keys.count()) / 4 + 1))))
    key = F.col(keys.columns[0])

    def place(c):
        return F.pmod(F.xxhash64(c, F.lit(7)), F.lit(bits))

    bitmap = keys.select(F.shiftright(place(key), 6).alias("_word"),
                         F.pmod(place(key), F.lit(64)).cast("int").alias("_bit")).groupBy("_word").agg(
        F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    got = rows.withColumn("_word", F.shiftright(place(col), 6)).withColumn("_bit", F.pmod(place(col), F.lit(64)).cast("int"))
    got = got.join(F.broadcast(bitmap), "_word").where(F.expr("(shiftrightunsigned(_bits, _bit) & 1L) = 1L"))
    return got.drop("_word", "_bit", "_bits")


def one_of_each(texts: DataFrame) -> DataFrame:
    return texts.groupBy(*KEY).agg(F.first("text").alias("text"))


def pieces(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(anchor, content, weight, n, off, words): the word hashes of the records listed for each text."""
    def run(batches):
        for b in batches:
            out = {c: [] for c in ("anchor", "content", "weight", "n", "off", "words")}
            for t, listed in zip(b["text"], b["listed"]):
                h = word_hashes(t)
                for r in listed:
                    for c in ("anchor", "content", "weight", "n", "off"):
                        out[c].append(r[c])
                    out["words"].append(h[r["s"]:r["s"] + r["n"] - 1 + width].tobytes())
            yield out

    return map_arrow(texts.join(wanted, list(KEY)).select("text", "listed"), run,
                     "anchor long, content long, weight int, n int, off int, words binary")


def tree_windows(group: np.ndarray, weight: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """Which suffixes share their first ``width`` words with another one of their group.

    The suffix trees of all groups are built together, top-down: each round splits the nodes by their suffixes' next
    word and drops those that hold a single suffix. ``words``: a row of ``width`` word hashes for each suffix.
    """
    rows = np.arange(len(group))
    node = np.unique(group, return_inverse=True)[1]
    for depth in range(width):
        _, word = np.unique(words[rows, depth], return_inverse=True)
        _, node = np.unique(node * (int(word.max(initial=0)) + 1) + word, return_inverse=True)
        inner = np.bincount(node, weights=weight[rows])[node] > 1 if len(rows) else np.zeros(0, bool)
        rows, node = rows[inner], node[inner]
        if not len(rows):
            break
    out = np.zeros(len(group), bool)
    out[rows] = True
    return out


def grow_trees(rows: DataFrame, width: int, suffixes_at_once: int = 1 << 17) -> DataFrame:
    """(anchor, content, first, mask): the repeated windows of the rows (key, ..., first, n, words), a bit for each."""
    def run(batches):
        held, count = [], 0

        def flush(part):
            part = [r for r, before in zip(part, [None, *part]) if before is None or r[:4] != before[:4]]
            group = np.unique([r[0] for r in part], return_inverse=True)[1]
            n = np.array([r[5] for r in part])
            flat = np.frombuffer(b"".join(r[6] for r in part), np.uint64)
            at = np.cumsum(n + width - 1) - (n + width - 1)
            row, start = ranges(at, n)
            hit = tree_windows(group[row], np.array([r[4] for r in part])[row], flat[start[:, None] + np.arange(width)],
                               width)
            mask = np.zeros(len(part), np.int64)
            np.bitwise_or.at(mask, row[hit], np.int64(1) << (start - at[row])[hit])
            return {"anchor": [r[1] for r in part], "content": [r[2] for r in part], "first": [r[3] for r in part],
                    "mask": mask}

        for b in batches:
            for r in zip(*(b[c] for c in ("key", "anchor", "content", "first", "weight", "n", "words"))):
                if count >= suffixes_at_once and r[0] != held[-1][0]:
                    yield flush(held)
                    held, count = [], 0
                held.append(r)
                count += r[5]
        if held:
            yield flush(held)

    dealt = rows.repartition(bucket_counts(rows.sparkSession), "key").sortWithinPartitions(
        "key", "anchor", "content", "first")
    return map_arrow(dealt, run, "anchor long, content long, first int, mask long").where("mask <> 0")


def split_by_prefix(rows: DataFrame, width: int, more: int) -> DataFrame:
    """The suffixes of the rows one by one, keyed by their prefix up to ``more`` words behind the anchor's."""
    k = run_length(width)

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            out = {c: [] for c in ("key", "anchor", "content", "first", "weight", "n", "off", "words")}
            for a, c, f, w, n, off, words in zip(*(b[x] for x in ("anchor", "content", "first", "weight", "n", "off", "words"))):
                for i in range(n):
                    before = off - i  # words of the suffix before its anchor
                    own = words[8 * i:8 * (i + width)]
                    size = min(width, before + k + more)
                    key = xxh64_intdigest(own[:8 * size], a % (1 << 32) + before)
                    for name, v in zip(out, (np.uint64(key).astype(np.int64), a, c, f + i, w, 1, before, own)):
                        out[name].append(v)
            yield out

    return map_arrow(rows, run, "key long, anchor long, content long, first int, weight int, n int, off int, words binary")


def repeated_windows(found: DataFrame, width: int, max_group: int) -> DataFrame:
    """(anchor, content, mask) of the repeated windows of ``pieces``."""
    rows = found.select(F.col("anchor").alias("key"), "anchor", "content", F.lit(0).alias("first"), "weight", "n", "off",
                        "words")
    more, got = 0, None
    while True:
        large = stage_table(rows.groupBy("key").count().where(F.col("count") > max_group).select("key"), "suffix-large")
        fits = grow_trees(rows.join(large, "key", "left_anti"), width)
        got = fits if got is None else got.unionByName(fits)
        if large.isEmpty():
            break
        rest = rows.join(large, "key", "left_semi")
        if more > width:  # the prefix is the whole window: all suffixes of a group are equal, and only count
            whole = rest.groupBy("key").agg(F.sum("weight").alias("all")).where(F.col("all") > 1).select("key")
            got = got.unionByName(rest.join(whole, "key", "left_semi").select(
                "anchor", "content", "first", F.lit(1).cast("long").alias("mask")))
            break
        rows = stage_table(split_by_prefix(rest, width, more), "suffix-split")
        more += STEP
    return got.groupBy("anchor", "content").agg(F.bit_or(F.expr("shiftleft(mask, first)")).alias("mask"))


def repeats(docs: DataFrame, width: int = 35, max_group: int = 4096, text_col: str = "text") -> DataFrame:
    """(d1, d2, listed): for each different text with repeated windows, an array of (s, mask): bit i stands for s + i."""
    texts = keyed(docs, text_col)
    seen = records(texts, width)
    anchors = seen.groupBy("anchor").agg(F.count("*").alias("times"), F.min("content").alias("low"),
                                         F.max("content").alias("high")).where(F.col("times") > 1)
    anchors = stage_table(anchors.select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "suffix-anchors")
    shared = stage_table(maybe_in(seen, F.col("anchor"), anchors.select("anchor")).join(anchors, "anchor"), "suffix-shared")
    mixed = shared.where("mixed")
    wanted = mixed.groupBy("anchor", "content").agg(
        F.min(F.struct("d1", "d2", "s", "n", "off")).alias("r"),
        F.when(F.count("*") > 1, 2).otherwise(1).alias("weight"))
    wanted = wanted.groupBy("r.d1", "r.d2").agg(
        F.collect_list(F.struct("anchor", "content", "weight", "r.s", "r.n", "r.off")).alias("listed"))
    wanted = stage_table(wanted, "suffix-wanted")
    some = one_of_each(maybe_in(texts, F.col("d1"), wanted.select("d1")))
    found = stage_table(pieces(some, wanted, width), "suffix-pieces")
    masks = stage_table(repeated_windows(found, width, max_group), "suffix-masks")
    every = F.expr("CASE WHEN n >= 63 THEN -1L ELSE shiftleft(1L, n) - 1L END")
    marked = shared.where("NOT mixed").select(*KEY, "s", every.alias("mask")).unionByName(
        mixed.join(masks, ["anchor", "content"]).select(*KEY, "s", "mask"))
    return marked.groupBy(*KEY, "s").agg(F.max("mask").alias("mask")).groupBy(*KEY).agg(
        F.collect_list(F.struct("s", "mask")).alias("listed"))


def covered(listed: list, n: int, width: int) -> np.ndarray:
    """Which of ``n`` words stand in a listed window."""
    if not listed:
        return np.zeros(n, bool)
    s, mask = (np.array([r[c] for r in listed], np.int64) for c in ("s", "mask"))
    edges = np.zeros(n + 1, np.int64)
    for bit in range(int(mask.max()).bit_length()):
        on = s[(mask >> bit) & 1 == 1] + bit  # no start is listed twice
        edges[on] += 1
        edges[on + width] -= 1
    return np.cumsum(edges[:-1]) > 0


def drop_repeats(docs: DataFrame, width: int = 35, max_group: int = 4096, id_col: str = "doc_id", text_col: str = "text",
                 keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): every row of ``docs`` without its words in repeated windows.

    ``keep_text`` adds the kept words as column ``kept``.
    """
    marked = stage_table(repeats(docs, width, max_group, text_col), "suffix-repeats")
    kept_type = ", kept string" if keep_text else ""

    def cut(batches):
        for b in batches:
            out = {c: [] for c in ("d1", "d2", "n_removed", "sha", *(["kept"] if keep_text else []))}
            for d1, d2, t, listed in zip(b["d1"], b["d2"], b["text"], b["listed"]):
                words = words_of(t)
                gone = covered(listed, len(words), width)
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                row = (d1, d2, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"))
                for c, v in zip(out, row):
                    out[c].append(v)
            yield out

    def whole(batches):
        for b in batches:
            out = {c: [] for c in ("doc_id", "d1", "d2", "n_words", "all_sha", *(["all"] if keep_text else []))}
            for i, d1, d2, t in zip(b["doc_id"], b["d1"], b["d2"], b["text"]):
                words = words_of(t)
                kept = b" ".join(words)
                row = (i, d1, d2, len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"))
                for c, v in zip(out, row):
                    out[c].append(v)
            yield out

    texts = keyed(docs, text_col)
    changed = map_arrow(one_of_each(maybe_in(texts, F.col("d1"), marked.select("d1"))).join(marked, list(KEY)), cut,
                        "d1 long, d2 int, n_removed long, sha string" + kept_type)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("d1"),
                       F.hash(text_or_empty(text_col)).alias("d2"), text_or_empty(text_col).alias("text"))
    rows = map_arrow(rows, whole, "doc_id long, d1 long, d2 int, n_words long, all_sha string" + kept_type.replace("kept", "all"))
    got = rows.join(changed, list(KEY), "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("sha", "all_sha").alias("kept_sha256"), *([F.coalesce("kept", "all").alias("kept")] if keep_text else []))
    return got
