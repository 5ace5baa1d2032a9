"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs (lines).

Each paragraph is hashed to a wide vector of 64-bit lanes, and a fingerprint is the lane-wise sum modulo
2 ** 64 over the paragraphs. Sums do not depend on the order, and a paragraph is inserted or deleted by adding or subtracting
its vector. The first ``EQUAL`` lanes are uniform hashes of the whole paragraph: equal multisets have equal
lanes, others differ but for chance (no count of equal paragraphs that fits a text wraps). The other ``SKETCH`` lanes hold a
+1 or -1 for every run of three words of the paragraph, at a place chosen by its hash; the squared length of the difference
of two such sums estimates how many runs the texts do not share, which gives the likeness.

Nulls and edges: null and empty texts are one empty paragraph; two texts without words are alike (1) if equal,
else 0; repeated rows are neighbours in the order and keep their own rows; a null id comes last in descending order; rows
of one id, or without one, are ordered by their first ``PREFIX`` characters, then by a hash of the text; the
only document is its own next; an empty table gives an empty result. A text of any length is hashed whole, its run hashes
``AT_ONCE`` at a time. Other columns are not read and not returned.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_counts, map_arrow, stage_table, text_or_empty

EQUAL, SKETCH, RUN = 8, 256, 3
AT_ONCE = 1 << 16  # run hashes in memory together
PREFIX = 32  # characters of a text that order rows of one id
KEY = ("last", "descending", "prefix", "hash")  # the order of documents: descending id, null ids last, ties by text
LANES = EQUAL + SKETCH


def fingerprint(text: str) -> np.ndarray:
    """The sum of the paragraphs' vectors; the hashes of many paragraphs are counted together."""
    from xxhash import xxh64_intdigest

    out = np.zeros(LANES, np.uint64)
    sketch = np.zeros(SKETCH, np.int64)
    digests: list[bytes] = []
    runs: list[int] = []

    def count():
        h = np.array(runs, np.uint64)
        sketch[:] += np.bincount(((h >> np.uint64(8)) % np.uint64(SKETCH)).astype(np.int64),
                                 (h & np.uint64(1)).astype(np.int64) * 2 - 1, SKETCH).astype(np.int64)
        out[:EQUAL] += np.frombuffer(b"".join(digests), "<u8").reshape(-1, EQUAL).sum(0, dtype=np.uint64)
        digests.clear()
        runs.clear()

    for p in text.encode("utf-8", "replace").split(b"\n"):
        digests.append(hashlib.blake2b(p, digest_size=8 * EQUAL).digest())
        words = p.lower().split()
        if len(words) >= RUN:
            runs += map(xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(RUN)))))
        elif words:
            runs.append(xxh64_intdigest(b" ".join(words)))
        if len(runs) >= AT_ONCE:
            count()
    if digests:
        count()
    out[EQUAL:] = sketch.view(np.uint64)
    return out


def paragraph_vector(paragraph: str) -> np.ndarray:
    """The vector of one paragraph (a text without line ends)."""
    return fingerprint(paragraph)


def insert(f: np.ndarray, paragraph: str) -> np.ndarray:
    return f + paragraph_vector(paragraph)


def delete(f: np.ndarray, paragraph: str) -> np.ndarray:
    return f - paragraph_vector(paragraph)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: 1 for equal fingerprints, else 1 less the estimated share of word runs not in common."""
    if np.array_equal(a, b):
        return 1.0
    size = lambda v: float((v[EQUAL:].view(np.int64).astype(np.float64) ** 2).sum())
    both = size(a) + size(b)
    return min(1.0, max(0.0, 1 - size(a - b) / both)) if both else 0.0


def as_text(f: np.ndarray) -> str:
    """The fingerprint as text: the bytes of a sketch lane (2, 4 or 8, as few as hold every lane), then all lanes in base64."""
    sketch = f[EQUAL:].view(np.int64)
    width = next(w for w in (2, 4, 8) if w == 8 or (abs(sketch) < 1 << (8 * w - 1)).all())
    return str(width) + base64.b64encode(f[:EQUAL].astype("<u8").tobytes() + sketch.astype(f"<i{width}").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = base64.b64decode(s[1:])
    sketch = np.frombuffer(raw[8 * EQUAL:], f"<i{s[0]}").astype(np.int64)
    return np.concatenate([np.frombuffer(raw[:8 * EQUAL], "<u8").astype(np.uint64), sketch.view(np.uint64)])


def edited(text: str, following: str) -> str:
    """The last half of the text's code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row of ``docs``."""
    def run(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "fingerprint": [as_text(fingerprint(t)) for t in b["text"]]}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")),
                     run, "doc_id long, fingerprint string")


def with_slice(rows: DataFrame, heads: list[tuple]) -> DataFrame:
    """``rows`` with the ``slice`` of their key: the one whose head is the last up to the key.

    A key that is the head of several slices has its rows spread over them by ``place``.
    """
    @F.pandas_udf("int")
    def find(last: pd.Series, descending: pd.Series, prefix: pd.Series, hash_: pd.Series, place: pd.Series) -> pd.Series:
        out = []
        for *key, p in zip(last, descending, prefix, hash_, place):
            lo, hi = bisect_left(heads, tuple(key)), bisect_right(heads, tuple(key))
            out.append(lo + p % (hi - lo) if hi > lo else max(lo - 1, 0))
        return pd.Series(out, dtype="int32")

    return rows.withColumn("slice", find(*KEY, "place"))


def with_next(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """(guest, doc_id, text), one slice of the order per partition, sorted within it.

    Spark's range partitioning cuts the keys (no texts) into slices of about equal counts, rows of one key included;
    the heads of the slices, one for each partition, are all that reaches the driver. Each slice also gets, as its last row, a
    ``guest``: the first row of the next slice (of the first for the last), so a task finds every next text in its own
    rows. Each text moves once. Rows that repeat should come in the same order when ``docs`` is read again, as those of a
    stored table do.
    """
    n = slices or bucket_counts(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select(
        "doc_id", "text", F.col("doc_id").isNull().cast("int").alias("last"),
        F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("descending"),
        F.substring("text", 1, PREFIX).alias("prefix"), F.xxhash64("text").alias("hash"),
        F.monotonically_increasing_id().alias("place"))
    keys = stage_table(rows.select(*KEY, "place"), "fingerprint-keys")
    cut = keys.repartitionByRange(n, *KEY, "place").select(F.spark_partition_id().alias("p"), F.struct(*KEY).alias("key"))
    heads = sorted(tuple(r.key) for r in cut.groupBy("p").agg(F.min("key").alias("key")).collect())
    firsts = with_slice(keys, heads).groupBy("slice").agg(F.min(F.struct(*KEY)).alias("key"))
    all_slices = Window.orderBy("slice")  # one row per slice
    firsts = stage_table(firsts.select(
        "slice", "key.*", F.coalesce(F.lag("slice").over(all_slices), F.max("slice").over(Window.partitionBy())).alias("to")),
        "fingerprint-firsts")
    rows = with_slice(rows, heads)
    guests = rows.join(F.broadcast(firsts), ["slice", *KEY]).groupBy("to").agg(
        F.first(F.struct("doc_id", "text", *KEY)).alias("r"))  # a row per slice; rows of one key have one text
    every = rows.select("slice", F.lit(False).alias("guest"), "doc_id", "text", *KEY).unionAll(
        guests.select(F.col("to"), F.lit(True), "r.*"))
    return every.repartitionById(n, "slice").sortWithinPartitions("guest", *KEY, "text").select("guest", "doc_id", "text")


def compare(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness to it and to the next document's."""
    def run(batches):
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        held = None  # the document that waits for its next
        for b in batches:
            out = {n: [] for n in names}
            for guest, i, text in zip(b["guest"], b["doc_id"], b["text"]):
                own = fingerprint(text)
                if held is not None:
                    last_id, last, f = held
                    new = edited(last, text)
                    g = fingerprint(new)
                    row = (last_id, len(last), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), as_text(f),
                           as_text(g), likeness(f, g), likeness(f, own))
                    for n, v in zip(names, row):
                        out[n].append(v)
                held = None if guest else (i, text, own)
            yield out

    return map_arrow(with_next(docs), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                           "edited_fingerprint string, near_edited double, near_next double")
