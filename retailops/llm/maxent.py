"""LM scoring with a hashed maximum-entropy model.

The probability of a token is that of its class given the words before it, times that of the token within its
class. The class factor is a softmax over hashed features of the history: the last word, the last two words,
the word before the last (skip), the last class, the last two classes, and the class three back (skip). The
factor within a class is its own maximum-entropy solution for word counts, smoothed as the base score is, so all
probabilities sum to one over the known tokens and one unknown token for each class.

Texts are tokenized once, into shards of some MB of text: token arrays, and the shard's own vocabulary, each word by
its 64-bit hash (among a thousand million different words, two share one with a chance of 3 in 100; they would then be
counted as one word). Counts are aggregated over all shards. The class factor is trained in rounds: the tasks take gradient steps over their shards' training
tokens, starting from the same weights, and the changes are averaged row by row, by how often a feature occurred, in a
Spark aggregate. Weights (``ROWS`` x ``CLASSES`` floats) are the only thing broadcast. For scoring, each shard gets the
counts of its own vocabulary, which is bounded by its text, so no task holds the corpus vocabulary.

Nulls and edges: null and empty texts are one end token; repeated rows are scored alike; a null id counts as the empty text in
the fold rule; words never seen in training have count 0; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, space_words, stage_table, text_or_empty

ROWS, CLASSES, FEATURES = 1 << 13, 48, 6
AT_ONCE = 4096  # tokens whose class probabilities are in memory together
BLOCK = 1 << 18  # tokens whose history features are in memory together
SHARD = ("shard bigint, ids array<bigint>, train array<boolean>, lengths binary, tokens binary, keys binary, "
         "counts binary, classes binary")
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
PUNCTUATION = b".,;:!?|\"')"


def class_of(word: bytes) -> int:
    """A word's class from its last letters and the mark behind them; the end token (b'') is class 0."""
    from zlib import crc32

    if not word:
        return 0
    core = word.rstrip(PUNCTUATION)
    return 1 + crc32(core[-3:] + b" " + word[len(core):][:1]) % (CLASSES - 1)


def shards_of(docs: DataFrame, train: Column, id_col: str, text_col: str, shard_chars: int = 8 << 20) -> DataFrame:
    """One row per shard; ``train`` is a condition on ``docs`` that says which rows are learned from."""
    def shard(number, ids, flags, texts):
        from xxhash import xxh64_intdigest

        vocabulary = defaultdict(itertools.count().__next__)  # a new word gets the next number
        code = vocabulary.__getitem__
        code(b"")  # the end token is 0
        tokens, lengths = [], []
        for t in texts:
            words = space_words(t)
            words.append(b"")
            tokens.append(np.fromiter(map(code, words), np.int32, len(words)))
            lengths.append(len(words))
        learned = [t for t, f in zip(tokens, flags) if f]
        counts = np.bincount(np.concatenate(learned) if learned else np.zeros(0, np.int32), minlength=len(vocabulary))
        return {"shard": [number], "ids": pa.array([ids], pa.list_(pa.int64())), "train": [flags],
                "lengths": [np.array(lengths, np.int32).tobytes()], "tokens": [np.concatenate(tokens).tobytes()],
                "keys": [np.array([xxh64_intdigest(w) for w in vocabulary], np.uint64).tobytes()],
                "counts": [counts.astype(np.int32).tobytes()],
                "classes": [np.array([class_of(w) for w in vocabulary], np.uint8).tobytes()]}

    def run(batches):
        number = TaskContext.get().partitionId() << 24  # the same for a repeated task
        ids, flags, texts, size = [], [], [], 0
        for b in batches:
            for i, f, t in zip(b["id"], b["train"], b["text"]):
                ids.append(i)
                flags.append(bool(f))
                texts.append(t)
                size += len(t) + 64
                if size >= shard_chars:
                    yield shard(number, ids, flags, texts)
                    number, ids, flags, texts, size = number + 1, [], [], [], 0
        if ids:
            yield shard(number, ids, flags, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), train.alias("train"), text_or_empty(text_col).alias("text"))
    return map_arrow(rows, run, SHARD)


def places(lengths: np.ndarray) -> np.ndarray:
    """Each token's place in its text."""
    first = np.cumsum(lengths, dtype=np.int64) - lengths
    return (np.arange(lengths.sum(), dtype=np.int64) - np.repeat(first, lengths)).astype(np.int32)


def history_rows(tokens: np.ndarray, place: np.ndarray, keys: np.ndarray, classes: np.ndarray, lo: int,
                 hi: int) -> np.ndarray:
    """The FEATURES weight rows of the histories of tokens lo..hi; before a text's first token stand end tokens (code 0)."""
    def back(k):
        out = np.zeros(hi - lo, tokens.dtype)
        skip = max(0, k - lo)
        out[skip:] = tokens[lo + skip - k:hi - k] if hi > k else tokens[:0]
        out[place[lo:hi] < k] = 0
        return out

    one, two, three = back(1), back(2), back(3)
    w1, w2 = keys[one], keys[two]
    c1, c2, c3 = (classes[x].astype(np.uint64) for x in (one, two, three))
    features = (w1 * np.uint64(8) + np.uint64(1), (w1 * np.uint64(1000003) ^ w2) * np.uint64(8) + np.uint64(2),
            w2 * np.uint64(8) + np.uint64(3), c1 * np.uint64(8) + np.uint64(4),
            (c1 * np.uint64(CLASSES) + c2) * np.uint64(8) + np.uint64(5), c3 * np.uint64(8) + np.uint64(6))
    out = np.empty((hi - lo, FEATURES), np.int64)
    for i, k in enumerate(features):
        out[:, i] = (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)
    return out


def logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Unnormalized log probabilities of the classes, the largest of each token being 0."""
    z = weights[rows[:, 0]]
    z += bias
    for i in range(1, FEATURES):
        z += weights[rows[:, i]]
    z -= z.max(1, keepdims=True)
    return z


def class_log10(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log10 probability of each token's class, a bounded number of tokens at once."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), AT_ONCE):
        z = logits(weights, bias, rows[at:at + AT_ONCE])
        picked = z[np.arange(len(z)), target[at:at + AT_ONCE]].astype(np.float64)
        out[at:at + AT_ONCE] = (picked - np.log(np.exp(z, out=z).sum(1))) / np.log(10)
    return out


def gradient_steps(weights: np.ndarray, bias: np.ndarray, speed: np.ndarray, used: np.ndarray, rows: np.ndarray,
                   target: np.ndarray, rng: np.random.Generator, rate: float = 0.1, batch: int = 16384) -> None:
    """AdaGrad steps over batches of tokens, in place; ``speed`` and ``used`` are kept by weight row.

    The gradient of a weight is how often its feature met its class less how often the model expects it. The
    expectation is estimated without bias by one class drawn from the model for each token, so both sides are counts.
    """
    shape = weights.shape
    for at in range(0, len(rows), batch):
        r, t = rows[at:at + batch], target[at:at + batch]
        drawn = np.empty(len(r), np.int64)
        for k in range(0, len(r), AT_ONCE):
            z = logits(weights, bias, r[k:k + AT_ONCE])
            sums = np.exp(z, out=z).cumsum(1)
            pick = rng.random((len(z), 1), np.float32) * sums[:, -1:]
            drawn[k:k + AT_ONCE] = np.minimum((sums < pick).sum(1), shape[1] - 1)
        cells = r * shape[1]
        grad = (np.bincount((cells + t[:, None]).ravel(), minlength=weights.size)
                - np.bincount((cells + drawn[:, None]).ravel(), minlength=weights.size)).reshape(shape).astype(np.float32)
        used += np.bincount(r.ravel(), minlength=shape[0])
        speed += (grad * grad).mean(1)
        weights += rate * grad / np.sqrt(speed + 1e-6)[:, None]


def arrays(b: dict, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(b["tokens"][i], np.int32), np.frombuffer(b["lengths"][i], np.int32),
            np.frombuffer(b["keys"][i], np.uint64), np.frombuffer(b["classes"][i], np.uint8).astype(np.int64))


def train_round(shards: DataFrame, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """New weights after the gradient steps of all tasks over ``shards``."""
    sent = shards.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches):
        start, prior = sent.value
        w = start.copy()
        speed, used = np.full(ROWS, 1e-3, np.float32), np.zeros(ROWS, np.int64)
        rng = np.random.default_rng(11)
        for b in batches:
            for i in range(len(b["tokens"])):
                tokens, lengths, keys, classes = arrays(b, i)
                place, learn = places(lengths), np.repeat(np.array(b["train"][i], bool), lengths)
                for lo in range(0, len(tokens), BLOCK):
                    own = learn[lo:lo + BLOCK]
                    rows = history_rows(tokens, place, keys, classes, lo, min(lo + BLOCK, len(tokens)))[own]
                    gradient_steps(w, prior, speed, used, rows, classes[tokens[lo:lo + BLOCK][own]], rng)
        row = np.flatnonzero(used)
        change = (w - start)[row] * used[row][:, None].astype(np.float32)
        lists = pa.ListArray.from_arrays(np.arange(len(row) + 1, dtype=np.int32) * CLASSES, change.ravel())
        yield {"row": row.astype(np.int32), "n": used[row], "change": lists}

    parts = map_arrow(shards.select("train", "lengths", "tokens", "classes", "keys"), run,
                      "row int, n long, change array<float>")
    sums = parts.groupBy("row").agg(F.sum("n").alias("n"), F.array(
        *(F.sum(F.col("change")[i]) for i in range(CLASSES))).alias("change")).collect()
    out = weights.copy()
    for r in sums:
        out[r.row] += np.array(r.change, np.float32) / np.float32(r.n)
    return out


def vocabulary_of(shards: DataFrame, learned: bool) -> DataFrame:
    """(shard, at, key, n, class): the shards' words, with ``learned`` only those of training tokens."""
    def run(batches):
        for b in batches:
            for i, number in enumerate(b["shard"]):
                n = np.frombuffer(b["counts"][i], np.int32)
                at = np.flatnonzero(n) if learned else np.arange(len(n))
                for k in range(0, len(at), 1 << 16):
                    part = at[k:k + (1 << 16)]
                    yield {"shard": np.full(len(part), number), "at": part.astype(np.int32),
                           "key": np.frombuffer(b["keys"][i], np.int64)[part], "n": n[part].astype(np.int64),
                           "class": np.frombuffer(b["classes"][i], np.uint8)[part].astype(np.int32)}

    return map_arrow(shards.select("shard", "counts", "keys", "classes"), run,
                     "shard long, at int, key long, n long, class int")


def language_scores(docs: DataFrame, train: Column, rounds: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``train`` says which rows to learn from. Each round of training takes its own part of the shards.
    """
    shards = stage_table(shards_of(docs, train, id_col, text_col), "maxent-shards")
    counts = stage_table(vocabulary_of(shards, learned=True).groupBy("key").agg(
        F.sum("n").alias("c"), F.max("class").alias("class")), "maxent-counts")
    by_class = counts.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    total, distinct = sum(r.c for r in by_class), sum(r.v for r in by_class)
    mass = np.full(CLASSES, 0.5)
    for r in by_class:
        mass[r["class"]] += r.c + 0.5 * r.v
    bias = np.log(mass / mass.sum()).astype(np.float32)
    weights = np.zeros((ROWS, CLASSES), np.float32)
    for i in range(rounds):
        weights = train_round(shards.where(F.pmod(F.xxhash64("shard"), F.lit(rounds)) == i), weights, bias)
    known = (vocabulary_of(shards, learned=False).select(F.col("shard").alias("of"), "at", "key")
             .join(counts.select("key", "c"), "key").select("of", "at", "c"))
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias, mass, total, distinct))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        w, prior, class_mass, n, v = sent.value
        b = left.to_pydict()
        tokens, lengths, keys, classes = arrays(b, 0)
        c = np.zeros(len(classes), np.int64)
        c[right.column("at").to_numpy()] = right.column("c").to_numpy()
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        within = np.log10((c + 0.5) / class_mass[classes])
        place, given = places(lengths), np.empty(len(tokens))
        for lo in range(0, len(tokens), BLOCK):
            hi = min(lo + BLOCK, len(tokens))
            given[lo:hi] = class_log10(w, prior, history_rows(tokens, place, keys, classes, lo, hi), classes[tokens[lo:hi]])
        first = np.cumsum(lengths) - lengths
        return pa.table({
            "doc_id": pa.array(b["ids"][0], pa.int64()), "held_out": [not t for t in b["train"][0]],
            "n_tokens": pa.array(lengths.astype(np.int64)),
            "n_known": pa.array(np.add.reduceat((c[tokens] > 0).astype(np.int64), first)),
            "base_score": np.add.reduceat(base[tokens], first),
            "score": np.add.reduceat(given + within[tokens], first)})

    scored = shards.select("shard", "ids", "train", "lengths", "tokens", "classes", "keys").groupBy("shard").cogroup(
        known.groupBy("of")).applyInArrow(run, OUT)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
