"""Toxicity: a learned lexicon met through Levenshtein automata, scored in context.

The lexicon holds words and word beginnings (written ``abc*``) that mark labelled toxic documents, each with
its log odds. It is kept as a trie. A word of a text is run as a Levenshtein automaton (states as bit sets)
over the trie, which finds every term within the edits its length allows; words that share no part in place
with a term of like length are passed over before, as k edits leave one of k + 1 parts whole. Each hit is weighed by the words around it:
more hits nearby raise it, quotation marks on both sides or words that report speech lower it.
A logistic model of the summed hits gives the score.

Labels are used only where ``labels.toxic`` is given and the caller's training rule holds; lang, source and id are
never features.

Nulls and edges: null and empty texts score as texts without hits; repeated rows are scored alike; rows with a null id
are scored; an id with several labels counts as toxic if one says so; without labelled rows of both kinds
every text scores 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stage_table, text_or_empty

WORD = re.compile(r"[^\W\d_]+")
QUOTES = set("\"“”„«»‘’‚")
# Fixed list: words that report or discuss speech.
REPORTING = frozenset("said says wrote quote quoted meaning defined definition "
                      "dijo citó llamó dit écrit cité sagte schrieb zitat".split())
# An apostrophe between letters quotes nothing.
APOSTROPHE = re.compile(r"(?<=[^\W\d_])[’‘](?=[^\W\d_])")
STEMS = range(3, 9)
FEATURES = 5


class Model(NamedTuple):
    lexicon: dict[str, float]
    mean: list[float]
    scale: list[float]
    weights: list[float]  # the last is the constant


def terms_of(text: str) -> set[str]:
    """The distinct words of a text and their beginnings."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


class Lexicon:
    """A trie of weighted terms, searched with a word's Levenshtein automaton.

    ``long`` and ``longest`` are the word lengths from which one and two edits are allowed; beginnings are met exactly.
    """

    def __init__(self, terms: dict[str, float], long: int = 5, longest: int = 10):
        self.long, self.longest = long, longest
        self.trie: dict = {}
        self.stems = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}
        self.stem_sizes = sorted({len(s) for s in self.stems})
        self.words = {t: w for t, w in terms.items() if not t.endswith("*")}
        self.parts: set[tuple[int, int, str]] = set()  # word length, place (-1: at the end), part
        for t, w in self.words.items():
            node = self.trie
            for ch in t:
                node = node.setdefault(ch, {})
            node[""] = w
            if (k := self.edits(t)):
                cuts = [len(t) * i // (k + 1) for i in range(k + 2)]
                for n in range(len(t) - k, len(t) + k + 1):  # k edits leave one of k + 1 parts whole:
                    self.parts.add((n, 0, t[:cuts[1]]))  # the first in place, the last at the end,
                    self.parts.add((n, -1, t[cuts[k]:]))
                    for shift in range(-1, 2) if k == 2 else ():  # the middle one moved by one at most
                        self.parts.add((n, cuts[1] + shift, t[cuts[1]:cuts[2]]))
        # What a word must show before its parts are looked up: two first, two last or three middle letters.
        self.heads = {p[:2] for n, at, p in self.parts if at == 0}
        self.tails = {p[-2:] for n, at, p in self.parts if at == -1}
        self.middles = {(at, p[:3]) for n, at, p in self.parts if at > 0}
        self.places = sorted({at for at, _ in self.middles})
        self.looks: dict[int, set[tuple[int, int]]] = {}
        for n, at, part in self.parts:
            self.looks.setdefault(n, set()).add((at, len(part)))
        self.stem_heads = {x[:min(self.stem_sizes)] for x in self.stems} if self.stems else set()
        self.head_size = min(self.stem_sizes, default=1)
        self.known: dict[str, tuple[float, int] | None] = {}

    def edits(self, term: str) -> int:
        return 0 if len(term) < self.long else 1 if len(term) < self.longest else 2

    def near(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the best term within its own limit of edits, the trie pruned by the automaton."""
        n, best = len(word), None
        at: dict[str, int] = {}
        for i, ch in enumerate(word):
            at[ch] = at.get(ch, 0) | 1 << i
        # A state set holds, for 0, 1 and 2 edits, the bits of the word positions reached.
        stack = [(self.trie, 0, (1, 3, 7))]
        while stack:
            node, depth, (r0, r1, r2) = stack.pop()
            for ch, child in node.items():
                if ch == "":
                    e = 0 if r0 >> n & 1 else 1 if r1 >> n & 1 else 2 if r2 >> n & 1 else 3
                    allowed = 0 if depth < self.long else 1 if depth < self.longest else 2
                    if e <= allowed and (best is None or child * 0.7 ** e > best[0] * 0.7 ** best[1]):
                        best = (child, e)
                    continue
                s = at.get(ch, 0)
                a0 = (r0 & s) << 1
                a1 = (r1 & s) << 1 | r0 | r0 << 1 | a0 << 1
                a2 = (r2 & s) << 1 | r1 | r1 << 1 | a1 << 1
                if a2:
                    stack.append((child, depth + 1, (a0, a1, a2)))
        return best

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of what the lexicon has for a word, None if nothing."""
        exact = self.words.get(word, 0.0)
        if word[:self.head_size] in self.stem_heads:
            for n in self.stem_sizes:
                if n >= len(word):
                    break
                exact = max(exact, self.stems.get(word[:n], 0.0))
        if exact:
            return exact, 0
        if word[:2] in self.heads or word[-2:] in self.tails or any(
                (at, word[at:at + 3]) in self.middles for at in self.places):
            n = len(word)
            for at, k in self.looks.get(n, ()):
                if (n, at, word[n - k:] if at < 0 else word[at:at + k]) in self.parts:
                    return self.near(word)
        return None

    def hits(self, text: str, words: list[str]) -> dict[str, tuple[float, int]]:
        """The words of a text that the lexicon knows; words met before are remembered."""
        if len(self.known) > 200_000:
            self.known.clear()
        known, out = self.known, {}
        for w in set(words):
            if w in known:
                got = known[w]
            else:
                got = known[w] = self.match(w)
            if got:
                out[w] = got
        return out


def features(lexicon: Lexicon, text: str, window: int = 8) -> list[float]:
    """Hits weighed in context: exact sum, misspelled sum, density, largest, quoted sum."""
    text = text.lower()
    words = WORD.findall(text)
    known = lexicon.hits(text, words)
    if not known:
        return [0.0] * FEATURES
    text = APOSTROPHE.sub("'", text)
    spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
    places = [i for i, w in enumerate(words) if w in known]
    exact = fuzzy = largest = quoted = 0.0
    for k, i in enumerate(places):
        weight, e = known[words[i]]
        lo, hi = max(0, i - window), min(len(words) - 1, i + window)
        before, after = text[spans[lo][0]:spans[i][0]], text[spans[i][1]:spans[hi][1]]
        crowd = (k > 0 and places[k - 1] >= lo) + (k + 1 < len(places) and places[k + 1] <= hi)
        told = (QUOTES & set(before) and QUOTES & set(after)) or any(w in REPORTING for w in words[lo:i])
        w = weight * 0.7 ** e * (1 + 0.25 * crowd)
        if told:
            quoted += w
            w *= 0.2
        if e:
            fuzzy += w
        else:
            exact += w
            largest = max(largest, w)
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(100 * exact / len(words)), largest, math.log1p(quoted)]


def labelled(labels: DataFrame, train: Column, most: int) -> DataFrame:
    """(doc_id, toxic): about ``most`` labelled training ids at most, taken by their hash."""
    rows = (labels.where(train & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def learn_lexicon(rows: DataFrame, least: float) -> dict[str, float]:
    """All terms in three toxic documents or more whose document counts differ by G2 of ``least`` or more at three times
    the odds, with log odds; only these tests and the size of ``rows`` bound their number.

    A word or beginning that covers nearly the same toxic documents as a longer one gives way to it.
    """
    def run(batches):
        seen: dict[str, list[int]] = {}
        for b in batches:
            for t, y in zip(b["text"], b["toxic"]):
                for term in terms_of(t):
                    seen.setdefault(term, [0, 0])[y] += 1
            if len(seen) > 300_000:
                yield {"term": list(seen), "clean": [c[0] for c in seen.values()], "toxic": [c[1] for c in seen.values()]}
                seen = {}
        yield {"term": list(seen), "clean": [c[0] for c in seen.values()], "toxic": [c[1] for c in seen.values()]}

    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    total = (sizes.get(0, 0), sizes.get(1, 0))
    if not all(total):
        return {}
    share = total[1] / sum(total)
    counts = map_arrow(rows, run, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    x, z = F.col("toxic"), F.col("clean")
    g2 = 2 * (x * F.log(x / ((x + z) * share)) + F.when(z > 0, z * F.log(z / ((x + z) * (1 - share)))).otherwise(0.0))
    got = counts.where((x >= 3) & (x * total[0] > 3 * z * total[1])).where(g2 >= least).withColumn("g2", g2).collect()
    scored = [(r.g2, r.term, r.toxic, r.clean) for r in got]
    kept: dict[str, tuple[int, int]] = {}
    # Longer terms first: a beginning stays only if it covers clearly more toxic documents than any that extends it.
    cover: Counter = Counter()
    for g, t, x, z in sorted(scored, key=lambda s: (-len(s[1].rstrip("*")), s[1])):
        stem = t.rstrip("*")
        if t.endswith("*") and cover[stem] >= 0.95 * x:
            continue
        kept[t] = (x, z)
        for n in range(1, len(stem) + 1):
            cover[stem[:n]] = max(cover[stem[:n]], x)
    # Shorter beginnings that stayed make those that extend them needless unless clearly purer.
    odds = {t: math.log((x + 0.5) / (total[1] + 1) * (total[0] + 1) / (z + 0.5)) for t, (x, z) in kept.items()}
    final = {}
    for t in sorted(odds, key=lambda t: (len(t.rstrip("*")), t)):
        over = max((final.get(t[:n] + "*", 0.0) for n in range(1, len(t.rstrip("*")))), default=0.0)
        if not over or odds[t] > over + 0.5:
            final[t] = odds[t]
    return {t: final[t] for t in sorted(final)}


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model | None:
    """Logistic regression by Newton steps; None without both kinds of rows."""
    if not len(y) or y.min() == y.max():
        return None
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    hold = np.diag(np.r_[np.full(x.shape[1], ridge), 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + hold + 1e-9 * np.eye(len(w)),
                               z.T @ (y - p) - hold @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return Model({}, mean.tolist(), scale.tolist(), w.tolist())


def learn(docs: DataFrame, labels: DataFrame, train: Column, most: int = 40_000, least: float = 15.0) -> Model | None:
    """A model from the labelled rows for which ``train`` (a condition on ``labels``) holds.

    About ``most`` labelled rows are used, chosen by a hash of their id, near copies once: the lexicon is learned from
    three fifths of them and the logistic model from the others. The ids (12 bytes each) are broadcast, so no other
    text moves.
    """
    ids = labelled(labels, train, most).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().alias("text")).join(
        F.broadcast(ids), "_id")
    # Copies and most near copies share the smallest hash of their word triples, and count once.
    w = F.col("w")
    triples = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
                          lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    kin = F.coalesce(F.array_min(triples), F.xxhash64("text"))
    rows = rows.withColumn("w", F.split(F.lower("text"), r"\s+"))
    rows = rows.groupBy(kin.alias("_kin")).agg(F.min(F.struct("_id", "text", "toxic")).alias("r")).select("r.*")
    rows = stage_table(rows, "toxicity-sample")
    fold = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(5)) < 3
    lexicon = learn_lexicon(rows.where(fold).select("text", "toxic"), least)
    if not lexicon:
        return None

    def run(batches):
        lex = Lexicon(lexicon)
        for b in batches:
            yield {"x": [features(lex, t) for t in b["text"]], "y": b["toxic"]}

    got = map_arrow(rows.where(~fold).select("text", "toxic"), run, "x array<double>, y int").collect()
    model = fit(np.array([r.x for r in got], float).reshape(-1, FEATURES), np.array([r.y for r in got], float))
    return model and model._replace(lexicon=lexicon)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model and tuple(model))  # plain values

    def run(batches):
        m = sent.value and Model(*sent.value)
        lex = Lexicon(m.lexicon) if m else None
        for b in batches:
            if m is None:
                s = [0.0] * len(b["text"])
            else:
                x = np.array([features(lex, t) for t in b["text"]], float).reshape(-1, FEATURES)
                z = ((x - m.mean) / m.scale) @ np.array(m.weights[:-1]) + m.weights[-1]
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield {"doc_id": b["doc_id"], "score": list(s)}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")),
                     run, "doc_id long, score double")
