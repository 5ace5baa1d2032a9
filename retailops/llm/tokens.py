"""Token counts by rank-synchronous array merging of byte-level BPE.

A batch's distinct pre-tokens are held as one ragged array of symbol ids. Each round looks up the rank of
every adjacent pair, takes the lowest rank of each pre-token, and merges all its places at once; the
pre-tokens that have no pair left to merge drop out, and the surviving symbols are counted.

Nulls and edges: null and empty texts have 0 tokens; special strings inside a text count as their one token, as the
library's default does; repeated rows are kept; rows with a null id are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_or_empty

# Fixed pattern of this tokenizer family's pre-tokens.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


BITS = 21


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def spread(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


class Merges:
    """A tokenizer file's merges as sorted arrays: pair key, rank and the merged symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.byte_id = np.zeros(256, np.int64)
        for ch, b in byte_letters().items():
            self.byte_id[b] = vocab[ch]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        key = left * self.size + right
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order, made[order]
        self.by_rank = made
        self.maybe = np.zeros(1 << BITS, bool)  # most pairs do not merge: this tells at once
        self.maybe[spread(key)] = True

    def ranks(self, key: np.ndarray) -> np.ndarray:
        """Rank of each pair key, ``none`` for pairs that do not merge."""
        out = np.full(len(key), self.none, np.int64)
        there = np.flatnonzero(self.maybe[spread(key)])
        k = key[there]
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        same = self.key[at] == k
        out[there[same]] = self.rank[at[same]]
        return out


def count_symbols(tokens: list[bytes], m: Merges) -> np.ndarray:
    """Surviving symbols of each pre-token."""
    n = np.array([len(t) for t in tokens], np.int64)
    result = n.copy()
    sym = m.byte_id[np.frombuffer(b"".join(tokens), np.uint8)]
    owner = np.repeat(np.arange(len(tokens)), n)
    rank = np.full(len(sym), m.none, np.int64)  # of the pair that starts at a symbol
    if len(sym) > 1:
        rank[:-1] = m.ranks(sym[:-1] * m.size + sym[1:])
        rank[:-1][owner[:-1] != owner[1:]] = m.none
    while len(sym):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        low = np.minimum.reduceat(rank, first)
        size = np.diff(np.r_[first, len(sym)])
        over = low == m.none
        if over.any():  # finished pre-tokens leave
            result[owner[first[over]]] = size[over]
            stay = np.repeat(~over, size)
            sym, owner, rank, low, size = sym[stay], owner[stay], rank[stay], low[~over], size[~over]
            if not len(sym):
                break
        hit = rank == np.repeat(low, size)
        at = np.flatnonzero(hit)
        # Of places that overlap (a a a), the leftmost of each run and every second one after it merge.
        run = np.r_[True, np.diff(at) > 1]
        nth = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        at = at[nth % 2 == 0]
        sym[at] = m.by_rank[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        new = at - np.arange(len(at))  # where the merged symbols stand after the others moved up
        sym, owner, rank = sym[keep], owner[keep], rank[keep]
        stale = np.unique(np.r_[new, new - 1])
        stale = stale[stale >= 0]
        nxt = np.minimum(stale + 1, len(sym) - 1)
        got = m.ranks(sym[stale] * m.size + sym[nxt])
        got[(owner[stale] != owner[nxt]) | (stale == nxt)] = m.none
        rank[stale] = got
    return result


class Counter50k:
    """Token counts of texts; counts of pre-tokens met before are remembered."""

    def __init__(self, path: str, batch_bytes: int = 1 << 20, remember: int = 300_000):
        import regex

        self.merges = Merges(path)
        self.split = regex.compile(PRE_TOKEN).findall
        self.parts = (regex.compile("(" + "|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True)))
                                    + ")").split if self.merges.special else None)
        self.known: dict[str, int] = {}
        self.batch_bytes, self.remember = batch_bytes, remember

    def pieces(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, special tokens) of a text."""
        if self.parts is None or not any(s in text for s in self.merges.special):
            return self.split(text), 0
        parts = self.parts(text)
        return [t for p in parts[::2] for t in self.split(p)], len(parts) // 2

    def learn(self, tokens: set[str]) -> None:
        """Count pre-tokens not met before, a bounded number of bytes at once."""
        new = [t for t in tokens if t not in self.known]
        raw = [t.encode("utf-8", "replace") for t in new]
        start = size = 0
        for i, r in enumerate(raw):
            size += len(r)
            if size >= self.batch_bytes or i == len(raw) - 1:
                self.known.update(zip(new[start:i + 1], count_symbols(raw[start:i + 1], self.merges).tolist()))
                start, size = i + 1, 0

    def counts(self, texts: list[str], at_once: int = 4 << 20) -> list[int]:
        out, start = [], 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= at_once):
                size += len(texts[stop])
                stop += 1
            bags = []
            for t in texts[start:stop]:
                tokens, special = self.pieces(t)
                bags.append((Counter(tokens), special))
            if len(self.known) > self.remember:
                self.known.clear()
            self.learn(set().union(*(b for b, _ in bags)))
            known = self.known
            out += [special + sum(known[t] * n for t, n in b.items()) for b, special in bags]
            start = stop
        return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; ``tokenizer`` is the path of a byte-level BPE file."""
    def run(batches):
        counter = Counter50k(tokenizer)
        for b in batches:
            yield {"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": counter.counts(b["text"])}

    text = text_or_empty(text_col)
    rows = map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                                 F.octet_length(text).cast("long").alias("n_bytes")),
                     run, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
