"""License scans: an exact set-similarity join of text blocks with notice templates.

Blocks are the lines and, with ``wrapped``, also every run of a template's length in the word sequence of the whole text,
whatever line ends fall into it, so that a notice wrapped at any column is met. Whole paragraphs are no blocks: in one of
some length the few words of a short template stand by chance.

A block meets a template if it holds at least ``threshold`` of the template's distinct words, and all of its obligatory
ones (what sets the notice apart from those of other licenses). All word sets are
ordered by how many blocks of the whole corpus hold the word, rarest first. A pair needs ``need`` common words, so the
block must hold a word of the template's prefix (all but its last ``need - 1`` words) within the block's own prefix
(length filter: it must have ``need`` words at all), and the first common word must leave enough words behind it on
both sides (positional filter). What remains is verified by counting. Words that no template has cannot be
common and are left out of the block's set, which changes no result.

The templates are a stated set of bounded size and are sent to every task.

Nulls and edges: null and empty texts have no words and no labels; a very long text is read whole, line by line and as one
sequence of words; of equal containments any gives the score; repeated rows are kept; rows with a null id are kept;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, map_arrow, text_or_empty

# Fixed phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Fixed notices and their labels.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-text": "you may not use this file except in compliance with the license",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-text": "you can redistribute it and or modify it under the terms of the gnu general public license as published "
                "by the free software foundation",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                "associated documentation files",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
# Fixed words without which a block is another notice: the license's name, or its version.
OBLIGATORY = {"apache-2.0": "apache 2", "gpl-3.0": "gnu 3", "gpl-text": "gnu", "mit-notice": "mit", "cc-by-nc-4.0": "cc by nc 4",
              "mpl-2.0": "mozilla 2"}


def block_words(line: bytes) -> list[bytes]:
    return line.translate(WORD_TABLE).split()


def required(size: int, threshold: float) -> int:
    """Common words needed of a template of ``size``; the tolerance undoes rounding of the product."""
    return max(1, -int(-(size * threshold - 1e-9) // 1))


class TemplateIndex:
    """Templates in the global word order, with an inverted index of their prefixes."""

    def __init__(self, templates: Mapping[str, str], blocks_with: Mapping[bytes, int], threshold: float,
                 obligatory: Mapping[str, str] = OBLIGATORY):
        sets = {label: {*block_words(t.encode())} for label, t in templates.items()}
        words = sorted({w for s in sets.values() for w in s}, key=lambda w: (blocks_with.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(words)}
        self.templates = []  # label, ranks, need
        self.lengths = [len(block_words(t.encode())) for t in templates.values()]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        self.must, self.heads = [], []  # of each template: obligatory words, and words of which a run holds one at least
        for label, s in sets.items():
            ranks = sorted(self.rank[w] for w in s)
            need = required(len(ranks), threshold)
            for at, r in enumerate(ranks[:len(ranks) - need + 1]):
                self.prefix.setdefault(r, []).append((len(self.templates), at))
            self.templates.append((label, ranks, need))
            self.must.append({self.rank[w] for w in block_words(obligatory.get(label, "").encode())})
            self.heads.append({*ranks[:len(ranks) - need + 1]} | self.must[-1])
        self.first_words = {words[r] for r in self.prefix}

    def meet(self, words: list[bytes]) -> dict[str, float]:
        """{label: containment} of all templates that a block of these words meets."""
        block = sorted({self.rank[w] for w in words if w in self.rank})
        met, tried = {}, set()
        for at, r in enumerate(block):
            for k, place in self.prefix.get(r, ()):
                if k in tried:
                    continue
                tried.add(k)  # this is the first common word of the two, by the order
                label, ranks, need = self.templates[k]
                if len(block) < need or min(len(ranks) - place, len(block) - at) < need:
                    continue
                common = len({*block[at:]}.intersection(ranks))
                if common >= need and self.must[k].issubset(block):
                    met[label] = common / len(ranks)
        return met

    def meet_runs(self, words: list[bytes]) -> dict[str, float]:
        """{label: containment} of all templates that a run of as many words as the template has meets."""
        at = [(i, self.rank[w]) for i, w in enumerate(words) if w in self.rank]
        own = {r for _, r in at}
        met = {}
        for (label, ranks, need), length, must, heads in zip(self.templates, self.lengths, self.must, self.heads):
            if len(own.intersection(ranks)) < need or not must <= own:
                continue
            wanted, inside, first, best = {*ranks}, Counter(), 0, 0
            places = [(i, r) for i, r in at if r in wanted]
            # only runs around a word of the prefix can meet the template
            starts = [i for i, r in places if r in heads]
            near = [bisect(starts, i + length - 1) > bisect(starts, i - length) for i, _ in places]
            places = [p for p, on in zip(places, near) if on]
            for i, r in places:
                inside[r] += 1
                while places[first][0] <= i - length:
                    inside[places[first][1]] -= 1
                    if not inside[places[first][1]]:
                        del inside[places[first][1]]
                    first += 1
                if len(inside) > best and must <= inside.keys():
                    best = len(inside)
            if best >= need:
                met[label] = best / len(ranks)
        return met


def places(words: list[bytes], phrases: Mapping[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of all places where a phrase's words stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at = joined.find(needle)
        before, counted = 0, 0
        while at >= 0:
            counted += joined.count(b" ", before, at)
            before = at
            out.append((counted, label))
            at = joined.find(needle, at + 1)
    return out


def block_counts(docs: DataFrame, templates: Mapping[str, str]) -> dict[bytes, int]:
    """For every template word, how many blocks of the corpus hold it."""
    vocabulary = {w for t in templates.values() for w in block_words(t.encode())}

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                for line in t.encode("utf-8", "replace").split(b"\n"):
                    counts.update(vocabulary.intersection(block_words(line)))
        yield {"word": [w.decode() for w in counts], "n": list(counts.values())}

    got = map_arrow(docs, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word.encode(): r.n for r in got}


def licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES,
             threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
             wrapped: bool = False, obligatory: Mapping[str, str] = OBLIGATORY) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, blocks, score) for every row.

    ``blocks`` counts the lines that meet a template; ``score`` is the largest containment met, 1 where a phrase stands.
    With ``wrapped``, templates met by a run of words across line ends count in ``labels`` and ``score`` too.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    index = TemplateIndex(templates, block_counts(rows.select("text"), templates), threshold, obligatory)
    last_words = {p.split()[-1].encode() for p in phrases}

    def one(text: str):
        raw = text.encode("utf-8", "replace")
        words = block_words(raw)
        own = {*words}
        base = sorted(places(words, phrases)) if own & last_words else []
        labels, best, blocks = {x for _, x in base}, 1.0 if base else 0.0, 0
        base_labels = ",".join(sorted(labels))
        if own & index.first_words:
            for line in raw.split(b"\n"):
                if met := index.meet(block_words(line)):
                    blocks += 1
                    labels |= met.keys()
                    best = max(best, *met.values())
            if wrapped and (met := index.meet_runs(words)):
                labels |= met.keys()
                best = max(best, *met.values())
        return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, base_labels,
                ",".join(sorted(labels)), blocks, best)

    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "blocks", "score")

    def run(batches):
        for b in batches:
            cols = list(zip(*map(one, b["text"]))) or [()] * len(names)
            yield {"doc_id": b["doc_id"]} | {n: list(c) for n, c in zip(names, cols)}

    return map_arrow(rows, run, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                "base_labels string, labels string, blocks long, score double")
