"""Source divergence, ranked search and substring dedup against brute force, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from retailops.llm import divergence, lexical, queries, suffixes
from retailops.sources.tables import read_table

from conftest import SF_SMALL
from test_operators import DOC, empty, ids, lower, odd_docs

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- source divergence

def plain_audit(rows, least, top):
    df, n, groups = Counter(), Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(lower(text or ""))
        groups.add((lang, source))
        df.update((lang, t) for t in set(terms))
        n.update((lang, source, t) for t in terms)
    out = []
    for lang, source in groups:
        kept = sorted(t for (x, t), k in df.items() if x == lang and k >= least)
        others = sorted(s for x, s in groups if x == lang)

        def p(counts):
            whole = sum(counts)
            return [1 + 10**9 * (c + 5) // (whole + 5 * len(kept)) for c in counts]

        per = {s: [n[lang, s, t] for t in kept] for s in others}
        mine, all_ = p(per[source]), p([sum(per[s][i] for s in others) for i in range(len(kept))])
        pairs = [(-sum(abs(a - b) for a, b in zip(mine, p(per[s]))), s) for s in others if s != source]
        terms = [(q - m, t) for t, m, q, c in zip(kept, mine, all_, per[source]) if c and m > q]
        out += [(lang, source, "pair", s, -v, i + 1) for i, (v, s) in enumerate(sorted(pairs))]
        out += [(lang, source, "term", t, -v, i + 1) for i, (v, t) in enumerate(
            sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,top,leaves,tile", [(1, 50, 4, 2), (3, 2, 1024, 64), (10**6, 5, 8, 1)])
def test_audit_matches_brute_force_whatever_the_blocks_and_tiles(spark, least, top, leaves, tile):
    df, rows = odd_docs(spark, [(60 + i, f"common w{i % 7} w{i % 3} É{i % 2}", "en", f"s{i % 6}", 1) for i in range(60)])
    got = divergence.audit(df, least, top, leaves, tile)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(got) == plain_audit(rows, least, top)


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(empty(spark)).count() == 0


def test_equal_subtrees_are_one_node_and_equal_pairs_are_priced_once():
    counts = np.array([[1, 2, 1, 2, 1, 2, 1, 2], [3, 4, 3, 4, 3, 4, 3, 4], [1, 2, 1, 2, 3, 4, 3, 4]])
    f = divergence.Forest(counts)
    assert [len(c[0]) for c in f.children] == [2, 2, 3]  # pairs (1, 2) and (3, 4) are one node each, wherever they stand
    priced = []

    def leaf(pair, c, d):
        priced.extend(zip(c.tolist(), d.tolist()))
        return np.abs(c - d)

    price, _, _ = f.walk(np.array([0]), np.array([1]), leaf, np.add)
    assert price.tolist() == [16] and sorted(priced) == [(1, 3), (2, 4)]


def test_shares_are_exact_beyond_64_bits():
    c, n = np.array([10**13 + 7, 3]), np.array([10**14, 10**14])
    assert divergence.share(c, n, 11).tolist() == [1 + 10**9 * (int(x) + 5) // (10**14 + 55) for x in c]


# ---- ranked search

def plain_search(rows, items, top):
    texts = [(r[0], WORD.findall(lower(r[1] or ""))) for r in rows]
    texts = [(i, w, Counter(w)) for i, w in texts if w]
    n, total = len(texts), sum(len(w) for _, w, _ in texts)
    df = Counter(t for _, _, c in texts for t in c)
    out = []
    for item, text in items:
        terms = {t for t in WORD.findall(lower(text or "")) if t in df}
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms}
        scored = []
        for i, w, c in texts:
            m = 50 + 50 * len(w) * n // total
            s = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, x[2], -x[0]) for k, x in enumerate(scored[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("top,at_once,block_docs", [(50, 1 << 20, 4096), (3, 1 << 20, 7), (1, 12, 1), (8, 5, 16)])
def test_search_matches_brute_force_whatever_the_blocks(spark, top, at_once, block_docs):
    df, rows = odd_docs(spark)
    rnd = random.Random(2)
    asked = [(i, " ".join(rnd.choices("the of loan straße naïve e9 x ray 東京 nowhere WORLD license".split(), k=k)))
             for i, k in enumerate((1, 2, 3, 5, 8, 12))] + [(2, "loan loan gnu"), (None, "gnu"), (9, None), (10, "")]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumns({"number": F.lit(1), "terms": F.lit(2)})
    got = lexical.search(df, items, top, at_once, block_docs)
    assert rows_of(got) == plain_search(rows, asked, top)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.search(empty(spark), items).count() == 0
    assert lexical.search(odd_docs(spark)[0], items.where("false")).count() == 0


def test_the_index_is_written_and_read_block_by_block(spark, monkeypatch):
    files, stage = [], lexical.stage_table

    def spy(df, name, **options):
        got = stage(df, name, **options)
        if name == "lexical-index":
            files.extend(f.removeprefix("file:").replace("//", "") for f in got.inputFiles())
        return got

    monkeypatch.setattr(lexical, "stage_table", spy)
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "parquet.hadoop.vectored.io.enabled")
    before = [spark.conf.get(name, None) for name in names]
    rows = [(i, f"loan w{i % 4} the w{i % 3}") for i in range(40)]
    asked = [(1, "the loan w1"), (2, "w0 w2 the")]
    got = lexical.search(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1),
                         spark.createDataFrame(asked, "item_id long, text string"), 5, block_docs=6)
    assert rows_of(got) == plain_search(rows, asked, 5)
    groups = [m.row_group(i) for m in map(pq.read_metadata, files) for i in range(m.num_row_groups)]
    assert [g.num_rows for g in groups] == [1] * 7
    assert not any(g.column(c).is_stats_set for g in groups for c in range(g.num_columns))
    assert [spark.conf.get(name, None) for name in names] == before


def test_bounds_skip_but_lose_no_document_and_pairs_skip_more():
    """Terms 2i and 2i + 1 never meet in a document; some terms of a query are not in the block at all."""
    rnd = random.Random(7)
    weights, proposed = np.arange(60, 36, -1), Counter()
    for trial in range(40):
        cells = [(d, t, rnd.randint(1, 1000)) for d in range(200) for t in range(20) if t % 2 == d % 2 and rnd.random() < 0.3]
        docs, codes, impacts = map(np.array, zip(*cells))
        terms = rnd.sample(range(24), 18) if trial % 2 else list(range(20))
        wanted = np.unique([min(a, b) * 24 + max(a, b) for a, b in zip(terms, terms[1:])])
        row = lexical.build_block(list(range(200)), docs, codes, impacts, weights, wanted, 5)
        _, singles, pairs = lexical.read_block({**row, "doc_ids": [list(range(200))]}, 0, weights)
        true = np.zeros(200, np.int64)
        on = np.isin(codes, terms)
        np.add.at(true, docs[on], (weights[codes] * impacts)[on])
        least = int(np.sort(true)[-5])
        for name, held in (("pairs", pairs), ("single", None)):
            seen = []
            found, scores = lexical.search_block(terms, 200, singles, held, 24, least, seen)
            assert found.tolist() == np.flatnonzero(true >= least).tolist() and (scores == true[found]).all()
            proposed[name] += seen[0]
        per = [{t: s for t, s in zip(codes[docs == d].tolist(), (weights[codes] * impacts)[docs == d].tolist())}
               for d in range(200)]
        for bound, own in lexical.units(terms, singles, pairs, 24):
            assert bound >= max(sum(p.get(t, 0) for t in own) for p in per)
    assert proposed["pairs"] < proposed["single"]


# ---- substring dedup

def plain_repeats(texts, width):
    words = [SPACED.findall(t or "") for t in texts]
    at = defaultdict(int)
    for w in words:
        for i in range(len(w) - width + 1):
            at[tuple(w[i:i + width])] += 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if at[tuple(w[i:i + width])] > 1:
                gone[i:i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def passages(rnd, n, size, alphabet):
    """Texts that share passages, whole or with a word changed, next to their own words."""
    shared = [rnd.choices(alphabet, k=size) for _ in range(4)]
    out = []
    for i in range(n):
        words = rnd.choices(alphabet, k=rnd.randint(0, size))
        for p in rnd.sample(shared, rnd.randint(0, 2)):
            p = list(p)
            if rnd.random() < 0.4:
                p[rnd.randrange(len(p))] = f"new{i}"
            at = rnd.randint(0, len(words))
            words[at:at] = p
        out.append(rnd.choice([" ", "\n", "\t "]).join(words))
    return out


@pytest.mark.parametrize("width,max_group,alphabet", [(35, 4096, 500), (35, 3, 500), (5, 4, 30), (3, 2, 4), (12, 1, 40),
                                                      (70, 4096, 50), (2, 5, 9), (1, 3, 200)])
def test_substring_dedup_matches_brute_force(spark, width, max_group, alphabet):
    rnd = random.Random(width * 10 + max_group)
    words = [f"w{i}" for i in range(alphabet - 2)] + ["Ünï", "東京"]
    texts = passages(rnd, 60, 3 * max(width, 10), words)
    texts += [texts[0], texts[1], texts[1], "", None, " \t\n", "a b " * 200, "w0 " * 300, "x" * 100_000]
    rows = [(i if i % 9 else None, t, None, None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("d1", "d2", "listed", "s", "key", "_word")})
    got = suffixes.drop_repeats(df, width, max_group)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert rows_of(got) == sorted(((r[0], *x) for r, x in zip(rows, plain_repeats(texts, width))), key=repr)


def test_substring_dedup_keeps_rows_and_gives_texts(spark):
    df, rows = odd_docs(spark)
    got = suffixes.drop_repeats(df, 4, keep_text=True)
    assert ids(got) == sorted((r[0] for r in rows), key=lambda x: (x is None, x or 0))
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got.collect())
    assert suffixes.drop_repeats(empty(spark)).count() == 0


def test_long_texts_are_hashed_in_slices(monkeypatch):
    text = "".join(random.Random(3).choices(["ab ", "東京\n", "x", "\t"], k=5000))
    whole = suffixes.word_hashes(text).tolist()
    monkeypatch.setattr(suffixes, "SLICE", 7)
    assert suffixes.word_hashes(text).tolist() == whole and len(whole) == len(text.split())


def test_the_three_queries_against_brute_force(spark):
    docs = [tuple(r) for r in read_table(spark, SF_SMALL, "documents").select("doc_id", "text", "lang", "source").collect()]
    items = [tuple(r) for r in read_table(spark, SF_SMALL, "benchmark").select("item_id", "text").collect()]
    assert rows_of(queries.op11_source_divergence(spark, SF_SMALL)) == plain_audit(docs, 30, 50)
    assert rows_of(queries.op12_lexical_search(spark, SF_SMALL)) == plain_search(docs, items, 50)
    assert rows_of(queries.op13_substring_dedup(spark, SF_SMALL)) == sorted(
        ((d[0], *x) for d, x in zip(docs, plain_repeats([d[1] for d in docs], 35))), key=repr)
