"""The stages of corpus_pipeline and run() against plain Python, with null and repeated ids and planted copies."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from retailops.llm import common, mixing, toxicity

from test_operators import DOC, base_spans, components, contaminated, plain_simhash

BAD = ["blork", "skunge", "vexit"]


@pytest.fixture(scope="module")
def corpus(spark):
    """(docs, rows, tables): clean, toxic, contaminated, linked and secret rows that share null or repeated ids."""
    rnd = random.Random(23)

    def text(toxic=False, n=40):
        words = [f"w{rnd.randrange(400)}" for _ in range(n)]
        for k in rnd.sample(range(n), 5) if toxic else ():
            words[k] = rnd.choice(BAD)
        return " ".join(words)

    rows, labels = [], []
    for i in range(400):
        rows.append((i, text(i % 5 == 0), "en", f"s{i % 3}", i))
        labels.append((i, int(i % 5 == 0)))
    items = [(k, text(n=14)) for k in range(5)]
    copy, leak = text(), " ".join([text(n=10), items[2][1], text(n=10)])
    for i in (None, 1, 401, 402):  # each id holds clean texts, a toxic one, a leaked one, copies and secrets
        rows += [(i, t, "de", "s0", 7) for t in (text(), text(), text(True, 30), leak, copy, f"token=abcdefgh1 {text()}")]
    rows += [(None, None, None, None, None), (None, "", "en", "s0", 0), (403, copy, None, None, 5), rows[7], rows[7]]
    tables = {"documents": spark.createDataFrame(rows, DOC), "benchmark": spark.createDataFrame(items, "item_id long, text string"),
              "labels": spark.createDataFrame(labels, "doc_id long, toxic int")}
    return rows, items, tables


@pytest.fixture(autouse=True)
def reads(corpus, monkeypatch):
    monkeypatch.setattr(pipe, "read_table", lambda spark, sf_dir, name: corpus[2][name])


def plain_toxicity(rows, tables):
    m = toxicity.learn(tables["documents"], tables["labels"], common.crc_text(F.col("doc_id")) % 3 != 1)
    lexicon = toxicity.Lexicon(m.lexicon)

    def score(t):
        z = (np.array(toxicity.features(lexicon, t or "")) - m.mean) / m.scale @ np.array(m.weights[:-1]) + m.weights[-1]
        return 1 / (1 + np.exp(-z))

    return [r for r in rows if score(r[1]) < 0.7]


def plain_near_duplicates(rows):
    fps = [plain_simhash(r[1] or "") for r in rows]
    of, best = components(set(fps), 2), {}
    for fp, r in zip(fps, rows):
        best.setdefault(of[fp], []).append(r)
    return [sorted(rs, key=lambda r: (r[0] is None, r[0] or 0)) for rs in best.values()]


def plain_decontamination(rows, items):
    return [r for r in rows if not contaminated([(0, r[1])], items)[0][2]]


def plain_secret_scan(rows):
    out = []
    for i, t, lang, source, n in rows:
        spans, at, parts = base_spans(t or ""), 0, []
        for start, _, kind, end in spans:
            if start >= at:
                parts += [t[at:start], f"[{kind}]"]
            at = max(at, end)
        if spans:
            t = "".join(parts) + t[at:]
            n = len(t)
        out.append((i, t, lang, source, n))
    return out


def bag(got):
    return Counter(map(tuple, got.collect() if hasattr(got, "collect") else got))


def one_of_each(got, groups):
    """Every group has one row in ``got``, one with the smallest id, and nothing else is there."""
    got = bag(got)
    for rs in groups:
        least = [r for r in rs if r[0] == rs[0][0]]
        mine = [r for r in set(least) if got[r] == 1]
        assert len(mine) == 1, rs
        del got[mine[0]]
    assert not got


def test_toxicity_stage_drops_rows_by_their_own_text(spark, corpus):
    rows, _, tables = corpus
    want = plain_toxicity(rows, tables)
    assert len(rows) - len(want) > 60 and sum(r[0] is None for r in want) >= 6
    assert bag(pipe.toxicity(spark, tables["documents"], "")) == bag(want)


def test_near_duplicates_stage_keeps_one_row_of_each_component(spark, corpus):
    rows, _, tables = corpus
    groups = plain_near_duplicates(rows)
    assert sum(rs[0][0] is None for rs in groups) >= 5
    one_of_each(pipe.near_duplicates(spark, tables["documents"], ""), groups)


def test_decontamination_stage_drops_rows_by_their_own_text(spark, corpus):
    rows, items, tables = corpus
    want = plain_decontamination(rows, items)
    assert len(rows) - len(want) == 4
    assert bag(pipe.decontamination(spark, tables["documents"], "")) == bag(want)


def test_secret_scan_stage_keeps_every_row(spark, corpus):
    rows, _, tables = corpus
    want = plain_secret_scan(rows)
    assert sum("[assign]" in (r[1] or "") for r in want) == 4
    assert bag(pipe.secret_scan(spark, tables["documents"], "")) == bag(want)


def test_mixture_stage_keeps_the_sampled_rows(spark, corpus):
    rows, _, tables = corpus
    got = bag(pipe.mixture(spark, tables["documents"], "").select(*tables["documents"].columns))
    drawn = mixing.mix(tables["documents"]).where("sampled").select(*tables["documents"].columns)
    assert got == bag(drawn) and 0 < sum(got.values()) < len(rows) and not got - bag(rows)


def test_run_chains_the_stages(spark, corpus):
    rows, items, tables = corpus
    groups = plain_near_duplicates(plain_toxicity(rows, tables))
    chosen = [rs[0] for rs in groups]
    left = plain_secret_scan(plain_decontamination(chosen, items))
    drawn = mixing.mix(spark.createDataFrame(left, DOC)).where("sampled")
    some = F.col("text") != ""  # which of the rows without text stays is a tie
    assert bag(pipe.run(spark, "").where(some).select("doc_id", "text")) == bag(drawn.where(some).select("doc_id", "text"))


def test_stages_take_an_empty_table(spark, corpus):
    for _, stage in pipe.STAGES:
        assert stage(spark, corpus[2]["documents"].limit(0), "").count() == 0


def test_stages_keep_columns_of_any_name(spark, corpus):
    odd = ["_row", "__row", "_blob", "_spans", "_score", "score", "fp", "id", "order", "component_id", "n_hit", "blob", "topic"]
    docs = corpus[2]["documents"].withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
                                               for c in odd})
    for name, stage in pipe.STAGES:
        got = stage(spark, docs, "")
        if name == "mixture":
            continue
        assert got.columns == docs.columns and got.count() > 0
        for c in odd:
            assert got.where(F.col(c) != F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))).count() == 0
