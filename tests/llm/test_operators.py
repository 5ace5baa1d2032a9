"""The training-data operators against brute force on small tables, and their edge cases.

Every operator meets nulls in any column, empty and very long texts, ties and repeated rows, an empty table, and extra
columns whose names clash with its own.
"""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retailops.llm import (common, decontam, fingerprint, licenses, maxent, mixing, queries, secrets, simhash, sql,
                           tokens, toxicity, urls)
from retailops.session import scratch_path
from retailops.sources.tables import read_table

from conftest import SF_SMALL

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of loan Straße naïve e9 x-ray 東京 Hello, WORLD a the of end. gnu license".split()


def odd_docs(spark, extra=()):
    """Nulls everywhere, empty and long texts, repeated rows and ids, clashing extra columns."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(0, 40))), rnd.choice(["en", "de", None]),
             rnd.choice(["s0", "s1", None]), i) for i in range(40)]
    rows += [(40, "", "en", "s0", 0), (41, None, None, None, None), (None, "null id", "en", "s0", 7),
             (None, "null id", "en", "s0", 7), (None, None, None, None, None), (3, "same id, other text", "en", "s0", 1),
             (42, "word " * 30_000, "en", "s0", 1), (43, "x" * 100_000, "en", "s0", 1), rows[5], rows[5],
             (44, "\x00 \x1c\x85 odd \u2028 blanks\r\n", "fr", "s1", 3), (45, "🦊" * 50, "es", "s1", 50), *extra]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({c: F.lit(1) for c in ("score", "fp", "blob", "tokens", "topic", "probability", "id", "_id",
                                                 "items", "bucket", "spans", "train", "share")}), rows


def ids(df, col="doc_id"):
    return sorted((r[0] for r in df.select(col).collect()), key=lambda x: (x is None, x or 0))


def empty(spark):
    return spark.createDataFrame([], DOC)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_follow_their_patterns():
    rnd = random.Random(1)
    for _ in range(300):
        s = "".join(chr(rnd.choice([rnd.randrange(0x80), rnd.randrange(0x80, 0x3000), 0x1F98A, 0x2028])) for _ in range(40))
        assert [w.decode() for w in common.plain_words(s)] == PLAIN.findall(lower(s))
        assert [w.decode() for w in common.space_words(s)] == SPACED.findall(lower(s))


# --- secrets --------------------------------------------------------------------------

def base_spans(text):
    a = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, "assign", m.end()) for m in a.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


SECRET_TEXTS = ['password: "hunter2hunter2"', "pass password:token:abcdefgh1 secret=short secret = 12345678",
                "🦊🦊 AKIA" + "Z9" * 8 + " AKIAAKIAAKIAAKIA", "g" + "0f" * 16 + "g " + "a" * 31, "to\u212aen=abcdefgh12",
                "API_KEY='x' apikey=" + "q" * 9, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 18,
                "http://me:pw12@host token=token=abcdefgh12", "secret==========", "passwordpassword=abcdefgh"]


def test_secret_spans_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(SECRET_TEXTS)], DOC)
    got = secrets.secrets(docs, scratch_path(spark, "ledger")).collect()
    for r in got:
        own = [(s.start, s.rank, s.kind, s.end) for s in r.spans if s.rank < 3]
        assert own == base_spans(SECRET_TEXTS[r.doc_id]), r
    kinds = {s.kind for r in got for s in r.spans}
    assert {"private_key", "hosting", "login_url"} <= kinds


def test_the_linear_pattern_has_the_plain_matches():
    rnd = random.Random(8)
    (rule,) = [r for r in secrets.RULES if r.linear]
    plain = rule._replace(linear="")
    for _ in range(3000):
        text = "".join(rnd.choice(["eyJ", "eyJ", ".eyJ", ".", "abcdefgh", "aZ09_-xy", "a", " ", "é", "eyeyJ"]) for _ in range(rnd.randint(1, 14)))
        assert secrets.find(text, [(6, rule)]) == secrets.find(text, [(6, plain)]), text


def test_a_million_characters_take_no_quadratic_time():
    import time
    ranked = list(enumerate(secrets.RULES))
    for text in ("eyJ" * 333_334, "a" * 1_000_000, "http://" + "u" * 1_000_000, "token" * 200_000, "://" * 333_333,
                 "AKIA" * 250_000, "ftp://a:" * 125_000, "-----BEGIN " + "A " * 500_000):
        start = time.monotonic()
        secrets.find(text, ranked)
        assert time.monotonic() - start < 20, text[:10]
    long = f"see db://{'u' * 200}:{'p' * 300}@host"
    assert [(s["kind"], s["start"]) for s in secrets.find(long, ranked)] == [("login_url", 4)]


def test_secret_ledger_scans_only_what_it_lacks(spark, monkeypatch):
    path = scratch_path(spark, "ledger")
    one = spark.createDataFrame([("a/x", "token=abcdefgh1"), ("b/y", "token=abcdefgh1"), ("c", "clean")], "path string, text string")
    first = {r.path: len(r.spans) for r in secrets.secrets(one, path, path_cols=["path"]).collect()}
    assert first == {"a/x": 1, "b/y": 1, "c": 0}
    assert secrets.read_ledger(spark, path).count() == 2  # one entry per blob
    two = spark.createDataFrame([("a/x", "token=abcdefgh1"), ("d", "AKIA" + "Q" * 16)], "path string, text string")
    fresh = secrets.scan(two, secrets.read_ledger(spark, path))
    assert fresh.count() == 1  # the blob known already is not read again
    assert {r.path: len(r.spans) for r in secrets.secrets(two, path, path_cols=["path"]).collect()} == {"a/x": 1, "d": 1}
    # a new version of one rule is applied to all blobs, the others are not
    newer = tuple(r._replace(version=2, least=4) if r.kind == "assign" else r for r in secrets.RULES)
    again = secrets.scan(one, secrets.read_ledger(spark, path), newer).collect()
    assert [r.rules for r in again] == [["assign@2"]] * 2
    # both ways of fetching the texts agree
    a = secrets.scan(one, secrets.read_ledger(spark, None), few_blobs=0).select("blob", "spans").collect()
    b = secrets.scan(one, secrets.read_ledger(spark, None)).select("blob", "spans").collect()
    key = lambda r: bytes(r.blob)
    assert sorted(a, key=key) == sorted(b, key=key)


def test_secret_edge_cases(spark):
    docs, rows = odd_docs(spark)
    assert ids(secrets.secrets(docs, scratch_path(spark, "ledger"))) == ids(docs)
    assert secrets.secrets(empty(spark), scratch_path(spark, "ledger")).count() == 0
    text = "a token=abcdefgh1 b AKIA" + "Q" * 16 + " c " + "0f" * 20
    found = secrets.secrets(spark.createDataFrame([(1, text, None, None, None)], DOC), scratch_path(spark, "ledger"))
    out = found.select(secrets.redact(F.lit(text), F.col("spans")).alias("t")).first().t
    assert out == "a [assign] b [access] c [hex]"


# --- toxicity -------------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automata_find_every_term_within_its_edits():
    rnd = random.Random(2)
    terms = {"idiot": 3.0, "pathetic": 2.0, "worthlessness": 1.5, "scum": 4.0, "moron": 2.5, "clown": 1.0}
    lex = toxicity.Lexicon(terms)
    words = set()
    for t in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rnd.randint(0, 3)):
                k, i = rnd.randrange(3), rnd.randrange(len(w))
                if k == 0:
                    w[i] = rnd.choice("abcdeiorst")
                elif k == 1:
                    w.insert(i, rnd.choice("abcdeiorst"))
                elif len(w) > 1:
                    del w[i]
            words.add("".join(w))
    for w in words:
        near = [(x * 0.7 ** e, x, e) for t, x in terms.items() if (e := edits(w, t)) <= lex.edits(t)]
        want = (terms[w], 0) if w in terms else max(near)[1:] if near else None
        got = lex.match(w)
        assert (got is None) == (not near), w
        assert got is None or math.isclose(got[0] * 0.7 ** got[1], want[0] * 0.7 ** want[1]), (w, got, want)


def test_quotation_scores_below_abuse():
    lex = toxicity.Lexicon({"idiot": 3.0, "zorg*": 2.0})
    abuse = toxicity.features(lex, "you are such an idiot and you know it")
    quote = toxicity.features(lex, 'the report quoted the word "idiot" once in a footnote')
    assert abuse[0] > quote[0] and quote[4] > 0 and abuse[4] == 0
    assert toxicity.features(lex, "you idiott")[1] > 0 and toxicity.features(lex, "zorgisch")[0] > 0
    assert toxicity.features(lex, "") == [0.0] * toxicity.FEATURES


@pytest.fixture(scope="module")
def abuse(spark):
    rnd = random.Random(6)
    bad, good = ["blork", "skunge", "vexit"], [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = rnd.choices(good, k=40)
        for j in range(4 if toxic else 0):
            words[rnd.randrange(40)] = rnd.choice(bad)
        rows.append((i, " ".join(words), "en", "s", None))
        labels.append((i, int(toxic)))
    return (spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels))


def test_toxicity_held_out_accuracy(spark, abuse):
    docs, labels, truth = abuse
    model = toxicity.learn(docs, labels, common.crc_text(F.col("doc_id")) % 3 != 1)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 50 and all((got[i] >= 0.7) == bool(truth[i]) for i in held)


def test_toxicity_edge_cases(spark, abuse):
    docs, labels, _ = abuse
    odd, _ = odd_docs(spark)
    model = toxicity.learn(docs, labels.unionByName(spark.createDataFrame([(None, 1), (1, None), (5, 0)], labels.schema)), F.lit(True))
    assert ids(toxicity.score(odd, model)) == ids(odd)
    assert toxicity.score(empty(spark), model).count() == 0
    none = toxicity.learn(docs, labels.where("toxic = 0"), F.lit(True))
    assert none is None and {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.learn(empty(spark), labels.limit(0), F.lit(True)) is None


def test_lexicon_keeps_every_term_that_passes(spark):
    """500 words, each in some 24 toxic texts and no other: none is cut by its rank."""
    rnd = random.Random(12)
    marks = ["".join(rnd.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(500)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 3 == 0
        words = rnd.sample(marks, 24) if toxic else []
        words += [f"w{rnd.randrange(10**6)}" for _ in range(30)]
        rows.append((i, " ".join(words), "en", "s", None))
        labels.append((i, int(toxic)))
    model = toxicity.learn(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, toxic int"),
                           F.lit(True))
    lexicon = toxicity.Lexicon(model.lexicon)  # a mark's beginning may stand for it
    assert sum(lexicon.match(m) is not None and lexicon.match(m)[1] == 0 for m in marks) > 480


# --- urls -----------------------------------------------------------------------------

def test_url_rules_and_vocabulary(spark):
    cases = {None: ("", "", None, "allow"), "no scheme/de/": ("", "", None, "allow"),
             "http://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
             "http://a.net": ("a.net", "", None, "allow"), "http://a.net/": ("a.net", "/", "net/", "block"),
             "https://x.example.com/de/a": ("x.example.com", "/de/a", "example.com/de/", "block"),
             "https://notexample.com/de/a": ("notexample.com", "/de/a", None, "allow"),
             "http://b.org/fr/casino": ("b.org", "/fr/casino", "org/fr/", "allow"),
             "http://casino.example.com/en": ("casino.example.com", "/en", None, "block"),
             "http://casinos.example.com/en": ("casinos.example.com", "/en", None, "allow"),
             "http://free-bets.example.com/": ("free-bets.example.com", "/", None, "block"),
             "http://bet-bets.example.com/": ("bet-bets.example.com", "/", None, "allow"),
             "http://a.com/éfree-ñwin": ("a.com", "/éfree-ñwin", None, "allow"),
             "http://a.com/free/²win": ("a.com", "/free/²win", None, "allow"),
             "http://a.com/free…win": ("a.com", "/free…win", None, "block"),
             "http://free-free.example.com/": ("free-free.example.com", "/", None, "allow"),
             "http://x.com?q=://y": ("x.com", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow")}
    rows = [(i, u) for i, u in enumerate(cases)] + [(None, "http://a.net/"), (0, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))
    got = urls.judge(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    for i, (u, want) in enumerate(cases.items()):
        assert by[i] == want, u
    assert urls.judge(pages.limit(0)).count() == 0


# --- licenses -------------------------------------------------------------------------

def must(label):
    return {*licenses.OBLIGATORY.get(label, "").split()}


def test_notices_of_other_licenses_get_no_label(spark):
    texts = {"Licensed under CC BY 4.0.": "cc-by", "released under the apache license": "apache",
             "Released under the BSD License": "", "This work is licensed under the GNU General Public License version 2": "gpl",
             "Licensed under the\nApache License, version 2.0": "apache,apache-2.0", "released under MIT license": "mit,mit-notice"}
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r.labels for r in licenses.licenses(docs, wrapped=True).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_license_join_against_brute_force(spark):
    rnd = random.Random(9)
    pool = sorted({w for t in licenses.TEMPLATES.values() for w in t.split()}) + ["foo", "bar"]
    rows = []
    for i in range(300):
        lines = []
        for _ in range(rnd.randint(0, 4)):
            t = rnd.choice(list(licenses.TEMPLATES.values())).split()
            t = [w for w in t if rnd.random() < 0.9] + rnd.choices(pool, k=rnd.randint(0, 5))
            rnd.shuffle(t) if rnd.random() < 0.3 else None
            lines.append(" ".join(t).title())
        rows.append((i, "\n".join(lines), None, None, None))
    for threshold in (0.5, 0.8, 1.0):
        got = {r.doc_id: r for r in licenses.licenses(spark.createDataFrame(rows, DOC), threshold=threshold).collect()}
        for i, text, *_ in rows:
            met = {}
            for line in text.split("\n"):
                words = set(PLAIN.findall(lower(line)))
                for label, t in licenses.TEMPLATES.items():
                    t = set(t.split())
                    if len(t & words) >= threshold * len(t) - 1e-9 and must(label) <= words:
                        met[label] = max(met.get(label, 0), len(t & words) / len(t))
            w = PLAIN.findall(lower(text))
            base = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(w))
                          if w[k:k + len(p.split())] == p.split())
            labels = {x for _, x in base}
            r = got[i]
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (
                len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None)
            assert r.base_labels == ",".join(sorted(labels)) and r.labels == ",".join(sorted(labels | met.keys()))
            assert math.isclose(r.score, 1.0 if base else max(met.values(), default=0.0))


def test_license_edge_cases(spark):
    docs, _ = odd_docs(spark, [(50, "mit license mit license", None, None, None)])
    out = licenses.licenses(docs)
    assert ids(out) == ids(docs)
    r = out.where("doc_id = 50").first()
    assert (r.n_base, r.first_word, r.last_word) == (2, 0, 2)
    assert licenses.licenses(empty(spark)).count() == 0


def test_wrapped_notices_are_met(spark, monkeypatch):
    """Every template at every wrapping, behind comment signs and between other words, and against brute force."""
    rnd = random.Random(19)
    pool = sorted({w for t in licenses.TEMPLATES.values() for w in t.split()}) + ["foo", "bar"]
    rows, planted = [], {}
    for label, t in licenses.TEMPLATES.items():
        for width in (1, 2, 3, 5, 8, 13):
            words = [f"x{k}" for k in range(rnd.randint(0, 7))] + t.split() + ["y1", "y2"]
            text = "\n".join(" * " + " ".join(words[k:k + width]) for k in range(0, len(words), width))
            planted[len(rows)] = label
            rows.append((len(rows), text, "en", "s", None))
    for _ in range(200):
        words = [w for t in rnd.choices(list(licenses.TEMPLATES.values()), k=2) for w in t.split() if rnd.random() < 0.9]
        words += rnd.choices(pool, k=rnd.randint(0, 20))
        rows.append((len(rows), "".join(w + rnd.choice("  \n") for w in words), "en", "s", None))
    docs = spark.createDataFrame(rows, DOC)
    monkeypatch.setattr(queries, "read_table", lambda spark, sf_dir, name: docs)
    got = {r.doc_id: r for r in queries.op4_license_scan(spark, "").collect()}
    assert all(label in got[i].labels.split(",") and got[i].score == 1.0 for i, label in planted.items())
    for i, text, *_ in rows:
        w, want = PLAIN.findall(lower(text)), {x for x in got[i].base_labels.split(",") if x}
        lines = [PLAIN.findall(line) for line in lower(text).split("\n")]
        best = 1.0 if want else 0.0
        for label, t in licenses.TEMPLATES.items():
            t = t.split()
            own = {*t}
            blocks = lines + [w[k:k + len(t)] for k in range(len(w))]
            most = max((len(own & {*b}) / len(own) for b in blocks if must(label) <= {*b}), default=0.0)
            if most >= 0.8 - 1e-9:
                want.add(label)
                best = max(best, most)
        assert got[i].labels == ",".join(sorted(want)) and math.isclose(got[i].score, best), text
    # the SQL twin knows wrapped notices too
    import duckdb
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r[0], r[1]) for r in rows], columns=["doc_id", "text"]))
    twin = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, labels, score FROM ({sql.licenses_sql()})").fetchall()}
    assert all(twin[i][0] == got[i].labels and math.isclose(twin[i][1], got[i].score) for i in got)


# --- decontamination ------------------------------------------------------------------

def contaminated(docs, items, width=10, slop=None):
    win = {}
    for i, text in items:
        w = PLAIN.findall(lower(text or ""))
        for k in range(max(1, len(w) - width + 1)) if w else ():
            win.setdefault(tuple(w[k:k + width]), set()).add(i)
    out = []
    for i, text in docs:
        w = PLAIN.findall(lower(text or ""))
        hit, found = set(), set()
        for k in range(len(w)):
            for n in range(1, width + 1):
                own = win.get(tuple(w[k:k + n])) if k + n <= len(w) else None
                if own:
                    found |= own
                    hit.update(range(k, k + n))
        out.append((i, len(w), len(hit), tuple(sorted(found, key=str))))
    return sorted(out, key=repr)


def bench_case():
    rnd = random.Random(12)
    pool = [f"t{i}" for i in range(30)] + ["the"] * 20
    items = [(i, " ".join(rnd.choices(pool, k=rnd.choice([0, 1, 3, 10, 14, 25])))) for i in range(25)]
    items += [(25, None), (26, items[3][1]), (27, "the " * 30), (3, "a second row of item three")]
    docs = []
    for i in range(120):
        w = rnd.choices(pool, k=rnd.randint(0, 60))
        if i % 3 == 0:
            t = (items[rnd.randrange(25)][1] or "").split()
            w[5:5] = t[rnd.randint(0, 3):]
        docs.append((i, " ".join(w).upper()))
    docs += [(None, items[10][1]), (None, None), (7, "the " * 5000), (120, ""), (120, "")]
    return docs, items


def test_decontamination_against_brute_force(spark):
    docs, items = bench_case()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("x"))
    want = contaminated(docs, items)
    for block_words in (2_000_000, 100):  # one block of windows, and several whose results are merged
        got = decontam.contamination(d, b, block_words=block_words)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"], key=str))) for r in got.collect()),
                      key=repr) == want
    assert decontam.contamination(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontam.contamination(d, b.limit(0)).collect()} == {0}


def near_items(docs, items, slop, width=10):
    """Items with a window whose words all lie near an occurrence of its word that is rarest in all of ``docs``."""
    words = [PLAIN.findall(lower(t or "")) for _, t in docs]
    freq, out = Counter(x for w in words for x in w), []
    for (i, _), w in zip(docs, words):
        found = set()
        for k, text in items:
            t = PLAIN.findall(lower(text or ""))
            for n in range(max(1, len(t) - width + 1)) if t else ():
                win = t[n:n + width]
                rare, reach = min(win, key=lambda x: freq[x]), len(win) + slop
                if any(x == rare and {*win} <= {*w[max(0, p - reach):p + reach + 1]} for p, x in enumerate(w)):
                    found.add(k)
                    break
        out.append((i, tuple(sorted(found))))
    return sorted(out, key=repr)


def test_proximity_against_brute_force_whatever_the_segments(spark):
    rnd = random.Random(3)
    items = [(0, "alpha beta gamma delta"), (1, "kappa lambda mu nu xi"), (2, " ".join(f"x{k}" for k in range(14))), (3, None)]
    docs = []
    for i in range(90):
        w = rnd.choices([f"f{k}" for k in range(9)], k=rnd.choice([40, 200]))
        for t in items[i % 3][1].split():
            w[rnd.randrange(40)] = t
        docs.append((i, " ".join(w)))
    docs += [(None, items[1][1]), (91, None), (92, "delta gamma " + "f1 " * 70 + "beta alpha")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for slop in (0, 6, 100):  # the last reaches over 63 words
        want = near_items(docs, items, slop)
        for size, block in ((4 << 20, 1_000_000), (500, 20)):
            got = decontam.contamination(d.repartition(3), b, slop=slop, segment_chars=size, block_words=block)
            assert sorted(((r.doc_id, tuple(sorted(r.near))) for r in got.collect()), key=repr) == want
    assert any(len(x) for _, x in want)


def test_long_items_go_in_pieces_and_a_full_bitmap_loses_nothing(spark, monkeypatch):
    rnd = random.Random(8)
    long = " ".join(f"w{rnd.randrange(3000)}" for _ in range(9000))
    docs = [(1, "a " + " ".join(long.split()[4090:4110]) + " b"), (2, long), (3, "w1 w2 w3"), (4, "q " * 100_000)]
    items = [(7, long), (8, "w1 w2 w3")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = contaminated(docs, items)
    for bits in (25, 16):
        monkeypatch.setattr(decontam, "MOST_BITS", bits)
        got = decontam.contamination(d, b, block_words=5000).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in got), key=repr) == want


# --- simhash --------------------------------------------------------------------------

def plain_simhash(text, k=3):
    import xxhash
    w = SPACED.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_fingerprints_against_brute_force(spark):
    docs, rows = odd_docs(spark)
    want = sorted(((i, plain_simhash(t or "")) for i, t, *_ in rows), key=repr)
    got = sorted(((r.doc_id, r.fp % (1 << 64)) for r in simhash.fingerprints(docs).collect()), key=repr)
    assert got == want


def components(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(list(fps), np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= radius):
            x, y = find(int(a[i])), find(int(a[i + 1 + j]))
            root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("radius,max_shard", [(2, 2048), (2, 37), (0, 2048), (3, 50)])
def test_components_against_brute_force(spark, radius, max_shard):
    rnd = random.Random(radius * 100 + max_shard)
    fps = {rnd.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1}
    for c in [rnd.getrandbits(64) for _ in range(12)]:  # clouds around centres: long chains and crowded shards
        for _ in range(60):
            c2 = c
            for _ in range(rnd.randint(0, 5)):
                c2 ^= 1 << rnd.randrange(64)
            fps.add(c2)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in
             simhash.connected(simhash.links(classes, radius, max_shard)).collect()}
    want = components(sorted(fps), radius)
    groups = lambda m: sorted(sorted(f for f in fps if m(f) == g) for g in {m(f) for f in fps})
    assert groups(lambda f: roots.get(f, f)) == groups(want.get)


def test_bk_trees_follow_their_keys():
    rnd = np.random.default_rng(8)
    fp = rnd.integers(0, 1 << 64, 500, dtype=np.uint64)
    tree = np.sort(rnd.integers(0, 5, 500))
    root, keys, children = simhash.build_trees(tree, fp)
    parent, d = keys // 65, keys % 65
    assert len(children) == 500 - 5 and len(set(zip(parent, d))) == len(keys)
    assert (np.bitwise_count(fp[parent] ^ fp[children]) == d).all() and (tree[parent] == tree[children]).all()


def test_simhash_edge_cases(spark):
    docs, rows = odd_docs(spark)
    out = simhash.near_duplicates(docs)
    assert ids(out) == ids(docs)
    zero = {r.component_id for r in out.where("fp = 0").collect()}
    least = min(i for i, t, *_ in rows if i is not None and not SPACED.findall(t or ""))
    assert zero == {least}  # the empty, the null and the blank texts
    assert simhash.near_duplicates(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d")] * 2, "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(nulls).collect()} == {None}


# --- mixing ---------------------------------------------------------------------------

def raked(cells, targets, steps=400):
    share = {k: t / sum(cells.values()) for k, t in cells.items()}
    for _ in range(steps):
        for d, want in enumerate(targets):
            have = Counter()
            for k, s in share.items():
                have[k[d]] += s
            share = {k: s * want[k[d]] / have[k[d]] for k, s in share.items()}
    return share


def test_raking_against_brute_force(spark):
    rnd = random.Random(21)
    cells = {(s, la, t): rnd.randint(1, 500) for s in ("s0", "s1", "s2", None) for la in ("en", "de") for t in ("a", "b", "c")
             if rnd.random() < 0.9}
    df = spark.createDataFrame([(*k, float(v)) for k, v in cells.items()], "source string, lang string, topic string, tokens double")
    dims = ("source", "lang", "topic")
    fitted = mixing.rake(df, {d: mixing.targets_of(df, d, None, 0.5) for d in dims}, tolerance=1e-10, sweeps=60)
    targets = []
    for d in range(3):
        sums = Counter()
        for k, v in cells.items():
            sums[k[d]] += v
        z = sum(math.sqrt(v) for v in sums.values())
        targets.append({k: math.sqrt(v) / z for k, v in sums.items()})
    want = raked(cells, targets)
    got = {(r.source, r.lang, r.topic): r.share for r in fitted.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    for budget in (0.1, 0.5, 0.9, 1.0):
        p = {(r.source, r.lang, r.topic): (r.probability, r.tokens) for r in mixing.calibrate(fitted, budget).collect()}
        assert all(0 <= x <= 1 for x, _ in p.values())
        assert math.isclose(sum(x * t for x, t in p.values()), budget * sum(cells.values()), rel_tol=1e-9)


def test_mixing_given_targets_and_edge_cases(spark):
    docs, _ = odd_docs(spark)
    out = mixing.mix(docs, targets={"lang": {"en": 3, "de": 1, None: 1}})
    rows = out.collect()
    assert ids(out) == ids(docs) and set(docs.columns) <= set(out.columns)
    share = Counter()
    for r in rows:
        share[r.lang] += r.tokens * r.probability
    assert share["fr"] == 0 and share["es"] == 0
    assert rows and all(r.sampled in (True, False) for r in rows)
    again = {(r.doc_id, r.text): r.sampled for r in mixing.mix(docs, targets={"lang": {"en": 3, "de": 1, None: 1}}).collect()}
    assert all(again[(r.doc_id, r.text)] == r.sampled for r in rows)
    assert mixing.mix(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, "", "en", "s", 0)], DOC)
    assert mixing.mix(blank).collect()[0].tokens == 0


def test_mixing_uses_no_python(spark):
    plan = mixing.mix(read_table(spark, SF_SMALL, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- fingerprints ---------------------------------------------------------------------

def test_fingerprint_is_a_multiset_hash():
    a = "one two three four\nfive six seven eight\nnine ten"
    b = "nine ten\none two three four\nfive six seven eight"
    f = fingerprint.fingerprint
    assert np.array_equal(f(a), f(b)) and not np.array_equal(f(a), f(a + "\nnine ten"))
    assert np.array_equal(fingerprint.insert(f(a), "nine ten"), f(a + "\nnine ten"))
    assert np.array_equal(fingerprint.delete(f(a + "\nnine ten"), "nine ten"), f(a))
    assert np.array_equal(fingerprint.from_text(fingerprint.as_text(f(a))), f(a))
    rnd = random.Random(5)
    w = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    x, y = w(400), w(400)
    assert fingerprint.likeness(f(x), f(x)) == 1.0 and fingerprint.likeness(f(x), f(y)) < 0.3
    assert 0.3 < fingerprint.likeness(f(x + " " + y), f(x + " " + w(400))) < 0.7


def next_of(rows):
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    return [(a, order[(k + 1) % len(order)]) for k, a in enumerate(order)]


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_edited_texts_against_brute_force(spark, parts):
    docs, rows = odd_docs(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprint.compare(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = []
    for (i, t), (_, n) in next_of(rows):
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[:len(t) - half] + n[:half]).encode()).hexdigest(),
                     fingerprint.as_text(fingerprint.fingerprint(t))))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in got), key=repr) == sorted(want, key=repr)


def test_fingerprint_edge_cases(spark):
    assert fingerprint.compare(empty(spark)).count() == 0
    one = fingerprint.compare(spark.createDataFrame([(1, "ab cd", None, None, None)], DOC)).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(5, 1.0)]


def test_many_equal_paragraphs_do_not_wrap():
    f, text = fingerprint.fingerprint, fingerprint.as_text
    assert text(f("")) != text(f("\n" * 65_535)) and text(f("\n" * 65_536)) != text(f(""))
    three, many = f("\n".join(["a b c"] * 3)), f("\n".join(["a b c"] * 65_539))
    assert text(three) != text(many) and fingerprint.likeness(three, many) < 0.01
    for g in (three, many, f("x y z\n" * 40_000)):
        assert np.array_equal(fingerprint.from_text(text(g)), g)


@pytest.mark.parametrize("hot", ["text {}", "one text"])
def test_rows_of_one_id_are_spread_over_slices(spark, hot):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, hot.format(i), "en", "s", 1) for i in range(900)]
    docs = spark.createDataFrame(rows, DOC)
    got = fingerprint.with_next(docs, 12).select(F.spark_partition_id().alias("p"), "guest").where("not guest")
    sizes = [r["count"] for r in got.groupBy("p").count().collect()]
    assert sum(sizes) == 900 and max(sizes) < 250
    want = sorted((t[:len(t) - len(t) // 2] + n[:len(t) // 2] for (_, t), (_, n) in next_of(rows)))
    sha = sorted(hashlib.sha256(w.encode()).hexdigest() for w in want)
    assert sorted(r.edited_sha256 for r in fingerprint.compare(docs).collect()) == sha


def test_plan_does_not_grow_with_partitions(spark):
    docs = spark.createDataFrame([(i, f"t {i}", "en", "s", 1) for i in range(300)], DOC)
    size = lambda n: len(fingerprint.with_next(docs, n)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(200) - size(4)) < 200


# --- language model -------------------------------------------------------------------

def test_base_scores_against_brute_force(spark):
    docs, rows = odd_docs(spark)
    train = common.crc_text(F.col("doc_id")) % 5 != 1
    got = maxent.language_scores(docs, train).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    toks = [(i, SPACED.findall(lower(t or "")) + [None]) for i, t, *_ in rows]
    c = Counter(w for i, ws in toks if fold(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, not fold(i), len(ws), sum(c[w] > 0 for w in ws), n,
                    round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5)) for i, ws in toks), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got),
                  key=repr) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_model_is_a_distribution_and_learns():
    rnd = np.random.default_rng(1)
    w = rnd.normal(0, 1, (maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    rows = rnd.integers(0, maxent.ROWS, (50, maxent.FEATURES))
    zero = np.zeros(maxent.CLASSES, np.float32)
    total = sum(10 ** maxent.class_log10(w, zero, rows, np.full(50, k)) for k in range(maxent.CLASSES))
    assert np.allclose(total, 1, atol=1e-5)
    # a pattern that the last word decides is learned
    rows = np.repeat(rnd.integers(0, maxent.ROWS, (8, maxent.FEATURES)), 500, 0)
    target = np.repeat(np.arange(8), 500)
    order = rnd.permutation(4000)
    w, prior = np.zeros_like(w), np.full(maxent.CLASSES, -math.log(maxent.CLASSES), np.float32)
    before = maxent.class_log10(w, prior, rows, target).mean()
    maxent.gradient_steps(w, prior, np.full(maxent.ROWS, 1e-3, np.float32), np.zeros(maxent.ROWS, np.int64),
                          rows[order], target[order], np.random.default_rng(1), batch=100)
    assert maxent.class_log10(w, prior, rows, target).mean() > before + 0.8


def test_history_blocks_equal_the_whole():
    rnd = np.random.default_rng(4)
    lengths = rnd.integers(1, 9, 60)
    tokens, keys, classes = rnd.integers(1, 30, lengths.sum()).astype(np.int32), rnd.integers(0, 1 << 60, 30).astype(np.uint64), rnd.integers(0, 9, 30)
    n, place = len(tokens), maxent.places(lengths)
    whole = maxent.history_rows(tokens, place, keys, classes, 0, n)
    for size in (1, 2, 3, 7, 50):
        parts = [maxent.history_rows(tokens, place, keys, classes, lo, min(lo + size, n)) for lo in range(0, n, size)]
        assert np.array_equal(np.concatenate(parts), whole)
    ends = np.cumsum(lengths)[:-1]
    same = maxent.history_rows(tokens, place, keys, classes, 0, n)[np.r_[0, ends]]
    assert (same == same[0]).all()  # all texts begin with the same history


def test_model_beats_the_base_on_held_out_texts(spark):
    rnd = random.Random(3)
    sides = [[f"{p}{i}{e}" for i in range(60)] for p, e in (("k", "ing"), ("z", "ung"))]
    rows = [(i, " ".join(rnd.choices(sides[i % 2], k=60)), None, None, None) for i in range(400)]
    got = maxent.language_scores(spark.createDataFrame(rows, DOC), common.crc_text(F.col("doc_id")) % 5 != 1)
    r = got.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]
    assert maxent.language_scores(empty(spark), F.lit(True)).count() == 0


# --- token counts ---------------------------------------------------------------------

TOKENIZER = __import__("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(TOKENIZER)
    extra = [(60 + i, t, None, None, None) for i, t in enumerate(
        ["aaaaaaaaaaa" * 50, "<|endoftext|>a <|endoftext|><|endoftext|>", "I'll we're 'S  \n\n  x\t", "ééé 東京都 🦊🦊 \u00a0\u2003z",
         "x" * 3000 + " " * 500 + "1234567890" * 50, "-" * 1000, "\u0301\u200b", " leading", "trailing  "])]
    docs, rows = odd_docs(spark, extra)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, TOKENIZER).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=repr)
    assert tokens.token_counts(empty(spark), TOKENIZER).count() == 0


def test_merging_random_bytes_equals_the_library():
    from tokenizers import Tokenizer
    lib, rnd = Tokenizer.from_file(TOKENIZER), random.Random(2)
    texts = ["".join(rnd.choices("aeiou tnshrdlu.,01\n'", k=rnd.randint(0, 200))) for _ in range(300)]
    got = tokens.Counter50k(TOKENIZER, batch_bytes=500, remember=50).counts(texts, at_once=1000)
    assert got == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


# --- registered queries ---------------------------------------------------------------

def test_queries_return_their_contracts(spark):
    n = {t: read_table(spark, SF_SMALL, t).count() for t in ("documents", "pages")}
    want = {"op1_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans", "op2_toxicity": "doc_id held_out score predicted",
            "op3_url_filter": "page_id host path rule verdict", "op4_license_scan":
            "doc_id n_words n_base first_word last_word base_labels labels score", "op5_decontamination":
            "doc_id n_words n_hit n_items items_sha256 contaminated", "op6_simhash": "doc_id fingerprint component_id",
            "op8_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
            "op9_language_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
            "op10_token_counts": "doc_id n_bytes n_tokens over_limit"}
    for name, cols in want.items():
        out = queries.QUERIES[name](spark, SF_SMALL)
        assert set(cols.split()) <= set(out.columns), name
        assert out.count() == n["pages" if name.startswith("op3") else "documents"], name


# --- context of toxic terms -----------------------------------------------------------

def test_apostrophes_and_common_words_quote_nothing():
    lex = toxicity.Lexicon({"idiot": 3.0})
    plain = toxicity.features(lex, "you are an idiot and i don't like it")
    assert toxicity.features(lex, "you’re an idiot and i don’t like it")[0] == pytest.approx(plain[0])
    assert toxicity.features(lex, "in other words you are an idiot")[0] > toxicity.features(lex, "he said you are an idiot")[0]
    assert toxicity.features(lex, "they wrote ‘idiot’ there")[0] < plain[0]
