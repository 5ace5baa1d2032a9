"""DuckDB twins of the operators that SQL can express, over the same tables."""

from __future__ import annotations

from . import licenses, secrets, urls
from .common import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


def words_of(text: str) -> str:
    return f"regexp_extract_all({lowered(text)}, '{WORD}')"


def secrets_sql() -> str:
    """Places are rebuilt from the pieces between the matches of each kind."""
    parts = []
    for rank, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        if rank == 0:  # either case of the letters of the names, and of those only
            head, names, rest = pattern.partition(")")
            pattern = "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in head) + names + rest
        size = f"length(regexp_extract(m, '{pattern}', {r.group}))"
        parts.append(f"""SELECT r, {rank} AS rank, '{r.kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT r, ms[i] AS m, list_sum(list_transform(ps[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS ps FROM d),
    unnest(generate_series(1, len(ms))) AS u(i)) WHERE {size} >= {r.least}""")
    label = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{k}'), 0)::BIGINT AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT r, {counts}, string_agg({label}, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
        string_agg({label}, ',' ORDER BY s, rank) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.r = g.r"""


def urls_sql() -> str:
    """The vocabulary as one boundary pattern per term."""
    text = lowered("url")
    edge = r"[^\p{L}\p{N}]"
    plural = {t: "s?" if t + "s" in urls.SOFT else "" for t in urls.SOFT}
    hit = lambda t: f"regexp_matches({text}, '(^|{edge}){t}{plural.get(t, '')}({edge}|$)')::INT"
    strict = " + ".join(f"len(list_filter(regexp_split_to_array({text}, '{edge}'), lambda x: x = '{t}'))"
                        for t in urls.STRICT)
    own = {t: w for t, w in urls.SOFT.items() if urls.singular(t, urls.SOFT) == t}
    soft = " + ".join(hit(t) for t in own)
    weight = " + ".join([f"1.0 * {hit(t)}" for t in urls.STRICT] + [f"{w} * {hit(t)}" for t, w in own.items()])
    rule, verdict = "", ""
    for kind, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')"
        rule += f" WHEN {fits} THEN '{h}{p}'"
        verdict += f" WHEN {fits} THEN '{kind}'"
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""
WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '{pattern}', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '{pattern}', 2) AS path FROM pages),
h AS (SELECT *, ({strict})::BIGINT AS n_strict, ({soft})::BIGINT AS n_soft, ({weight})::DOUBLE AS weight FROM p)
SELECT page_id, host, path, CASE{rule} END AS rule,
  CASE{verdict} WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict,
  n_strict, n_soft, weight FROM h"""


def licenses_sql(threshold: float = 0.8) -> str:
    """Every line, and every run of a template's length in the word sequence, is met with every template by counting common
    words; phrases by comparing word by word."""
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    templates = []
    for label, t in licenses.TEMPLATES.items():
        own = sorted({*t.split()})
        must = licenses.OBLIGATORY.get(label, "").split()
        templates.append(f"('{label}', {listed(own)}, {licenses.required(len(own), threshold)}, "
                         f"{listed(must) if must else 'CAST([] AS VARCHAR[])'}, {len(t.split())})")
    phrases = ", ".join(f"({listed(p.split())}, '{label}')" for p, label in licenses.PHRASES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words_of("text")} AS w, {lowered("text")} AS t FROM documents),
tpl(label, own, need, must, size) AS (VALUES {", ".join(templates)}),
phr(own, label) AS (VALUES {phrases}),
b AS (SELECT d.r, i - 1 AS p0, phr.label FROM d, unnest(generate_series(1, len(w))) AS u(i), phr
      WHERE w[i] = phr.own[1] AND w[i:i + len(phr.own) - 1] = phr.own),
l AS (SELECT DISTINCT r, list_sort(list_distinct(regexp_extract_all(line, '{WORD}'))) AS ws
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
m AS (SELECT l.r, tpl.label, len(list_intersect(l.ws, tpl.own)) / len(tpl.own)::DOUBLE AS c FROM l, tpl
      WHERE len(l.ws) >= need AND len(list_intersect(l.ws, tpl.own)) >= need AND list_has_all(l.ws, tpl.must)
      UNION ALL
      SELECT r, label, max(c) FROM (
        SELECT d.r, tpl.label, tpl.own, need, must, list_distinct(w[i:i + size - 1]) AS ws,
          len(list_intersect(list_distinct(w[i:i + size - 1]), own)) / len(own)::DOUBLE AS c
        FROM d, tpl, unnest(generate_series(1, len(w))) AS u(i)
        WHERE len(list_intersect(list_distinct(w), own)) >= need AND list_has_all(w, must) AND list_contains(own, w[i]))
      WHERE len(list_intersect(ws, own)) >= need AND list_has_all(ws, must) GROUP BY r, label),
bb AS (SELECT r, count(*) AS n, min(p0) AS f, max(p0) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY r),
mm AS (SELECT r, max(c) AS c FROM m GROUP BY r),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
       FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(bb.n, 0)::BIGINT AS n_base, bb.f::BIGINT AS first_word, bb.z::BIGINT AS last_word,
  coalesce(bb.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
  CASE WHEN bb.n > 0 THEN 1.0 ELSE coalesce(mm.c, 0) END::DOUBLE AS score
FROM d LEFT JOIN bb ON d.r = bb.r LEFT JOIN mm ON d.r = mm.r LEFT JOIN al ON d.r = al.r"""


def decontamination_sql(width: int = 10, slop: int = 5) -> str:
    """All windows of documents joined with all windows of items; and each occurrence of a window's rarest word joined with
    the occurrences of its other words."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words_of("text")} AS w FROM documents),
i AS (SELECT item_id, {words_of("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[k:k + {width} - 1] AS win
       FROM i, unnest(generate_series(1, greatest(1, len(w) - {width} + 1))) AS u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT r, k, n, w[k:k + n - 1] AS win FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS u(k)),
m AS (SELECT DISTINCT dw.r, dw.k, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM m, unnest(generate_series(k, k + n - 1)) AS u(p) GROUP BY r),
x AS (SELECT r, count(DISTINCT item_id) AS n_items,
        sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS sha FROM m GROUP BY r),
dp AS (SELECT r, p, w[p] AS word FROM d, unnest(generate_series(1, len(w))) AS u(p)),
freq AS (SELECT word, count(*) AS n FROM dp GROUP BY word),
iw AS (SELECT row_number() OVER () AS id, win FROM (SELECT DISTINCT win FROM bw)),
wp AS (SELECT id, p, win[p] AS word, len(win) + {slop} AS reach FROM iw, unnest(generate_series(1, len(win))) AS u(p)),
wd AS (SELECT id, word, min(p) AS p, any_value(reach) AS reach FROM wp GROUP BY id, word),
wf AS (SELECT id, arg_min(wd.word, (freq.n, wd.p)) AS word, any_value(reach) AS reach, count(*) AS n
       FROM wd JOIN freq ON wd.word = freq.word GROUP BY id),
an AS (SELECT wf.id, dp.r, dp.p, reach, wf.n FROM wf JOIN dp ON wf.word = dp.word
       WHERE wf.n = (SELECT count(*) FROM wd WHERE wd.id = wf.id)),
ok AS (SELECT an.id, an.r, an.p FROM an JOIN wd ON an.id = wd.id
       JOIN dp ON dp.r = an.r AND dp.word = wd.word AND dp.p BETWEEN an.p - an.reach AND an.p + an.reach
       GROUP BY an.id, an.r, an.p HAVING count(DISTINCT wd.word) = any_value(an.n)),
y AS (SELECT r, count(DISTINCT item_id) AS n_near,
        sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS near
      FROM ok JOIN iw ON ok.id = iw.id JOIN bw ON bw.win = iw.win GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near, coalesce(near, sha256('')) AS near_sha256
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN x ON d.r = x.r LEFT JOIN y ON d.r = y.r"""


def divergence_sql(least: int = 30, top: int = 50) -> str:
    """Every source's share of every kept term, and all pairs of sources term by term."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({lowered("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {least}),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS whole FROM g JOIN k ON g.lang = k.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
z AS (SELECT lang, source, sum(n)::BIGINT AS size FROM s GROUP BY lang, source),
p AS (SELECT s.lang, s.source, s.term, s.n, 1 + (1000000000 * (s.n + 5)) // (z.size + 5 * v.v) AS p,
        1 + (1000000000 * (s.whole + 5)) // (v.n + 5 * v.v) AS q
      FROM s JOIN z ON z.lang = s.lang AND z.source = s.source JOIN v ON v.lang = s.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b
      ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM x QUALIFY part = 'pair' OR rank <= {top}"""


def lexical_sql(top: int = 50) -> str:
    """Every document with a term of an item is scored."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words_of("text")} AS w FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, list_distinct({words_of("text")}) AS w FROM benchmark),
q AS (SELECT i, unnest(w) AS term FROM i),
a AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, 50 + (50 * len(w) * a.n) // a.l AS m FROM d, a WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d)
       WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * a.n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, a GROUP BY term, a.n),
s AS (SELECT q.i, tf.r, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m)))::BIGINT AS score
      FROM q JOIN tf ON tf.term = q.term JOIN w ON w.term = q.term JOIN m ON m.r = tf.r GROUP BY q.i, tf.r)
SELECT item_id, (row_number() OVER (PARTITION BY s.i ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
FROM s JOIN i ON i.i = s.i JOIN m ON m.r = s.r WHERE score > 0 QUALIFY rank <= {top}"""


def substring_sql(width: int = 35) -> str:
    """Every window of every text, grouped by its words."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
g AS (SELECT r, k, array_to_string(w[k:k + {width - 1}], ' ') AS win
      FROM d, unnest(generate_series(1, len(w) - {width - 1})) AS u(k)),
m AS (SELECT win FROM g GROUP BY win HAVING count(*) > 1),
c AS (SELECT DISTINCT r, p FROM g JOIN m ON g.win = m.win, unnest(generate_series(k, k + {width - 1})) AS u(p)),
n AS (SELECT r, count(*) AS n FROM c GROUP BY r),
a AS (SELECT r, i, w[i] AS x FROM d, unnest(generate_series(1, len(w))) AS u(i)),
k AS (SELECT a.r, string_agg(x, ' ' ORDER BY i) AS s FROM a ANTI JOIN c ON a.r = c.r AND a.i = c.p GROUP BY a.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN k ON d.r = k.r"""


SQL: dict[str, str] = {"op1_secret_scan": secrets_sql(), "op3_url_filter": urls_sql(), "op4_license_scan": licenses_sql(),
                       "op5_decontamination": decontamination_sql(), "op11_source_divergence": divergence_sql(),
                       "op12_lexical_search": lexical_sql(), "op13_substring_dedup": substring_sql()}
