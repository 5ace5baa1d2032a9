"""URL filters: host and path rules, then a weighted vocabulary found by Aho-Corasick.

A rule (host, path) fits its host and every subdomain where the url's path starts with the rule's; the longest fitting
rule decides. Other urls are searched for the vocabulary: a term counts where no letter or digit, of any script,
touches it. One strict term rejects, and so do several distinct soft ones; a soft term and its plural are one.

Nulls and edges: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed unless its
text holds vocabulary (a null url holds none); a very long url is searched whole; of rules of one length that fit, the later
listed decides; other columns are not read; repeated rows are kept; rows with a null id are kept; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, map_arrow

# Fixed rules: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
# Fixed vocabulary: strict terms weigh 1 and soft terms what stands beside them.
STRICT = ("casino", "porn", "xxx", "viagra", "cialis", "escort", "gambling", "torrent", "warez", "malware", "phishing")
SOFT = {"free": 0.5, "win": 0.5, "bet": 0.6, "bets": 0.6, "betting": 0.6, "cheap": 0.5, "pill": 0.6, "pills": 0.6,
        "poker": 0.6, "slots": 0.6, "loan": 0.5, "loans": 0.5, "ads": 0.5, "track": 0.4, "tracker": 0.5,
        "click": 0.4, "bonus": 0.5, "deal": 0.3, "deals": 0.3, "sex": 0.6, "adult": 0.6, "nude": 0.6, "crack": 0.5,
        "keygen": 0.6, "spam": 0.6, "prize": 0.5}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return (F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def singular(term: str, terms) -> str:
    """A term without its plural s, where both stand in ``terms``."""
    return term[:-1] if term.endswith("s") and term[:-1] in terms else term


def vocabulary_hits(urls: DataFrame, strict: Sequence[str] = STRICT, soft: Mapping[str, float] = SOFT) -> DataFrame:
    """(id, url, n_strict, n_soft, weight): strict places, distinct soft terms, and the weight of all distinct terms.

    A letter or digit is what Unicode calls one (general categories L and N).
    """
    strict, soft = tuple(strict), dict(soft)
    lower = str.maketrans(UPPER, LOWER)

    def run(batches):
        import ahocorasick
        from unicodedata import category

        found = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            found.add_word(term, term)
        if found:
            found.make_automaton()
        for b in batches:
            n_strict, n_soft, weight = [], [], []
            for url in b["url"]:
                text = (url or "").translate(lower)
                hits = []
                for end, term in (found.iter(text) if found else ()):
                    start = end - len(term) + 1
                    before = text[start - 1] if start else " "
                    after = text[end + 1] if end + 1 < len(text) else " "
                    if category(before)[0] not in "LN" and category(after)[0] not in "LN":
                        hits.append(singular(term, soft) if term in soft else term)
                own = {*hits}
                n_strict.append(sum(t in strict for t in hits))
                n_soft.append(len(own & soft.keys() - {*strict}))
                weight.append(float(sum(1.0 if t in strict else soft[t] for t in sorted(own))))
            yield {"id": b["id"], "url": b["url"], "n_strict": n_strict, "n_soft": n_soft, "weight": weight}

    return map_arrow(urls, run, "id long, url string, n_strict long, n_soft long, weight double")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT,
          soft: Mapping[str, float] = SOFT, several: int = 2, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft, weight) for every row of ``pages``."""
    rows = vocabulary_hits(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url")), strict, soft)
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= several), "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
                       F.coalesce(verdict, own).alias("verdict"), "n_strict", "n_soft", "weight")
