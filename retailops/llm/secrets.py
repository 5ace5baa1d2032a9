"""Secret scans over an incremental blob ledger.

Every historical version of every path is addressed by the SHA-256 of its text. The ledger, a
parquet table that only grows, records for each blob which rule versions have been applied and
what they found. A scan reads the text of those blobs only that lack a rule version, one copy of
each, applies the missing rules, appends to the ledger, and joins the findings back to
every path that holds the blob.

Nulls and edges: a null text is the empty text; a null path keeps its row; repeated rows are kept;
empty texts have no findings; a very long text is scanned whole, in time that grows with its length; matches of several
rules at one place are all kept, by the order of the rules; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, stage_table, text_or_empty

SPANS = "array<struct<start:int,rank:int,kind:string,end:int,rule:string>>"
LEDGER = f"blob binary, rules array<string>, spans {SPANS}"


class Rule(NamedTuple):
    """A secret's pattern. ``needs``: literals of which one stands in every match, or none to always look.

    ``linear``: a pattern of the same matches, in its group ``hit``, where the plain one takes quadratic time on long texts.
    """

    kind: str
    version: int
    pattern: str
    needs: tuple[str, ...] = ()
    group: int = 0
    least: int = 1
    flags: int = re.ASCII
    linear: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed patterns: the first three are the base kinds, in their order.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         (":", "="), 2, 8, re.ASCII | re.IGNORECASE),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("AKIA",), 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", ("-----BEGIN ",)),
    Rule("hosting", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyJ",),
         # from the start of a run of token characters to its first eyJ, which alone can begin a match in the run
         linear=r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(?P<hit>eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\."
                r"[A-Za-z0-9_-]{8,}+)"),
    Rule("login_url", 2, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]{3,}@", ("://",)),
)


def find(text: str, rules: Sequence[tuple[int, Rule]]) -> list[dict]:
    """Leftmost non-overlapping matches of each rule, those too short dropped, in code points."""
    out = []
    for rank, r in rules:
        if r.needs and not any(x in text for x in r.needs):
            continue
        whole = "hit" if r.linear else 0
        for m in re.compile(r.linear or r.pattern, r.flags).finditer(text):
            if m.end(r.group) - m.start(r.group) >= r.least:
                out.append({"start": m.start(whole), "rank": rank, "kind": r.kind, "end": m.end(whole), "rule": r.name})
    return out


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def unseen(blobs: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, missing): the distinct blobs with the rule versions that the ledger lacks for them."""
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    every = F.array(*(F.lit(r.name) for r in rules))
    missing = F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, "seen"))
    return (blobs.select("blob").distinct().join(seen, "blob", "left")
            .select("blob", missing.alias("missing")).where(F.size("missing") > 0))


def scan(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text",
         few_blobs: int = 100_000) -> DataFrame:
    """What the ledger lacks for the texts of ``versions``: rows to append, one per blob.

    At most ``few_blobs`` unseen blobs (50 bytes each) are broadcast and only their texts move.
    More are met after one copy of each blob has moved; either way gives the same rows.
    """
    texts = versions.select(blob_of(text_or_empty(text_col)).alias("blob"), text_or_empty(text_col).alias("text"))
    todo = stage_table(unseen(texts, ledger, rules), "secrets-todo")
    if todo.count() <= few_blobs:
        work = texts.join(F.broadcast(todo), "blob").groupBy("blob").agg(F.first("text").alias("text"),
                                                                       F.first("missing").alias("missing"))
    else:
        work = texts.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
    ranked = {r.name: (i, r) for i, r in enumerate(rules)}

    def run(batches):
        for b in batches:
            yield {"blob": b["blob"], "rules": b["missing"],
                   "spans": [find(t, [ranked[r] for r in names]) for t, names in zip(b["text"], b["missing"])]}

    return map_arrow(work.select("blob", "text", "missing"), run, LEDGER)


def read_ledger(spark: SparkSession, path: str | None) -> DataFrame:
    """The ledger at ``path``, an empty one where nothing was written yet."""
    if path is not None:
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
            return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def findings(spark: SparkSession, ledger_path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, spans): the blobs of the ledger in which these rule versions found something."""
    current = F.filter("spans", lambda s: s["rule"].isin([r.name for r in rules]))
    return (read_ledger(spark, ledger_path).select("blob", current.alias("spans")).where(F.size("spans") > 0)
            .groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")))


def secrets(versions: DataFrame, ledger_path: str, rules: Sequence[Rule] = RULES, path_cols: Sequence[str] = ("doc_id",),
            text_col: str = "text") -> DataFrame:
    """Scan what the ledger at ``ledger_path`` lacks, append it, and return ``path_cols`` with blob and spans.

    A run that dies before its append is complete leaves the ledger as it was: the writer commits
    its files at the end. Appending twice does no harm, findings are made distinct.
    """
    spark = versions.sparkSession
    scan(versions, read_ledger(spark, ledger_path), rules, text_col).write.mode("append").parquet(ledger_path)
    found = findings(spark, ledger_path, rules)
    paths = versions.select(*path_cols, blob_of(text_or_empty(text_col)).alias("blob"))
    empty = F.array().cast(SPANS)
    return paths.join(found, "blob", "left").select(*path_cols, "blob", F.coalesce("spans", empty).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones joined, replaced by its kind in brackets."""
    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], gap, mark).alias("out"), F.greatest(s["end"], acc["at"]).alias("at"))

    done = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    rest = F.substring(text, done["at"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(done["out"], rest)).otherwise(text)
