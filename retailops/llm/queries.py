"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import read_table
from . import (decontam, divergence, fingerprint, lexical, licenses, maxent, mixing, simhash, suffixes, tokens, toxicity,
               urls)
from . import secrets as secret_scan
from .common import crc_text
from .sql import SQL

__all__ = ["QUERIES", "SQL"]
SCORE_AT = 0.7
NEAR = 5  # words beyond its length in which a test window's terms count as near their rarest


def digest(parts: "F.Column") -> "F.Column":
    """SHA-256 in lowercase hex of an array of strings, comma-joined."""
    return F.sha2(F.array_join(parts, ","), 256)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(read_table(spark, sf_dir, "documents"), scratch_path(spark, "secrets-ledger"))
    label = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.transform(F.filter("spans", lambda s: s["rank"] < 3),
                       lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("doc_id").cast("long").alias("doc_id"), count("assign"), count("access"),
                        count("hex"), digest(base).alias("base_sha256"), F.array_join(label, ",").alias("spans"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    fold = crc_text(F.col("doc_id")) % 3
    got = toxicity.score(docs, toxicity.learn(docs, labels, fold != 1))
    return got.select("doc_id", (fold == 1).alias("held_out"), "score",
                      (F.col("score") >= SCORE_AT).cast("int").alias("predicted"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(read_table(spark, sf_dir, "documents"), wrapped=True).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.contamination(*(read_table(spark, sf_dir, t) for t in ("documents", "benchmark")), slop=NEAR)

    def names(items):
        return digest(F.array_sort(F.transform(items, lambda i: i.cast("string"))))

    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      names("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
                      F.size("near").cast("long").alias("n_near"), names("near").alias("near_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "source", "lang", "topic", "tokens", "probability", "weight", "sampled")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(read_table(spark, sf_dir, "documents"))


def op9_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.language_scores(read_table(spark, sf_dir, "documents"), crc_text(F.col("doc_id")) % 5 != 1)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.drop_repeats(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_url_filter, op4_license_scan, op5_decontamination,
                            op6_simhash, op7_mixing, op8_fingerprints, op9_language_scores, op10_token_counts, op11_source_divergence,
                            op12_lexical_search, op13_substring_dedup, pipeline)}
