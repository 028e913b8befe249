"""The registered queries of the corpus operators, and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .bpe import encode_texts
from .exact_dedup import FIND_COPIES_SQL, find_copies
from .fingerprints import fingerprint_edits
from .html_text import extract_pages
from .mixing import DIMENSIONS, MIX_SQL, mix_corpus
from .near_dedup import find_near_copies
from .pii import KINDS, MORE_KINDS, find_private, joined
from .prefix_trie import TRIE_SQL, conversation_trie
from .quality import classify_quality
from .token_counts import count_tokens
from .toxicity import score_toxicity
from .url_filters import FILTER_URLS_SQL, RULES, filter_urls, rule_table
from .whitening import whiten


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's mixture after one round of bounded raking, as MIX_SQL states it, and the largest relative miss that it leaves."""
    mixed = mix_corpus(table(spark, sf_dir, "documents"), rounds=1)
    return mixed.select(F.col("id").alias("doc_id"), *DIMENSIONS, "tokens", "probability", "kept", F.round("miss", 9).alias("miss"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), keep_ids=False, keep_decoded=False)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"), keep_texts=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds are of base spans; those of the kinds that the field alone finds, n_added and n_spans follow."""
    found = find_private(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda spans, name: F.size(spans).cast("long").alias(name)
    of_kind = lambda spans, kind: count(F.filter(spans, lambda s: s["kind"] == kind), f"n_{kind}")
    counts = [of_kind(base, kind) for kind in KINDS]
    more = [*(of_kind("spans", kind) for kind in MORE_KINDS), count(F.filter("spans", lambda s: ~s["base"]), "n_added"), count(F.col("spans"), "n_spans")]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *more)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_near_copies(table(spark, sf_dir, "documents"), words=4)


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_fingerprints": op5_fingerprints,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_url_filters": op8_url_filters,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_html_text": op11_html_text,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op1_mixing": MIX_SQL,
    "op8_url_filters": FILTER_URLS_SQL,
    "op9_exact_dedup": FIND_COPIES_SQL,
    "op12_prefix_trie": TRIE_SQL,
}
