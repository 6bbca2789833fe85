"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import fingerprint, hamming, jaccard, licenses, mixing, negatives, oracles, packing, pii, prefix_trie, suffix_dedup, toxicity, tree_dedup, url_filter
from gleaner.llm.common import documents

#: Secret of the surrogates; a caller in production passes its own.
PII_KEY = "gleaner-surrogates"
TOKENIZER = "word_bpe_49k.json"


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), 100)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(documents(spark, sf_dir), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY, "n_replaced")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_dedup.remove_passages(documents(spark, sf_dir), 35)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=10)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), 2048)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.listed_sites(spark))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_suffix_array_dedup, op2_document_fingerprints, op3_ngram_jaccard_join, op4_source_mixing, op5_pii_surrogates, op6_toxicity, op7_license_scan, op8_substring_dedup, op9_exact_topk, op10_best_fit_packing, op11_prefix_trie, op12_hard_negatives, op13_url_filter, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Operators that SQL expresses; the others are held against brute force in tests (models, keyed draws, sketches, tokenizer)."""
    return {"op7_license_scan": licenses.oracle(), "op11_prefix_trie": prefix_trie.oracle(), "op12_hard_negatives": negatives.oracle(), "op13_url_filter": url_filter.oracle(), **oracles.all_of_them()}
