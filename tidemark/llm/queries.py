"""The registered query of each text operator, over its whole table, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, extraction, language_model, near_text, near_vectors, packing, personal, prefix_trie, quality, rules, urls, vector_codes, warc
from .common import table

#: Vocabularies by name; every worker finds them through the public tokenizers' package.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(personal.find(table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed_bits", "base_failed", "kept")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"), min_bytes=0, with_html=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, with_ids=False).drop("ids")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


OPERATORS = (op1_quality, op2_bpe, op3_pii, op4_quality_rules, op5_embedding_dedup, op6_warc, op7_minhash, op8_html, op9_packing, op10_lm, op11_url_filter, op12_prefix_trie, op13_vector_codes)

QUERIES = {f.__name__: f for f in OPERATORS}

ORACLES = {"op4_quality_rules": rules.ledger_sql(), "op12_prefix_trie": prefix_trie.TRIE_SQL, "op13_vector_codes": vector_codes.CODES_SQL}
