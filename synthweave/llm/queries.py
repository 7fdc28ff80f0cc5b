"""One query per operator over its whole table, and DuckDB SQL where SQL can state it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthweave.llm import (byte_bpe, collocations, language_id, mixing, multi_index, quality_rules, secrets_scan, sharding,
                            substring_dedup, suffix_array_dedup, url_filter, weighted_minhash, whitening)
from synthweave.sources.tables import load

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100."""
    return multi_index.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter.judge(load(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    rows = quality_rules.judged(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *[f"quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page; the text model learns from the documents' labels."""
    return language_id.identify(load(spark, sf_dir, "pages"), load(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.assign_shards(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", sharding.shard_names())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    rows = mixing.plan_mix(mixing.sized(load(spark, sf_dir, "documents")))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Round trip of every document: counts and hashes of its ids and of the bytes they decode to."""
    path = path or public_tokenizers.path(RANKS)
    rows = byte_bpe.round_trip(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    joined = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document."""
    return bpe_digests(load(spark, sf_dir, "documents"))


def op8_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return weighted_minhash.near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    spans = secrets_scan.scan(load(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["verdict"], s["owners"].cast("string"), s["repos"].cast("string"))), ",")
    return spans.select("doc_id", *[count(k) for k in secrets_scan.BASE],
                        F.sha2(secrets_scan.span_text(F.col("spans"), secrets_scan.BASE), 256).alias("base_sha256"),
                        secrets_scan.span_text(F.col("spans")).alias("spans"), told.alias("verdicts"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeated runs cover, and a hash of those left."""
    return substring_dedup.remove_repeats_digest(load(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's 32 whitened components."""
    return whitening.whitened(load(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of two or three words."""
    return collocations.collocations(load(spark, sf_dir, "documents"))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that earlier 100-byte strings cover, and a hash of those left."""
    return suffix_array_dedup.remove_later_digest(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_multi_index, op2_url_filter, op3_quality_rules, op4_language_id, op5_sharding, op6_mixing, op7_byte_bpe,
    op8_weighted_minhash, op9_secret_scan, op10_substring_dedup,
    op11_whitening, op12_collocations, op13_suffix_array_dedup)}

ORACLES = {"op3_quality_rules": quality_rules.oracle_sql(), "op5_sharding": sharding.oracle_sql(), "op6_mixing": mixing.oracle_sql(),
           "op12_collocations": collocations.oracle_sql()}
