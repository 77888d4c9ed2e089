"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hostrules, langid, merkle, mixing, neighbours, quality, ranked, secretscan, simhash, suffixdedup, toxicity, urls
from .common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.featured(table(spark, sf_dir, "documents"))
    model = quality.fit_featured(rows, table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    scored = rows.select(F.col("key").alias("doc_id"), (fold("key", 4) == 2).alias("held_out"), quality.featured_score_udf(model)(F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= model.accept_at).cast("int"))


def op2_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    judged = toxicity.judge(docs, model, keep=((fold("doc_id", 5) == 0).alias("held_out"),))
    return judged.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


URL_RULES = [("net/", urls.BLOCK), ("example.net/en/", urls.ALLOW), ("example.com/de/", urls.BLOCK), ("org/fr/", urls.ALLOW)]


def op3_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hostrules.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_fair_queueing_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = langid.fit(docs.where(fold("doc_id", 5) != 0))
    return langid.predict(docs, dictionaries, keep=((fold("doc_id", 5) == 0).alias("held_out"),))


def op8_two_stage_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("bytes", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")))
    out = suffixdedup.deduplicated(docs, keep=("bytes",))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s.end - s.start))
    return out.select("doc_id", F.col("bytes").alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op10_sentencepiece_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.with_digests(both).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_persistent_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document; a fifth are tampered with."""
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf_digest(*rest, F.translate("text", merkle.UPPER, merkle.UPPER.lower())))
    return merkle.manifest(table(spark, sf_dir, "documents"), "doc_id", "source", merkle.leaf_digest(*rest, F.col("text")), lowered)


def op12_combined_automaton_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every whole text of ``documents``; null counts as empty."""
    found = secretscan.scanned(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secretscan.BASE]
    counts = [F.size(secretscan.of_kinds("spans", kind)).cast("long").alias(f"n_{kind}") for kind in base]
    return found.select("doc_id", *counts, F.sha2(secretscan.listed(secretscan.of_kinds("spans", *base)).cast("binary"), 256).alias("base_sha256"), secretscan.listed("spans").alias("spans"))


def op13_term_partitioned_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id and score of the 50 best documents of every benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_bradley_terry_quality, op2_noisy_or_toxicity, op3_url_language_models, op4_host_rules, op5_inverted_multi_index, op6_fair_queueing_mix, op7_compression_language, op8_two_stage_suffix_arrays, op9_pigeonhole_simhash, op10_sentencepiece_byte_bpe, op11_persistent_merkle_manifest, op12_combined_automaton_secrets, op13_term_partitioned_search)}

ORACLE_SQL: dict[str, str] = {"op3_url_language_models": urls.ORACLE_SQL, "op4_host_rules": hostrules.ORACLE_SQL, "op11_persistent_merkle_manifest": merkle.oracle_sql(), "op12_combined_automaton_secrets": secretscan.oracle_sql(), "op13_term_partitioned_search": ranked.ORACLE_SQL}
