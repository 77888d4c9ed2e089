"""The corpus pipeline: score and reject, drop near copies, cut repeated passages, mix sources, tokenise."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayledger.llm import bpe, mixing, quality, simhash, suffixdedup
from wayledger.llm.common import fold, written


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score reaches the accepted quantile; learnt from all labelled ones among them, but a fold."""
    learnt = fold("doc_id", 4) != 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(learnt)
    return quality.accepted(docs, quality.fit(docs.where(learnt), labels))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of smallest id.

    Texts link where their SimHash fingerprints differ in 2 bits at most, found by the pigeonhole plan of query 9, and
    also, as 2 bits leave most near copies apart, where their five-word shingles are 0.8 similar or more.
    """
    linked = simhash.classes(docs, by_text=True)
    return simhash.representatives(docs, simhash.merged(linked, simhash.near_classes(docs, words=5, similarity=0.8)))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that also start earlier; ``n_chars`` counts what is left.

    A character of which a cut leaves only some bytes goes; a text that is cut away whole stays as an empty one.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    spans, kept = (name + "_" * max(map(len, docs.columns)) for name in ("spans", "kept"))  # longer than any column's name
    out = suffixdedup.deduplicated(docs, keep=others, spans=spans, kept=kept, readable="text")
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so a document that is taken twice is two rows."""
    return mixing.repeated(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of a round trip."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return bpe.with_digests(both).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", accept_quality),
    ("simhash", one_of_each_class),
    ("suffix", cut_repeats),
    ("mix", mix_sources),
    ("bpe", tokenise),
]

#: Fitted models, compression and fingerprints can't be said in SQL; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
