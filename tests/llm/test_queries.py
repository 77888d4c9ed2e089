"""The registered queries 1 to 10 themselves: names, types, folds, cut-offs, held-out accuracy, and the mix recomputed in plain Python."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

from wayledger.llm import mixing, queries

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")

COLUMNS = {
    "op1_bradley_terry_quality": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op2_noisy_or_toxicity": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op3_url_language_models": [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")],
    "op4_host_rules": [("doc_id", "bigint"), ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean")],
    "op5_inverted_multi_index": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")],
    "op6_fair_queueing_mix": [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")],
    "op7_compression_language": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
    "op8_two_stage_suffix_arrays": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")],
    "op9_pigeonhole_simhash": [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")],
    "op10_sentencepiece_byte_bpe": [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_types(spark, name):
    got = queries.QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name]) <= set(got.dtypes), got.dtypes


def remainder(key, n):
    return zlib.crc32(str(key).encode()) % n


@pytest.mark.parametrize("name, label, folds, left_out, cut, found, accused", [("op1_bradley_terry_quality", "quality", 4, 2, 0.7, 0.95, 0.1), ("op2_noisy_or_toxicity", "toxic", 5, 0, 0.5, 0.5, 0.05)])
def test_classifiers_on_held_out_rows(spark, name, label, folds, left_out, cut, found, accused):
    rows = queries.QUERIES[name](spark, FOLDER).select("doc_id", "held_out", "score", "predicted").collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where(f"{label} IS NOT NULL").collect()}
    for r in rows:
        assert r.held_out == (remainder(r.doc_id, folds) == left_out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    yes, no = [p for t, p in held if t == 1], [p for t, p in held if t == 0]
    assert sum(yes) / len(yes) >= found and sum(no) / len(no) <= accused, (sum(yes), len(yes), sum(no), len(no))


def test_languages_on_held_out_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op7_compression_language(spark, FOLDER).collect()
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows) and len(rows) == len(docs)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang is not None and any(c.isalpha() for c in docs[r.doc_id].text or "")]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) >= 0.97


def plain_mix(rows, most=3):
    """{key: taken}: every copy's finish time, all copies in one list, taken while the sum of sizes holds."""
    upto, copies = {}, []
    for r in sorted(rows, key=lambda r: (r.h, r.doc_id)):
        upto[r.source] = upto.get(r.source, 0) + r.size
        for e in range(most):
            if r.size and r.source_size * e + upto[r.source] - r.size < r.target:
                copies.append(((r.source_size * e + upto[r.source]) / r.target, r.doc_id, r.size))
    budget, spent, taken = sum(r.size for r in rows), 0, {r.doc_id: 0 for r in rows}
    copies.sort()
    at = 0
    while at < len(copies):
        ties = [c for c in copies[at:] if c[0] == copies[at][0]]
        if spent + sum(c[2] for c in ties) > budget:
            break
        for _, key, size in ties:
            taken[key] += size
        spent += sum(c[2] for c in ties)
        at += len(ties)
    return taken


@pytest.mark.parametrize("rows_per_bin", [20_000, 50])
def test_mix_order_and_cut_in_plain_python(spark, rows_per_bin):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = mixing.mixed(docs, rows_per_bin=rows_per_bin).withColumn("h", F.xxhash64(F.lit(1), "doc_id")).collect()
    assert {r.doc_id: r.taken for r in got} == plain_mix(got)
    by = {}
    for r in got:
        t = by.setdefault(r.source, [r.target, 0, r.source_size, 0])
        t[1], t[3] = t[1] + r.taken, max(t[3], r.size)
        assert r.taken <= 3 * r.size
    # no further from its target than its longest document
    assert all(abs(taken - target) <= longest and target <= 3 * size + 1e-6 for target, taken, size, longest in by.values()), by


def test_neighbours_are_exact_and_mostly_found(spark):
    import numpy as np

    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = {}
    for r in queries.op5_inverted_multi_index(spark, FOLDER).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        found = sorted(found)
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(d[ids == v][0] - s) < 1e-9 for _, v, s in found)
        order = np.lexsort((ids, d))
        best = [int(i) for i in ids[order] if i != q][:10]
        hits += len({v for _, v, _ in found} & set(best))
    assert hits / (10 * len(got)) >= 0.9
