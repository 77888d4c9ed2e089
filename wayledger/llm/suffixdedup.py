"""Removal of passages that repeat across a corpus, byte-exact, by suffix arrays in two-stage order.

A string of ``length`` bytes (a window) is removed where it also starts earlier.  Equal windows contain the same rarest
k-gram (the one of least hash), so windows are dealt out by that k-gram, as runs of neighbouring windows that share it
(segments).  Equal segments are one entry; the different segments of a k-gram meet in one block of text, whose
suffix array shows their common windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, placed, small, written

K = 24  # bytes of a k-gram; half the windows' length or less
DEPTH = 8  # bytes compared at a time
NO_KEY = -(1 << 63)
ENTRY = np.dtype([("key", "<u8"), ("seg", "<u8"), ("doc", "<i8"), ("h", "<i4"), ("start", "<i4"), ("n", "<i4"), ("loops", "?")])
REQUEST = np.dtype([("key", "<u8"), ("start", "<i4"), ("n", "<i4")])


# ---------------------------------------------------------------------------------------------- windows and segments


def hashes(text: np.ndarray, sizes: tuple[int, ...], seed: int) -> list[np.ndarray]:
    """64-bit hashes of the substrings of each of some sizes: polynomials over random codes of the bytes, then mixed."""
    rng = np.random.default_rng(seed)
    factor, h = int(rng.integers(1 << 62, 1 << 63)) | 1, 1
    power = {1: rng.integers(1, 1 << 63, 256, dtype=np.uint64)[text]}

    def join(a: np.ndarray, b: np.ndarray, at: int, size: int) -> np.ndarray:
        """Of substrings of ``at`` bytes and of the ``size`` bytes that follow them."""
        n = len(b) - at
        out = a[:n] * np.uint64(pow(factor, size, 1 << 64))
        out += b[at:]
        return out

    while 2 * h <= max(sizes):
        power[2 * h] = join(power[h], power[h], h, h)
        if not any(size & h for size in sizes):
            del power[h]
        h *= 2
    out = []
    for size in sizes:
        done, got = 0, None
        for p in sorted(power, reverse=True):
            if done + p <= size:
                got = power[p] if got is None else join(got, power[p], done, p)
                done += p
        got = got ^ (got >> np.uint64(31))
        got *= np.uint64(0x9E3779B97F4A7C15)
        got ^= got >> np.uint64(32)
        out.append(got)
    return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    out, done = x, 1
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def segments(texts: list[bytes], length: int, heavy: np.ndarray) -> np.ndarray:
    """The texts' segments as ENTRY rows, ``doc`` being the place in the list.

    ``loops``: the k-gram occurs twice in the segment, so that its own windows may repeat.  Segments of ``heavy`` k-grams
    (sorted) are dealt out window by window, each window under its own hash.
    """
    import xxhash

    raw = b"".join(texts) + bytes(length)
    buf, size = np.frombuffer(raw, "u1"), np.array([len(t) for t in texts])
    base, long_enough = np.cumsum(size) - size, size >= length
    if not long_enough.any():
        return np.zeros(0, ENTRY)
    width = length - K + 1
    gram = hashes(buf, (K,), 1)[0]
    key = sliding_least(gram, width)
    n = len(key) - 1  # windows that start inside the texts' bytes, all of them followed by another place
    gram, next_, key = gram[:n], gram[width - 1 : width - 1 + n], key[:n]
    ok, first = np.zeros(n, bool), np.append(True, key[1:] != key[:-1])
    for a, b in zip(base[long_enough].tolist(), (base + size - length + 1)[long_enough].tolist()):
        ok[a:b] = True
        first[a] = True
    first &= ok
    last = ok & np.append(first[1:] | ~ok[1:], True)
    runs, ends = np.flatnonzero(first), np.flatnonzero(last)
    loops = (gram == key) & ok & ~last
    loops |= (next_ == key) & ok & ~first
    out = np.zeros(len(runs), ENTRY)
    n = ends - runs + 1
    out["key"], out["n"], out["loops"] = key[runs], n, np.logical_or.reduceat(loops, runs)
    begin = runs
    digest = xxhash.xxh3_64_intdigest
    out["seg"] = [digest(raw[a:b]) for a, b in zip(begin.tolist(), (begin + n - 1 + length).tolist())]
    if len(heavy):
        hit = heavy[np.minimum(np.searchsorted(heavy, out["key"]), len(heavy) - 1)] == out["key"]
        if hit.any():
            own = np.repeat(runs[hit] - (np.cumsum(n[hit]) - n[hit]), n[hit]) + np.arange(n[hit].sum())
            single = np.zeros(len(own), ENTRY)
            single["key"], single["seg"], single["n"] = hashes(buf, (length,), 2)[0][own], hashes(buf, (length,), 3)[0][own], 1
            out, begin = np.concatenate([out[~hit], single]), np.concatenate([begin[~hit], own])
    out["doc"] = np.searchsorted(base, begin, "right") - 1
    # empty texts share their successor's base: the last text that begins there is the one with the bytes
    out["start"] = begin - base[out["doc"]]
    return out


def in_order(e: np.ndarray) -> np.ndarray:
    """Sorted by k-gram, segment and then place, so that the first of equal segments is the earliest."""
    return e[np.lexsort((e["start"], e["h"], e["doc"], e["seg"], e["key"]))]


def earlier_copies(e: np.ndarray) -> np.ndarray:
    """For sorted entries: whether the same segment stands before."""
    return np.append(False, (e["key"][1:] == e["key"][:-1]) & (e["seg"][1:] == e["seg"][:-1])) if len(e) else np.zeros(0, bool)


# -------------------------------------------------------------------------------------------------- the suffix array


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; past the end are zeros."""
    padded = np.append(text, np.zeros(DEPTH, "u1"))
    out = np.zeros(len(text), np.uint64)
    for j in range(DEPTH):
        out = out << np.uint64(8) | padded[j : j + len(text)]
    return out


def word(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at < len(words), words[np.minimum(at, len(words) - 1)], np.uint64(0))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes' places in the order of their first ``depth`` bytes at least, by two-stage sorting.

    Stage one sorts the suffixes that are smaller than their successors.  Stage two scans the buckets of first bytes in
    order: each suffix found puts its predecessor, if that one is larger than its successor, at the next free place of
    the larger ones in its own bucket, which stand before the sorted smaller ones.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    words = words_at(text)
    step = np.sign(np.append(text[1:].astype(np.int16) - text[:-1], -1))  # the end is below every byte
    nearest = np.minimum.accumulate(np.where(step != 0, np.arange(n), n)[::-1])[::-1]
    small = np.flatnonzero(step[nearest] > 0)
    keys = [word(words, small + DEPTH * k) for k in range(-(-depth // DEPTH))]
    small = small[np.lexsort(keys[::-1])]
    lead = text[small]
    edges = np.searchsorted(lead, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)):
        large = waiting[c]
        last = np.concatenate(large) if large else np.zeros(0, np.int64)
        large = [last]
        while len(last):  # a run of one byte induces itself, one place further to the left in each round
            before = last[last > 0] - 1
            last = before[text[before] == c]
            large.append(last)
        bucket = np.concatenate([*large, small[edges[c] : edges[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        lead = text[before]
        order = np.argsort(lead, kind="stable")
        cuts = np.flatnonzero(np.diff(lead[order])) + 1
        for part in np.split(before[order], cuts) if len(before) else ():
            waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in order, the bytes it shares with the one before, counted up to ``most``; 0 for the first."""
    words = words_at(text)
    out = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for k in range(-(-most // DEPTH)):
        a, b = order[open_ - 1] + DEPTH * k, order[open_] + DEPTH * k
        differ = word(words, a) ^ word(words, b)
        zeros = np.zeros(len(differ), np.int64)
        for j in range(1, DEPTH + 1):
            zeros += differ >> np.uint64(8 * (DEPTH - j)) == 0
        out[open_] += zeros
        open_ = open_[differ == 0]
    return np.minimum(out, most)


def repeats(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text the starts of its windows that also start earlier, in an earlier text or further left in itself."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    block = np.frombuffer(b"\xff".join(texts) + b"\xff", "u1")  # no UTF-8 text holds this byte
    order = suffix_array(block, length)
    shared = common_prefixes(block, order, length)
    group = np.flatnonzero(shared < length)
    least = np.minimum.reduceat(order, group)
    copies = order[order != np.repeat(least, np.diff(np.append(group, len(order))))]
    copies = np.sort(copies)
    text = np.searchsorted(ends, copies, "right")
    whole = copies + length <= ends[text] - 1  # windows that don't run over a text's end
    copies, text = copies[whole], text[whole]
    begin = ends - np.array([len(t) + 1 for t in texts])
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [copies[cuts[i] : cuts[i + 1]] - begin[i] for i in range(len(texts))]


# ------------------------------------------------------------------------------------------------------ the Spark job


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans, sorted by start, as maximal ones: rows of (start, end)."""
    if not len(starts):
        return np.zeros((0, 2), "<i4")
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.append(True, starts[1:] > ends[:-1])
    at = np.flatnonzero(first)
    return np.stack([starts[at], ends[np.append(at[1:], len(ends)) - 1]], 1).astype("<i4")


ROUTED = "bucket int, doc long, h int, entries binary, spans binary"
RESOLVED = "doc long, h int, spans binary, requests binary"


def _arrow(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(schema), schema)], [n for n, _ in schema])


ROUTED_ARROW = [("bucket", pa.int32()), ("doc", pa.int64()), ("h", pa.int32()), ("entries", pa.binary()), ("spans", pa.binary())]
PIECE_ARROW = [("bucket", pa.int32()), ("key", pa.int64()), ("doc", pa.int64()), ("h", pa.int32()), ("start", pa.int32()), ("text", pa.binary())]
RESOLVED_ARROW = [("doc", pa.int64()), ("h", pa.int32()), ("spans", pa.binary()), ("requests", pa.binary())]


def by_document(e: np.ndarray, length: int) -> Iterator[tuple[int, int, bytes]]:
    """(doc, h, spans) for the windows of some entries."""
    e = e[np.lexsort((e["start"], e["h"], e["doc"]))]
    new = np.flatnonzero(np.append(True, (e["doc"][1:] != e["doc"][:-1]) | (e["h"][1:] != e["h"][:-1]))) if len(e) else np.zeros(0, int)
    for a, b in zip(new, [*new[1:], len(e)]):
        part = e[a:b]
        yield int(part["doc"][0]), int(part["h"][0]), _spans(part["start"], part["start"] + part["n"] - 1 + length).tobytes()


def router(length: int, buckets: int, heavy: np.ndarray, held: int = 200_000, chunk: int = 1 << 18):
    """The map side: documents to their segments, packed by bucket.

    Of equal segments met by a task within ``held`` segments only the earliest goes on; the others are removed already.
    So are all bytes of a text equal to an earlier one.  However common a passage is, a bucket gets it once from each task.
    """

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        e = in_order(np.concatenate(parts))
        again = earlier_copies(e)
        rows = [(doc % buckets, doc, h, None, spans) for doc, h, spans in by_document(e[again], length)]
        e = e[~again]
        to = (e["key"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        e, cuts = e[order], np.searchsorted(to[order], np.arange(buckets + 1))
        rows += [(b, None, None, e[cuts[b] : cuts[b + 1]].tobytes(), None) for b in range(buckets) if cuts[b] < cuts[b + 1]]
        for at in range(0, len(rows), 512):
            yield _arrow(ROUTED_ARROW, rows[at : at + 512])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            doc, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            upto = np.cumsum(pc.binary_length(batch.column(2)).to_numpy().astype(np.int64))
            at = 0
            while at < len(doc):
                # texts of ``chunk`` bytes together, or one longer text
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + chunk, "right")))
                e = segments(batch.column(2)[at:end].cast(pa.binary()).to_pylist(), length, heavy)
                e["h"], e["doc"] = h[at:end][e["doc"]], doc[at:end][e["doc"]]
                parts.append(e)
                n += len(e)
                at = end
                if n >= held:
                    yield from flush(parts)
                    parts, n = [], 0
        if n:
            yield from flush(parts)

    return run


def resolver(length: int):
    """The reduce side, a bucket: copies of an earlier segment are removed; different segments of a k-gram need their text."""

    def run(table: pa.Table) -> pa.Table:
        rows = [(d, h, s, None) for d, h, s in zip(*(table.column(c).to_pylist() for c in ("doc", "h", "spans"))) if s is not None]
        packed = b"".join(x for x in table.column("entries").to_pylist() if x is not None)
        e = in_order(np.frombuffer(packed, ENTRY))
        again = earlier_copies(e)
        rows += [(d, h, s, None) for d, h, s in by_document(e[again], length)]
        e = e[~again]
        if len(e):
            same = np.append(False, e["key"][1:] == e["key"][:-1])
            wanted = e[same | np.append(same[1:], False) | e["loops"]]
            wanted = wanted[np.lexsort((wanted["h"], wanted["doc"]))]
            new = np.flatnonzero(np.append(True, (wanted["doc"][1:] != wanted["doc"][:-1]) | (wanted["h"][1:] != wanted["h"][:-1]))) if len(wanted) else []
            for a, b in zip(new, [*new[1:], len(wanted)]):
                ask = np.zeros(b - a, REQUEST)
                for c in REQUEST.names:
                    ask[c] = wanted[c][a:b]
                rows.append((int(wanted["doc"][a]), int(wanted["h"][a]), None, ask.tobytes()))
        return pa.Table.from_batches([_arrow(RESOLVED_ARROW, rows)])

    return run


def matcher(length: int, block: int = 1 << 19):
    """The suffix arrays of a bucket's segments, in blocks of whole k-grams."""

    def run(table: pa.Table) -> pa.Table:
        key, doc, h, start = (table.column(c).to_numpy() for c in ("key", "doc", "h", "start"))
        text = table.column("text").to_pylist()
        order = np.lexsort((start, h, doc, key))
        sizes = np.array([len(text[i]) for i in order])
        last_of_key = np.append(key[order][1:] != key[order][:-1], True) if len(order) else np.zeros(0, bool)
        rows, at, size = [], 0, 0
        for end, (more, closes) in enumerate(zip(sizes.tolist(), last_of_key.tolist()), 1):
            size += more
            if closes and (size >= block or end == len(order)):
                part = order[at:end]
                part = part[np.lexsort((start[part], h[part], doc[part]))]  # places in the block are then in the corpus's order
                for i, found in zip(part, repeats([text[i] for i in part], length)):
                    if len(found):
                        found = found + start[i]
                        rows.append((int(doc[i]), int(h[i]), _spans(found, found + length).tobytes(), None))
                at, size = end, 0
        return pa.Table.from_batches([_arrow(RESOLVED_ARROW, rows)])

    return run


def heavy_grams(keyed: DataFrame, length: int, rows: int, sample: int = 5000) -> np.ndarray:
    """k-grams with so many different segments that one bucket should not get them all.

    Found on about ``sample`` documents; which k-grams they are changes only how windows are dealt out, not the result.
    """
    every = max(1, rows // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, 64) for batch in batches for at in range(0, len(batch), 64)):
            e = segments(part.column(0).cast(pa.binary()).to_pylist(), length, np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(e["key"].view("<i8")), pa.array(e["seg"].view("<i8"))], ["key", "seg"])

    picked = keyed.where(F.pmod(F.xxhash64("doc"), F.lit(every)) == 0).select("text")
    segs = picked.mapInArrow(run, "key long, seg long").distinct().groupBy("key").agg(F.count("*").alias("n"))
    least = max(30, sample // 100)
    return np.sort(np.array([r.key for r in segs.where(F.col("n") >= least).select("key").collect()], dtype=np.int64).view(np.uint64))


def text_numbers(docs: DataFrame, key: str, text: str) -> DataFrame | None:
    """(doc, sha, h): the texts of a key that bears several, numbered by their SHA-256, without number 0; None if no key repeats.

    Only counts of keys are made where none repeats; else the numbers come from sorted ranges, so a key of very many texts
    (null, say) never meets in one task.
    """
    doc = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("doc")
    twice = written(docs.select(doc).groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "repeated-keys")
    if twice.isEmpty():
        return None
    rows = docs.select(doc, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha")).join(small(twice, 100_000), "doc", "left_semi").distinct()
    return placed(rows.withColumn("tree", F.col("doc").cast("string")), F.col("sha")).where("pos > 0").select("doc", "sha", F.col("pos").cast("int").alias("h"))


def numbered(rows: DataFrame, numbers: DataFrame | None, doc: str = "doc", text: str = "text", h: str = "h") -> DataFrame:
    """``rows`` with their text's number among the texts of their key, 0 where it is the only or the first one."""
    if numbers is None:
        return rows.withColumn(h, F.lit(0))
    named = numbers.select(F.col("doc").alias(doc), F.col("sha").alias("_sha"), F.col("h").alias("_number"))
    out = rows.withColumn("_sha", F.sha2(text, 256)).join(small(named, 100_000), [doc, "_sha"], "left")
    return out.withColumn(h, F.coalesce("_number", F.lit(0))).drop("_sha", "_number")


def removed(docs: DataFrame, numbers: DataFrame | None, key: str = "doc_id", text: str = "text", length: int = 100, entries_per_bucket: int = 400_000) -> DataFrame:
    """(doc, h, spans) of the documents that lose bytes; spans are packed rows of (start, end), which may overlap.

    A document is a key and a text, known by its number ``h`` among the key's texts; a null key sorts first.
    """
    spark = docs.sparkSession
    keyed = in_small_batches(docs).select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = numbered(keyed, numbers).where(F.octet_length("text") >= length).select("doc", "h", "text")
    total, rows = keyed.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count("*")).first()
    per_entry = (length - K + 2) / 2  # bytes of text to a segment, on random text
    buckets = max(int(total / per_entry / entries_per_bucket) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    heavy = heavy_grams(keyed, length, rows)
    routed = keyed.mapInArrow(router(length, buckets, heavy), ROUTED)
    resolved = written(routed.groupBy("bucket").applyInArrow(resolver(length), RESOLVED), "resolved")
    wanted = resolved.where("requests is not null").groupBy("doc", "h").agg(F.collect_list("requests").alias("requests"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            doc, h_, texts, asked = (batch.column(c) for c in ("doc", "h", "text", "requests"))
            for i in range(len(batch)):
                raw = texts[i].as_py().encode()
                for ask in np.frombuffer(b"".join(asked[i].as_py()), REQUEST).tolist():
                    rows.append((ask[0] % buckets, ask[0] - (ask[0] >> 63 << 64), doc[i].as_py(), h_[i].as_py(), ask[1], raw[ask[1] : ask[1] + ask[2] - 1 + length]))
                    size += ask[2] + length
                    if size >= 1 << 20:
                        yield _arrow(PIECE_ARROW, rows)
                        rows, size = [], 0
            if rows:
                yield _arrow(PIECE_ARROW, rows)

    pieces = keyed.join(wanted, ["doc", "h"]).mapInArrow(cut_out, "bucket int, key long, doc long, h int, start int, text binary")
    # equal rows of the input ask twice for the same piece
    found = written(pieces.dropDuplicates(["bucket", "key", "doc", "h", "start"]).groupBy("bucket").applyInArrow(matcher(length), RESOLVED), "matched")
    return resolved.unionByName(found).where("spans is not null").groupBy("doc", "h").agg(F.collect_list("spans").alias("spans"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, keep: tuple[str, ...] = (), spans: str = "spans", kept: str = "kept", readable: str | None = None) -> DataFrame:
    """(key, kept columns, spans array<struct(start, end)>, kept binary) of every row; ``spans`` and ``kept`` name the last two.
    With ``readable``, the whole characters among the kept bytes are one more column of that name.

    Every byte covered by a ``length``-byte string that also starts earlier (in a document of smaller key, or further
    left in the same one) is removed; strings are judged on the input.  ``spans`` are the maximal removed runs as byte
    offsets.  Null and short texts lose nothing (a null text keeps zero bytes); a null key comes before all others.  Rows
    that repeat a key with different texts are ordered by the SHA-256 of the text, rows equal in both are one document and get
    the same result.  Other columns are ignored.
    """
    d = in_small_batches(docs).select(
        F.col(key).alias("_key"), F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
    )
    numbers = text_numbers(docs, key, text)
    d = numbered(d, numbers, "_doc", "_text", "_h")
    gone = removed(docs, numbers, key, text, length).select(F.col("doc").alias("_doc"), F.col("h").alias("_h"), F.col("spans").alias("_spans"))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, packed in batches:
            rows = []
            for t, blobs in zip(texts, packed):
                raw = t.encode()
                cuts = np.frombuffer(b"".join(blobs), "<i4").reshape(-1, 2) if blobs is not None else np.zeros((0, 2), int)
                cuts = _spans(cuts[:, 0], cuts[:, 1]).tolist()
                edges = [0, *(x for s in cuts for x in s), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append(([{"start": a, "end": b} for a, b in cuts], left, left.decode(errors="ignore") if readable else None))
            yield pd.DataFrame(rows, columns=["spans", "kept", "readable"])

    # one function for all, as a second one in the same task would be a second Python worker
    cut = F.pandas_udf(run, "spans array<struct<start:int,end:int>>, kept binary, readable string")
    out = d.join(gone, ["_doc", "_h"], "left").withColumn("_r", cut("_text", "_spans"))
    return out.select(F.col("_key").alias(key), *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], F.col("_r.spans").alias(spans), F.col("_r.kept").alias(kept), *([F.col("_r.readable").alias(readable)] if readable else []))
