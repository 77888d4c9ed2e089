"""Ranked lexical search over an index that is partitioned by term, in a pipeline of term owners.

Documents are indexed in blocks of at most ``BLOCK_DOCS``.  Terms are dealt to owners, the rarest to the first.  Items
travel in bundles: at each owner a bundle meets that owner's postings of one block by cogroup, adds their integer
contributions to its sparse accumulators and moves on.  Between owners every item's ``top``-th best sum so far is a proven
floor of its final threshold: accumulators that can't reach it any more with all that is still to come are let go, and no
new ones are begun where the rest alone can't reach it.  So results are whole, and nothing grows but with the documents.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import discard, in_small_batches, small, written

#: Terms in UTF-8 bytes: ASCII letters and digits and everything beyond ASCII, A-Z lower-cased.
TERM = rb"[0-9A-Za-z\x80-\xFF]+"
BLOCK_DOCS, BLOCK_POSTINGS = 2048, 1 << 20
BUNDLE = 256
BITS = 1 << 24


def bundled(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(bundle, slot, key, terms array): every row of ``items`` an item of its own, up to ``BUNDLE`` of them a bundle; written."""

    @F.arrow_udf("array<binary>")
    def terms(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(set(re.findall(TERM, t.as_py().lower()))) if t.is_valid else [] for t in texts], pa.list_(pa.binary()))

    number = F.monotonically_increasing_id()
    rows = items.select(F.col(key).alias("key"), terms(F.col(text).cast("binary")).alias("terms"), number.alias("number"))
    return written(rows.select(F.floor(F.col("number") / BUNDLE).alias("bundle"), (F.col("number") % BUNDLE).cast("int").alias("slot"), "key", "terms"), "items")


def wanted(terms: DataFrame) -> bytes:
    """Bits at the crc32 of every ``term``, modulo ``BITS``: 2 MB whatever the number of terms."""
    h = F.crc32("term") % BITS
    parts = terms.groupBy(F.bitmap_bucket_number(h + 1).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h + 1)).alias("bits"))
    out = bytearray(BITS // 8)
    for row in parts.collect():  # 512 rows at most
        at = (row["at"] - 1) * 4096
        out[at : at + 4096] = row["bits"]
    return bytes(out)


def indexed(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of an inverted index of all documents, for the terms among ``terms`` and few others; written.

    Rows with a term: (block, term, docs, tfs, ns), the places of documents in the block, the term's occurrences and the
    documents' sizes in terms.  A row without a term: (block, keys, ns) of the block's documents, ascending by key, null
    last.  Blocks follow the input's partitions, so nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted(terms))
    schema = T.StructType.fromDDL("block long, term binary, docs array<int>, tfs array<int>, ns array<int>").add("keys", T.ArrayType(docs.schema[key].dataType))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, find, number, known = shared.value, re.compile(TERM).findall, TaskContext.get().partitionId() << 32, {}
        keys, sizes, names, which, where, times = [], [], {}, array("i"), array("i"), array("i")

        def flushed() -> pa.RecordBatch:
            order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] if keys[i] is not None else 0))
            place = np.empty(len(order), "i4")
            place[order] = np.arange(len(order))
            ns = np.array(sizes, "i4")
            t, d, tf = (np.frombuffer(a, "i4") for a in (which, where, times))
            by = np.lexsort((place[d], t))
            t, d, tf = t[by], d[by], tf[by]
            ends = np.concatenate([np.searchsorted(t, np.arange(len(names) + 1)), [len(t)]])
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v)) for v in (place[d], tf, np.concatenate([ns[d], ns[order]]).astype("i4"))]
            lists[2] = pa.ListArray.from_arrays(pa.array([*ends[:-1], len(t) + len(ns)], pa.int32()), lists[2].values)
            all_keys = pa.array([None] * len(names) + [[keys[i] for i in order]], pa.list_(of_key))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(names) + 1, number)), pa.array([*names, None], pa.binary()), *lists, all_keys], names=schema.names)

        for batch in batches:
            of_key = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = Counter(find(t.as_py().lower())) if t.is_valid else {}
                for term, n in counts.items():
                    hit = known.get(term)
                    if hit is None:
                        h = zlib.crc32(term) % BITS
                        hit = known[term] = bits[h >> 3] >> (h & 7) & 1
                    if hit:
                        which.append(names.setdefault(term, len(names)))
                        where.append(len(keys))
                        times.append(n)
                keys.append(k)
                sizes.append(sum(counts.values()))
                if len(keys) == BLOCK_DOCS or len(which) >= BLOCK_POSTINGS:
                    yield flushed()
                    number, keys, sizes, names, which, where, times = number + 1, [], [], {}, array("i"), array("i"), array("i")
                if len(known) > 1_000_000:
                    known = {}
        if keys:
            yield flushed()

    rows = in_small_batches(docs).select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    return written(rows.mapInArrow(blocks, schema), "index")


def _floors(held: DataFrame, top: int) -> DataFrame:
    """(bundle, slot, floor): each item's ``top``-th best sum over all blocks; only items with that many."""
    each = held.select("bundle", "slot", F.explode("best").alias("score"))
    place = F.row_number().over(W.Window.partitionBy("bundle", "slot").orderBy(F.desc("score")))
    return each.withColumn("_at", place).where(F.col("_at") <= top).groupBy("bundle", "slot").agg(F.min("score").alias("floor"), F.count("*").alias("_n")).where(F.col("_n") == top).drop("_n")


HELD = "bundle long, block long, slot int, docs array<int>, scores array<long>, best array<long>"


def _stage(top: int, last: bool):
    """The cogroup of one owner: accumulators of a bundle in a block, and the owner's postings there with the items that ask."""

    def run(key: tuple, held: pa.Table, posted: pa.Table) -> pa.Table:
        sums: dict[int, np.ndarray] = {}
        held, posted = held.combine_chunks(), posted.combine_chunks()

        def lists(table: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
            col = table[name].chunk(0) if table[name].num_chunks == 1 else pa.concat_arrays(table[name].chunks)
            return col.offsets.to_numpy(), col.values

        if held.num_rows:
            ends, docs = lists(held, "docs")
            scores_at, scores = lists(held, "scores")
            docs, scores = docs.to_numpy(), scores.to_numpy()
            for i, (slot, need) in enumerate(zip(held["slot"].to_pylist(), held["need"].to_pylist())):
                d, s = docs[ends[i] : ends[i + 1]], scores[scores_at[i] : scores_at[i + 1]]
                sums[slot] = np.zeros(BLOCK_DOCS, "i8")
                sums[slot][d[s >= need]] = s[s >= need]
        if posted.num_rows:
            ends, docs = lists(posted, "docs")
            cs_at, cs = lists(posted, "cs")
            asks_at, asks = lists(posted, "asks")
            docs, cs, slots, needs = docs.to_numpy(), cs.to_numpy(), asks.field("slot").to_numpy(), asks.field("need").to_numpy()
            for i, w in enumerate(posted["w"].to_pylist()):
                d, v = docs[ends[i] : ends[i + 1]], w * cs[cs_at[i] : cs_at[i + 1]].astype("i8")
                for slot, need in zip(slots[asks_at[i] : asks_at[i + 1]].tolist(), needs[asks_at[i] : asks_at[i + 1]].tolist()):
                    if need <= 0:
                        if slot not in sums:
                            sums[slot] = np.zeros(BLOCK_DOCS, "i8")
                        sums[slot][d] += v
                    elif slot in sums:
                        live = sums[slot][d] > 0
                        sums[slot][d[live]] += v[live]
        rows = {"slot": [], "docs": [], "scores": [], "best": []}
        for slot, dense in sums.items():
            d = np.flatnonzero(dense)
            s = dense[d]
            best = np.lexsort((d, -s))[:top]  # ties to the smaller place, which has the smaller key
            if len(d):
                if last:
                    d, s, best = d[best], s[best], np.arange(len(best))
                for name, value in (("slot", slot), ("docs", d.astype("i4")), ("scores", s), ("best", s[best])):
                    rows[name].append(value)
        n = len(rows["slot"])
        kinds = {"slot": pa.int32(), "docs": pa.list_(pa.int32()), "scores": pa.list_(pa.int64()), "best": pa.list_(pa.int64())}
        where = [pa.array([k.as_py()] * n, pa.int64()) for k in key]
        return pa.Table.from_arrays([*where, *(pa.array(rows[c], kinds[c]) for c in kinds)], names=["bundle", "block", *kinds])

    return run


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", top: int = 50, owners: int = 3) -> DataFrame:
    """(item, rank, key, score): the ``top`` documents of every row of ``items``, the highest score first, ties to the smaller key.

    A term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))); a document's part of it is w times
    (10^9 tf) div (1000 tf + 20 m), where m = 50 + (50 n N) div L.  Only scores above 0 are returned.  Null and empty texts
    have no terms; null keys come last among ties; repeated rows are documents or items of their own; an empty table of
    either kind gives no rows; other columns are ignored.  Sums are 64-bit integers, so they don't depend on any order.
    """
    spark = docs.sparkSession
    asked = bundled(items, item, text)
    pairs = asked.select("bundle", "slot", F.explode("terms").alias("term"))
    index = indexed(docs, pairs, key, text)
    ns = index.where("term IS NULL").select("block", "keys", "ns")
    total = ns.agg(F.sum(F.size(F.filter("ns", lambda n: n > 0))).alias("n"), F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, n: a + n)).alias("l")).first()
    n, size = total["n"] or 0, max(total["l"] or 0, 1)
    part = f"zip_with(tfs, ns, (tf, n) -> cast((1000000000L * tf) div (1000L * tf + 20L * (50L + (50L * n * {n}L) div {size}L)) as int))"
    postings = index.where("term IS NOT NULL").select("block", "term", "docs", F.expr(part).alias("cs"))
    stats = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max(F.array_max("cs")).alias("most"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n) + 2) / (2 * F.col("df").cast("double") + 1)))
    shares = written(pairs.join(stats, "term").withColumn("w", weight), "shares")  # one row for each item and term
    # owners: by how common a term is, so that what the first ones add up is a small part of all
    volume = shares.groupBy(F.floor(F.log2("df")).alias("c")).agg(F.sum("df").alias("v")).orderBy("c").collect()  # 64 rows at most
    owner_of, done, all_of = {}, 0, sum(r["v"] for r in volume)
    for r in volume:
        done += r["v"]
        owner_of[r["c"]] = next(k for k in range(owners) if k == owners - 1 or done <= all_of * 6.0 ** (k + 1 - owners))
    owner = F.coalesce(*(F.when(F.floor(F.log2("df")) == c, k) for c, k in owner_of.items()), F.lit(0))
    shares = shares.withColumn("owner", owner)
    rests = written(shares.groupBy("bundle", "slot").agg(*(F.sum(F.when(F.col("owner") > k, F.col("w") * F.col("most")).otherwise(0)).alias(f"rest{k}") for k in range(owners))), "rests")
    held, needs, old = spark.createDataFrame([], HELD), rests.select("bundle", "slot", F.lit(0).cast("long").alias("need")), []
    for k in range(owners):
        terms = shares.where(F.col("owner") == k).join(needs, ["bundle", "slot"])
        asks = terms.groupBy("term", "bundle", "w").agg(F.collect_list(F.struct("slot", "need")).alias("asks"))  # BUNDLE at most
        posted = postings.join(small(written(asks, "asks"), 100_000), "term").select("bundle", "block", "w", "docs", "cs", "asks")
        carried = held.drop("best").join(small(needs, 100_000), ["bundle", "slot"])
        held = written(carried.groupBy("bundle", "block").cogroup(posted.groupBy("bundle", "block")).applyInArrow(_stage(top, k + 1 == owners), HELD), "held")
        floors = written(_floors(held, top), "floors")
        needs = written(rests.join(floors, ["bundle", "slot"], "left").select("bundle", "slot", (F.coalesce("floor", F.lit(0)) - F.col(f"rest{k}")).alias("need")), "needs")
        discard(*old)
        old = [held]
    best = held.join(small(needs, 100_000), ["bundle", "slot"])  # after the last owner nothing is to come: need is the floor
    best = best.withColumn("found", F.filter(F.arrays_zip("docs", "scores"), lambda x: x.scores >= F.col("need"))).where(F.size("found") > 0)
    best = written(best.select("bundle", "slot", "block", "found"), "found")
    keyed = ns.select("block", "keys").join(small(best, 200_000), "block")
    each = keyed.select("bundle", "slot", F.explode(F.transform("found", lambda x: F.struct(F.element_at("keys", x.docs + 1).alias("k"), x.scores.alias("score")))).alias("x"))
    order = W.Window.partitionBy("bundle", "slot").orderBy(F.desc("x.score"), F.asc_nulls_last("x.k"))
    first = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(asked.select("bundle", "slot", "key"), ["bundle", "slot"]).select(F.col("key").alias(item), "rank", F.col("x.k").alias(key), "x.score")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
f AS (SELECT doc_id, len(ts) AS n, t, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS t FROM d) GROUP BY ALL),
g AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS terms FROM d WHERE len(ts) > 0),
w AS (SELECT t, floor(1000 * ln((2.0 * docs + 2)::DOUBLE / (2.0 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, g GROUP BY t, docs),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN f USING (t), g GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""
