"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that vary together share a partition; each partition gets a threshold of its own, and the thresholds that
dynamic programming allots cost the fewest estimated probes and candidates while no pair within reach can be missed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, in_small_batches, small, unused, written
from .components import joined, roots

BITS = 64


def fingerprint_udf(shingle: int = 3, seed: int = 42):
    """A column function: text -> 64-bit SimHash as a signed long.

    ASCII letters are lower-cased, words are runs without ASCII white space, shingles of ``shingle`` words count with
    repeats (a shorter text is one shingle), and a bit is 1 if set in over half the shingles' XXH64 values.  Texts
    without words, null among them, get 0.
    """

    def one(text: str | None) -> int:
        import xxhash

        ws = text.encode().lower().split() if text else []  # bytes know ASCII letters and ASCII white space only
        if not ws:
            return 0
        parts = [b" ".join(p) for p in zip(*(ws[i:] for i in range(shingle)))] or [b" ".join(ws)]
        digest, ones = xxhash.xxh64_digest, np.zeros(BITS, dtype=np.int64)
        for at in range(0, len(parts), 1 << 15):
            hashes = b"".join([digest(p, seed) for p in parts[at : at + (1 << 15)]])
            ones += np.unpackbits(np.frombuffer(hashes, "u1").reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        return int(np.packbits(2 * ones > len(parts)).view(">i8")[0])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="int64")

    return F.pandas_udf(run, "long")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of even size, each grown from a bit by those most correlated with the group."""
    bits = np.unpackbits(sample.astype(">u8").view("u1").reshape(-1, 8), axis=1)[:, ::-1].astype(float)
    spread = bits.std(0)
    z = (bits - bits.mean(0)) / np.where(spread > 0, spread, 1)
    alike = np.abs(z.T @ z) / max(len(bits), 1)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (alike[b, group].sum(), -b))
            left.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def allot(costs: list[list[float]], reach: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum of (t_i + 1) = reach + 1 at least total cost; -1 leaves a partition out.

    Two values within ``reach`` bits of each other then agree to within t_i on some partition i.  ``costs[i][t]``: the
    cost of threshold t on partition i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, reach - used + 1):
                if t < len(own):
                    total = cost + (own[t] if t >= 0 else 0.0)
                    if used + t + 1 not in new or total < new[used + t + 1][0]:
                        new[used + t + 1] = (total, [*chosen, t])
        best = new
    return best[reach + 1]


def plan(sample: np.ndarray, n: int, reach: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe for ``n`` fingerprints, costed on a sample of them.

    A threshold's cost: its probes, and the pairs expected to agree within it, whose share is that among the sample's
    pairs or, if larger, that of independent even bits.  Partitions of 2 to ``reach`` + 2 groups are compared.
    """
    sample = sample[:1024]
    far = sample[:, None] ^ sample[None, :]
    choices = []
    for parts in range(2, reach + 3):
        groups = group_bits(sample, parts)
        costs = []
        for g in groups:
            mask = np.uint64(sum(1 << b for b in g))
            apart = np.bitwise_count(far & mask)[np.triu_indices(len(sample), 1)]
            own = []
            for t in range(min(reach, 1) + 1):  # a threshold of 2 or more has far more probes than it saves
                ball = sum(math.comb(len(g), k) for k in range(t + 1))
                share = max(float((apart <= t).mean()) if len(apart) else 0.0, ball / 2.0 ** len(g))
                own.append(n * (ball + 1) + share * n * n / 2)
            costs.append(own)
        if parts * 2 >= reach + 1:
            cost, thresholds = allot(costs, reach)
            choices.append((cost, parts, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(choices)[2]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fingerprints: DataFrame, reach: int = 2, bucket_cap: int = 64) -> DataFrame:
    """(a, b) such that any two of the distinct ``fp`` within ``reach`` bits (2 at most) are joined by a path of links.

    Each fingerprint stands in its own bucket of every partition and probes those within the partition's threshold.  In
    buckets of up to ``bucket_cap`` fingerprints each candidate pair is verified.  In larger ones all pairs would grow
    with the square, so instead every member names the points one bit away; two members within two bits name a common
    point, which at most 65 fingerprints can name: the members of a point are linked to its least.
    """
    if reach not in (1, 2):
        raise ValueError("reach is 1 or 2: members of large buckets are linked through points one bit away")
    n = fingerprints.count()
    sample = np.array([r.fp for r in fingerprints.orderBy(F.xxhash64("fp")).limit(1024).collect()] or [0], dtype=np.int64).astype(np.uint64)
    fp = F.col("fp")
    flipped = lambda bits: F.concat(F.array(fp), F.array(*[fp.bitwiseXOR(F.lit(signed(1 << b))) for b in bits]))
    kept, probed = [], []
    for i, (bits, t) in enumerate(plan(sample, n, reach)):
        mask = F.lit(signed(sum(1 << b for b in bits)))
        bucket = lambda c: F.struct(F.lit(i).alias("part"), c.bitwiseAND(mask).alias("bits")).alias("bucket")  # noqa: B023, E731
        kept.append(fingerprints.select(bucket(fp), "fp"))
        near = fingerprints.select("fp", F.explode(flipped(bits) if t else F.array(fp)).alias("via"))
        probed.append(near.select(bucket(F.col("via")), "fp"))
    kept, probed = reduce(DataFrame.unionByName, kept), reduce(DataFrame.unionByName, probed)
    sizes = written(kept.groupBy("bucket").agg(F.count("*").alias("size")), "buckets")
    small, large = sizes.where(F.col("size") <= bucket_cap).select("bucket"), sizes.where(F.col("size") > bucket_cap).select("bucket")
    candidates = kept.join(small, "bucket").withColumnRenamed("fp", "a").join(probed.withColumnRenamed("fp", "b"), "bucket")
    pairs = candidates.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= reach)).select("a", "b")
    pointed = probed.join(large, "bucket").select("fp").distinct().select("fp", F.explode(flipped(range(BITS))).alias("point"))
    if reach == 1:
        through = pointed.join(fingerprints.select(fp.alias("point")), "point").select(F.col("fp").alias("a"), F.col("point").alias("b"))
    else:
        least = pointed.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("members")).where("members > 1")
        through = pointed.join(least, "point").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(through.where("a <> b")).distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 2, shingle: int = 3, seed: int = 42, by_text: bool = False) -> DataFrame:
    """(key, fp, component_id) of every row: fingerprints within ``reach`` bits link, classes are named by least key.

    Equal fingerprints are one node, however many rows share them.  Null keys take part but name no class, unless a
    class has no other key; repeated rows stay; other columns are ignored.  With ``by_text`` rows also have ``component``
    and ``sha``, as those of ``near_classes``.
    """
    sha = [F.sha2(F.col(text), 256).alias("sha")] if by_text else []
    marked = written(in_small_batches(docs).select(F.col(key).alias("key"), *sha, fingerprint_udf(shingle, seed)(F.col(text)).alias("fp")), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("key").alias("least")), "nodes")
    root = roots(links(nodes.select("fp"), reach)).withColumnRenamed("node", "fp")
    rooted = written(nodes.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id", F.col("root").alias("component"))
    return marked.join(by_fp, "fp").select(F.col("key").alias(key), "fp", "component_id", *(["component", "sha"] if by_text else []))


class WordHashes(dict):
    """The XXH64 of words, each worked out once while it is held."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingle_hashes(ws: list[bytes], words: int, known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of the shingles of ``words`` words, one after the other; of fewer words, the one of them all.

    A shingle's is a polynomial over the hashes of its words, mixed.
    """
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    span, out = min(words, len(ws)), np.zeros(max(len(ws) - words, 0) + 1, np.uint64)
    for i in range(span):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)] + np.uint64(1)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return (out ^ out >> np.uint64(32)).view(np.int64)


def bands_for(similarity: float, rows: int, missed: float) -> int:
    """How many bands of ``rows`` least values two sets of this similarity share one of, but for a chance of ``missed``."""
    return math.ceil(math.log(missed) / math.log1p(-(similarity**rows)))


def band_hashes(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each band: of the least values of the set ``h`` under ``rows`` fixed orders of all hashes."""
    rng = np.random.default_rng(42)
    turn, times = rng.integers(0, 2**63, (2, bands * rows), np.uint64)
    times = times * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    for i in range(0, len(h), 256):
        np.minimum(least, ((h[i : i + 256, None].view(np.uint64) ^ turn) * times).min(0), out=least)
    out = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        out = (out ^ out >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + column
    return ((out ^ out >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def shingle_udf(words: int, bands: int = 0, rows: int = 5):
    """A column function: text -> (id, size, parity, hashes) of the set of its shingles of ``words`` words, as 64-bit hashes.

    ``id`` is a hash of the whole set and ``size`` how many there are.  ``parity`` has, for each of 1,024 classes of hashes,
    whether the set has an odd number of them: two sets differ in at least as many hashes as their parities in bits.
    ``hashes`` are those of the bands, or of all shingles if ``bands`` is 0.  Words and short texts are taken as for the
    fingerprint.
    """
    known = WordHashes()

    def one(text: str | None) -> tuple[int, int, np.ndarray, np.ndarray]:
        import xxhash

        h = np.unique(shingle_hashes(text.encode().lower().split() if text else [], words, known))
        odd = np.packbits(np.bincount(h & 1023, minlength=1024) & 1).view(np.int64)
        return signed(xxhash.xxh64_intdigest(h.tobytes())), len(h), odd, band_hashes(h, bands, rows) if bands else h

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["id", "size", "parity", "hashes"])
            if len(known) > 200_000:  # what a worker holds is bounded
                known.clear()

    return F.pandas_udf(run, "id long, size int, parity array<long>, hashes array<long>")


def near_roots(members: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: Fraction, few: int = 64, hub_rounds: int = 5) -> DataFrame:
    """(node, root): equal roots for sets joined by a path of pairs of the similarity or more; only sets in such a pair appear.

    ``members`` has (hash, id, size, parity); a bucket is all that share a hash, and the pairs compared are those in a
    bucket.  ``sets`` gives (id, hashes) of a frame of ids, and is asked only for pairs whose sizes and parities allow the
    similarity.  First each set is compared with one set alone, the least of its buckets' hubs (the members of least hash).
    In each later round all of a bucket are compared with its hub, which then leaves: all its pairs are decided.  Pairs that
    a path already joins need no comparison, so a bucket of near copies is done after a round or two.  From the third round
    on small buckets, and after ``hub_rounds`` all, compare every pair that no path joins: all outside the bucket's largest
    class with all others.  Of buckets with the same members one is compared.
    """
    p, q = similarity.numerator, similarity.denominator

    def possible(x: str, y: str) -> Column:
        sizes = F.col(f"{x}.size"), F.col(f"{y}.size")
        apart = sum((F.bit_count(F.col(f"{x}.parity")[i].bitwiseXOR(F.col(f"{y}.parity")[i])) for i in range(16)), F.lit(0))
        return (F.least(*sizes) * q >= F.greatest(*sizes) * p) & (apart * (p + q) <= (q - p) * (sizes[0] + sizes[1]))

    ends = lambda x, y: (F.least(f"{x}.id", f"{y}.id").alias("a"), F.greatest(f"{x}.id", f"{y}.id").alias("b"))
    pending, rooted, tested, turn = written(members.withColumn("root", F.col("id")), "pending"), None, None, 0
    while True:
        hub = F.min(F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), "id", "size", "parity", "root")).alias("hub")
        buckets = pending.groupBy("hash").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("who"), F.min("root").alias("lo"), F.max("root").alias("hi"), hub)
        open_ = buckets.where("lo <> hi").groupBy("n", "who").agg(F.min(F.struct("hash", "hub")).alias("one")).select("one.*", "n")
        live = written(pending.join(open_, "hash"), "live")
        discard(pending)
        if live.isEmpty():
            return live.select(F.col("id").alias("node"), F.col("id").alias("root")).limit(0) if rooted is None else rooted
        whole = F.lit(False) if turn < 2 else F.col("n") <= few if turn < hub_rounds else F.lit(True)
        star = live.alias("x").where(~whole & (F.col("x.root") != F.col("hub.root")) & possible("x", "hub"))
        pairs = star.select(*ends("x", "hub"))
        if not turn:
            pairs = star.groupBy("id").agg(F.min("hub").alias("hub")).alias("x").select(*ends("x", "hub"))
        if turn > 1:
            rest = live.where(whole).select("hash", "id", "size", "parity", "root")
            most = rest.groupBy("hash", "root").agg(F.count("*").alias("k")).groupBy("hash").agg(F.max_by("root", F.struct("k", "root")).alias("most"))
            rest = rest.join(most, "hash").withColumn("minor", F.col("root") != F.col("most")).drop("most")
            x, y = rest.where("minor").alias("x"), rest.alias("y")
            apart = (F.col("x.root") != F.col("y.root")) & (~F.col("y.minor") | (F.col("x.id") < F.col("y.id")))
            each = x.join(y, (F.col("x.hash") == F.col("y.hash")) & apart & possible("x", "y"))
            pairs = pairs.unionByName(each.select(*ends("x", "y")))
        pairs = pairs.distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "candidates")
        tested = pairs if tested is None else tested.unionByName(pairs)
        whole_sets = written(sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")
        both = pairs.join(whole_sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(whole_sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
        near = both.where(F.size(F.array_intersect("x", "y")) * (p + q) >= p * (F.size("x") + F.size("y"))).select("a", "b")
        rooted = joined(written(near, "near"), rooted)
        left = live.where(~whole & ((F.col("id") != F.col("hub.id")) | F.lit(turn == 0))).select("hash", "id", "size", "parity")
        pending = left.join(rooted.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        pending = written(pending, "pending")
        discard(whole_sets, live)
        turn += 1


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, rows: int = 5, missed: float = 1e-6) -> DataFrame:
    """(key, component_id, component, sha) of every row: texts whose shingles are similar link.

    Classes are named by their least key, and by a number of their own, ``component``, where keys are null or repeat;
    ``sha`` is the SHA-256 of the row's text (null for null).

    Similarity is the Jaccard similarity of the sets of ``words``-word shingles, compared by their 64-bit hashes: none below
    is linked.  Pairs meet where they share a band of ``rows`` least values; there are so many bands that a pair at the
    similarity shares none with a chance of ``missed``, whatever else is in the input, and one above it still more seldom.
    Equal sets are one node.  ``docs`` is read again in each round.
    Null keys, repeated rows and other columns as in ``classes``; all texts without words are alike.
    """
    t, took = Fraction(str(similarity)), in_small_batches(docs).select(F.col(key).alias("key"), F.col(text).alias("text"))
    first = shingle_udf(words, bands_for(similarity, rows, missed), rows)(F.col("text"))
    marked = written(took.select("key", F.sha2("text", 256).alias("sha"), first.alias("s")).select("key", "sha", "s.*"), "shingles")
    # 64-bit names of sets: should two share one, their classes would merge
    same = (F.any_value(c).alias(c) for c in ("size", "parity", "hashes"))
    nodes = written(marked.groupBy("id").agg(F.min("key").alias("least"), *same), "nodes")
    banded = nodes.select("id", F.explode("hashes").alias("hash"))
    shared = banded.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    members = banded.join(shared, "hash", "left_semi").join(nodes.select("id", "size", "parity"), "id")

    def sets(ids: DataFrame) -> DataFrame:
        keys = small(nodes.select("id", "least").join(ids, "id").select(F.col("least").alias("_key")).distinct(), 500_000)
        texts = took.join(keys, F.col("key").eqNullSafe(F.col("_key")), "left_semi")
        return texts.select(shingle_udf(words)(F.col("text")).alias("s")).select("s.id", "s.hashes")  # repeated rows only repeat links

    root = near_roots(members, sets, t).withColumnRenamed("node", "id")
    rooted = written(nodes.select("id", "least").join(root, "id", "left").select("id", "least", F.coalesce("root", "id").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_id = rooted.join(named, "root").select("id", "root", "component_id")
    return marked.select("key", "sha", "id").join(by_id, "id").select(F.col("key").alias(key), "component_id", F.col("root").alias("component"), "sha")


def merged(found: DataFrame, other: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, component, sha) of every row of ``found``: texts joined by a path of links of either result are one class.

    Both are results of ``classes`` by text or of ``near_classes`` for the same rows.  Classes of ``found`` that meet in one
    of ``other`` are joined.
    """
    ours, theirs = (d.select("sha", F.col("component").alias(name)).distinct() for d, name in ((found, "ours"), (other, "theirs")))
    theirs = theirs.withColumnRenamed("sha", "_sha")
    both = written(ours.join(theirs, F.col("sha").eqNullSafe(F.col("_sha"))).select("ours", "theirs").distinct(), "both")
    meeting = both.groupBy("theirs").agg(F.min("ours").alias("a"), F.max("ours").alias("last")).where("a <> last").select("theirs", "a")
    root = written(roots(both.join(meeting, "theirs").select("a", F.col("ours").alias("b"))), "roots")
    return found.join(root.withColumnRenamed("node", "component"), "component", "left").select(key, F.coalesce("root", "component").alias("component"), "sha")


def representatives(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each class in ``found`` one row with its own columns: that of least key, null last.

    ``found`` is the result of ``near_classes``, of ``classes`` by text, or of ``merged``.

    Of rows of that key the text of least SHA-256 stays, and of rows equal in key and text any one.  The result of
    ``classes`` without texts will do where keys are not null and don't repeat with different texts: it knows rows by their key alone.
    """
    k, sha, rows, at = unused(docs, "key", "sha", "rows", "row")
    by_text = "sha" in found.columns
    if not by_text:
        found = found.select(key, F.col("component_id").alias("component"), F.lit(None).cast("string").alias("sha"))
    each = found.groupBy("component", key, "sha").agg(F.count("*").alias("_rows"))
    least = each.groupBy("component").agg(F.min(F.struct(F.col(key).isNull(), key, "sha", "_rows")).alias("m"))
    chosen = written(least.select(F.col(f"m.{key}").alias(k), F.col("m.sha").alias(sha), F.col("m._rows").alias(rows)), "representatives")
    same = F.col(key).eqNullSafe(F.col(k))
    kept = docs.join(chosen, same & F.sha2(text, 256).eqNullSafe(F.col(sha)) if by_text else same)
    if not chosen.where(F.col(rows) > 1).isEmpty():
        kept = written(kept.withColumn(at, F.monotonically_increasing_id()), "repeated")  # numbered once
        first = kept.where(F.col(rows) > 1).groupBy(k, sha).agg(F.min(at).alias(at)).select(at)
        kept = kept.where(F.col(rows) == 1).unionByName(kept.where(F.col(rows) > 1).join(first, at, "left_semi"))
    return kept.select(*docs.columns)


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
