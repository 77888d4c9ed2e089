"""Merkle manifests of a table: one tree of digests for each group of rows, one tree over their roots, and proofs.

A tree's leaves are cut into aligned blocks of ``RUN ** DEPTH`` nodes.  Inside a block the tree is persistent: a changed
leaf makes a new version that copies its ancestors in the block and shares every other node with the first one.  A version
goes on upwards by the siblings of its block, which come down from the upper blocks once for all its rows.  So each task
holds one block at a time, and no tree, path or version is ever in one place.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import placed, written

RUN, DEPTH = 16, 2
BLOCK = RUN**DEPTH
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NODES = "tree string, pos long, n long, digest binary"
ABOVE = "array<struct<before: string, after: string>>"


def leaf_digest(*fields: Column) -> Column:
    """Hex SHA-256 of the fields, each as byte count, colon and value, or ``-`` for null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, fields)).cast("binary"), 256)


# ------------------------------------------------------------------------------- a persistent tree inside one block
# A node is (digest in hex, children); leaves have no children.  Nothing is ever changed in place.


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def built(leaves: list[str], height: int) -> tuple:
    """The root of ``leaves`` after ``height`` levels, each of which makes one node of every ``RUN``."""
    nodes = [(leaf, ()) for leaf in leaves]
    for _ in range(height):
        runs = [tuple(nodes[i : i + RUN]) for i in range(0, len(nodes), RUN)]
        nodes = [(digest([child[0] for child in run]), run) for run in runs]
    return nodes[0]


def version(node: tuple, height: int, at: int, leaf: str) -> tuple:
    """A new root with ``leaf`` at place ``at``: its ancestors are copied, all other nodes are those of ``node``."""
    if not height:
        return (leaf, ())
    i, rest = divmod(at, RUN ** (height - 1))
    children = node[1][:i] + (version(node[1][i], height - 1, rest, leaf),) + node[1][i + 1 :]
    return (digest([child[0] for child in children]), children)


def siblings(node: tuple, height: int, at: int) -> list[dict[str, str]]:
    """For each level from the leaf upwards, the digests of the run before and after the one on the path."""
    out = []
    while height:
        i, at = divmod(at, RUN ** (height - 1))
        digests = [child[0] for child in node[1]]
        out.append({"before": "".join(digests[:i]), "after": "".join(digests[i + 1 :])})
        node, height = node[1][i], height - 1
    return out[::-1]


def folded(value: str, above: list[dict[str, str]]) -> str:
    for step in above:
        value = digest([step["before"], value, step["after"]])
    return value


def _block(nodes: pa.Table) -> tuple[list[int], tuple, int]:
    """The rows' order, root and height of one block; the height of a tree's only block is what its nodes need."""
    order = nodes["pos"].to_numpy().argsort(kind="stable").tolist()
    n, height = nodes["n"][0].as_py(), DEPTH
    if n <= BLOCK:
        height = 0 if n == 1 else next(h for h in range(1, DEPTH + 1) if n <= RUN**h)
    digests = nodes["digest"].to_pylist()
    return order, built([digests[i].hex() for i in order], height), height


# ------------------------------------------------------------------------------------------- trees over many blocks


def blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes at every ``DEPTH``-th level that has several in a tree, lowest first; and (tree, digest, top) of the roots.

    ``top`` is the number of the last of these levels that the tree has.  A level has a ``BLOCK``-th of the rows below.
    """

    def root(blocks: pa.Table) -> pa.Table:
        _, node, _ = _block(blocks)
        row = {"tree": [blocks["tree"][0].as_py()], "pos": [blocks["block"][0].as_py()], "n": [-(-blocks["n"][0].as_py() // BLOCK)], "digest": [bytes.fromhex(node[0])]}
        return pa.table(row, pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))

    levels, tops = [nodes], []
    while True:
        up = written(blocked(levels[-1].select("tree", "pos", "n", "digest")).groupBy("tree", "block").applyInArrow(root, NODES), "level")
        tops.append(up.where("n = 1").select("tree", "digest", F.lit(len(levels) - 1).alias("top")))
        more = up.where("n > 1")
        if more.isEmpty():
            return levels, reduce(DataFrame.union, tops)
        levels.append(more)


def handed_down(levels: list[DataFrame], heads: DataFrame, to: int) -> DataFrame:
    """(tree, block, above, subroot) of the blocks of level ``to``: the siblings on the way from a block's root up.

    ``heads`` has (tree, top, above, subroot): what lies above each tree's root.
    """

    def steps(nodes: pa.Table, head: pa.Table) -> pa.Table:
        order, node, height = _block(nodes)
        above, size = head["above"][0].as_py(), nodes.num_rows
        first = nodes["block"][0].as_py() * BLOCK
        row = {
            "tree": [nodes["tree"][0].as_py()] * size, "block": [first + i for i in range(size)], "above": [siblings(node, height, i) + above for i in range(size)],
            "subroot": [head["subroot"][0].as_py()] * size,
        }
        step = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return pa.table(row, pa.schema([("tree", pa.string()), ("block", pa.int64()), ("above", step), ("subroot", pa.string())]))

    out = None
    for g in reversed(range(to, len(levels))):
        own = heads.where(F.col("top") == g).select("tree", F.lit(0).cast("long").alias("block"), "above", "subroot")
        here = own if out is None else own.unionByName(out)
        if g == to:
            return here
        nodes = blocked(levels[g].select("tree", "pos", "n", "digest"))
        out = written(nodes.groupBy("tree", "block").cogroup(here.groupBy("tree", "block")).applyInArrow(steps, f"tree string, block long, above {ABOVE}, subroot string"), "above")
    raise AssertionError("no such level")


def manifest(docs: DataFrame, key: str, tree: str, leaf: Column, found: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``leaf`` is the hex digest of a row as the manifest has it, ``found`` that of the row as it is found now (null or not
    given: unchanged).  Rows of equal ``tree`` ascend by key (null first), then by leaf; null is a tree of its own.  Of 16
    consecutive nodes one is made until one is left, the subroot; the subroots, ordered by the bytes of ``tree`` (null
    first), give the root in the same way.  ``proof_sha256`` is the digest of all siblings on the way up; ``folded_root``
    is what the found leaf and these siblings give, ``verified`` whether that is the root.

    Repeated rows are leaves of their own, an empty table gives no rows, other columns are ignored.
    """
    coded = F.coalesce(F.concat(F.lit("+"), F.col(tree).cast("string")), F.lit(""))  # in the same order, without null
    rows = docs.select(
        F.col(key).alias("key"), coded.alias("tree"), F.unhex(leaf).alias("digest"), F.unhex(found if found is not None else F.lit(None)).alias("found"), F.monotonically_increasing_id().alias("row")
    )
    leaves = placed(written(rows, "leaves"), F.col("key").asc_nulls_first(), F.col("digest"), F.col("row")).drop("row")
    levels, subroots = climbed(leaves)
    groups = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "top"), F.col("name"))
    upper, roots = climbed(groups)
    first = roots.first()
    root = bytes(first["digest"]).hex() if first else ""
    over = [upper[0].select("tree", "pos", "n", "digest"), *upper[1:]]
    top = roots.select("tree", F.col("top") + 1, F.array().cast(ABOVE).alias("above"), F.lit(root).alias("subroot"))  # levels count from the one below
    paths = handed_down([leaves, *over], top.toDF("tree", "top", "above", "subroot"), 0).select(F.col("block").alias("pos"), "above")
    heads = groups.join(paths, "pos").select(F.col("name").alias("tree"), "top", "above", F.lower(F.hex("digest")).alias("subroot"))
    heads = handed_down(levels, written(heads, "heads"), 0)
    out = T.StructType([T.StructField("key", docs.schema[key].dataType), *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType())])

    def results(nodes: pa.Table, head: pa.Table) -> pa.Table:
        order, node, height = _block(nodes)
        above, subroot = head["above"][0].as_py(), head["subroot"][0].as_py()
        rest = "".join(step["before"] + step["after"] for step in above)
        same = folded(node[0], above)  # of all rows that are found as they were: they share the block's first version
        found, leaf, proof, ends = nodes["found"].to_pylist(), [], [], []
        for at, i in enumerate(order):
            steps = siblings(node, height, at)
            proof.append(digest([step["before"] + step["after"] for step in steps] + [rest]))
            leaf.append(nodes["digest"][i].as_py().hex())
            ends.append(same if found[i] is None else folded(version(node, height, at, found[i].hex())[0], above))
        texts = {"leaf": leaf, "subroot": [subroot] * len(order), "root": [root] * len(order), "proof_sha256": proof, "folded_root": ends}
        columns = [nodes["key"].take(pa.array(order)), *(pa.array(v, pa.string()) for v in texts.values()), pa.array([e == root for e in ends], pa.bool_())]
        return pa.Table.from_arrays(columns, names=["key", *texts, "verified"])

    both = blocked(leaves).groupBy("tree", "block").cogroup(heads.groupBy("tree", "block"))
    return both.applyInArrow(results, out).withColumnRenamed("key", key)


# ------------------------------------------------------------------------------------------------- the same in SQL


def _sql_levels(nodes: str, up: str, tree: str, height: int) -> str:
    """CTEs ``{up}0`` ... and the runs ``{up}r0`` ... of nodes (tree, pos, h, n)."""
    out = [f"{up}0 AS (SELECT {tree} AS tree, pos, h, n FROM {nodes})"]
    for k in range(height):
        out.append(f"{up}r{k} AS (SELECT tree, pos // {RUN} AS p, n, list(h ORDER BY pos) AS hs FROM {up}{k} WHERE n > 1 GROUP BY ALL)")
        out.append(f"{up}{k + 1} AS (SELECT tree, p AS pos, sha256(array_to_string(hs, '')) AS h, (n + {RUN - 1}) // {RUN} AS n FROM {up}r{k})")
    return ",\n".join([*out, f"{up}roots AS ({' UNION ALL '.join(f'SELECT tree, h FROM {up}{k} WHERE n = 1' for k in range(height + 1))})"])


def _sql_folds(start: str, up: str, name: str, height: int) -> str:
    """CTEs that carry rows (doc_id, leaf, tree, pos, f, sib, ...) up through the runs ``{up}r0`` ..."""
    out, last = [], start
    for k in range(height):
        i = f"x.pos % {RUN}"
        out.append(f"""{name}{k} AS (SELECT x.* REPLACE (x.pos // {RUN} AS pos,
          CASE WHEN hs IS NULL THEN f ELSE sha256(array_to_string(hs[1:{i}], '') || f || array_to_string(hs[{i} + 2:], '')) END AS f,
          CASE WHEN hs IS NULL THEN sib ELSE sib || array_to_string(hs[1:{i}], '') || array_to_string(hs[{i} + 2:], '') END AS sib)
        FROM {last} x LEFT JOIN {up}r{k} r ON r.tree IS NOT DISTINCT FROM x.tree AND r.p = x.pos // {RUN})""")
        last = f"{name}{k}"
    return ",\n".join(out)


def oracle_sql(height: int = 6) -> str:
    """DuckDB SQL of the registered query for up to 16 ** ``height`` rows a source and as many sources."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    parts = lambda text: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (SELECT *, {parts("text")} AS leaf, {parts(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} AS low,
  xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS fold
  FROM documents, crc),
d AS (SELECT doc_id, leaf, source AS tree, leaf AS h, CASE WHEN fold % 5 = 0 THEN low ELSE leaf END AS f, '' AS sib, count(*) OVER (PARTITION BY source) AS n,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM raw),
{_sql_levels("d", "a", "tree", height)},
s AS (SELECT tree AS source, h, count(*) OVER () AS n, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos FROM aroots),
{_sql_levels("s", "b", "0", height)},
{_sql_folds("d", "a", "p", height)},
e AS (SELECT p.doc_id, p.leaf, s.h AS subroot, 0 AS tree, s.pos, p.f, p.sib FROM p{height - 1} p JOIN s ON p.tree IS NOT DISTINCT FROM s.source),
{_sql_folds("e", "b", "q", height)}
SELECT doc_id, leaf, subroot, h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = h AS verified FROM q{height - 1}, broots
"""
