"""Merkle manifest of a dataset: one tree for each language, one over their roots.

A leaf is the SHA-256 of a row's columns. In a tree every two neighbours become their hash, a last
one alone the hash of itself, until one node is left. Digests are hashed as their hex text.

The tree is an append log in postorder. Aligned builders each take 2**height leaves in a row and
write every node as soon as it is complete, so a builder's nodes are one stretch of the log. Nobody
counts: the node of level k whose last leaf is e (from 0) has the place 2 e - popcount(e) + k,
as before leaf e stand e leaves and the e - popcount(e) inner nodes that they completed, and the k nodes
below it end in e too. The rule holds for the last, incomplete nodes of a tree as well. Builders' tops are the
leaves of the next builders, 2**height to one again, until each tree has one top; those are the leaves of the tree
over all. A proof asks the log for siblings by these places: those inside a builder's stretch from its own row, the
others once for the whole stretch, from the row above.

Leaves are placed by a range partitioning on tree, id and digest, with offsets from counts by
partition; so one language may hold any part of the rows. Text is read once, in the scan, and never shuffled: what moves is
id and digests. A builder holds 2**height leaves, at most; the driver holds nothing but the number of tiers.

Defined results: null ids come first in their tree, null languages are a tree of their own, before all others;
rows that share an id are ordered by their leaf, and equal rows are leaves each; a lone leaf is its tree's root, and a
lone tree's root the root; an empty table has no rows; extra columns are no part of a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .common import materialize, table

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SIDE, WIDTH = {0: "none", 1: "left", 2: "right"}, 33  # a step of a path: where the sibling stands, and its digest


def leaf(values: list[Column]) -> Column:
    """SHA-256, in hex, of the values: `-` if null, else UTF-8 bytes, `:` and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


# The log's arithmetic.


def place(k: int, i: int, n: int) -> int:
    """Where node i of level k stands in the postorder log of a tree of n leaves."""
    end = min((i + 1) << k, n) - 1
    return 2 * end - end.bit_count() + k


def height_of(n: int) -> int:
    return (n - 1).bit_length()


def width_of(k: int, n: int) -> int:
    """Nodes of level k of n leaves."""
    return -(-n >> k)


def joined(digests: list[bytes]) -> bytes:
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def build(leaves: list[bytes], levels: int) -> list[bytes]:
    """The log of an aligned run of leaves, in the order of completion, up to one node of the given level.

    `open` holds each level's node that waits for its neighbour. Behind the last leaf what still waits is closed level by level.
    """
    log: list[bytes] = []
    waiting: list[bytes | None] = [None] * (levels + 1)
    for e, digest in enumerate(leaves):
        k, last = 0, e == len(leaves) - 1
        log.append(digest)
        while k < levels and (waiting[k] is not None or last):
            digest = joined([digest] if waiting[k] is None else [waiting[k], digest])
            waiting[k] = None
            k += 1
            log.append(digest)
        waiting[k] = digest
    return log


def siblings(log: list[bytes], i: int, n: int, levels: int) -> bytes:
    """The path from leaf i of a builder's n leaves to its top: a step for each level."""
    out = []
    for k in range(levels):
        other = (i >> k) ^ 1
        if other >= width_of(k, n):
            out.append(bytes(WIDTH))
        else:
            out.append((b"\x01" if other < i >> k else b"\x02") + log[place(k, other, n)])
    return b"".join(out)


def steps(path: bytes) -> Iterator[tuple[str, bytes]]:
    for at in range(0, len(path), WIDTH):
        yield SIDE[path[at]], path[at + 1 : at + WIDTH]


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest and its path give."""
    for side, other in steps(path):
        digest = joined([digest] if side == "none" else [other, digest] if side == "left" else [digest, other])
    return digest


def proof_digest(path: bytes) -> bytes:
    return joined([other for side, other in steps(path) if side != "none"])


# The Spark side: placed leaves, builders' stretches of the log, paths.


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with `tree`), `index`, each row's place among its tree's, and `total`, the tree's rows.

    The rows are dealt by range and numbered where they lie; counts by partition and tree give the offsets. A row's
    number in its file comes last in the order, so that rows that repeat are spread, too.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "__row")]
    once = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "merkle-rows")
    dealt = materialize(once.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()), "merkle-dealt")
    part = F.shiftright("__id", 33)
    runs = dealt.groupBy("tree", part.alias("__of")).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__count"))  # one for each partition and tree in it
    tree = Window.partitionBy("tree")
    before = tree.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("tree").alias("__tree"), "__of", "__first", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__before"), F.sum("__count").over(tree).alias("total"))
    both = dealt.join(runs, F.col("tree").eqNullSafe(F.col("__tree")) & (part == F.col("__of")))
    return both.select(*rows.columns, (F.col("__id") - F.col("__first") + F.col("__before")).alias("index"), "total")


def stretches(nodes: DataFrame, height: int, t: int, keep: list[str], name: str) -> DataFrame:
    """The builders of tier t: tree, total, block, rows (index, digest and keep of its leaves, in order), log."""
    one = F.struct("index", "digest", *keep)
    run = nodes.groupBy("tree", "total", F.shiftright("index", height).alias("block")).agg(F.array_sort(F.collect_list(one)).alias("rows"))  # 2**height at most

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = []
            for total, rows in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                leaves = rows.values.field("digest").to_pylist()
                logs.append(b"".join(build(leaves, min(height, height_of(width_of(t * height, total))))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.binary())], [*batch.schema.names, "log"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in run.schema.fields)
    return materialize(run.mapInArrow(write, f"{schema}, log binary"), name)


def tops(found: DataFrame) -> DataFrame:
    """The last nodes of a tier's builders as the next tier's leaves: tree, total, index, digest."""
    return found.select("tree", "total", F.col("block").alias("index"), F.expr("substring(log, length(log) - 31, 32)").alias("digest"))


def opened(log: bytes, total: int, block: int, height: int, t: int) -> tuple[list[bytes], int, int]:
    """A stretch's nodes, its leaves and its levels."""
    n = width_of(t * height, total)
    return [log[i : i + 32] for i in range(0, len(log), 32)], min(n - (block << height), 1 << height), min(height, height_of(n))


def with_above(found: DataFrame, above: DataFrame | None) -> DataFrame:
    """Stretches and, of their tops: rest (the path to the root), subroot and root. Without a tier above the top is the root."""
    if above is None:
        return found.select("*", F.lit(b"").alias("rest"), F.lit(None).cast("binary").alias("subroot"), F.expr("substring(log, length(log) - 31, 32)").alias("root"))
    a = above.select(F.col("tree").alias("__tree"), F.col("index").alias("__index"), F.col("path").alias("rest"), "subroot", "root")
    return found.join(a, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("block") == F.col("__index"))).drop("__tree", "__index")


def paths(found: DataFrame, above: DataFrame | None, height: int, t: int) -> DataFrame:
    """A row for each leaf of tier t: tree, subroot, root, path (to the root), index, digest and what else `rows` holds."""
    rows = with_above(found, above).select("tree", "total", "block", "log", "rest", "subroot", "root", "rows")
    inner = rows.schema["rows"].dataType.elementType

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (tree, total, block, log, rest, subroot, root) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:7]], strict=True)):
                nodes, count, levels = opened(log, total, block, height, t)
                leaves = batch.column(7)[i].values
                same = [pa.array([x] * count, kind) for x, kind in ((tree, pa.string()), (subroot, pa.binary()), (root, pa.binary()))]
                path = pa.array([siblings(nodes, j, count, levels) + rest for j in range(count)], pa.binary())
                yield pa.RecordBatch.from_arrays([*same, path, *leaves.flatten()], ["tree", "subroot", "root", "path", *inner.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.fields)
    return rows.mapInArrow(find, f"tree string, subroot binary, root binary, path binary, {kinds}")


class Manifest:
    """The log of every tree, tier by tier from the leaves up, and of the tree over their roots.

    rows: tree (string), digest (binary) and any other columns, in each tree by `order`. tiers[0] holds all columns.
    """

    def __init__(self, rows: DataFrame, order: list[str], height: int = 10):
        self.height = height
        self.tiers = self._tiers(placed(rows, order), [c for c in rows.columns if c not in ("tree", "digest")])
        roots = tops(self.tiers[-1]).select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
        self.over = self._tiers(placed(roots, ["of"]), ["of"])

    def _tiers(self, nodes: DataFrame, keep: list[str]) -> list[DataFrame]:
        out: list[DataFrame] = []
        most = 2
        while most > 1:
            t = len(out)
            out.append(stretches(nodes, self.height, t, keep if not t else [], f"merkle-tier-{t}"))
            nodes = tops(out[-1])
            most = (out[-1].agg(F.max("block")).first()[0] or 0) + 1  # the driver gets one number
        return out

    def proofs(self) -> DataFrame:
        """Every row with subroot, root and path, to the root of all: steps of one byte (0 no sibling, 1 left, 2 right) and its digest."""
        above = None
        for t, found in reversed(list(enumerate(self.over))):
            above = paths(found, above, self.height, t)
        above = above.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("index"), "path", F.col("digest").alias("subroot"), "root")
        for t, found in reversed(list(enumerate(self.tiers))):
            above = paths(found, above, self.height, t)
        return above

    def log(self) -> DataFrame:
        """The trees' nodes as rows tree, place, level, digest: places count from 0 in each tree, in the order of completion."""
        height, out = self.height, []
        for t, found in enumerate(self.tiers):

            def listed(batches: Iterator[pa.RecordBatch], t: int = t) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for tree, total, block, log in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                        nodes, count, levels = opened(log, total, block, height, t)
                        at = [(k, i) for k in range(1 if t else 0, levels + 1) for i in range(width_of(k, count))]  # a tier's leaves are the tops below
                        where = [place(t * height + k, (block << height - k) + i, total) for k, i in at]
                        yield pa.RecordBatch.from_arrays([pa.array([tree] * len(at), pa.string()), pa.array(where, pa.int64()), pa.array([t * height + k for k, _ in at], pa.int32()), pa.array([nodes[place(k, i, count)] for k, i in at], pa.binary())], ["tree", "place", "level", "digest"])

            out.append(found.select("tree", "total", "block", "log").mapInArrow(listed, "tree string, place long, level int, digest binary"))
        return reduce(DataFrame.unionByName, out)


@F.pandas_udf(BinaryType())
def folded(digest: pd.Series, path: pd.Series) -> pd.Series:
    """The root that a leaf and its path give."""
    return pd.Series([fold(d, p) for d, p in zip(digest, path, strict=True)])


@F.pandas_udf(StringType())
def proof_sha256(path: pd.Series) -> pd.Series:
    """The digest of a path's siblings, from the leaf to the root."""
    return pd.Series([proof_digest(p).hex() for p in path])


def tampered(id_col: str) -> Column:
    """Whether a row is one of those that the check alters."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 0, F.lit(False))


def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    own = [F.col(c) for c in COLUMNS]
    other = [F.col(c) + F.lit(1) if c == "n_chars" else F.col(c) for c in COLUMNS]
    rows = docs.select(F.col("lang").alias("tree"), "doc_id", F.unhex(leaf(own)).alias("digest"), F.when(tampered("doc_id"), F.unhex(leaf(other))).alias("altered"))
    found = Manifest(rows, ["doc_id", "digest"]).proofs()
    hexed = lambda c: F.lower(F.hex(c))
    found = found.select("doc_id", *[hexed(c).alias(name) for name, c in (("leaf", "digest"), ("subroot", "subroot"), ("root", "root"))], proof_sha256("path").alias("proof_sha256"), hexed(folded(F.coalesce("altered", "digest"), F.col("path"))).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(n_chars: str) -> str:
    one = lambda c: f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || ({c})::VARCHAR, '-')"
    return "sha256(" + " || ".join(one(n_chars if c == "n_chars" else c) for c in COLUMNS) + ")"


#: CRC-32 of a decimal number, bit by bit.
_CRC = "xor(list_reduce([ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')], lambda c, x: list_reduce(range(8), lambda y, j: xor(y >> 1, 3988292384 * (y & 1)), xor(c, x)), 4294967295::BIGINT), 4294967295)"


def _tree_sql(leaves: str, name: str) -> str:
    """The nodes of all trees (tree, k, i, h, n) of leaves (tree, i, h, n)."""
    return f"""{name} AS (SELECT tree, 0 AS k, i, h, n FROM {leaves}
  UNION ALL SELECT tree, k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, k, i // 2, n)"""


def _fold_sql(start: str, nodes: str, name: str) -> str:
    """Paths of rows (r, tree, i, n, h, proof) to their tree's root."""
    return f"""{name} AS (SELECT r, tree, 0 AS k, i, n, h, proof FROM {start}
  UNION ALL SELECT f.r, f.tree, f.k + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.i < f.i THEN s.h || f.h ELSE f.h || s.h END), f.proof || coalesce(s.h, '')
  FROM {name} f LEFT JOIN {nodes} s ON s.tree IS NOT DISTINCT FROM f.tree AND s.k = f.k AND s.i = xor(f.i, 1) WHERE f.n > 1)"""


SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, lang AS tree, {_leaf_sql("n_chars")} AS h, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} END AS altered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_tree_sql("l", "t")},
o AS (SELECT '' AS tree, tree AS of_tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM t WHERE n = 1),
{_tree_sql("o", "u")},
a AS (SELECT r, tree, i, n, coalesce(altered, h) AS h, '' AS proof FROM l),
{_fold_sql("a", "t", "f")},
b AS (SELECT f.r, '' AS tree, o.i, o.n, f.h, f.proof FROM f JOIN o ON f.tree IS NOT DISTINCT FROM o.of_tree WHERE f.n = 1),
{_fold_sql("b", "u", "g")}
SELECT l.doc_id, l.h AS leaf, o.h AS subroot, u.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = u.h AS verified
FROM l JOIN g ON g.r = l.r AND g.n = 1 JOIN o ON l.tree IS NOT DISTINCT FROM o.of_tree JOIN u ON u.n = 1
"""
