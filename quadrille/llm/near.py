"""Near-duplicate classes by Order MinHash.

Each text is read as five-word shingles, labelled by occurrence so that no two are equal.
For each of `sketches` orders, the `length` smallest are taken and hashed in the order in
which they stand in the text; two texts fall into one bucket of that order if they agree
on all of it, which texts do the likelier the less editing lies between them.
A candidate pair is verified by alignment of its two shingle sequences inside a band: of
the shared shingles that are no further apart than the similarity allows, the longest
chain rising in both texts counts, and chain / (all - chain) must reach `least`.

Classes are the connected components of the verified links. No step compares or emits all pairs of
a large group, and none is capped:
1. Equal texts are one node, so copies meet no alignment at all.
2. Buckets of up to `small` nodes give their pairs. In a larger one, all nodes are aligned with one leader L, the node
   that shares most buckets. If that leaves one component, the bucket is done.
3. Else two of its nodes, u and x, in different components, are candidates by what they differ in from L. D(x) is the
   set of shingles that just one of x and L holds; u and x differ in the very shingles in which D(u) and D(x) differ, so
   linked nodes share at least (|D(u)| + |D(x)| - (|u| + |x|) (1 - least) / (1 + least)) / 2 shingles of their D. With all D
   in one order, the rarest under L first, that many can only be shared if the first shared one comes early in both: a
   prefix and position filter, exact as the bound is. One of u and x isn't in the component of L, hence |D| of it is over what a
   link allows, and the bound is about half of the other's D. What many nodes add or lack comes last in the order, so
   texts that share a frequent passage, or are edited alike, meet only if they have more in common than that.
4. A node within the similarity of L by its set of shingles but not by their order has no such bound. It is aligned with
   all nodes that met L and whose size and |D| allow a link; `small` such nodes of each leader at a time.

Shingles of texts that share a bucket are written once; a leader's travel once for every `run` nodes, the nodes' own once a pair.

Defined results: null and empty texts are equal texts; a text of fewer than five words is
one shingle; rows with a null id are in no class (null) and stay; rows that share an id are classed each by its own
text (two classes can then bear one id), and those that repeat id and text are one row of `deduplicate`;
an empty table gives an empty result; extra columns are ignored by `classes`, returned by `deduplicate`.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, materialize, table
from .words import U, Words, chunks, mixed, runs

SHINGLE = 5
_NONE = U(0xFFFFFFFFFFFFFFFF)


def labelled(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles in order, labelled by occurrence so that they are unique in it, and each text's first."""
    shingles, begin = runs(w.hashes(), w.first, SHINGLE)
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    key = mixed(shingles + owner.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]) != 0) if len(key) else order
    nth = np.empty(len(key), np.int64)
    nth[order] = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
    return np.where(nth > 0, mixed(shingles + nth.astype(U) * U(0xD6E8FEB86659FD93)), shingles), begin


def order_minhash(labels: np.ndarray, begin: np.ndarray, sketches: int, length: int) -> np.ndarray:
    """texts x sketches; texts without shingles get zeros."""
    out = np.zeros((len(begin) - 1, sketches), U)
    full = np.flatnonzero(np.diff(begin))
    if not len(full):
        return out
    count = np.diff(begin)[full]
    start, owner = begin[:-1][full], np.repeat(np.arange(len(full)), count)
    for t in range(sketches):
        x = labels * mixed(np.array([2 * t + 1], U)) | U(1)
        x = x ^ (x >> U(31))
        places, values = np.full((length, len(full)), np.iinfo(np.int64).max), np.zeros((length, len(full)), U)
        for k in range(length):
            low = np.minimum.reduceat(x, start)
            hit = np.flatnonzero((x == low[owner]) & (x != _NONE))
            hit = hit[np.diff(owner[hit], prepend=-1) > 0]
            places[k, owner[hit]], values[k, owner[hit]] = hit, labels[hit]
            x[hit] = _NONE
        values = np.take_along_axis(values, np.argsort(places, axis=0, kind="stable"), axis=0)
        key = np.full(len(full), U(t + 1))
        for v in values:
            key = mixed(key + v)
        out[full, t] = key
    return out


def longest_rise(values: np.ndarray) -> int:
    if np.all(np.diff(values) > 0):
        return len(values)
    tails: list[int] = []
    for x in values.tolist():
        at = bisect_left(tails, x)
        tails[at : at + 1] = [x]
    return len(tails)


class Leader:
    """A sequence of shingles without repeats that others are aligned with."""

    def __init__(self, labels: np.ndarray):
        self.place = np.argsort(labels, kind="stable")
        self.labels = labels[self.place]

    def align(self, node: np.ndarray, least: float) -> tuple[bool, bool, np.ndarray]:
        """Whether the node is linked, whether it would be but for its order, and the shingles that just one of both holds."""
        n, m = len(self.labels), len(node)
        at = np.minimum(np.searchsorted(self.labels, node), max(n - 1, 0))
        hit = self.labels[at] == node if n else np.zeros(m, bool)
        here, at = np.flatnonzero(hit), at[hit]
        alone = np.ones(n, bool)
        alone[at] = False
        apart = np.concatenate([self.labels[alone], node[~hit]])
        if len(here) < least * (n + m - len(here)):
            return False, False, apart
        there = self.place[at]
        there = there[np.abs(here - there) <= (1 - least) / (1 + least) * (n + m)]
        chain = longest_rise(there) if len(there) >= least * (n + m - len(there)) else 0
        linked = chain >= least * (n + m - chain)
        return linked, not linked, apart


def sketch(docs: DataFrame, sketches: int, length: int, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, mark (of the text as it stands), digest of the words, number of shingles, keys; null ids left out."""

    def worker(batches):
        for batch in batches:
            digest, sizes, keys = [], [], []
            for _, _, w in chunks(batch.column(2)):
                labels, begin = labelled(w)
                keys.append(order_minhash(labels, begin, sketches, length))
                sizes.append(np.diff(begin))
            for text in batch.column(2):
                digest.append(hashlib.blake2b(b" ".join(text.as_buffer().to_pybytes().split()), digest_size=16).digest())
            flat = np.concatenate(keys).view(np.int64).ravel() if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(digest) + 1, dtype=np.int32) * sketches), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64()), lists], names=["doc_id", "mark", "digest", "size", "keys"])

    rows = marked(docs, id_col, text_col).select("doc_id", "mark", "text")
    return rows.mapInArrow(worker, "doc_id long, mark long, digest binary, size long, keys array<long>").withColumn("row", F.monotonically_increasing_id())


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text")).where("doc_id IS NOT NULL")
    return rows.withColumn("mark", F.xxhash64("text"))


def shingles(rows: DataFrame) -> DataFrame:
    """node, labels of rows (node, text)."""

    def worker(batches):
        for batch in batches:
            for low, high, w in chunks(batch.column(1)):
                labels, begin = labelled(w)
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(labels.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], names=["node", "labels"])

    return rows.select("node", "text").mapInArrow(worker, "node long, labels array<long>")


def align(pairs: DataFrame, labels: DataFrame, least: float, run: int) -> DataFrame:
    """Pairs (leader, node, onward) with linked, moved (linked but for the order), both sizes, and for those onward the shingles that just one of both holds.

    A leader's nodes are dealt to parts of about `run`; in each part its own shingles come first, and the nodes' follow one by one.
    """
    names = ["leader", "node", "onward", "linked", "moved", "leader_size", "size", "apart"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def worker(batches):
        leader = None
        for batch in batches:
            begin, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy().view(U)
            key, node, onward = (batch.column(k).to_pylist() for k in (0, 2, 3))
            out: list[tuple] = []
            for i in range(batch.num_rows):
                own = flat[begin[i] : begin[i + 1]]
                if node[i] is None:
                    leader = Leader(own)
                    continue
                linked, moved, apart = leader.align(own, least)
                out.append((key[i], node[i], onward[i], linked, moved, len(leader.labels), len(own), apart.view(np.int64) if onward[i] else None))
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    sizes = materialize(pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n")), "near-leaders")  # written: the join of a hot leader can be split
    dealt = pairs.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("node"), F.floor(F.col("n") / run) + 1).alias("part"), "node", "onward")
    heads = dealt.select("leader", "part").distinct().join(labels.withColumnRenamed("node", "leader"), "leader")
    rows = dealt.join(labels, "node").select("leader", "part", "node", "onward", "labels")
    rows = rows.unionByName(heads.select("leader", "part", F.lit(None).cast("long").alias("node"), F.lit(False).alias("onward"), "labels"))
    rows = rows.repartition("leader", "part").sortWithinPartitions("leader", "part", F.col("node").asc_nulls_first())
    # Rows that repeat id and text have their shingles twice; the same pair then comes out once more, and counts once.
    return rows.mapInArrow(worker, "leader long, node long, onward boolean, linked boolean, moved boolean, leader_size long, size long, apart array<long>")


def candidates(buckets: DataFrame, small: int) -> DataFrame:
    """Pairs (leader, node, onward) from rows (key, node, n), n the size of the key's bucket.

    A bucket of up to `small` nodes gives its pairs, small - 1 a node at most. A larger one gives
    a pair for each node, with the one that shares most buckets; these go onward.
    """
    lists = buckets.where(F.col("n") <= small).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("all"))
    each = lists.select(F.inline(F.flatten(F.transform("all", lambda x, i: F.transform(F.filter("all", lambda y, j: j > i), lambda y: F.struct(x.alias("leader"), y.alias("node")))))))
    rows = buckets.where(F.col("n") > small)
    weight = rows.groupBy("node").agg(F.sum("n").alias("w"))
    rows = rows.join(weight, "node")
    first = materialize(rows.groupBy("key").agg(F.max(F.struct("w", (-F.col("node")).alias("back"))).alias("top")), "near-tops")
    star = rows.join(first, "key").where("node <> -top.back").select((-F.col("top.back")).alias("leader"), "node")
    both = each.withColumn("onward", F.lit(False)).unionByName(star.withColumn("onward", F.lit(True)))
    return both.groupBy("leader", "node").agg(F.max("onward").alias("onward"))


def with_comp(rows: DataFrame, comps: DataFrame, node: str, name: str) -> DataFrame:
    """Adds the component of a node; a node without a link is its own."""
    of = comps.select(F.col("node").alias("__of"), F.col("comp").alias("__comp"))
    return rows.join(of, F.col(node) == F.col("__of"), "left").withColumn(name, F.coalesce("__comp", node)).drop("__of", "__comp")


def unsettled(aligned: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of `align` that met a large bucket's leader, with comp and out (of the leader's component), where that leader has a node out."""
    rows = with_comp(with_comp(aligned.where("onward"), comps, "node", "comp"), comps, "leader", "of_leader")
    rows = rows.withColumn("out", F.col("comp") != F.col("of_leader")).drop("of_leader")
    return rows.join(materialize(rows.where("out").select("leader").distinct(), "near-open"), "leader", "left_semi")


def by_difference(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (leader, node) in different components of rows of `unsettled` that what they differ in from the leader lets be linked."""
    part = (1 - least) / (1 + least)  # linked nodes differ in no more than this part of both sizes
    rows = rows.withColumn("count", F.size("apart")).withColumn("most", F.col("size") * ((1 - least) / least))
    least_shared = F.greatest((F.col("count") + (F.col("leader_size") - F.col("size")) * part) / 2, F.col("count") - F.col("most"), F.lit(0.0))
    rows = rows.withColumn("long", F.least(F.col("count").cast("double"), F.col("most") + 1)).withColumn("half", F.col("count") - least_shared + 1)
    each = rows.select("leader", "node", "comp", "out", "size", "count", "long", "half", F.explode("apart").alias("z"))
    often = each.groupBy("leader", "z").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").drop("low", "high")
    # Shingles of one component alone come first in the order; no pair depends on them.
    own = Window.partitionBy("leader", "node")
    kept = each.join(often, ["leader", "z"]).withColumn("place", F.row_number().over(own.orderBy("n", "z")) + F.col("count") - F.count(F.lit(1)).over(own))
    kept = kept.where((F.col("out") & (F.col("place") <= F.col("long"))) | (F.col("place") <= F.col("half"))).select("leader", "z", "node", "comp", "out", "size", "count", "place", (F.col("place") <= F.col("half")).alias("in_half"))
    a, b = kept.where("out").alias("a"), kept.alias("b")
    shared = (F.col("a.count") + F.col("b.count") - (F.col("a.size") + F.col("b.size")) * part) / 2
    rest = F.least(F.col("a.count") - F.col("a.place"), F.col("b.count") - F.col("b.place")) + 1
    meet = F.expr("a.leader = b.leader AND a.z = b.z AND a.comp <> b.comp AND b.in_half AND (NOT b.out OR (a.in_half AND a.node < b.node))")
    sizes = (F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * least - 1e-6) & (rest >= shared - 1e-6)
    return a.join(b, meet & sizes).select(F.col("a.node").alias("leader"), F.col("b.node").alias("node")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) for all nodes with a link: smallest labels spread and jump until none changes."""
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "near-labels")
    while True:
        around = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("other"))
        step = labels.join(around, F.col("node") == F.col("a")).select("node", F.col("comp").alias("old"), F.least("comp", "other").alias("via"))
        jump = step.join(labels.select(F.col("node").alias("via"), F.col("comp").alias("far")), "via").select("node", "old", F.least("via", "far").alias("comp"))
        new = materialize(jump, "near-labels")
        labels = new.select("node", "comp")
        if new.where("comp <> old").isEmpty():
            return labels


def classed(docs: DataFrame, least: float, sketches: int, length: int, small: int, run: int, id_col: str, text_col: str) -> DataFrame:
    """One row per input row with an id: doc_id, mark, class_id, class_size, kept."""
    found = materialize(sketch(docs, sketches, length, id_col, text_col), "near-sketches")
    # Written, so that both sides of the join have plain exchanges and adaptive execution splits a digest or class with very many rows.
    copies = materialize(found.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "near-copies")
    member = materialize(found.join(copies, "digest").select("row", "doc_id", "mark", "node", "first_id", "n", "size", "keys"), "near-members")
    nodes = member.where("row = node")
    rows = nodes.where("size > 0").select("node", F.explode("keys").alias("key"))  # a key holds its order's number
    shared = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-shared")
    buckets = materialize(rows.join(shared, "key").select("key", "node", "n"), "near-buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("w_id"), F.col("mark").alias("w_mark"))
    texts = marked(docs, id_col, text_col)
    labels = materialize(shingles(texts.join(wanted, (F.col("doc_id") == F.col("w_id")) & (F.col("mark") == F.col("w_mark")))), "near-shingles")

    links = lambda rows: rows.where("linked").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    first = materialize(align(materialize(candidates(buckets, small), "near-pairs"), labels, least, run), "near-aligned")
    comps = components(links(first))
    rows = materialize(unsettled(first, comps), "near-unsettled")
    closer = materialize(by_difference(rows, least).withColumn("onward", F.lit(False)), "near-pairs")
    all_links = links(first).unionByName(links(materialize(align(closer, labels, least, run), "near-aligned")))
    moved = rows.where("moved AND out").select("leader", "node", "comp", "size", F.size("apart").alias("count")).distinct()
    moved = materialize(moved.withColumn("turn", F.floor((F.row_number().over(Window.partitionBy("leader").orderBy("node")) - 1) / small)), "near-moved")
    # What two nodes differ in from L is apart by what they differ in at most, and linked nodes' sizes are within the similarity.
    within = (F.least("size", "s") >= F.greatest("size", "s") * least - 1e-6) & (F.abs(F.col("d") - F.col("count")) <= (F.col("size") + F.col("s")) * ((1 - least) / (1 + least)) + 1e-6)
    for turn in range((moved.agg(F.max("turn")).first()[0] or 0) + 1 if not moved.isEmpty() else 0):
        to = rows.select(F.col("leader").alias("l"), F.col("node").alias("n"), F.col("comp").alias("c"), F.col("size").alias("s"), F.size("apart").alias("d"))
        pairs = moved.where(F.col("turn") == turn).join(to, F.expr("leader = l AND comp <> c") & within).select(F.col("node").alias("leader"), F.col("n").alias("node"), F.lit(False).alias("onward")).distinct()
        all_links = all_links.unionByName(links(materialize(align(materialize(pairs, "near-pairs"), labels, least, run), "near-aligned")))
    comps = components(all_links)

    of = with_comp(nodes.select("node", "first_id", "n"), comps, "node", "comp")
    per = materialize(of.groupBy("comp").agg(F.min(F.struct("first_id", "node")).alias("top"), F.sum("n").alias("class_size")), "near-classes")
    per = of.select(F.col("node").alias("of"), "comp").join(per, "comp").select("of", F.col("top.first_id").alias("class_id"), F.col("top.node").alias("first_node"), "class_size")
    return member.join(per, F.col("node") == F.col("of")).select("doc_id", "mark", "class_id", "class_size", ((F.col("doc_id") == F.col("class_id")) & (F.col("node") == F.col("first_node"))).alias("kept"))


def classes(docs: DataFrame, least: float = 0.8, sketches: int = 16, length: int = 3, small: int = 8, run: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id of its class), class_size (rows), kept."""
    found = classed(docs, least, sketches, length, small, run, id_col, text_col).drop("mark")
    none = docs.where(F.col(id_col).cast("long").isNull())
    return found.unionByName(none.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("class_size"), F.lit(True).alias("kept")))


def deduplicate(docs: DataFrame, least: float = 0.8, sketches: int = 16, length: int = 3, small: int = 8, run: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document of each class, and rows with a null id, with all columns."""
    kept = classed(docs, least, sketches, length, small, run, id_col, text_col).where("kept").select(F.col("doc_id").alias("__q_kept"), F.col("mark").alias("__q_kept_mark")).distinct()
    rows = docs.withColumn("__q_id", F.col(id_col).cast("long")).withColumn("__q_mark", F.xxhash64(body(text_col)))
    stay = rows.join(kept, (F.col("__q_id") == F.col("__q_kept")) & (F.col("__q_mark") == F.col("__q_kept_mark")))
    # The join has brought the rows of one id and text together already.
    stay = stay.withColumn("__q_row", F.row_number().over(Window.partitionBy("__q_id", "__q_mark").orderBy(F.lit(1)))).where("__q_row = 1")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return stay.select(*columns).unionByName(docs.where(F.col(id_col).cast("long").isNull()))


def op4_near_dedup(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"))
