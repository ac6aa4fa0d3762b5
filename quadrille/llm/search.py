"""Ranked lexical search by two trees.

Items are a stated set of queries, searched block by block; documents are read whole. A term is a run of ASCII letters and
digits and of characters beyond ASCII, with A to Z in lower case. A document scores sum(w * s) over the terms of an item,
repeats included, where w falls with the number of documents that hold the term and s = 10**9 tf div (1000 tf + 8 m) grows
with tf and falls with the document's length m; all in whole numbers.

1. `index`: one pass over the texts gives each document's length and its terms out of the items' vocabulary. That table is
   what the search reads; N, L and document frequencies are sums over it, so weights need no second look at the texts.
2. In every task, a batch of documents, ordered by their weightiest term so that like ones are neighbours, becomes a tree: a
   node holds each term's largest s among its documents. The items form a tree likewise, a node holding each
   term's largest w times repeats among its items. The product of two nodes bounds every score between their items
   and documents. From both roots down, a pair of nodes is dropped if its bound is under the weakest k-th score known
   of the node's items, and with it the whole batch; equality is not dropped, as ties go to the smaller id. Pairs of leaves are
   scored exactly.
3. Each task gives its k best of each item; the best of those are found within salts, then over them.

The first known k-th scores come from a search among a small part of the documents, chosen by hash. It only saves work: a k-th
score among some documents is a lower bound of that among all, and every document, these too, is then searched. Bounds are sums of
64-bit floats, raised by one part in 10**9 for rounding, so pruning never drops a document that belongs in.

Bounded memory: a block holds about `block_bytes` of items, so its vocabulary is bounded, and a batch has as many documents
as keep documents times vocabulary under `cells`. Nothing is collected but a block's vocabulary, weights and items.

Terms are matched by two 64-bit hashes of their bytes.

Defined results: null and empty texts have no term; null ids come before others among equal scores; repeated documents are ranked
each, repeated items answered each; without items, documents or shared terms the result is empty; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, materialize, table
from .words import IS_LETTER, LOWER, Rolling, U, chunks

TERM = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
CAPITALS = bytes(LOWER.tolist())
SECOND = U(0xB492B66FBE98F273)  # base of the second hash
K1000, B, UNIT = 8, 75, 1_000_000_000
ITEM_FAN = 4  # items to a node, and nodes to the next


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text, in order."""
    return TERM.findall((text or "").encode().translate(CAPITALS))


@dataclass(frozen=True)
class Items:
    """A block of items: their ids, and their terms as places in the vocabulary with how often they occur."""

    ids: list[int | None]
    vocabulary: list[bytes]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple[int | None, str | None]]) -> Items:
        counted = [Counter(terms_of(text)) for _, text in rows]
        vocabulary = sorted(set().union(*counted)) if counted else []
        at = {t: i for i, t in enumerate(vocabulary)}
        held = [sorted((at[t], n) for t, n in c.items()) for c in counted]
        return Items([i for i, _ in rows], vocabulary, [np.array([t for t, _ in h], dtype=np.int64) for h in held], [np.array([n for _, n in h], dtype=np.int64) for h in held])


def twice_hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    return rolling.of(start, end), Rolling(data.astype(U) + U(1), SECOND).of(start, end)


def index(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in the vocabulary), tf (occurrences) of every row with a term."""
    flat = np.frombuffer(b"".join(vocabulary), dtype=np.uint8)
    ends = np.cumsum([0, *map(len, vocabulary)])
    one, two = twice_hashed(flat, ends[:-1], ends[1:], Rolling(flat.astype(U) + U(1)))
    order = np.argsort(one)
    one, two = one[order], two[order]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, words in chunks(batch.column(1), inside=IS_LETTER, fold=LOWER):
                n = np.diff(words.first)
                a, b = twice_hashed(words.data, words.start, words.end, words.rolling)
                where = np.minimum(np.searchsorted(one, a), max(len(one) - 1, 0))
                hit = np.flatnonzero((one[where] == a) & (two[where] == b)) if len(one) else np.zeros(0, dtype=np.int64)
                size = max(len(vocabulary), 1)
                keys, tf = np.unique(words.docs()[hit] * size + order[where[hit]], return_counts=True)
                begin = np.searchsorted(keys, np.arange(high - low + 1) * size)
                some = np.flatnonzero(n)
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(x, kind))
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(n, pa.int64()), lists(keys % size, pa.int32()), lists(tf, pa.int64())], ["doc_id", "n", "terms", "tf"])
                yield out.take(pa.array(some, pa.int64()))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    return rows.mapInArrow(read, "doc_id long, n long, terms array<int>, tf array<long>")


@dataclass(frozen=True)
class Weighted:
    """What a task needs to search: items with weights, in the order of the tree, and the corpus's N and L."""

    terms: list[np.ndarray]
    values: list[np.ndarray]  # w times repeats
    weights: np.ndarray  # w by term
    documents: int
    length: int
    least: np.ndarray  # a lower bound of each item's k-th score

    def scores(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """s of occurrences tf in documents of n terms."""
        m = 100 - B + (B * n * self.documents) // self.length
        return (UNIT * tf) // (1000 * tf + K1000 * m)


def item_tree(terms: list[np.ndarray], values: list[np.ndarray]) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Levels from single items up to one root: (items, terms, largest value of each term) of every node."""
    level = [(np.array([i]), t, v.astype(np.float64)) for i, (t, v) in enumerate(zip(terms, values, strict=True))]
    out = [level]
    while len(level) > 1:
        up = []
        for low in range(0, len(level), ITEM_FAN):
            part = level[low : low + ITEM_FAN]
            held, back = np.unique(np.concatenate([t for _, t, _ in part]), return_inverse=True)
            most = np.zeros(len(held))
            np.maximum.at(most, back, np.concatenate([v for *_, v in part]))
            up.append((np.concatenate([i for i, *_ in part]), held, most))
        level = up
        out.append(level)
    return out


def like_neighbours(terms: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """An order of items in which those that share their weightiest terms are neighbours."""
    heads = [tuple(t[np.argsort(-v, kind="stable")[:3]]) for t, v in zip(terms, values, strict=True)]
    return np.array(sorted(range(len(heads)), key=lambda i: heads[i]), dtype=np.int64)


class Search:
    """The search of one task: the k best documents of each item so far, fed with batches of documents."""

    def __init__(self, to: Weighted, k: int, leaf: int = 16, fan: int = 8):
        self.to, self.k, self.leaf, self.fan = to, k, leaf, fan
        self.tree = item_tree(to.terms, to.values)
        self.least = to.least.copy()
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in to.terms]  # score, whether the id is known, id
        self.pairs = 0  # exact scores made

    def add(self, ids: np.ndarray, known: np.ndarray, n: np.ndarray, begin: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        """A batch: ids, whether each is known, lengths, and terms with their occurrences, those of document i from begin[i] on."""
        owner = np.repeat(np.arange(len(ids)), np.diff(begin))
        s = self.to.scores(n[owner], tf)
        width = len(self.to.weights)
        value = s * self.to.weights[terms]
        last = np.lexsort((value, owner))[begin[1:] - 1]  # each document's weightiest term
        order = np.lexsort((-value[last], terms[last]))
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        dense = np.zeros((len(ids), width), dtype=np.int32)  # s is under 10**6
        dense[place[owner], terms] = s
        ids, known = ids[order], known[order]

        # levels[0] are leaves of `leaf` documents; the last level is one root.
        levels, size = [], self.leaf
        rows = dense
        while True:
            cuts = np.arange(0, len(rows), size)
            rows = np.maximum.reduceat(rows, cuts, axis=0)
            levels.append(rows)
            size = self.fan
            if len(rows) == 1:
                break
        self._descend(len(self.tree) - 1, 0, len(levels) - 1, np.array([0]), levels, dense, ids, known)

    def _descend(self, depth: int, node: int, height: int, open_: np.ndarray, levels: list[np.ndarray], dense: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Item node `node` of level `depth` against the document nodes `open_` of level `height`: those that may hold more go on, both sides down in turn."""
        items, terms, values = self.tree[depth][node]
        bound = (levels[height][np.ix_(open_, terms)] @ values) * (1 + 1e-9)
        open_ = open_[(bound >= self.least[items].min()) & (bound > 0)]
        if not len(open_):
            return
        if depth == height == 0:
            self._score(int(items[0]), open_, dense, ids, known)
        elif height and height >= depth:
            below = (open_[:, None] * self.fan + np.arange(self.fan)).ravel()
            self._descend(depth, node, height - 1, below[below < len(levels[height - 1])], levels, dense, ids, known)
        else:
            for child in range(node * ITEM_FAN, min((node + 1) * ITEM_FAN, len(self.tree[depth - 1]))):
                self._descend(depth - 1, child, height, open_, levels, dense, ids, known)

    def _score(self, item: int, leaves: np.ndarray, dense: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Exact scores of an item with all documents of some leaves."""
        at = (leaves[:, None] * self.leaf + np.arange(self.leaf)).ravel()
        at = at[at < len(ids)]
        scores = dense[at][:, self.to.terms[item]].astype(np.int64) @ self.to.values[item]
        self.pairs += len(at)
        good = np.flatnonzero((scores >= max(self.least[item], 1)))
        if len(good):
            found = [*self.best[item], *zip(scores[good].tolist(), known[at[good]].tolist(), ids[at[good]].tolist(), strict=True)]
            found.sort(key=lambda x: (-x[0], x[1], x[2]))
            self.best[item] = found[: self.k]
            if len(self.best[item]) == self.k:
                self.least[item] = max(self.least[item], self.best[item][-1][0])


def best_of(indexed: DataFrame, to: Weighted, k: int, cells: int) -> DataFrame:
    """item (its place), doc_id, score: each task's k best."""
    most = max(16, min(4096, cells // max(len(to.weights), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(to, k)
        for whole in batches:
            for low in range(0, whole.num_rows, most):
                batch = whole.slice(low, most)
                ids = batch.column(0)
                lists = batch.column(2)
                begin = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                search.add(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), begin, lists.flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy())
        rows = [(i, d if known else None, s) for i, best in enumerate(search.best) for s, known, d in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    found = indexed.mapInArrow(run, "item int, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_first()]
    salted = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(16))).orderBy(*order)
    some = found.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def blocks(items: DataFrame, block_bytes: int, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of about block_bytes, by hash."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), body(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = size // block_bytes + 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    for b in range(count):
        found = [(r["item_id"], r["text"]) for r in rows.where(F.col("block") == b).collect()]
        if found:
            yield sorted(found, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 1 << 20, cells: int = 1 << 23, first: int = 64, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0. One document in `first` gives the first k-th scores."""
    out = None
    for rows in blocks(items, block_bytes, item_id, item_text):
        found = search_block(docs, Items.of(rows), k, cells, first, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def search_block(docs: DataFrame, items: Items, k: int, cells: int, first: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    indexed = materialize(index(docs, items.vocabulary, id_col, text_col), "search-index")
    documents, length = indexed.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(items.vocabulary), dtype=np.int64)
    for r in indexed.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[r["term"]] = r["count"]
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    values = [weights[t] * n for t, n in zip(items.terms, items.repeats, strict=True)]
    order = like_neighbours(items.terms, values)
    of = lambda least: Weighted([items.terms[i] for i in order], [values[i] for i in order], weights, documents, length or 1, least)
    least = np.zeros(len(order), dtype=np.int64)
    matching = indexed.where(F.size("terms") > 0)
    early = best_of(matching.where(F.pmod(F.xxhash64("doc_id"), F.lit(first)) == 0), of(least), k, cells)
    for r in early.where(F.col("rank") == k).select("item", "score").collect():  # one number for each item of the block
        least[r["item"]] = r["score"]
    found = best_of(matching, of(least), k, cells)
    names = spark.createDataFrame([(i, items.ids[j]) for i, j in enumerate(order.tolist())], "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM benchmark),
n AS (SELECT r, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM n),
a AS (SELECT q, item_id, term, count(*)::BIGINT AS asked FROM (SELECT q, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
f AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM a) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY term), c),
s AS (SELECT q, item_id, r, doc_id, sum(asked * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score
  FROM f JOIN w USING (term) JOIN n USING (r) JOIN a USING (term), c GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
