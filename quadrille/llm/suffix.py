"""Repeated passages by a sparse suffix array.

Texts are sequences of words. Of any `window` consecutive word positions, the one whose
`gram` words hash smallest is retained (a minimiser, chosen by content alone), so any two
occurrences of a passage retain the same positions inside it: each stretch of `least` words has chosen one among its
first `window`, with `reach` = `least` - `window` + 1 words ahead. Suffixes whose first `reach` words occur once are dropped. The others are sorted by content and
compared with their neighbours, in two orders:
1. by the stretch of words that takes in every stretch of `least` words that chose the suffix (`window` more on both
   sides). A suffix with an equal neighbour before it is settled, as all of its stretches occur there.
2. those without one, the first of their stretches or next to an edit or a passage's end, by each stretch of `least`
   words that chose them.
So every stretch of `least` words that occurs earlier has a neighbour that holds it. Neighbours are
compared on the texts themselves and extended, word by word, as far left and right as the texts agree; fingerprints only
propose.

The sort is Spark's, inside windows of one fingerprint. Each fingerprint is salted by
document first, and the heads of the salts are then compared among themselves, so that a
passage of a third of all documents is sorted in `salts` parts. A suffix has one
neighbour in each order, so the pairs grow in proportion to the text.

`repeats` gives, for every document, the stretches of at least `least` words that an
earlier document, or an earlier place of the same one, holds too; the first occurrence has none. Words are runs
without ASCII white space and compared byte for byte. A stretch's `of` is a document before it, or itself, that holds `least` words of it: the smallest id
of the neighbours it was compared with. Where more than two documents hold a passage, which of them that is depends on `salts`; the stretches don't.

Defined results: null and empty texts and texts under `least` words have no repeats; rows with a null id
are left out; rows that repeat id and text are one document, and rows that share an id with
other texts are documents of their own, in the order of their texts' hashes; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, materialize, table
from .words import Rolling, U, chunks, mixed, points, split

_STEP = U(0xA24BAED4963EE407)
_DOC = ["doc_id", "mark"]


def chosen(rank: np.ndarray, window: int) -> np.ndarray:
    """For each `window` consecutive positions, the one of least rank."""
    low = np.lib.stride_tricks.sliding_window_view(rank, window)
    return np.arange(len(low)) + np.argmin(low, axis=1)


def retained(hashes: np.ndarray, first: np.ndarray, least: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the retained suffixes with `reach` words ahead, their texts, and both fingerprints."""
    reach = least - window + 1
    n = len(hashes)
    if n < max(reach, window):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, U), np.zeros(0, U)
    roll = Rolling(hashes, _STEP)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = first[doc + 1]
    at = np.arange(n)
    spot = np.unique(chosen(roll.of(at, np.minimum(at + gram, last)), window))  # windows across texts only retain some positions more
    spot = spot[spot + reach <= last[spot]]
    wide_from, wide_to = np.maximum(spot - window, first[doc[spot]]), np.minimum(spot + reach + window, last[spot])
    return spot, doc[spot], roll.of(spot, spot + reach), mixed(roll.of(wide_from, wide_to) + (spot - wide_from).astype(U))


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text")).where("doc_id IS NOT NULL")
    return rows.select("doc_id", F.xxhash64("text").alias("mark"), "text")


def suffixes(texts: DataFrame, least: int, window: int, gram: int) -> DataFrame:
    """doc_id, mark, pos, head, wide of the retained suffixes."""

    def worker(batches):
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for low, _, w in chunks(batch.column(2)):
                spot, doc, head, wide = retained(w.hashes(), w.first, least, window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(ids[low + doc]), pa.array(marks[low + doc]), pa.array((spot - w.first[doc]).astype(np.int32)), pa.array(head.view(np.int64)), pa.array(wide.view(np.int64))], names=[*_DOC, "pos", "head", "wide"])

    return texts.mapInArrow(worker, "doc_id long, mark long, pos int, head long, wide long")


def stretches(rows: DataFrame, least: int, window: int, gram: int) -> DataFrame:
    """doc_id, mark, pos, key: each stretch of `least` words of rows (doc_id, mark, at, text) that chose one of the positions in `at`."""

    def worker(batches):
        for batch in batches:
            out = []
            for low, high, w in chunks(batch.column(3)):
                hashes = w.hashes()
                for i in range(low, high):
                    own = hashes[w.first[i - low] : w.first[i - low + 1]]
                    n = len(own) - least + 1
                    if n < 1:
                        continue
                    roll, begin = Rolling(own, _STEP), np.arange(len(own))
                    pick = chosen(roll.of(begin, np.minimum(begin + gram, len(own))), window)[:n]
                    start = np.flatnonzero(np.isin(pick, batch.column(2)[i].values.to_numpy()))
                    out.append((i, start, roll.of(start, start + least).view(np.int64)))
            which = np.concatenate([np.full(len(x), i) for i, x, _ in out]) if out else np.zeros(0, int)
            columns = [batch.column(k).take(pa.array(which)) for k in (0, 1)]
            joined = lambda k, kind: pa.array(np.concatenate([x[k] for x in out]) if out else np.zeros(0), kind)
            yield pa.RecordBatch.from_arrays([*columns, joined(1, pa.int64()).cast(pa.int32()), joined(2, pa.int64())], names=[*_DOC, "pos", "key"])

    return rows.select(*_DOC, "at", "text").mapInArrow(worker, "doc_id long, mark long, pos int, key long")


def neighbours(found: DataFrame, key: str, salts: int) -> DataFrame:
    """doc_id, mark, pos, of, of_mark, at: each place with the one before it in sorted order among those of the same key; of is null where there is none."""
    names = {"of": "doc_id", "of_mark": "mark", "at": "pos"}
    before = lambda w: [F.lag(c).over(w).alias(k) for k, c in names.items()]
    order = [F.col("doc_id"), F.col("mark"), F.col("pos")]
    salted = found.select(*_DOC, "pos", F.col(key).alias("key")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    near = salted.select("*", *before(Window.partitionBy("key", "salt").orderBy(*order))).where("NOT (of <=> doc_id AND of_mark <=> mark AND at <=> pos)")  # a row read twice is no repeat
    inside = near.where("of IS NOT NULL").select(*_DOC, "pos", *names)
    heads = near.where("of IS NULL").select(*_DOC, "pos", "key")
    return inside.unionByName(heads.select(*_DOC, "pos", *before(Window.partitionBy("key").orderBy(*order))))


def extend(a: list[bytes], b: list[bytes], anchors: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Stretches of b, from and to in words, that equal stretches of a through one of the anchors (position in b, in a)."""
    out, done = [], {}
    for j, i in sorted(anchors):
        if done.get(j - i, -1) > j:  # already inside a stretch on this diagonal
            continue
        low, high = 0, 0
        while j + high < len(b) and i + high < len(a) and a[i + high] == b[j + high]:
            high += 1
        while low < min(i, j) and a[i - low - 1] == b[j - low - 1]:
            low += 1
        done[j - i] = j + high
        if low + high >= least:
            out.append((j - low, j + high))
    return out


def repeats(docs: DataFrame, least: int = 50, window: int = 24, gram: int = 8, salts: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document with a repeat: doc_id, n_words, repeated_words, first_of (smallest `of`), and spans: words f to t, code points start to end, of."""
    all_texts = marked(docs, id_col, text_col)
    found = suffixes(all_texts, least, window, gram)
    # Written, so that the join has a plain exchange on both sides and adaptive execution splits a hot head.
    often = materialize(found.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("head"), "suffix-heads")
    met = materialize(found.join(often, "head").select(*_DOC, "pos", "wide"), "suffix-met")
    held = met.select(F.col("doc_id").alias("w_id"), F.col("mark").alias("w_mark")).distinct()
    texts = materialize(all_texts.join(held, F.expr("doc_id = w_id AND mark = w_mark"), "left_semi"), "suffix-texts")
    wide = materialize(neighbours(met, "wide", salts), "suffix-wide")
    open_ = wide.where("of IS NULL").groupBy(*_DOC).agg(F.collect_set("pos").alias("at"))  # bounded by the document's own length
    exact = neighbours(stretches(open_.join(texts, _DOC), least, window, gram), "key", salts).where("of IS NOT NULL")
    pairs = wide.where("of IS NOT NULL").unionByName(exact)
    links = pairs.groupBy(*_DOC, "of", "of_mark").agg(F.collect_set(F.struct("pos", "at")).alias("anchors"))  # bounded by the document's own length
    # Both sides rename the same columns, so Spark shuffles the texts once and uses that exchange twice. Rows that repeat id and text give the same stretches again, which merge.
    side = lambda k: texts.select(F.col("doc_id").alias(f"id_{k}"), F.col("mark").alias(f"mark_{k}"), F.col("text").alias(f"text_{k}"))
    both = links.join(side("a"), F.expr("of = id_a AND of_mark = mark_a")).join(side("b"), F.expr("doc_id = id_b AND mark = mark_b"))
    one = pa.struct([("f", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("of", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(one))])

    def worker(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                doc, mark, of = (batch.column(k)[i].as_py() for k in range(3))
                text = batch.column(5)[i].as_buffer().to_pybytes()
                b = text.split()
                a = batch.column(4)[i].as_buffer().to_pybytes().split()
                if spans := extend(a, b, [(x["pos"], x["at"]) for x in batch.column(3)[i].as_py()], least):
                    data = np.frombuffer(text, np.uint8)
                    w, before = split(data, np.array([0, len(data)])), points(data)
                    rows.append({"doc_id": doc, "mark": mark, "of": of, "n_words": len(b), "spans": [{"f": x, "t": y, "start": int(before[w.start[x]]), "end": int(before[w.end[y - 1]])} for x, y in spans]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    found = both.select("doc_id", "mark", "of", "anchors", "text_a", "text_b").mapInArrow(worker, "doc_id long, mark long, of long, n_words long, spans array<struct<f:long,t:long,start:long,end:long>>")
    return merged(found)


def merged(found: DataFrame) -> DataFrame:
    """Stretches of one document joined where they overlap."""
    one = found.select("doc_id", "mark", "of", "n_words", F.inline("spans"))
    run = Window.partitionBy(*_DOC).orderBy("f", "t")
    before = F.max("t").over(run.rowsBetween(Window.unboundedPreceding, -1))
    part = one.withColumn("new", F.when(before >= F.col("f"), 0).otherwise(1)).withColumn("part", F.sum("new").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    spans = part.groupBy(*_DOC, "part").agg(F.max("n_words").alias("n_words"), F.min("f").alias("f"), F.max("t").alias("t"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("of").alias("of"))
    per = spans.groupBy(*_DOC).agg(F.max("n_words").alias("n_words"), F.sum(F.col("t") - F.col("f")).alias("repeated_words"), F.min("of").alias("first_of"), F.sort_array(F.collect_list(F.struct("f", "t", "start", "end", "of"))).alias("spans"))
    return per.drop("mark")


def op3_suffix_dedup(spark, sf_dir):
    found = repeats(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"], x["of"])), ",")
    return found.select("doc_id", "n_words", "repeated_words", "first_of", text.alias("spans"))
