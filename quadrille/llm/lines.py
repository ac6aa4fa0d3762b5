"""Line dedup by winnowing.

A document is the sequence of its lines that hold a word. Of every `window` consecutive runs
of `gram` lines, the one with the smallest hash is a fingerprint (the last of equal ones), so each run of
`least` = `window` + `gram` - 1 lines holds one, chosen by its content alone; about 2 / (`window` + 1) of the lines are.
A line of `alone` words or more is a fingerprint and a run by itself.

Only fingerprints are shuffled and counted. Those that occur more than once stand for the runs that chose them:
these are joined with the place where the same run occurs first, in the order of ids and lines, the match is
extended line by line both ways on digests of the lines, and every line of the later run is deleted. So a line
goes if and only if it lies in a run of `least` lines that occurs earlier, or has `alone` words and occurs earlier;
a repeated line that is shorter, in other company, stays.

First places come from a minimum that is combined before the shuffle, and the joins back are
such that adaptive execution splits where a run or a first place is hot.

Lines are compared by 128-bit BLAKE2b digests of their bytes.

Defined results: null and empty texts have no lines and lose none; lines without a word stay; rows
with a null id lose nothing; rows that share an id with other texts are documents of their own, in the order of
their texts' hashes, and rows that repeat id and text are one; an empty table
gives an empty result; extra columns are ignored by `repeated`, returned by `delete`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, materialize, table
from .words import IS_WORD, Rolling, U, chunks, mixed

_STEPS = (U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))
_NOT_BREAK = np.ones(256, dtype=bool)
_NOT_BREAK[0x0A] = False
_RUN = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("key", pa.int64()), ("key2", pa.int64())])
_PICK = pa.struct([("gram", pa.int64()), ("runs", pa.list_(_RUN))])


def fingerprints(hashes: np.ndarray, gram: int, window: int) -> np.ndarray:
    """For each run of window + gram - 1 lines of one document, the start of the run of `gram` lines it selects: the last of equal minima."""
    n = len(hashes) - gram + 1
    if n < window:
        return np.zeros(0, int)
    at = np.arange(n)
    view = np.lib.stride_tricks.sliding_window_view(Rolling(hashes, _STEPS[0]).of(at, at + gram), window)
    return np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1)


def picks(hashes: np.ndarray, words: np.ndarray, gram: int, window: int, alone: int) -> list[dict]:
    """A document's fingerprints, each with the runs that it stands for."""
    least = gram + window - 1
    one, two = (Rolling(h, s) for h, s in zip((hashes, mixed(hashes)), _STEPS, strict=True))
    chosen, single = fingerprints(hashes, gram, window), np.flatnonzero(words >= alone)
    begin = np.concatenate([np.arange(len(chosen)), single])
    end = begin + np.repeat([least, 1], [len(chosen), len(single)])
    at, size = np.concatenate([chosen, single]), np.repeat([gram, 1], [len(chosen), len(single)])
    grams, keys, keys2 = one.of(at, at + size).view(np.int64).tolist(), one.of(begin, end).view(np.int64).tolist(), two.of(begin, end).view(np.int64).tolist()
    out: dict[tuple, dict] = {}
    for i, (a, n, s, e) in enumerate(zip(at.tolist(), size.tolist(), begin.tolist(), end.tolist(), strict=True)):
        out.setdefault((a, n), {"gram": grams[i], "runs": []})["runs"].append({"start": s, "size": e - s, "key": keys[i], "key2": keys2[i]})
    return list(out.values())


def line_table(docs: DataFrame, gram: int, window: int, alone: int, id_col: str, text_col: str) -> DataFrame:
    """Per row with an id: doc_id, mark (of its text), n_lines, lines (digests of those with a word, end to end), places (their numbers), picks."""

    def worker(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_lines", "lines", "places", "picks")}
            for _, _, w in chunks(batch.column(2), inside=_NOT_BREAK):
                is_in = IS_WORD[w.data]
                opens = is_in.copy()
                opens[1:] &= ~is_in[:-1]
                words = np.concatenate([[0], np.cumsum(opens)])
                # A line's first byte opens a word whatever the byte before it, which is a break or another text's.
                per_line = words[w.end] - words[w.start] + (is_in[w.start] & ~opens[w.start]) if len(w.start) else np.zeros(0, int)
                breaks = np.concatenate([[0], np.cumsum(w.data == 0x0A)])
                data = w.data.tobytes()
                for i in range(len(w.offsets) - 1):
                    own = np.arange(w.first[i], w.first[i + 1])
                    own = own[per_line[own] > 0]
                    lines = b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(w.start[own].tolist(), w.end[own].tolist(), strict=True)])
                    out["n_lines"].append(int(breaks[w.offsets[i + 1]] - breaks[w.offsets[i]] + 1))
                    out["lines"].append(lines)
                    out["places"].append((breaks[w.start[own]] - breaks[w.offsets[i]]).astype(np.int32))
                    out["picks"].append(picks(np.frombuffer(lines, U)[::2], per_line[own], gram, window, alone))
            kinds = {"n_lines": pa.int64(), "lines": pa.binary(), "places": pa.list_(pa.int32()), "picks": pa.list_(_PICK)}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(out[k], kinds[k]) for k in kinds]], names=["doc_id", "mark", *kinds])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text")).where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(worker, "doc_id long, mark long, n_lines long, lines binary, places array<int>, picks array<struct<gram:long,runs:array<struct<start:int,size:int,key:long,key2:long>>>>")


def stretch(a: np.ndarray, b: np.ndarray, anchors: list[dict], least: int) -> np.ndarray:
    """Which lines of b lie in a stretch that equals one of a through one of the anchors (start in b, at in a, size)."""
    out = np.zeros(len(b), bool)
    for x in anchors:
        j, k, size = x["start"], x["at"], x["size"]
        if k + size > len(a) or j + size > len(b) or not np.array_equal(a[k : k + size], b[j : j + size]):
            continue
        low, high = 0, size
        while low < min(j, k) and a[k - low - 1] == b[j - low - 1]:
            low += 1
        while j + high < len(b) and k + high < len(a) and a[k + high] == b[j + high]:
            high += 1
        if low + high < least:  # a long line alone
            low, high = 0, size
        out[j - low : j + high] = True
    return out


def repeated(docs: DataFrame, gram: int = 1, window: int = 3, alone: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with an id: doc_id, mark, n_lines, removed (numbers of its deleted lines, from 0, in order)."""
    least = gram + window - 1
    lines = materialize(line_table(docs, gram, window, alone, id_col, text_col), "line-table")
    found = lines.select("doc_id", "mark", F.inline("picks"))
    # Written, so that the join has a plain exchange on both sides and adaptive execution splits a hot line.
    often = materialize(lines.select(F.explode("picks.gram").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "line-grams")
    spots = materialize(found.join(often, "gram").select("doc_id", "mark", F.inline("runs")), "line-spots")
    first = materialize(spots.groupBy("key", "key2").agg(F.min(F.struct("doc_id", "mark", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "line-firsts")
    later = spots.join(first, ["key", "key2"]).where("NOT (doc_id = first.doc_id AND mark = first.mark AND start = first.start)")
    later = later.select("doc_id", "mark", "start", "size", F.col("first.doc_id").alias("of"), F.col("first.mark").alias("of_mark"), F.col("first.start").alias("at"))
    links = later.groupBy("doc_id", "mark", "of", "of_mark").agg(F.collect_set(F.struct("start", "at", "size")).alias("anchors"))  # bounded by the document's lines
    # Written too: every document with a hot line asks for the same holder's lines, and a plain exchange can be split there.
    one = materialize(lines.select("doc_id", "mark", "lines", "places").dropDuplicates(["doc_id", "mark"]), "line-documents")
    both = links.join(one.select(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark"), F.col("lines").alias("a")), ["of", "of_mark"])
    both = both.join(one.select("doc_id", "mark", F.col("lines").alias("b"), "places"), ["doc_id", "mark"])

    def worker(batches):
        for batch in batches:
            gone = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(k)[i].as_buffer(), "V16") for k in (3, 4))
                gone.append(batch.column(5)[i].values.to_numpy()[stretch(a, b, batch.column(2)[i].as_py(), least)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "mark", "gone"])

    gone = both.select("doc_id", "mark", "anchors", "a", "b", "places").mapInArrow(worker, "doc_id long, mark long, gone array<int>")
    gone = gone.groupBy("doc_id", "mark").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("removed"))
    per = lines.groupBy("doc_id", "mark").agg(F.max("n_lines").alias("n_lines"))
    return per.join(gone, ["doc_id", "mark"], "left").select("doc_id", "mark", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def delete(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with all columns, their repeated lines deleted from the text."""
    gone = repeated(docs, id_col=id_col, text_col=text_col, **how).where(F.size("removed") > 0).select(F.col("doc_id").alias("__q_id"), F.col("mark").alias("__q_mark"), F.col("removed").alias("__q_removed"))
    rows = docs.join(gone, (docs[id_col].cast("long") == F.col("__q_id")) & (F.xxhash64(body(text_col)) == F.col("__q_mark")), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains("__q_removed", i)), "\n")
    return rows.select(*[F.when(F.col("__q_id").isNotNull(), kept).otherwise(F.col(c)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op5_line_dedup(spark, sf_dir):
    found = repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, place, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
r AS (SELECT doc_id, i, line || chr(10) || lead(line, 1) OVER s || chr(10) || lead(line, 2) OVER s AS run FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM r WHERE run IS NOT NULL),
a AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS nth FROM w WHERE n >= 5),
g AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM k WHERE nth > 1 UNION SELECT doc_id, i FROM a WHERE nth > 1),
o AS (SELECT doc_id, count(*) AS n_removed, string_agg(place::VARCHAR, ',' ORDER BY place) AS removed FROM (SELECT DISTINCT doc_id, i FROM g) JOIN w USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id) LEFT JOIN o USING (doc_id)
"""
