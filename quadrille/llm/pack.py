"""Harmonic packing of documents into sequences of at most `capacity` tokens.

Class j holds pieces between 1 / (j + 1) and 1 / j of the capacity, and each of its bins
takes exactly j of them. Cuts are free, so a document is cut into whole sequences first,
and what remains into pieces that nearly fill their class: while a remainder would fill
less than `fill` of its class's share, a piece of the next class's full share is cut off.
Every worker fills its bins by itself while it reads its own partition; there is no
shuffle. What is left in open bins at a worker's end is laid end to end, cut at the
capacity, and only its last sequence is short, one for each worker.

Sequence ids hold the partition's number, so they are unique and a task that is run
again gives the same ones.

Defined results: a null or empty text is the end id alone; null ids are kept as null;
repeated rows are packed each; a text of any length is cut into as many sequences as it
needs; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, table

END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
_CACHE_MOST = 300_000
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Byte-level vocabularies write a byte as a letter: printable ones as themselves, the others from U+0100 on, in order.
_BYTE_LETTERS = [chr(x) if x in _PLAIN else chr(256 + sum(y not in _PLAIN for y in range(x))) for x in range(256)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Ids(dict):
    """Ids, as little-endian bytes, of runs without white space; the vocabulary drops white space, so runs never join.

    The memory is bounded: it is emptied whenever it holds _CACHE_MOST runs.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        whole = Tokenizer.from_file(path)
        self.encode, self.pieces = whole.encode, whole.model.tokenize

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= _CACHE_MOST:
            self.clear()
        # Letters and the marks behind them are tokens apart, and letters are read in lower case, so "Word," takes its ids from
        # "word" and ",". Below U+0250 and without U+0130, lower case keeps length and no mark combines, so the model itself,
        # which takes bytes as letters, gives the ids of a plain word.
        word = chunk.rstrip(_MARKS)
        if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:
            low = word.lower()
            letters = low if low.isascii() else "".join(_BYTE_LETTERS[x] for x in low.encode())
            found = array("I", [x.id for x in self.pieces(letters)]).tobytes() + (self[chunk[len(word) :]] if len(word) < len(chunk) else b"")
        else:
            found = np.array(self.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(chunk) <= 64:
            self[chunk] = found
        return found


_TOKENIZERS: dict[str, _Ids] = {}


def token_ids(text: str, path: str) -> bytes:
    """A text's ids with the end id, as little-endian unsigned 32-bit integers."""
    known = _TOKENIZERS.setdefault(path, None) or _TOKENIZERS.__setitem__(path, _Ids(path)) or _TOKENIZERS[path]
    return b"".join(map(known.__getitem__, _CHUNK.findall(text))) + END_ID.to_bytes(4, "little")


def cuts(n: int, capacity: int, fill: float) -> list[int]:
    """Lengths that add up to n: whole sequences, then pieces that nearly fill their class."""
    whole, rest = divmod(n, capacity)
    out = [capacity] * whole
    while rest:
        k = capacity // rest
        if rest * k < fill * capacity:
            piece = capacity // (k + 1)
            out.append(piece)
            rest -= piece
        else:
            out.append(rest)
            rest = 0
    return out


def _rest(pieces: list[tuple], capacity: int, number) -> list[tuple]:
    """Open bins' pieces end to end, cut at the capacity."""
    out, room, sequence = [], 0, 0
    for doc, start, ids, total in pieces:
        while ids:
            if not room:
                room, sequence = capacity, number()
            part, ids = ids[: 4 * room], ids[4 * room :]
            out.append((doc, start, part, total, sequence, capacity - room))
            start += len(part) // 4
            room -= len(part) // 4
    return out


def _batches(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, ids, total, sequence, offset = zip(*rows, strict=True) if rows else ((),) * 6
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], schema=_ARROW)


def pack(docs: DataFrame, capacity: int = 2048, fill: float = 0.98, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()

    def worker(batches):
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 40, 0
        open_bins: dict[int, list[tuple]] = {}

        def number() -> int:
            nonlocal made
            made += 1
            return base + made - 1

        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), path)
                total, start = len(ids) // 4, 0
                for length in cuts(total, capacity, fill):
                    piece = (doc, start, ids[4 * start : 4 * (start + length)], total)
                    start += length
                    k = capacity // length
                    held = open_bins.setdefault(k, [])
                    held.append(piece)
                    if len(held) == k:
                        sequence, at = number(), 0
                        for d, s, x, t in open_bins.pop(k):
                            out.append((d, s, x, t, sequence, at))
                            at += len(x) // 4
                size += len(ids)
                if size > 8 << 20:
                    yield _batches(out)
                    out, size = [], 0
            yield _batches(out)
        yield _batches(_rest([x for k in sorted(open_bins) for x in open_bins[k]], capacity, number))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    return rows.mapInArrow(worker, SCHEMA)


def op9_pack_harmonic(spark, sf_dir):
    found = pack(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
