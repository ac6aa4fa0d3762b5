"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the vocabulary's word mark before it. A task inserts the
distinct pre-tokens of a stretch of texts in a trie, and computes the best unigram score
of each node once, from the nodes above it: pre-tokens that share a prefix share its
scores. All nodes of one depth are taken together: the vocabulary's pieces that end at a
node are found by the hash of its last bytes. A node that ends a pre-token stores its
count of tokens, and a text's count is the sum over its pre-tokens.

Scores are a parameter, a dictionary of pieces; without it they are those of Zipf's law by place in the vocabulary, -ln(place + 1), as
the public vocabulary is no unigram model and has none; a byte that no
piece covers is one token at `byte_score`. Of equal scores, the split with fewer tokens counts.
A pre-token of more than 256 bytes stays outside the trie: its scores are computed byte by
byte, in stretches that carry on the scores of as many bytes as the longest piece has, so its
split is the best one too. With `longest`, an option that the query doesn't take, pre-tokens are cut into stretches of so many bytes
first and their counts are summed, which isn't the best split of a longer one.

The vocabulary is a public file whose path is a parameter; nothing is trained. Texts are
read once, there is no shuffle, and a task's memory depends on a few MB of text only.

Defined results: null and empty texts have no tokens; null ids are kept as null; repeated
rows are counted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, table
from .words import U, chunks, powers

_BASE = U(0xBF58476D1CE4E5B9)
MARK = "▁".encode()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Hashes of the pieces' bytes by length, with their scores."""

    def __init__(self, path: str, byte_score: float = -20.0, scores: dict[str, float] | None = None):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.byte_score = byte_score
        self.pieces: dict[bytes, float] = {}
        for piece, score in (scores or {}).items():
            self.pieces[piece.encode()] = float(score)
        for i in range(0 if scores else sp.get_piece_size()):
            if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i)):
                self.pieces.setdefault(sp.id_to_piece(i).encode(), -float(np.log(i + 1)))
        up, _ = powers(_BASE, 1 << 16)
        by: dict[int, tuple[list, list]] = {}
        for piece, score in self.pieces.items():
            hashes, scores = by.setdefault(len(piece), ([], []))
            # the same hash as a stretch of Levels: later bytes weigh less
            hashes.append(int((np.frombuffer(piece, np.uint8).astype(U) + U(1)).dot(up[len(piece) - 1 :: -1] if len(piece) > 1 else up[:1])))
            scores.append(score)
        self.by_length = {}
        for n, (hashes, scores) in sorted(by.items()):
            order = np.argsort(np.array(hashes, U))
            self.by_length[n] = (np.array(hashes, U)[order], np.array(scores)[order])


#: Bytes of the longest pre-token that goes into the trie.
TRIE = 256
_KNOWN: dict[tuple[str, float, int], Vocabulary] = {}


def trie_counts(words: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Tokens of each pre-token. words: distinct pre-tokens as rows of bytes, zeros after the end, in sorted order; sizes: bytes of each.

    A row's node at depth d is new if its first d bytes differ from the row before; others take that row's node.
    """
    n, width = words.shape
    up, _ = powers(_BASE, width + 1)
    same = np.zeros(n, np.int64)  # bytes that each shares with the one before
    if n > 1:
        equal = np.logical_and.accumulate(words[1:] == words[:-1], axis=1) & (np.arange(width) < np.minimum(sizes[1:], sizes[:-1])[:, None])
        same[1:] = equal.sum(1)
    node = [np.zeros(n, np.int64)]  # of each row at each depth
    hashes, scores, counts = [np.zeros(1, U)], [np.zeros(1)], [np.zeros(1, np.int64)]
    parents: list[np.ndarray] = [np.zeros(1, np.int64)]
    out = np.zeros(n, np.int64)
    for d in range(1, width + 1):
        has = sizes >= d
        fresh = has & (same < d)
        rows = np.flatnonzero(fresh)
        if not len(rows):
            break
        place = np.cumsum(fresh) - 1
        node.append(np.where(has, place, 0))
        above = node[d - 1][rows]
        parents.append(above)
        h = hashes[d - 1][above] * _BASE + words[rows, d - 1].astype(U) + U(1)
        hashes.append(h)
        best, count = scores[d - 1][above] + vocabulary.byte_score, counts[d - 1][above] + 1
        up_to = above
        for m in range(1, d + 1):
            start = up_to if m == 1 else parents[d - m + 1][up_to]
            up_to = start
            if m in vocabulary.by_length:
                keys, values = vocabulary.by_length[m]
                tail = h - hashes[d - m][start] * up[m]
                at = np.minimum(np.searchsorted(keys, tail), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == tail)
                if len(hit):
                    s, c = scores[d - m][start[hit]] + values[at[hit]], counts[d - m][start[hit]] + 1
                    better = (s > best[hit]) | ((s == best[hit]) & (c < count[hit]))
                    best[hit[better]], count[hit[better]] = s[better], c[better]
            elif m > max(vocabulary.by_length):
                break
        scores.append(best)
        counts.append(count)
        ends = np.flatnonzero(sizes == d)
        out[ends] = count[node[d][ends]]
    return out


def counts_of(pre: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """Tokens of distinct pre-tokens, taken in groups of similar length so that rows of bytes stay narrow."""
    out = np.zeros(len(pre), np.int64)
    sizes = np.array([len(x) for x in pre], np.int64)
    low = 0
    for high in (16, 32, 64, 1 << 20):
        pick = np.flatnonzero((sizes > low) & (sizes <= high))
        low = high
        if len(pick):
            rows = np.array([pre[i] for i in pick], dtype=f"S{int(sizes[pick].max())}")
            grid = rows.view(np.uint8).reshape(len(pick), -1)
            order = np.lexsort((sizes[pick], rows))
            out[pick[order]] = trie_counts(grid[order], sizes[pick][order], vocabulary)
    return out


def long_count(word: bytes, vocabulary: Vocabulary, stretch: int = 1 << 16) -> int:
    """Tokens of one pre-token of any length; memory depends on `stretch` bytes."""
    most, data = max(vocabulary.by_length), np.frombuffer(word, np.uint8)
    scores, counts = [0.0], [0]  # after the bytes from base to low
    for low in range(0, len(data), stretch):
        base = low - len(scores) + 1
        part = data[base : low + stretch].astype(U) + U(1)
        up, down = powers(_BASE, len(part) + 1)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(part * down[: len(part)], dtype=U)])
        ends, sizes, gains = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for m, (keys, values) in vocabulary.by_length.items():
            end = np.arange(max(m, low - base + 1), len(part) + 1)
            tail = (sums[end] - sums[end - m]) * up[end - 1]
            at = np.minimum(np.searchsorted(keys, tail), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == tail)
            ends.append(end[hit])
            sizes.append(np.full(len(hit), m))
            gains.append(values[at[hit]])
        end = np.concatenate(ends)
        order = np.argsort(end, kind="stable")
        first = np.searchsorted(end[order], np.arange(len(part) + 2)).tolist()
        size, gain = np.concatenate(sizes)[order].tolist(), np.concatenate(gains)[order].tolist()
        for e in range(low - base + 1, len(part) + 1):
            best, count = scores[e - 1] + vocabulary.byte_score, counts[e - 1] + 1
            for k in range(first[e], first[e + 1]):
                s, c = scores[e - size[k]] + gain[k], counts[e - size[k]] + 1
                if s > best or (s == best and c < count):
                    best, count = s, c
            scores.append(best)
            counts.append(count)
        scores, counts = scores[-most - 1 :], counts[-most - 1 :]
    return counts[-1]


def count_tokens(docs: DataFrame, vocabulary: str | None = None, byte_score: float = -20.0, longest: int | None = None, scores: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_pretokens, n_tokens."""
    path = vocabulary or default_vocabulary()

    def worker(batches):
        key = (path, byte_score, hash(frozenset(scores.items())) if scores else 0)
        known = _KNOWN.get(key) or _KNOWN.setdefault(key, Vocabulary(path, byte_score, scores))
        for batch in batches:
            words, tokens = [], []
            for _, _, w in chunks(batch.column(1), most=2 << 20):
                _, at, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
                data = w.data.tobytes()
                pre = [MARK + data[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
                cuts = [[x] if longest is None else [x[i : i + longest] for i in range(0, len(x), longest)] for x in pre]
                parts = {y for x in cuts for y in x}
                plain = sorted(x for x in parts if len(x) <= TRIE)
                got = dict(zip(plain, counts_of(plain, known).tolist(), strict=True)) | {x: long_count(x, known) for x in parts if len(x) > TRIE}
                each = np.array([sum(got[y] for y in x) for x in cuts], np.int64)
                sums = np.concatenate([[0], np.cumsum(each[which])]) if len(at) else np.zeros(1, np.int64)
                words.append(np.diff(w.first))
                tokens.append(sums[w.first[1:]] - sums[w.first[:-1]])
            joined = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), joined(words), joined(tokens)], names=["doc_id", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    return rows.mapInArrow(worker, "doc_id long, n_pretokens long, n_tokens long")


def op8_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))
