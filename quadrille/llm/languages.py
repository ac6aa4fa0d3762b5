"""Language identification by language-bitmask filters of n-grams.

Texts are read as n-grams of bytes: ASCII letters in lower case and all bytes beyond ASCII are
letters, anything else is one separator, and an n-gram holds a separator at its ends only, so that
word beginnings and endings are n-grams of their own. Training counts, over all labelled documents,
how many of each language's documents hold each n-gram. An n-gram belongs to a language if at least
`least_docs` of its documents hold it, and it is not `apart` times as frequent, by share of documents,
in another language; so passages in a foreign language don't blur the sets.

The sets of all languages form one bit-sliced Bloom filter: each slot is a word with a bit for each
language, and the words at an n-gram's slots, met by AND, are at once all the languages that contain
it. Filters are built by a grouped bit_or; the driver gets 2**slot_bits words for each 64 languages and no more.

A document's n-grams with a bit are counted language by language. A filter with the part f of a language's bits set
answers yes for an absent n-gram with probability f**hashes, so of N n-grams with H hits the language is taken
to hold (H - N f**hashes) / (1 - f**hashes). The largest such count decides, ties by the smaller
value; the score is the winner's part of all languages' counts. Prediction is one pass without a shuffle.

Defined results: `und`, score 0, if the text is null or has no letter (Unicode); a text with letters but
without a known n-gram gets the language with most training documents, score 0. With nothing to learn from all are
`und`. Null ids are never learned from and not held out; null languages are not learned; repeated rows are each predicted;
extra columns are ignored. Language, source and id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, table
from .words import IS_LETTER, LOWER, U, chunks, mixed

IS_ALPHA = IS_LETTER.copy()
IS_ALPHA[0x30:0x3A] = False
UNKNOWN = "und"


def grams(words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts and values (n bytes as one number) of all n-grams of a chunk of lower-case texts."""
    count = len(words.offsets) - 1
    text = np.repeat(np.arange(count), np.diff(words.offsets))
    line = np.full(len(words.data) + count + n, 0x20, dtype=U)  # one separator before and behind each text
    line[np.arange(len(words.data)) + text + 1] = np.where(IS_ALPHA[words.data], words.data, 0x20)
    letter = line != U(0x20)
    size = len(line) - n + 1
    value, good = np.zeros(size, dtype=U), np.ones(size, dtype=bool)
    for i in range(n):
        value = value << U(8) | line[i : i + size]
        if 0 < i < n - 1:
            good &= letter[i : i + size]
    at = np.flatnonzero(good)
    # A good n-gram has letters inside, so its second byte stands in its text.
    owner = np.zeros(len(line), dtype=np.int64)
    owner[np.arange(len(words.data)) + text + 1] = text
    return owner[at + 1], value[at]


@dataclass(frozen=True)
class Filters:
    languages: list[str]  # in the order of their bits
    usual: str  # the language of most training documents
    bits: int
    hashes: int
    n: int
    slots: np.ndarray  # one row of words for each 64 languages

    def false_rates(self) -> np.ndarray:
        """The probability of a hit for an n-gram that a language doesn't contain."""
        full = [np.count_nonzero(self.slots[i // 64] >> U(i % 64) & U(1)) / self.slots.shape[1] for i in range(len(self.languages))]
        return np.array(full) ** self.hashes

    def holding(self, values: np.ndarray) -> np.ndarray:
        """For n-grams, the words of languages that contain them."""
        h = mixed(values)
        out = None
        for i in range(self.hashes):
            found = self.slots[:, (h >> U(i * self.bits) & U((1 << self.bits) - 1)).astype(np.int64)]
            out = found if out is None else out & found
        return out


def gram_counts(docs: DataFrame, n: int, text_col: str, lang_col: str) -> DataFrame:
    """lang, gram, docs: how many documents of each language hold an n-gram, summed per Arrow batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            langs, code = names.dictionary.to_pylist(), names.indices.to_numpy()
            parts = {}
            for low, high, words in chunks(batch.column(1), inside=IS_ALPHA, fold=LOWER):
                text, value = grams(words, n)
                for c in np.unique(code[low:high]):
                    mine = code[low:high][text] == c
                    pairs = np.unique(value[mine] << U(24) | text[mine].astype(U))  # a batch has under 2**24 rows
                    one, times = np.unique(pairs >> U(24), return_counts=True)
                    parts.setdefault(int(c), []).append((one, times))
            for c, found in parts.items():
                value, back = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                times = np.bincount(back, np.concatenate([x for _, x in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([langs[c]] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(times)], ["lang", "gram", "docs"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), body(text_col).alias("text"))
    found = rows.mapInArrow(count, "lang string, gram long, docs long")
    return found.groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))


def train(docs: DataFrame, n: int = 4, least_docs: int = 2, apart: float = 10.0, slot_bits: int = 20, hashes: int = 3, text_col: str = "text", lang_col: str = "lang") -> Filters | None:
    """Filters of the languages of docs, whose rows are all learned from; None without a row that has a language."""
    if hashes * slot_bits > 64 or not 3 <= n <= 5:
        raise ValueError("hashes * slot_bits may be 64 at most, n from 3 to 5")
    docs = docs.where(F.col(lang_col).isNotNull())
    per = docs.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("of"))
    totals = sorted((r["lang"], r["of"]) for r in per.collect())  # one row for each language
    if not totals:
        return None
    languages = [x for x, _ in totals]
    index = docs.sparkSession.createDataFrame([(x, i, k) for i, (x, k) in enumerate(totals)], "name string, bit int, of long")
    counted = gram_counts(docs, n, text_col, lang_col).join(F.broadcast(index), F.col("lang") == F.col("name"))
    best = counted.groupBy("gram").agg(F.collect_list(F.struct("bit", "docs", (F.col("docs") / F.col("of")).alias("rate"))).alias("all"), F.max(F.col("docs") / F.col("of")).alias("most"))  # at most one entry a language
    kept = best.select("gram", F.explode("all").alias("x"), "most").where((F.col("x.docs") >= least_docs) & (F.col("x.rate") * apart >= F.col("most")))
    words = kept.groupBy("gram", F.expr("x.bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, x.bit % 64)")).alias("mask"))
    return built(words, languages, max(totals, key=lambda x: x[1])[0], slot_bits, hashes, n)


def built(words: DataFrame, languages: list[str], usual: str, bits: int, hashes: int, n: int) -> Filters:
    """Filters of rows gram, word (64 languages each), mask. Slots are met by a grouped bit_or and come to the driver in runs of 4,096."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = mixed(batch.column(0).to_numpy().view(U))
            at = np.concatenate([h >> U(i * bits) & U((1 << bits) - 1) for i in range(hashes)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(1)] * hashes), pa.array(at), pa.concat_arrays([batch.column(2)] * hashes)], ["word", "slot", "mask"])

    spots = words.select("gram", F.col("word").cast("int"), "mask").mapInArrow(spread, "word int, slot long, mask long")
    met = spots.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    runs = met.groupBy("word", F.expr("slot div 4096").alias("run")).agg(F.collect_list("slot").alias("slots"), F.collect_list("mask").alias("masks"))
    slots = np.zeros((-(-len(languages) // 64), 1 << bits), dtype=U)
    for r in runs.toLocalIterator():
        slots[r["word"], np.array(r["slots"], dtype=np.int64)] = np.array(r["masks"], dtype=np.int64).view(U)
    return Filters(languages, usual, bits, hashes, n, slots)


def predict(docs: DataFrame, filters: Filters | None, text_col: str = "text") -> DataFrame:
    """All columns of docs but those called lang_pred and score, and lang_pred and score for each row."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    keep = [F.col(f"`{c}`") for c in names]
    if filters is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    rates = filters.false_rates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, lang, score = batch.column(batch.num_columns - 1), [], []
            for low, high, words in chunks(column, inside=IS_ALPHA, fold=LOWER):
                text, value = grams(words, filters.n)
                held = filters.holding(value)
                count = high - low
                n = np.bincount(text, minlength=count)
                hits = np.stack([np.bincount(text[(held[i // 64] >> U(i % 64) & U(1)).astype(bool)], minlength=count) for i in range(len(filters.languages))])
                true = np.maximum(hits - n * rates[:, None], 0) / np.maximum(1 - rates[:, None], 1e-9)
                true[hits == 0] = 0
                best, total = true.argmax(axis=0), true.sum(axis=0)
                top = true[best, np.arange(count)]
                ascii_letters = np.flatnonzero(IS_ALPHA[words.data] & (words.data < 0x80))
                plain = np.bincount(np.searchsorted(words.offsets, ascii_letters, side="right") - 1, minlength=count) > 0
                for i in range(count):
                    if not plain[i] and not any(c.isalpha() for c in column[low + i].as_py()):
                        lang.append(UNKNOWN)
                        score.append(0.0)
                    elif top[i] <= 0:
                        lang.append(filters.usual)
                        score.append(0.0)
                    else:
                        lang.append(filters.languages[best[i]])
                        score.append(float(top[i] / total[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(*keep, body(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)])
    return rows.mapInArrow(run, f"{schema}{', ' if schema else ''}lang_pred string, score double")


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def op12_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    filters = train(docs.where(remainder("doc_id") != 2))
    rows = docs.select("doc_id", F.coalesce(remainder("doc_id") == 2, F.lit(False)).alias("held_out"), "text")
    return predict(rows, filters).drop("text")
