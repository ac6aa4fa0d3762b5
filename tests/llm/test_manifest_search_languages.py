"""Merkle manifests, language identification and ranked search against plain Python, and earlier operators on one very long or very common text."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.llm import languages, merkle, search, secrets, suffix, toxic
from quadrille.llm.words import IS_LETTER, chunks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(nodes):
    return [sha(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def leaf(row, add=0):
    doc, text, lang, source, n = row
    values = [doc, source, lang, None if n is None else n + add, text]
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def path(nodes, i):
    out = []
    while len(nodes) > 1:
        o = i ^ 1
        out.append((o < i, nodes[o]) if o < len(nodes) else None)
        nodes, i = up(nodes), i // 2
    return out, nodes[0]


def fold(digest, steps):
    for s in steps:
        digest = sha([digest] if s is None else [s[1], digest] if s[0] else [digest, s[1]])
    return digest


def manifest(rows):
    """Expected result rows of the manifest."""
    trees = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(r))):
        trees[r[2]].append(r)
    leaves = {k: [leaf(r) for r in v] for k, v in trees.items()}
    roots = [path(leaves[k], 0)[1] for k in trees]
    out = collections.Counter()
    for t, (k, v) in enumerate(trees.items()):
        for i, r in enumerate(v):
            steps = path(leaves[k], i)[0] + path(roots, t)[0]
            root = path(roots, t)[1]
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            back = fold(leaf(r, int(altered)), steps)
            out[(r[0], leaves[k][i], roots[t], root, sha(s[1] for s in steps if s), back, back == root)] += 1
    return out


def write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("index", F.lit(7)).withColumn("total", F.lit("x")).withColumn("score", F.lit(0.5)).withColumn("term", F.lit(None).cast("int")).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("sizes", [{}, {"en": 1}, {"en": 2, None: 1}, {"en": 37, "de": 5, None: 3, "é": 8, "z": 1}])
def test_manifest(spark, tmp_path, sizes):
    rows = [(100 * t + i, "text é" * (i % 4) if i % 5 else None, lang, f"s{i % 3}" if i % 7 else None, i if i % 6 else None) for t, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    if len(rows) > 5:
        rows += [rows[4], rows[4], (rows[3][0], "other", "en", None, 1), (None, "no id", "en", "s", 2)]
    got = collections.Counter(map(tuple, merkle.op11_merkle_manifest(spark, write(spark, tmp_path, "documents", rows, SCHEMA)).collect()))
    assert got == manifest(rows)


@pytest.mark.parametrize("height", [1, 2, 3, 10])
def test_manifest_log_is_in_postorder(spark, height):
    leaves = [(lang, i, hashlib.sha256(f"{lang}{i}".encode()).digest()) for lang, n in (("a", 1), ("b", 21), ("c", 16)) for i in range(n)]
    found = merkle.Manifest(spark.createDataFrame(leaves, "tree string, key long, digest binary"), ["key"], height)
    nodes = collections.defaultdict(dict)
    for r in found.log().collect():
        assert r.place not in nodes[r.tree]
        nodes[r.tree][r.place] = (r.level, bytes(r.digest).hex())
    for lang in "abc":
        level, want = [d.hex() for t, _, d in leaves if t == lang], []

        def visit(k, i, levels=None):
            if k:
                for c in (2 * i, 2 * i + 1):
                    if c < len(levels[k - 1]):
                        visit(k - 1, c, levels)
            want.append((k, levels[k][i]))

        levels = [level]
        while len(levels[-1]) > 1:
            levels.append(up(levels[-1]))
        visit(len(levels) - 1, 0, levels)
        assert [nodes[lang][i] for i in range(len(want))] == want and len(nodes[lang]) == len(want)
    roots = {(bytes(r.root), merkle.fold(bytes(r.digest), bytes(r.path))) for r in found.proofs().collect()}
    assert len(roots) == 1 and len({*roots.pop()}) == 1


def words(rng, syllables, n):
    return " ".join("".join(syllables[i] for i in rng.integers(0, len(syllables), 3)) for _ in range(n))


SYLLABLES = {"aa": ["ka", "lo", "mi", "ru", "te"], "bb": ["sch", "ung", "ein", "ver", "ß"], "cc": ["да", "но", "ли", "ко", "ра"]}


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(3)
    names = [*SYLLABLES] * 40
    return [(i, words(rng, SYLLABLES[x], int(rng.integers(1, 40))), x, "s", 0) for i, x in enumerate(names)]


def test_languages(spark, tmp_path, prose):
    odd = [(1000, None, "aa", "s", 0), (1001, "", "bb", "s", 0), (1002, "12 € — 7", "aa", "s", 0), (1003, "xq zw", None, "s", 0), (1004, words(np.random.default_rng(4), SYLLABLES["cc"], 9000), None, "s", 0), (None, prose[0][1], "bb", "s", 0), prose[0]]
    rows = [*prose, *odd]
    got = languages.op12_language_id(spark, write(spark, tmp_path, "documents", rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    truth = {r[0]: r[2] for r in prose}
    assert all(by[i].lang_pred == x and by[i].score > 0.5 for i, x in truth.items())
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred in SYLLABLES and by[1003].score == 0 and by[1004].lang_pred == "cc"
    assert by[None].lang_pred == "aa"
    none = languages.predict(spark.createDataFrame(rows, SCHEMA), languages.train(spark.createDataFrame([], SCHEMA)))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}


def test_language_filters_by_brute_force(spark, prose):
    """Sets of n-grams held exactly, with filters so small that many n-grams are false hits."""
    docs = spark.createDataFrame(prose, SCHEMA)
    small, large = languages.train(docs, slot_bits=9), languages.train(docs)
    held = collections.defaultdict(collections.Counter)
    gram = lambda t: {x for w in re.findall(rb"[a-z\x80-\xff]+", t.encode().lower()) for v in [b" " + w + b" "] for x in (v[i : i + 4] for i in range(len(v) - 3))}
    for _, text, lang, *_ in prose:
        held[lang].update(gram(text))
    rate = lambda x, g: held[x][g] / 40
    sets = {x: {g for g, n in held[x].items() if n >= 2 and 10 * rate(x, g) >= max(rate(y, g) for y in held)} for x in held}
    every = sorted(set().union(*held.values()))
    values = np.array([int.from_bytes(g, "big") for g in every], dtype=np.uint64)
    for filters, exact in ((large, True), (small, False)):
        got = filters.holding(values)[0]
        for b, x in enumerate(filters.languages):
            said = {g for g, w in zip(every, got, strict=True) if int(w) >> b & 1}
            assert sets[x] <= said and (not exact or said == sets[x])
    assert max(small.false_rates()) > 0.01 > max(large.false_rates())
    same = languages.predict(docs, small).collect()
    assert sum(r.lang_pred == r.lang for r in same) >= 0.97 * len(same)


def test_many_languages_take_several_words(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(70):
        own = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(8)]
        rows += [(len(rows) + j, " ".join(rng.permutation(own)), f"l{i:02}", None, 0) for j in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    filters = languages.train(docs)
    assert filters.slots.shape[0] == 2
    assert all(r.lang_pred == r.lang for r in languages.predict(docs, filters).collect())


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def ranked(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        ask, scored = collections.Counter(terms(text)), []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // length
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in ask.items() if t in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return collections.Counter(out)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(6)
    vocabulary = [f"W{i}" for i in range(60)] + ["é", "naïve", "日本", "x1"]
    sample = lambda n: " ".join(vocabulary[min(int(x), 63)] for x in rng.exponential(9, n))
    docs = [(i, sample(int(rng.integers(1, 80)))) for i in range(300)]
    docs += [(300 + i, docs[7][1]) for i in range(30)] + [(7, docs[7][1]), (None, docs[7][1]), (400, None), (401, ""), (402, "!? --"), (403, sample(9000))]
    items = [(i, sample(int(rng.integers(1, 20)))) for i in range(40)] + [(40, docs[7][1]), (41, None), (42, "unheard of"), (0, "W1 w1, W1;É é"), (None, "w2 日本")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_bytes": 300, "cells": 500, "first": 2}, {"k": 3, "first": 1}])
def test_search(spark, texts, options):
    docs, items = texts
    found = search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), **options)
    got = collections.Counter(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()))
    assert got == ranked(docs, items, options.get("k", 10))


def test_search_query_and_empty_tables(spark, tmp_path, texts):
    docs, items = texts
    write(spark, tmp_path, "documents", docs, "doc_id long, text string")
    where = write(spark, tmp_path, "benchmark", items, "item_id long, text string")
    assert collections.Counter(map(tuple, search.op13_ranked_search(spark, where).select("item_id", "rank", "doc_id", "score").collect())) == ranked(docs, items, 10)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    none = lambda df: df.limit(0)
    assert search.search(none(d), i).count() == search.search(d, none(i)).count() == search.search(none(d), none(i)).count() == 0


def test_search_prunes(texts):
    """The trees leave out most pairs where a few documents stand out, and none that belongs in."""
    rng = np.random.default_rng(9)
    rows = search.Items.of([(i, " ".join(f"t{x}" for x in range(20 * i, 20 * i + 20))) for i in range(20)])
    width = len(rows.vocabulary)
    held = [sorted(rng.choice(20, 12, replace=False) + 20 * (i // 100)) for i in range(2000)]
    at = {t: i for i, t in enumerate(rows.vocabulary)}
    terms = np.concatenate([[at[b"t%d" % x] for x in h] for h in held])
    weights = np.full(width, 700)
    one = search.Search(search.Weighted(rows.terms, [weights[t] * n for t, n in zip(rows.terms, rows.repeats, strict=True)], weights, 2000, 24000, np.zeros(20, dtype=np.int64)), 10)
    one.add(np.arange(2000), np.ones(2000, bool), np.full(2000, 12), np.arange(2001) * 12, terms, np.ones(24000, dtype=np.int64))
    assert one.pairs < 0.2 * 20 * 2000 and all(len(b) == 10 for b in one.best)


def test_secrets_of_a_list_of_digests(spark):
    text = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(50_000))
    found = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.start, s.end) for s in found.spans] == [(m.start(), m.end()) for m in re.finditer("[0-9a-f]{24,}", text)]


def test_repeats_name_a_holder_whatever_the_salts(spark):
    rng = np.random.default_rng(12)
    some = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**6, n))
    shared, block = some(60), some(140)
    texts = {i: f"{some(30)} {shared} {some(30)}" for i in range(1, 25)} | {i: f"{some(3)} {block} {some(3)}" for i in range(30, 50)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for salts in (1, 3, 8):
        got = {r.doc_id: r for r in suffix.repeats(docs, salts=salts).collect()}
        assert {d: [(s.f, s.t) for s in r.spans] for d, r in got.items()} == {i: [(30, 90)] for i in range(2, 25)} | {i: [(3, 143)] for i in range(31, 50)}
        for d, r in got.items():
            assert r.first_of == min(s.of for s in r.spans) < d
            for s in r.spans:
                w, held = texts[d].split()[s.f : s.t], f" {texts[s.of]} "
                assert any(f" {' '.join(w[i : i + 50])} " in held for i in range(len(w) - 49))


def test_toxicity_passes_over_texts_beyond_its_budget(spark):
    rng = np.random.default_rng(13)
    clean = [f"w{i}" for i in range(300)]
    make = lambda toxic, n: " ".join("badword" if toxic and rng.random() < 0.2 else clean[rng.integers(300)] for _ in range(n))
    rows = [(i, make(i % 3 == 0, 60), int(i % 3 == 0)) for i in range(240)]
    rows += [(i, make(i % 2 == 0, 40_000), int(i % 2 == 0)) for i in range(240, 260)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxic.train(docs, labels, most_bytes=150_000)
    assert len(model.known)
    got = {r.doc_id: r.score for r in toxic.score(docs, model).collect()}
    assert min(got[i] for i, _, y in rows if y) > max(got[i] for i, _, y in rows if not y)


def test_chain_marginals_by_enumeration():
    """Forward and backward over stretches of tokens give the sums over all label sequences of short texts."""
    rng = np.random.default_rng(14)
    for text in ("bad good bad fine worse x y bad", "fine bad", "bad", "x y z bad good good x y"):
        w = next(chunks(pa.array([text]), inside=IS_LETTER))[2]
        features = toxic.token_features(w)
        known = np.unique([f for t in range(len(w.start)) if text.split()[t] in ("bad", "worse", "good") for f in (features[0][t], features[1][t])])
        model = toxic.Model(known, rng.normal(0, 1, len(known)), -0.7, rng.normal(0, 1, (2, 2)), np.zeros(3))
        token, place = toxic._found(known, features)
        unary = np.bincount(token, model.weight[place], len(w.start)) + model.bias
        total, on = 0.0, np.zeros(len(unary))
        for y in itertools.product((0, 1), repeat=len(unary)):
            weight = math.exp(sum(u for u, k in zip(unary, y, strict=True) if k) + sum(model.moves[i, j] for i, j in itertools.pairwise(y)))
            total += weight
            on += weight * np.array(y)
        at, got = toxic.marginals(model, w)
        assert np.allclose(got, (on / total)[at]) and {text.split()[t] for t in at} >= {"bad"}
