"""Written boards, lines of five, scores, ratios, even ranges and the sketch's error against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_core import five

from quadrille.functions import boards as b
from quadrille.functions import geometry as g
from quadrille.functions import ranges, scores
from quadrille.operators.moments import ratio_moments


def _sides(rng):
    cells = [rng.randrange(3) for _ in range(36)]
    return cells, *[sum(1 << x for x, c in zip(g.BITS, cells, strict=True) if c == k) for k in (1, 2)]


def test_written_boards_are_read_back_and_others_are_not(spark):
    rng = random.Random(2)
    rows = [_sides(rng) for _ in range(50)]
    df = spark.createDataFrame([("".join(map(str, c)), s, r) for c, s, r in rows], "digits string, s0 long, s1 long")
    got = df.select("digits", b.read_table_text(F.col("digits")).alias("board"), b.pack(F.col("s0"), F.col("s1")).alias("want"), b.picture(F.col("digits")).alias("picture")).collect()
    for r in got:
        assert r.board == r.want
        lines = r.picture.split("\n")
        assert lines[0] == f"counts: 0s = {r.digits.count('1')}, 1s = {r.digits.count('2')}" and lines[1] == lines[8] == "" and lines[9] == "   123456"
        assert all(lines[2 + i] == "abcdef"[i] + "  " + "".join("_01"[int(r.digits[6 * x + 5 - i])] for x in range(6)) for i in range(6))
    bad = ["", "0" * 35, "0" * 37, "3" + "0" * 35, "0" * 36 + "\n", "x" * 36, None]
    assert all(r[0] is None for r in spark.createDataFrame([(x,) for x in bad], "t string").select(b.read_table_text(F.col("t"))).collect())


def test_lines_of_five(spark):
    rng = random.Random(5)
    sides = [0, g.FULL, *g.win_masks(), *[sum(1 << x for x in g.BITS if rng.random() < 0.7) for _ in range(50)]]
    got = spark.createDataFrame([(s,) for s in sides], "s long").select("s", b.fives(F.col("s")).alias("f")).collect()
    for r in got:
        assert [x.line for x in r.f] == [m for m in g.win_masks() if m & r.s == m] and bool(r.f) == five(r.s)
        for x in r.f:
            assert sum(1 << g.bit_of(int(c[0]), int(c[1])) for c in x.cells.split(",")) == x.line


def test_scores(spark):
    rows = [(d, v, n) for d in (0, 5, 36) for v in (0, 1, 2) for n in (10, 11)]
    df = spark.createDataFrame(rows, "d long, v long, n long")
    once = scores.score(F.col("d"), F.col("v"))
    won = scores.winner(F.col("v") - 1, F.col("n"))
    for r in df.select("*", once.alias("s"), scores.lift(once).alias("l"), scores.lift(scores.lift(once)).alias("ll"), won.alias("w"), scores.of_mover(won, F.col("n")).alias("m"), scores.exact(F.col("v")).alias("e")).collect():
        assert (r.s, r.l, r.ll, r.e) == (4 * r.d + r.v, 4 * r.d + 4 + 2 - r.v, 4 * r.d + 8 + r.v, 144 + r.v)
        assert r.m == r.v - 1 and r.w == (0 if r.v == 1 else 1 if (r.v == 2) == (r.n == 10) else 2)


def test_moments_of_a_ratio(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randrange(1, 9), rng.random() * 10) for _ in range(500)] + [("a", 0, 5.0), ("a", None, 5.0), ("b", 3, None), ("none", 0, 1.0), (None, 2, 3.0)]
    got = {r.k: r for r in ratio_moments(spark.createDataFrame(rows, "k string, w long, p double"), ["k"], "w", "p").collect()}
    for k in ("a", "b", None):
        units = [p / w for x, w, p in rows if x == k and w and p is not None for _ in range(w)]
        mean = math.fsum(units) / len(units)
        assert got[k].whole == len(units) and got[k].mean == pytest.approx(mean) and got[k].dev == pytest.approx(math.sqrt(math.fsum((u - mean) ** 2 for u in units) / len(units)))
    assert got["none"].whole == 0 and got["none"].mean is None and got["none"].dev is None


def test_even_ranges_and_their_owners(spark):
    rows = [(n, k, p) for n in (0, 1, 5, 12, 37) for k in (1, 3, 7, 40) for p in range(k)]
    low, high = ranges.even_range(F.col("n"), F.col("k"), F.col("p"))
    got = spark.createDataFrame(rows, "n long, k long, p long").select("n", "k", "p", low.alias("low"), high.alias("high"))
    by = {}
    for r in got.collect():
        by.setdefault((r.n, r.k), []).append(range(r.low, r.high))
    for (n, k), parts in by.items():
        assert [i for p in parts for i in p] == list(range(n)) and max(map(len, parts)) - min(map(len, parts)) <= 1 and sorted(map(len, parts), reverse=True) == list(map(len, parts)), (n, k)
    own = spark.createDataFrame([(n, k, i) for n, k in by for i in range(-1, n + 1)], "n long, k long, i long").select("n", "k", "i", ranges.owner(F.col("n"), F.col("k"), F.col("i")).alias("o"))
    assert all((r.o is None) if not 0 <= r.i < r.n else r.i in by[r.n, r.k][r.o] for r in own.collect())


def test_ranges_read_from_text(spark):
    want = {"2:5": (2, 5), ":5": (0, 5), "2:": (2, 9), ":": (0, 9), "9:9": (9, 9), "5:2": None, "2:10": None, "2": None, "a:b": None, "-1:3": None, "1:2:3": None, "": None, None: None}
    low, high = ranges.read_range(F.col("t"), b.lit(9))
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", low.alias("low"), high.alias("high")).collect()
    assert {r.t: None if r.low is None else (r.low, r.high) for r in got} == want


def test_distinct_sketch_is_within_its_error(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 30_011).alias("v"))
    for r in df.groupBy("k").agg(F.approx_count_distinct("v", 0.02).alias("n"), F.count_distinct("v").alias("want")).collect():
        assert abs(r.n - r.want) <= 4 * 0.02 * r.want  # four standard errors
