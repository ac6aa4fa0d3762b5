"""Bijections, gathered shards, interleaved slices, comparisons, closure and reachability against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F
from test_core import five, turned

from quadrille.functions import geometry as g
from quadrille.operators import compare, interleave, shards
from quadrille.plans.closure import descendants
from quadrille.plans.reachable import reachable


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1009, 4096])
def test_bijection_of_any_range(spark, n):
    df = spark.range(n).withColumnRenamed("id", "x")
    df = shards.with_inverse(shards.with_bijection(df, "x", "y", n, 3), "y", "back", n, 3)
    got = df.collect()
    assert sorted(r.y for r in got) == list(range(n)) and all(r.back == r.x for r in got)
    if n > 1000:
        assert abs(sum(1 for a, b in zip(got, got[1:], strict=False) if a.y < b.y) / n - 0.5) < 0.1


def test_bijection_of_large_ranges_and_nulls(spark):
    n = 10**15 + 37
    rows = [(None,), (0,), (n - 1,), *[(random.Random(1).randrange(n),) for _ in range(3)]]
    df = shards.with_inverse(shards.with_bijection(spark.createDataFrame(rows, "x long"), "x", "y", n), "y", "back", n)
    assert all(r.back == r.x and (r.y is None) == (r.x is None) and (r.y is None or 0 <= r.y < n) for r in df.collect())


@pytest.mark.parametrize(("total", "count"), [(1000, 8), (37, 16), (5, 8)])
def test_gathered_shards_are_those_of_the_whole_range(spark, total, count):
    whole = shards.with_bijection(spark.range(total).withColumnRenamed("id", "linear"), "linear", "p", total, 2).collect()
    for part in (range(0, count), range(2, 5)):
        want = {(r.p % count, r.p // count, r.linear) for r in whole if r.p % count in part}
        got = shards.gather(spark, part, count, total, 2)
        assert {tuple(r) for r in got.select("shard", "place", "linear").collect()} == want


def test_interleaved_slices_keep_their_shares(spark):
    sizes = {"a": 700, "b": 250, "c": 49, None: 1}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = interleave.strides(spark.createDataFrame(rows, "k long, s string"), "k", "s", epochs=2, buckets=7, digits=1).collect()
    assert len(got) == 2000
    orders = []
    for epoch in (0, 1):
        run = sorted((r for r in got if r.epoch == epoch), key=lambda r: (r.bucket, r.place))
        assert sorted(r.k for r in run) == list(range(1000)) and all(0 <= r.bucket < 7 for r in run)
        seen = collections.Counter()
        for i, r in enumerate(run, 1):
            seen[r.s] += 1
            assert all(abs(seen[s] - i * n / 1000) <= 2 for s, n in sizes.items())
        orders.append([r.k for r in run])
    assert orders[0] != orders[1]


def test_differences_are_found_and_nothing_else(spark):
    rng = random.Random(4)
    left = {i: (rng.randrange(9), None if i % 11 == 0 else f"v{i % 5}") for i in range(500)}
    right = dict(left)
    for i in (3, 77, 401):
        right[i] = (left[i][0] + 1, left[i][1])
    right[22] = (left[22][0], "was null")
    del right[100], right[499]
    right[900] = (1, None)
    rows = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "k long, a long, b string")
    block = F.expr("k div 16")
    got = {r.k: (r.what, (r.left_a, r.left_b), (r.right_a, r.right_b)) for r in compare.differences(rows(left), rows(right), ["k"], ["a", "b"], block).collect()}
    none = (None, None)
    want = {i: ("changed", left[i], right[i]) for i in (3, 77, 401, 22)} | {i: ("left only", left[i], none) for i in (100, 499)} | {900: ("right only", none, right[900])}
    assert got == want and compare.differences(rows(left), rows(left), ["k"], ["a", "b"], block).count() == 0
    samples = rows({i: left[i] for i in (3, 4, 22, 100)})
    assert {r.k for r in compare.probe(samples, rows(right), ["k"], ["a", "b"], block).collect()} == {3, 22, 100}


def test_closure_counts_sections_by_stones(spark):
    """Sections up to symmetries of the square from the empty one: fixed values."""
    got = collections.Counter(r.slice for r in descendants(spark.createDataFrame([(0,)], "section long"), 7).collect())
    assert [got[n] for n in range(8)] == [1, 1, 3, 7, 18, 31, 59, 101]
    both = descendants(spark.createDataFrame([(0,), (1,), (1 << 16,)], "section long"), 3)
    assert both.count() == 12 and both.distinct().count() == 12
    assert descendants(spark.createDataFrame([], "section long")).count() == 0


def reached(last, other):
    """Whether the empty board is reached backwards."""
    if not last:
        return True
    for m in g.rotations():
        a, o = turned(last, m), turned(other, m)
        if not five(a) and not five(o):
            for c in g.BITS:
                if a >> c & 1 and reached(o, a & ~(1 << c)):
                    return True
    return False


def test_reachable_by_search(spark):
    lines, rng, roots = g.win_masks(), random.Random(7), [(0, 0, 0)]
    pairs = [(a, c) for a in lines for c in lines if not a & c]
    # Two fives are only undone together in a quadrant that both touch.
    apart = [(a, c) for a, c in pairs if not {q for q in range(4) if a & g.LANE[q]} & {q for q in range(4) if c & g.LANE[q]}]
    for i, (a, c) in enumerate([*apart[:4], *rng.sample(pairs, 10)], 1):
        roots.append((i, a, c if i % 4 else c & (c - 1)))
    got = {r.key: r.reached for r in reachable(spark.createDataFrame(roots, "key long, black long, white long"), 10).collect()}
    for key, black, white in roots:
        n = (black | white).bit_count()
        if key in [1, 2, 3]:
            assert not got[key]  # each turn leaves one of the fives
        else:
            assert got[key] == (reached(black, white) if n % 2 else reached(white, black))
