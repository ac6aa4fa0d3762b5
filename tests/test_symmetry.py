"""The group of 2048 symmetries, sets of rotations, numbered subsets and packed endgames against plain Python."""

import functools
import itertools
import random
from math import comb

import pytest
from pyspark.sql import functions as F
from test_core import five, packed, random_sides, turned

from quadrille.functions import boards as b
from quadrille.functions import geometry as g
from quadrille.functions import subsets, supers
from quadrille.functions import symmetries as sy
from quadrille.plans import packed as plan
from quadrille.plans.retrograde import solve
from quadrille.plans.tables import materialize
from quadrille.sources.positions import endgames, every_board


def act(s, side):
    for q in range(4):
        side = turned(side, g.quarter_turn(q, s >> 2 * q & 3))
    return turned(side, g.square_symmetries()[s >> 8])


def rotated(side, i):
    return act(i, side)


def test_products_inverses_and_images(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(2048), rng.randrange(2048)) for _ in range(200)] + [(0, 0), (2047, 1024)]
    probe = random_sides(rng, 1)[0][0] | 1
    df = sy.with_inverse(sy.with_product(spark.createDataFrame(pairs, "a long, b long"), "a", "b", "p"), "a", "i")
    for r in sy.with_moved(df.withColumn("x", F.lit(probe)), "x", "a", "y").collect():
        assert all(act(r.p, 1 << c) == act(r.a, act(r.b, 1 << c)) and act(r.i, act(r.a, 1 << c)) == 1 << c for c in g.BITS)
        assert r.y == act(r.a, probe)


def test_least_board_of_all_symmetries_and_the_first_that_gives_it(spark):
    rng = random.Random(4)
    sides = random_sides(rng, 12) + [(1 << x, 0) for x in (0, 4, 56)] + [(0, 0), (g.FULL, 0), (1 << 4 | 1 << 20, 1 << 36 | 1 << 52)]
    found = sy.with_witness(spark.createDataFrame(sides, "s0 long, s1 long"), "s0", "s1", "least", "symmetry").collect()
    for r in found:
        assert (r.least, r.symmetry) == min((packed(act(s, r.s0), act(s, r.s1)), s) for s in range(2048))


def words(held):
    held = list(held)
    return [sum(1 << i % 64 for i in held if i // 64 == k) for k in range(4)]


def unsigned(r, name):
    return [r[f"{name}{k}"] & (1 << 64) - 1 for k in range(4)]


def test_sets_of_fives_and_their_images(spark):
    rng = random.Random(5)
    sides = [(sum(1 << x for x in g.BITS if rng.random() < p), rng.randrange(2048)) for p in (0, 0.4, 0.6, 0.8, 1) for _ in range(8)]
    df = supers.with_transformed(supers.with_fives(spark.createDataFrame(sides, "s long, k long"), "s", "w"), "w", F.col("k"), "v")
    df = df.selectExpr("*", *[f"{c} AS n{i}" for i, c in enumerate(supers.near([f"w{k}" for k in range(4)]))])
    df = df.select("*", *[c.alias(f"m{i}") for i, c in enumerate(supers.rmax([F.col(f"w{k}") for k in range(4)]))])
    for r in df.collect():
        assert unsigned(r, "w") == words(i for i in range(256) if five(rotated(r.s, i)))
        assert unsigned(r, "v") == words(i for i in range(256) if five(rotated(act(r.k, r.s), i)))
        assert unsigned(r, "n") == unsigned(r, "m")


def method_sizes(spark, df):
    """Bytes of the largest generated method of each stage of a plan; -1 where it doesn't compile."""
    package = spark.sparkContext._jvm.org.apache.spark.sql.execution.debug
    found = getattr(getattr(package, "package$"), "MODULE$").codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return [found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())]


@pytest.mark.parametrize("name", ["any_turn_status", "stabilizer_counts", "rotation_set_images", "canonical_turns", "canonical_witness", "canonical_symmetry", "rotated_status", "section_children", "placements_summary"])
def test_board_queries_compile_to_small_methods(spark, name):
    from quadrille import catalog

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = method_sizes(spark, catalog.queries()[name](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and all(0 < x <= 8000 for x in sizes)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535"


@pytest.mark.parametrize(("n", "k"), [(6, 3), (18, 2), (5, 0), (4, 4)])
def test_subsets_are_numbered_in_order(spark, n, k):
    df = subsets.with_subset(spark.range(comb(n, k)).withColumnRenamed("id", "i"), "i", n, k, "m")
    got = df.select("i", "m", subsets.rank(F.col("m"), n).alias("rank")).orderBy("i").collect()
    want = sorted(sum(1 << x for x in c) for c in itertools.combinations(range(n), k))
    assert [r.m for r in got] == want and all(r.i == r["rank"] for r in got)


def negamax(us, them):
    """The value of a position without five for its mover, by search."""

    @functools.lru_cache(None)
    def value(us, them):
        best = -1
        for c in g.BITS:
            if (us | them) >> c & 1:
                continue
            placed = us | 1 << c
            if five(placed):
                return 1
            for m in g.rotations():
                a, o = turned(placed, m), turned(them, m)
                f, h = five(a), five(o)
                v = f - h if f or h else 0 if a | o == g.FULL else -value(o, a)
                best = max(best, v)
                if best == 1:
                    return 1
        return best

    return value(us, them)


def roots_of(spark, empties, keys):
    r = materialize(endgames(spark.range(keys).withColumnRenamed("id", "k"), "k", empties), "roots")
    return r.where(~b.won(F.col("us")) & ~b.won(F.col("them")))


@pytest.mark.parametrize(("empties", "keys"), [(1, 30), (3, 30), (4, 16)])
def test_packed_endgame_equals_the_flat_one(spark, empties, keys):
    roots = roots_of(spark, empties, keys)
    flat = {(r.key, r.us, r.them): r.value for r in solve(roots, empties)[0].collect()}
    found = plan.levels(roots, empties)
    assert flat and {(r.key, r.mover, r.other): r.v for r in found[-1].select("*", plan.value().alias("v")).collect()} == flat
    sizes = [comb(empties, n) * comb(n, n // 2) for n in reversed(range(empties))]
    assert [df.count() for df in found] == [x * len(flat) for x in sizes]


@pytest.mark.parametrize(("empties", "keys"), [(5, 6), (6, 5)])
def test_packed_endgame_by_search(spark, empties, keys):
    found = plan.levels(roots_of(spark, empties, keys), empties)[-1].select("*", plan.value().alias("v")).collect()
    assert found and all(r.v == negamax(r.mover, r.other) for r in found)


def test_packed_endgame_of_turned_boards(spark):
    """A rotation's bit is the value of the board turned so, where no side has five yet."""
    found = plan.with_decided(plan.levels(roots_of(spark, 2, 8), 2)[-1]).collect()
    for r in found:
        win, safe, over = (words_of(r, x) for x in ("win", "safe", "over"))
        for i in range(0, 256, 5):
            us, them = rotated(r.mover, i), rotated(r.other, i)
            assert (i in over) == (five(us) or five(them))
            if i not in over:
                assert (i in win) + (i in safe) - 1 == negamax(us, them)


def words_of(r, name):
    return {i for i in range(256) if unsigned(r, name)[i // 64] >> i % 64 & 1}


@pytest.mark.parametrize(("stones", "want"), [(0, (1, 1, 1)), (1, (36, 6, 3)), (3, (21420, 2715, 227)), (4, (353430, 44481, 2013))])
def test_every_board_is_made_once(spark, stones, want):
    """Boards as they stand, up to the square's symmetries, and up to turns of quadrants too."""
    df = sy.with_witness(every_board(spark, stones), "black", "white", "mod2048", "symmetry")
    df = df.select(b.pack(F.col("black"), F.col("white")).alias("mod1"), b.unfused(b.canonical(F.col("black"), F.col("white"))).alias("mod8"), "mod2048")
    assert tuple(df.agg(*[F.count_distinct(c) for c in ("mod1", "mod8", "mod2048")]).first()) == want
