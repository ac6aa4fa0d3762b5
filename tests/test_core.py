"""Geometry, column functions and backward solving against plain Python."""

import itertools
import random

from pyspark.sql import functions as F

from quadrille.functions import boards as b
from quadrille.functions import geometry as g
from quadrille.functions import supers
from quadrille.operators import intervals, moves, shards
from quadrille.plans.retrograde import solve
from quadrille.sources.positions import positions, read_names, read_npy
from quadrille.streaming import events


def turned(side, table):
    out = side & ~sum(1 << x for x in table)
    for x, y in table.items():
        out |= (side >> x & 1) << y
    return out


def five(side):
    return any(side & m == m for m in g.win_masks())


def packed(a, c):
    return sum(((a >> 16 * q + i & 1) + 2 * (c >> 16 * q + i & 1)) * 3**i << 16 * q for q in range(4) for i in range(9))


def random_sides(rng, n):
    out = []
    for _ in range(n):
        cells = [rng.randrange(3) for _ in g.BITS]
        out.append(tuple(sum(1 << x for x, c in zip(g.BITS, cells, strict=True) if c == k) for k in (1, 2)))
    return out


def test_geometry():
    assert len(g.win_masks()) == 32 and len(set(g.BITS)) == 36
    assert len({tuple(sorted(t.items())) for t in g.square_symmetries()}) == 8
    for t in g.rotations():
        assert sorted(t) == sorted(t.values())


def test_board_functions(spark):
    sides = random_sides(random.Random(1), 60)
    df = spark.createDataFrame(sides, "a long, c long")
    a, c = F.col("a"), F.col("c")
    df = df.select("a", "c", b.pack(a, c).alias("board"), b.won(a).alias("won"), b.rotated_won(a).alias("near"), b.canonical(a, c).alias("canon"), b.orbit_size(a, c).alias("orbit"))
    df = b.with_super_canonical(df, "a", "c", "super")
    df = b.with_closeness(df, a, c, "close").select("*", b.unpack(F.col("board"), 0).alias("a2"), b.unpack(F.col("board"), 1).alias("c2"))
    for r in df.collect():
        assert r.board == packed(r.a, r.c) and (r.a2, r.c2) == (r.a, r.c)
        assert r.won == five(r.a)
        assert r.near == (five(r.a) or any(five(turned(r.a, t)) for t in g.rotations()))
        images = [packed(turned(r.a, t), turned(r.c, t)) for t in g.square_symmetries()]
        assert r.canon == min(images) and r.orbit == len(set(images))
        least = []
        for t in g.square_symmetries():
            x, y = turned(r.a, t), turned(r.c, t)
            quads = [min((packed(turned(x, g.quarter_turn(q, k)), turned(y, g.quarter_turn(q, k))) >> 16 * q) & 0xFFFF for k in range(4)) for q in range(4)]
            least.append(sum(v << 16 * q for q, v in enumerate(quads)))
        assert r.super == min(least)
        away = [6 if r.c & m else 5 - (r.a & m).bit_count() for m in g.win_masks()]
        assert r.close == (0 if min(away) == 6 else (6 - min(away)) * 65536 + away.count(min(away)))


def test_rmax_is_one_turn_away(spark):
    rng = random.Random(2)
    rows = [[rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) for _ in range(4)] for _ in range(40)]
    signed = [[w - (1 << 64) if w >> 63 else w for w in r] for r in rows]
    df = spark.createDataFrame(signed, "w0 long, w1 long, w2 long, w3 long")
    got = df.select(*[c.alias(f"r{i}") for i, c in enumerate(supers.rmax([F.col(f"w{k}") for k in range(4)]))]).collect()
    for words, r in zip(rows, got, strict=True):
        held = {64 * k + i for k in range(4) for i in range(64) if words[k] >> i & 1}
        near = set()
        for x in held:
            for step in (1, 4, 16, 64):
                digit = x // step % 4
                near |= {x + ((digit + d) % 4 - digit) * step for d in (1, 3)}
        assert near == {64 * k + i for k in range(4) for i in range(64) if (r[k] & (1 << 64) - 1) >> i & 1}


def value(us, them):
    best = -1
    for x in g.BITS:
        if (us | them) >> x & 1:
            continue
        placed = us | 1 << x
        if five(placed):
            return 1
        for t in g.rotations():
            a, c = turned(placed, t), turned(them, t)
            fa, fc = five(a), five(c)
            v = fa - fc if fa or fc else 0 if a | c == g.FULL else -value(c, a)
            best = max(best, v)
    return best


def test_backward_solving_matches_negamax(spark):
    rng = random.Random(3)
    for empties, count in ((2, 6), (4, 1)):
        roots = []
        while len(roots) < count:
            cells = rng.sample(g.BITS, 36)[empties:]
            half = len(cells) // 2
            us, them = sum(1 << x for x in cells[:half]), sum(1 << x for x in cells[half:])
            if not five(us) and not five(them):
                roots.append((len(roots), us, them))
        values, moves = solve(spark.createDataFrame(roots, "key long, us long, them long"), empties)
        assert {r.key: r.value for r in values.collect()} == {k: value(u, t) for k, u, t in roots}
        assert {r.key: r.value for r in moves.groupBy("key").agg(F.max("value").alias("value")).collect()} == {k: value(u, t) for k, u, t in roots}


def test_permutation_and_intervals(spark):
    df = shards.with_permuted(spark.range(1 << 10), "id", "x", 10)
    df = shards.with_unpermuted(df, "x", "back", 10).collect()
    assert sorted(r.x for r in df) == list(range(1 << 10)) and all(r.back == r.id for r in df)
    spans = spark.createDataFrame([(1, 0, 10), (1, 5, 7), (1, 12, 15), (1, 40, 41), (2, 0, 1)], "k long, s long, e long")
    assert sorted(tuple(r) for r in intervals.merge(spans, ["k"], "s", "e", 3).collect()) == [(1, 0, 15, 3), (1, 40, 41, 1), (2, 0, 1, 1)]
    assert {(r.k, r.bucket): r.covered for r in intervals.rasterize(spans, ["k"], "s", "e", 10).collect()} == {(1, 0): 12, (1, 1): 3, (1, 4): 1, (2, 0): 1}


def test_names_and_arrays(spark, tmp_path):
    import numpy as np

    names = [("0",), ("5539990491619131392m",), ("99999999999999999999",), ("x",), (None,), ("65535",)]
    got = {r.name: (r.board, r.middle, r.well_formed) for r in read_names(spark.createDataFrame(names, "n string"), "n").collect()}
    assert got["0"] == (0, False, True) and got["5539990491619131392m"][1:] == (True, True)
    assert got["99999999999999999999"][2] is False and got["x"][2] is False and got[None][2] is False and got["65535"][2] is False
    np.save(tmp_path / "a.npy", np.arange(6).reshape(3, 2))
    assert sorted(tuple(r) for r in read_npy(spark, str(tmp_path), ["p", "q"]).collect()) == [(0, 1), (2, 3), (4, 5)]


def test_counts_of_different_boards(spark):
    # Boards with 0 to 3 stones, as they stand, up to the square's symmetries, and up to turns of quadrants too.
    want = {0: (1, 1, 1), 1: (36, 6, 3), 2: (1260, 165, 30), 3: (21420, 2715, 227)}
    rows = []
    for n in want:
        for cells in itertools.combinations(g.BITS, n):
            for first in itertools.combinations(cells, (n + 1) // 2):
                rows.append((n, sum(1 << x for x in first), sum(1 << x for x in cells if x not in first)))
    df = spark.createDataFrame(rows, "n int, a long, c long")
    df = b.with_super_canonical(df.withColumn("mod8", b.canonical(F.col("a"), F.col("c"))), "a", "c", "mod2048")
    got = df.groupBy("n").agg(F.count(F.lit(1)), F.count_distinct("mod8"), F.count_distinct("mod2048")).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want


def all_turns(side, i):
    for q in range(4):
        side = turned(side, g.quarter_turn(q, i >> 2 * q & 3))
    return side


def test_sets_of_rotations(spark):
    sides = [s for pair in random_sides(random.Random(5), 12) for s in pair]
    w = supers.with_fives(spark.createDataFrame([(s,) for s in sides], "s long"), "s", "w")
    words = [F.col(f"w{k}") for k in range(4)]
    images = [F.array(*supers.permuted(words, supers.image_of(m))).alias(f"i{k}") for k, m in enumerate(g.square_symmetries())]
    for r in w.select("s", F.array(*words).alias("w"), *images).collect():
        held = lambda x: {i for i in range(256) if x[i // 64] >> i % 64 & 1}
        assert held(r.w) == {i for i in range(256) if five(all_turns(r.s, i))}
        for k, m in enumerate(g.square_symmetries()):
            assert held(r[f"i{k}"]) == {i for i in range(256) if five(all_turns(turned(r.s, m), i))}


def test_moves_add_up(spark):
    rng = random.Random(6)
    rows = [(k, a, c) for k, (a, c) in enumerate(random_sides(rng, 25))]
    rows += [(100, 0, 0), (101, g.LANE[0], g.LANE[1] | g.LANE[2]), (102, 1 << 4, 1 << 20), (103, g.FULL, 0)]
    got = {r.key: r for r in moves.summary(spark.createDataFrame(rows, "key long, a long, c long"), "a", "c").collect()}
    for key, a, c in rows:
        boards, over = [], 0
        for x in g.BITS:
            if not (a | c) >> x & 1:
                for t in g.rotations():
                    mine, theirs = turned(a | 1 << x, t), turned(c, t)
                    boards.append(packed(theirs, mine))
                    over += five(mine) or five(theirs)
        if not boards:
            assert key not in got
            continue
        check = 0
        for x in boards:
            check ^= x
        assert tuple(got[key])[3:] == (len(boards), len(set(boards)), check, over)


def test_positions_of_large_keys(spark):
    assert positions(spark.createDataFrame([(6 * 10**10,), (9 * 10**18,)], "k long"), "k").count() == 2


def test_streams_over_batches_and_a_restart(spark, tmp_path):
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    kinds = ["view", "click", "purchase"]
    rows = [(i, at(m), u, kinds[i % 3]) for i, (m, u) in enumerate([(0, 1), (20, 1), (100, 1), (5, 2), (45, 1), (300, 2), (101, 1), (7, 3)])]
    path = tmp_path / "in"
    put = lambda part: spark.createDataFrame(part, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.mode("append").parquet(str(path))

    def want(part):
        out = []
        for u in {r[2] for r in part}:
            times = sorted(r[1] for r in part if r[2] == u)
            groups = [[times[0]]]
            for x in times[1:]:
                if x - groups[-1][-1] < datetime.timedelta(minutes=30):
                    groups[-1].append(x)
                else:
                    groups.append([x])
            out += [(u, y[0], y[-1], len(y)) for y in groups]
        return sorted(out)

    put(rows[:3])
    put(rows[3:5])
    get = lambda: sorted(tuple(r) for r in events.sessions(spark, str(path), folder=f"{tmp_path}/s", files=1).collect())
    assert get() == want(rows[:5])
    put(rows[5:])
    assert get() == want(rows) == get()
    seen = {r.user_id: (r.seen, r.complete) for r in events.arrivals(spark, str(path), kinds, files=1).collect()}
    assert seen == {u: (s := sum({1 << kinds.index(r[3]) for r in rows if r[2] == u}), s == 7) for u in (1, 2, 3)}
