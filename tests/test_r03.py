"""Findings of round 3: sums of moves and products of symmetries in compiled methods, row by row."""

import random

import pytest
from test_core import five, packed, random_sides, turned
from test_symmetry import method_sizes

from quadrille.functions import geometry as g
from quadrille.functions import symmetries as sy
from quadrille.operators import moves


def summed(a, c):
    boards, over = [], 0
    for x in g.BITS:
        if not (a | c) >> x & 1:
            for t in g.rotations():
                mine, theirs = turned(a | 1 << x, t), turned(c, t)
                boards.append(packed(theirs, mine))
                over += five(mine) or five(theirs)
    check = 0
    for x in boards:
        check ^= x
    return len(boards), len(set(boards)), check, over


def test_moves_of_quadrants_that_are_nearly_their_own_turns(spark):
    rng = random.Random(7)
    states = [x for x in range(512) if any((x ^ g.turned_states(k)[x]).bit_count() <= 2 for k in (1, 2))]
    rows = []
    for k in range(250):
        a = c = 0
        for q in range(4):
            mine = rng.choice(states)
            theirs = rng.choice([y for y in states if not y & mine])
            a, c = a | mine << 16 * q, c | theirs << 16 * q
        rows.append((k, a, c))
    rows += [(1000, 0, 0), (1001, g.FULL, 0), (1002, g.FULL & ~1, 0), (1003, None, 0)]
    rows += [(1004, 5, 0), (1004, 5, 0)]  # a row stays a row, also if it occurs twice
    got = sorted(tuple(r) for r in moves.summary(spark.createDataFrame(rows, "key long, a long, c long"), "a", "c").collect())
    assert got == [(k, a, c, *summed(a, c)) for k, a, c in rows if a is not None and a | c != g.FULL]


def test_moves_of_repeated_keys_are_added_up_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from quadrille import catalog

    spark.createDataFrame([(k,) for k in (3, 4, 5, 4, 6, 5, 5, None)], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((tuple(r) for r in catalog.queries()["moves_summary"](spark, str(tmp_path)).select("key", "moves", "boards", "checksum", "over").collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == sorted(con.execute(catalog.oracle_sql()["moves_summary"]).fetchall(), key=str)


@pytest.mark.parametrize("name", ["moves_summary", "symmetry_products"])
def test_heavy_rows_compile_to_small_methods_and_stay_single(spark, name):
    from quadrille import catalog

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
        sizes, plan = method_sizes(spark, df), df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and all(0 < x <= 8000 for x in sizes)
    assert "checksum" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    assert "inline" not in plan  # no row for each turn


def test_symmetry_tables_are_those_of_the_group(spark):
    pairs = [(a, b) for a in range(0, 2048, 37) for b in range(0, 2048, 41)] + [(a, a) for a in range(2048)]
    rows = sy.with_inverse(sy.with_product(spark.createDataFrame([*pairs, (None, 1), (1, None)], "a long, b long"), "a", "b", "p"), "a", "i").collect()
    moved = [[g.BITS.index(m[x]) for x in g.BITS] for m in g.square_symmetries()]
    local = [{x: y for q in range(4) for x, y in g.quarter_turn(q, t >> 2 * q & 3).items()} for t in range(256)]
    act = [[moved[s >> 8][g.BITS.index(local[s & 255][x])] for x in g.BITS] for s in range(2048)]
    number = {tuple(m): s for s, m in enumerate(act)}
    for r in rows:
        if r.a is None or r.b is None:
            assert r.p is None and (r.i is None) == (r.a is None)
            continue
        assert r.p == number[tuple(act[r.a][x] for x in act[r.b])]
        assert [act[r.i][x] for x in act[r.a]] == list(range(36))


def test_symmetry_products_of_odd_keys_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from quadrille import catalog

    keys = [(1, 1, 5), (2, 3, 2047), (None, 1, 4), (4, 2, None), (-3000, 1, 7), (9, 1, -8), (10**12, 7, 10**12), (1, 1, 5)]
    spark.createDataFrame(keys, "l_orderkey long, l_linenumber int, l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["symmetry_products"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(con.execute(catalog.oracle_sql()["symmetry_products"]).fetchall())
