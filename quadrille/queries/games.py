"""Queries on sets of rotations, on merged bits and on exact values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boards as b
from ..functions import geometry as g
from ..functions import sections as sec
from ..functions import supers
from ..plans.retrograde import solve
from ..plans.tables import materialize
from ..sources.positions import endgames, positions, table, write_names
from . import sqltext as t


def rotation_sets(spark, sf_dir):
    """For each customer's position with a five somewhere: rotations where the first side has five, and those one turn away from one."""
    p = positions(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("key", "s0").distinct()
    # Written first: pushed down, the filter would repeat the sets' expressions in full.
    w = materialize(supers.with_fives(p, "s0", "w"), "rotation-sets").where(" OR ".join(f"w{k} <> 0" for k in range(4)))
    words = [F.col(f"w{k}") for k in range(4)]
    w = w.select("*", *[c.alias(f"r{k}") for k, c in enumerate(supers.rmax(words))])
    near = [F.col(f"r{k}") for k in range(4)]
    return w.select("key", supers.popcount(words).alias("fives"), supers.popcount(near).alias("near"), supers.popcount([x.bitwiseAND(y) for x, y in zip(words, near, strict=True)]).alias("both"), *[F.bit_count(x).cast("long").alias(f"n{k}") for k, x in enumerate(near)])


def _lane(q: int) -> str:
    return "CASE r" + str(q) + " " + " ".join(f"WHEN {k} THEN {t.moved('s0', g.quarter_turn(q, k))} & {g.LANE[q]}" for k in range(4)) + " END"


ROTATION_SETS = f"""WITH {t.positions("customer", "c_custkey")}, k AS (SELECT DISTINCT key, s0 FROM p),
r AS (SELECT i, i & 3 AS r0, (i >> 2) & 3 AS r1, (i >> 4) & 3 AS r2, i >> 6 AS r3 FROM (SELECT unnest(range(256)) AS i)),
w AS (SELECT key, i, r0, r1, r2, r3 FROM (SELECT key, r.*, ({_lane(0)}) | ({_lane(1)}) | ({_lane(2)}) | ({_lane(3)}) AS side FROM k, r) WHERE {t.won("side")}),
e AS (SELECT a.i, b.i AS j FROM r a, r b WHERE CASE WHEN a.r0 = b.r0 THEN 0 WHEN (a.r0 - b.r0 + 4) % 4 = 2 THEN 9 ELSE 1 END + CASE WHEN a.r1 = b.r1 THEN 0 WHEN (a.r1 - b.r1 + 4) % 4 = 2 THEN 9 ELSE 1 END + CASE WHEN a.r2 = b.r2 THEN 0 WHEN (a.r2 - b.r2 + 4) % 4 = 2 THEN 9 ELSE 1 END + CASE WHEN a.r3 = b.r3 THEN 0 WHEN (a.r3 - b.r3 + 4) % 4 = 2 THEN 9 ELSE 1 END = 1),
n AS (SELECT DISTINCT key, e.i FROM w JOIN e ON w.i = e.j),
a AS (SELECT key, count(*) AS fives FROM w GROUP BY key),
c AS (SELECT key, count(*) AS near, {", ".join(f"count(*) FILTER (i // 64 = {k}) AS n{k}" for k in range(4))} FROM n GROUP BY key),
d AS (SELECT key, count(*) AS "both" FROM n JOIN w USING (key, i) GROUP BY key)
SELECT key, fives, near, coalesce("both", 0) AS "both", n0, n1, n2, n3 FROM a JOIN c USING (key) LEFT JOIN d USING (key)"""


def _customers(spark, sf_dir):
    return positions(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").distinct()


_TURNED = f"""k AS (SELECT DISTINCT key, s0, s1 FROM p), r AS (SELECT i, i & 3 AS r0, (i >> 2) & 3 AS r1, (i >> 4) & 3 AS r2, i >> 6 AS r3 FROM (SELECT unnest(range(256)) AS i))"""
_ANY_SIDE = lambda side: " | ".join(f"({_lane(q)})" for q in range(4)).replace("s0", side)


def any_turn_status(spark, sf_dir):
    """Whether either side of each customer's position has five after any turns of quadrants at all."""
    w = supers.with_fives(supers.with_fives(_customers(spark, sf_dir), "s0", "a"), "s1", "b")
    some = lambda x: " OR ".join(f"{x}{k} <> 0" for k in range(4))
    return w.select("key", F.expr(some("a")).alias("first"), F.expr(some("b")).alias("second"))


ANY_TURN_STATUS = f"""WITH {t.positions("customer", "c_custkey")}, {_TURNED}, f AS (SELECT key, {_ANY_SIDE("s0")} AS a, {_ANY_SIDE("s1")} AS b FROM k, r)
SELECT key, bool_or({t.won("a")}) AS first, bool_or({t.won("b")}) AS second FROM f GROUP BY key"""


def stabilizer_counts(spark, sf_dir):
    """By section: rotations that give either side five, and all rotations, each different board counted once, and times the section's images."""
    p = b.with_turned(_customers(spark, sf_dir), "s0", "s1", "t")
    parts = sec.counts(F.col("s0"), F.col("s1"))
    p = p.select("key", "s0", "s1", b.stabilizer_log([F.col(f"t{i}") for i in range(4)]).alias("shift"), sec.standard(parts).alias("section"), sec.images(parts).alias("images"))
    w = supers.with_fives(supers.with_fives(p, "s0", "a"), "s1", "b")
    shifted = lambda x: F.call_function("shiftright", x, F.col("shift"))
    w = w.select("section", "images", shifted(supers.popcount([F.col(f"a{k}") for k in range(4)])).alias("first"), shifted(supers.popcount([F.col(f"b{k}") for k in range(4)])).alias("second"), shifted(b.lit(256)).alias("boards"))
    return w.groupBy("section").agg(F.sum("first").alias("first"), F.sum("second").alias("second"), F.sum("boards").alias("boards"), F.sum(F.col("boards") * F.col("images")).alias("weighted"))


STABILIZER_COUNTS = f"""WITH {t.positions("customer", "c_custkey")}, {_TURNED}, f AS (SELECT key, s0, s1, {_ANY_SIDE("s0")} AS a, {_ANY_SIDE("s1")} AS b FROM k, r),
d AS (SELECT DISTINCT key, s0, s1, a, b FROM f),
c AS (SELECT key, s0, s1, sum({t.won("a")}::BIGINT)::BIGINT AS first, sum({t.won("b")}::BIGINT)::BIGINT AS second, count(*) AS boards FROM d GROUP BY ALL)
SELECT {t.standard(t.counts())} AS section, sum(first)::BIGINT AS first, sum(second)::BIGINT AS second, sum(boards)::BIGINT AS boards, sum(boards * {t.images(t.counts())})::BIGINT AS weighted FROM c GROUP BY 1"""


def rotation_set_images(spark, sf_dir):
    """The rotations that give the first side of each customer's position five, for the eight images of the board: the set itself is permuted."""
    w = supers.with_fives(_customers(spark, sf_dir), "s0", "w")
    each = w.select("key", *[f"w{k}" for k in range(4)], F.explode(F.sequence(b.lit(0), b.lit(7))).alias("symmetry"))
    moved = supers.with_transformed(each, "w", F.col("symmetry") * 256, "v")
    return moved.select("key", "symmetry", *[F.col(f"v{k}").alias(f"w{k}") for k in range(4)])


_IMAGES = " UNION ALL ".join(f"SELECT key, {i} AS symmetry, {t.moved('s0', m)} AS s0 FROM (SELECT DISTINCT key, s0 FROM p)" for i, m in enumerate(g.square_symmetries()))
_WORD = lambda k: f"(CASE WHEN h{k} >= 9223372036854775808 THEN h{k} - 18446744073709551616 ELSE h{k} END)::BIGINT AS w{k}"
ROTATION_SET_IMAGES = f"""WITH {t.positions("customer", "c_custkey")}, {_TURNED}, m AS ({_IMAGES}), f AS (SELECT key, symmetry, i, {_ANY_SIDE("s0")} AS a FROM m, r),
s AS (SELECT key, symmetry, {", ".join(f"coalesce(sum(1::HUGEINT << (i & 63)::INT) FILTER (i // 64 = {k} AND {t.won('a')}), 0) AS h{k}" for k in range(4))} FROM f GROUP BY key, symmetry)
SELECT key, symmetry::BIGINT AS symmetry, {", ".join(_WORD(k) for k in range(4))} FROM s"""


def closeness_any_turns(spark, sf_dir):
    """How close each side of each customer's position is to a line of five, quadrants turned freely: the part of a line in a quadrant takes that quadrant's best turn."""
    return _closeness(_customers(spark, sf_dir), [[_turned_parts(m, q, range(4)) for q in range(4)] for m in g.win_masks()])


def closeness_one_turn(spark, sf_dir):
    """As closeness_any_turns with at most one quadrant turned once: ways are pairs of a line and a quadrant that it touches, the one that may turn."""
    ways = [(m, t) for m in g.win_masks() for t in range(4) if m & g.LANE[t]]
    return _closeness(_customers(spark, sf_dir), [[_turned_parts(m, q, (0, 1, 3, 3) if q == t else (0, 0, 0, 0)) for q in range(4)] for m, t in ways])


def _turned_parts(line: int, q: int, turns) -> list[int]:
    """A line's part in a quadrant, after each of some numbers of quarter turns."""
    return [sum(1 << g.quarter_turn(q, r)[x] for x in g.BITS if line >> x & 1 and x // 16 == q) for r in turns]


def _closeness(p, masks: list[list[list[int]]]):
    """key, close0, close1 of positions (key, s0, s1): (6 - least) * 65536 + how many ways come that close, 0 if all are blocked. A way is four quadrants' parts, each with four forms of which the best counts."""
    rows = p.select("key", "s0", "s1", F.explode(F.expr("cast(array(" + ",".join("array(" + ",".join("array(" + ",".join(f"{x}L" for x in part) + ")" for part in line) + ")" for line in masks) + ") as array<array<array<bigint>>>)")).alias("line"))

    def cost(us: str, them: str):
        part = lambda m: F.when(F.col(them).bitwiseAND(m) != 0, 6).otherwise(F.bit_count(m.bitwiseAND(F.bitwise_not(F.col(us)))))
        return F.least(sum(F.least(*[part(F.col("line")[q][r]) for r in range(4)]) for q in range(4)), F.lit(6))

    rows = rows.select("key", cost("s0", "s1").alias("d0"), cost("s1", "s0").alias("d1"))
    best = rows.groupBy("key").agg(*[F.min(F.struct(F.col(d).alias("least"))).alias(d) for d in ("d0", "d1")], *[F.count_if(F.col(d) == k).alias(f"{d}_{k}") for d in ("d0", "d1") for k in range(6)])
    of = lambda d: F.coalesce(*[F.when(F.col(f"{d}.least") == k, F.lit((6 - k) * 65536) + F.col(f"{d}_{k}")) for k in range(6)], b.lit(0))
    return best.select("key", of("d0").alias("close0"), of("d1").alias("close1"))


def _any_close(us: str, them: str) -> str:
    return f"SELECT key, CASE WHEN min(d) = 6 THEN 0 ELSE (6 - min(d)) * 65536 + count(*) FILTER (d = low) END AS close FROM (SELECT *, min(d) OVER (PARTITION BY key) AS low FROM (SELECT key, mask, min(CASE WHEN ({them} & mask) <> 0 THEN 6 ELSE 5 - bit_count({us} & mask) END) AS d FROM f, (SELECT unnest([{', '.join(map(str, g.win_masks()))}]) AS mask) GROUP BY key, mask)) GROUP BY key"


CLOSENESS_ANY_TURNS = f"""WITH {t.positions("customer", "c_custkey")}, {_TURNED}, f AS (SELECT key, {_ANY_SIDE("s0")} AS a, {_ANY_SIDE("s1")} AS b FROM k, r), x AS ({_any_close("a", "b")}), y AS ({_any_close("b", "a")})
SELECT key, x.close::BIGINT AS close0, y.close::BIGINT AS close1 FROM x JOIN y USING (key)"""


_WAYS = ", ".join(f"({m}, {q})" for m in g.win_masks() for q in range(4) if m & g.LANE[q])
_ONE_TURN = " UNION ALL ".join(f"SELECT key, {q} AS q, {t.moved('s0', g.quarter_turn(q, r))} AS a, {t.moved('s1', g.quarter_turn(q, r))} AS b FROM k" for q in range(4) for r in (0, 1, 3))


def _one_turn_close(us: str, them: str) -> str:
    return f"SELECT key, CASE WHEN min(d) = 6 THEN 0 ELSE (6 - min(d)) * 65536 + count(*) FILTER (d = low) END AS close FROM (SELECT *, min(d) OVER (PARTITION BY key) AS low FROM (SELECT key, mask, f.q, min(CASE WHEN ({them} & mask) <> 0 THEN 6 ELSE 5 - bit_count({us} & mask) END) AS d FROM f JOIN ways USING (q) GROUP BY key, mask, f.q)) GROUP BY key"


CLOSENESS_ONE_TURN = f"""WITH {t.positions("customer", "c_custkey")}, k AS (SELECT DISTINCT key, s0, s1 FROM p), ways(mask, q) AS (VALUES {_WAYS}), f AS ({_ONE_TURN}),
x AS ({_one_turn_close("a", "b")}), y AS ({_one_turn_close("b", "a")}) SELECT key, x.close::BIGINT AS close0, y.close::BIGINT AS close1 FROM x JOIN y USING (key)"""


def or_accumulate(spark, sf_dir):
    """Bits that lines of an order contribute, merged by OR, AND and XOR: partial and final aggregation."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.call_function("shiftleft", b.lit(1), (F.col("l_partkey") % 62).cast("int")).alias("bit"))
    return lines.groupBy("l_orderkey").agg(F.bit_or("bit").alias("any"), F.bit_and("bit").alias("all"), F.bit_xor("bit").alias("odd"), F.bit_count(F.bit_or("bit")).cast("long").alias("n"))


OR_ACCUMULATE = 'SELECT l_orderkey, bit_or(bit) AS "any", bit_and(bit) AS "all", bit_xor(bit) AS odd, bit_count(bit_or(bit))::BIGINT AS n FROM (SELECT l_orderkey, 1::BIGINT << (l_partkey % 62)::INT AS bit FROM lineitem) GROUP BY l_orderkey'


def _roots(spark, sf_dir, name: str, key: str, empties: int):
    # Written first: pushed down, the filter would repeat the sides' expressions for every line of five.
    r = materialize(endgames(table(spark, sf_dir, name).select(key).distinct(), key, empties), "roots")
    return r.where(~b.won(F.col("us")) & ~b.won(F.col("them")))


def retrograde_two(spark, sf_dir):
    """Exact values of each customer's position with two empty cells, where neither side has five yet."""
    values, _ = solve(_roots(spark, sf_dir, "customer", "c_custkey", 2), 2)
    return values


_FIRST = " UNION ALL ".join(f"SELECT key, us, them, {t.moved('placed', m)} AS mine, {t.moved('them', m)} AS theirs FROM a WHERE NOT placed_won" for m in g.rotations())
_SECOND = " UNION ALL ".join(f"SELECT key, us, them, mine, theirs, {t.moved('placed', m)} AS x, {t.moved('mine', m)} AS y FROM d WHERE NOT placed_won" for m in g.rotations())
RETROGRADE_TWO = f"""WITH {t.endgames("customer", "c_custkey", 2)}, q AS (SELECT * FROM r WHERE NOT {t.won("us")} AND NOT {t.won("them")}),
cells AS (SELECT unnest([{", ".join(map(str, g.BITS))}]) AS bit),
a AS (SELECT *, {t.won("placed")} AS placed_won FROM (SELECT q.*, us | (1::BIGINT << bit) AS placed FROM q, cells WHERE ((us | them) & (1::BIGINT << bit)) = 0)),
b AS ({_FIRST}), f AS (SELECT *, {t.won("mine")} AS fm, {t.won("theirs")} AS ft FROM b),
d AS (SELECT *, {t.won("placed")} AS placed_won FROM (SELECT DISTINCT key, us, them, mine, theirs, theirs | ({g.FULL} & ~(mine | theirs)) AS placed FROM f WHERE NOT fm AND NOT ft)),
e AS ({_SECOND}),
v2 AS (SELECT key, us, them, mine, theirs, 1 AS v FROM d WHERE placed_won UNION ALL SELECT key, us, them, mine, theirs, {t.won("x")}::INT - {t.won("y")}::INT FROM e),
w2 AS (SELECT key, us, them, mine, theirs, max(v) AS v FROM v2 GROUP BY ALL),
v1 AS (SELECT key, us, them, 1 AS v FROM a WHERE placed_won UNION ALL SELECT key, us, them, fm::INT - ft::INT FROM f WHERE fm OR ft UNION ALL SELECT key, us, them, -v FROM w2)
SELECT key, us, them, max(v)::BIGINT AS value FROM v1 GROUP BY key, us, them"""


def retrograde_three(spark, sf_dir):
    """Exact values of each supplier's position with three empty cells, and how its moves share out into wins, ties and losses."""
    _, moves = solve(_roots(spark, sf_dir, "supplier", "s_suppkey", 3), 3)
    of = lambda v: F.count_if(F.col("value") == v)
    return moves.groupBy("key", "us", "them").agg(F.max("value").alias("value"), of(1).alias("wins"), of(0).alias("ties"), of(-1).alias("losses"))


def value_histogram(spark, sf_dir):
    """Losses, ties and wins among the customers' positions with one empty cell."""
    values, _ = solve(_roots(spark, sf_dir, "customer", "c_custkey", 1), 1)
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


_LAST = " UNION ALL ".join(f"SELECT key, us, them, {i} AS turn, {t.moved('placed', m)} AS mine, {t.moved('them', m)} AS theirs FROM a WHERE NOT placed_won" for i, m in enumerate(g.rotations()))
_ONE = f"""{t.endgames("customer", "c_custkey", 1)}, q AS (SELECT * FROM r WHERE NOT {t.won("us")} AND NOT {t.won("them")}),
a AS (SELECT *, {t.won("placed")} AS placed_won FROM (SELECT q.*, {g.FULL} & ~them AS placed FROM q)), b AS ({_LAST}),
v AS (SELECT key, us, them, NULL AS turn, 1 AS value FROM a WHERE placed_won UNION ALL SELECT key, us, them, turn, {t.won("mine")}::INT - {t.won("theirs")}::INT FROM b)"""
VALUE_HISTOGRAM = f"WITH {_ONE}, m AS (SELECT key, us, them, max(value)::BIGINT AS value FROM v GROUP BY ALL) SELECT value, count(*) AS n FROM m GROUP BY value"


def value_lookup(spark, sf_dir):
    """The answer of a lookup service for each customer's last move: a name and the values of its turns in order, as JSON."""
    _, moves = solve(_roots(spark, sf_dir, "customer", "c_custkey", 1), 1)
    rows = moves.groupBy("key", "us", "them").agg(F.max("value").alias("value"), F.sort_array(F.collect_list(F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), F.col("value").alias("value")))).alias("turns"))  # nine rows at most
    name = write_names(b.pack(F.col("us"), F.col("them")), F.lit(False))
    return rows.select("key", name.alias("name"), F.to_json(F.struct(F.col("value").alias("value"), F.transform("turns", lambda x: x["value"]).alias("turns"))).alias("answer"))


VALUE_LOOKUP = f"""WITH {_ONE} SELECT key, {t.pack("us", "them")}::VARCHAR AS name, '{{"value":' || max(value) || ',"turns":[' || string_agg(value::VARCHAR, ',' ORDER BY coalesce(turn, -1)) || ']}}' AS answer FROM v GROUP BY key, us, them"""



def value_lookup_tree(spark, sf_dir):
    """The answer of a lookup service for each customer's position with two empty cells, as JSON: its value, each stone's and each turn's after it.

    Signs follow half moves: between a stone and its turn the same side is to move, after the turn the other one. A stone that makes five has no turns.
    """
    _, moves = solve(_roots(spark, sf_dir, "customer", "c_custkey", 2), 2)
    turn = F.when(F.col("turn").isNotNull(), F.struct(F.col("turn"), (-F.col("value")).alias("value")))
    stones = moves.groupBy("key", "us", "them", "cell").agg(F.max("value").alias("value"), F.sort_array(F.collect_list(turn)).alias("turns"))  # eight rows at most
    stones = stones.withColumn("turns", F.transform("turns", lambda x: x["value"]))
    roots = stones.groupBy("key", "us", "them").agg(F.max("value").alias("value"), F.sort_array(F.collect_list(F.struct("cell", "value", "turns"))).alias("children"))  # two rows at most
    return roots.select("key", write_names(b.pack(F.col("us"), F.col("them")), F.lit(False)).alias("name"), F.to_json(F.struct("value", "children")).alias("answer"))


_FIRST_TURNS = " UNION ALL ".join(f"SELECT key, us, them, cell, {i} AS turn, {t.moved('placed', m)} AS mine, {t.moved('them', m)} AS theirs FROM a WHERE NOT placed_won" for i, m in enumerate(g.rotations()))
VALUE_LOOKUP_TREE = f"""WITH {t.endgames("customer", "c_custkey", 2)}, q AS (SELECT * FROM r WHERE NOT {t.won("us")} AND NOT {t.won("them")}),
cells AS (SELECT unnest([{", ".join(map(str, g.BITS))}]) AS bit),
a AS (SELECT *, {t.won("placed")} AS placed_won FROM (SELECT q.*, 1::BIGINT << bit AS cell, us | (1::BIGINT << bit) AS placed FROM q, cells WHERE ((us | them) & (1::BIGINT << bit)) = 0)),
b AS ({_FIRST_TURNS}), f AS (SELECT *, {t.won("mine")} AS fm, {t.won("theirs")} AS ft FROM b),
d AS (SELECT *, {t.won("placed")} AS placed_won FROM (SELECT DISTINCT key, us, them, mine, theirs, theirs | ({g.FULL} & ~(mine | theirs)) AS placed FROM f WHERE NOT fm AND NOT ft)),
e AS ({_SECOND}),
v2 AS (SELECT key, us, them, mine, theirs, 1 AS v FROM d WHERE placed_won UNION ALL SELECT key, us, them, mine, theirs, {t.won("x")}::INT - {t.won("y")}::INT FROM e),
w2 AS (SELECT key, us, them, mine, theirs, max(v) AS v FROM v2 GROUP BY ALL),
m AS (SELECT key, us, them, cell, NULL AS turn, 1 AS value FROM a WHERE placed_won UNION ALL
  SELECT f.key, f.us, f.them, cell, turn, CASE WHEN fm OR ft THEN fm::INT - ft::INT ELSE -w2.v END FROM f LEFT JOIN w2 ON w2.key = f.key AND w2.us = f.us AND w2.them = f.them AND w2.mine = f.mine AND w2.theirs = f.theirs),
c AS (SELECT key, us, them, cell, max(value) AS value, '{{"cell":' || cell || ',"value":' || max(value) || ',"turns":[' || coalesce(string_agg((-value)::VARCHAR, ',' ORDER BY turn) FILTER (turn IS NOT NULL), '') || ']}}' AS said FROM m GROUP BY key, us, them, cell)
SELECT key, {t.pack("us", "them")}::VARCHAR AS name, '{{"value":' || max(value) || ',"children":[' || string_agg(said, ',' ORDER BY cell) || ']}}' AS answer FROM c GROUP BY key, us, them"""

QUERIES = {
    "rotation_sets": (rotation_sets, ROTATION_SETS),
    "any_turn_status": (any_turn_status, ANY_TURN_STATUS),
    "stabilizer_counts": (stabilizer_counts, STABILIZER_COUNTS),
    "rotation_set_images": (rotation_set_images, ROTATION_SET_IMAGES),
    "closeness_any_turns": (closeness_any_turns, CLOSENESS_ANY_TURNS),
    "closeness_one_turn": (closeness_one_turn, CLOSENESS_ONE_TURN),
    "or_accumulate": (or_accumulate, OR_ACCUMULATE),
    "retrograde_two": (retrograde_two, RETROGRADE_TWO),
    "retrograde_three": (retrograde_three, None),
    "value_histogram": (value_histogram, VALUE_HISTOGRAM),
    "value_lookup": (value_lookup, VALUE_LOOKUP),
    "value_lookup_tree": (value_lookup_tree, VALUE_LOOKUP_TREE),
}
