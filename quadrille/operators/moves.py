"""Moves as rows, and what all moves of a position add up to without a row for each."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.boards import any_of, completing, lane, lit, looked_up, moved, stones, unfused


def empty_bits(us: Column, them: Column) -> Column:
    """The masks of empty cells, x by x then y by y."""
    filled = us.bitwiseOR(them)
    return F.array_compact(F.array(*[F.when(filled.bitwiseAND(lit(1 << b)) == 0, lit(1 << b)) for b in g.BITS]))


def placements(df: DataFrame, us: str = "us", them: str = "them") -> DataFrame:
    """A row for each empty cell: all columns, `cell` (its mask) and `placed` (the mover's side with it)."""
    rows = df.select("*", unfused(empty_bits(F.col(us), F.col(them))).alias("__cells"))
    out = rows.select(*df.columns, F.explode_outer("__cells").alias("cell")).where("cell IS NOT NULL")  # no filter of the array's size is made of it
    return out.withColumn("placed", F.col(us).bitwiseOR(F.col("cell")))


def turns(df: DataFrame, placed: str = "placed", them: str = "them") -> DataFrame:
    """A row for each of the eight turns: all columns, `turn`, `mine` and `theirs` after it."""
    pair = [F.struct(F.lit(i).alias("turn"), moved(F.col(placed), t).alias("mine"), moved(F.col(them), t).alias("theirs")) for i, t in enumerate(g.rotations())]
    rows = df.select("*", unfused(F.array(*pair)).alias("__turns"))
    return rows.select(*df.columns, F.inline_outer("__turns"))


@lru_cache
def _kinds() -> list[int]:
    """For each of the 512 states of a quadrant in one side, in bits 0 and 1: 2 if a quarter turn leaves it as it is, 1 if only a half turn does;
    bit 2: one more stone makes it its own half turn; bit 3: one stone makes it what a quarter turn makes of it with one stone, either way round; bit 4: the same stone both times.
    """
    a, half, c = (g.turned_states(k) for k in (1, 2, 3))
    apart = lambda x, y: (x ^ y).bit_count() == 2
    return [(2 if a[x] == x else int(half[x] == x)) | apart(x, half[x]) << 2 | apart(x, a[x]) << 3 | (apart(x, a[x]) and a[x] & ~x == c[x] & ~x) << 4 for x in range(512)]


def summary(df: DataFrame, us: str, them: str) -> DataFrame:
    """df's columns with moves (a stone and a turn), boards (different ones they lead to), checksum (exclusive or of
    the boards, their side first) and over (moves that leave a five), for each row of df whose board isn't full.

    A row stays one row, so nothing is exchanged. Moves that put a stone in the same quadrant give the same board only if they turn the same
    quadrant to the same state, or quadrants that a turn leaves as they are. So boards follow from each quadrant's own states.
    A stone's quadrant comes out of two turns alike only where the other side's stones there do, and its own do or are one stone short of it (`_kinds`).
    Stones make five where they hold the last cell of a line of the turned side.
    """
    digits, quads = g.ternary(), range(g.QUADRANTS)
    turned = {d: g.turned_states(d) for d in (1, 3)}
    filled = F.col(us).bitwiseOR(F.col(them))
    lanes = [lane(side, q).alias(f"__{k}{q}") for q in quads for k, side in (("m", F.col(us)), ("h", F.col(them)), ("f", filled))]
    rows = df.select("*", unfused(F.col(us)).alias("__us"), filled.alias("__all"), *lanes)
    found = []
    for q in quads:
        mine, theirs = F.col(f"__m{q}"), F.col(f"__h{q}")
        kind = looked_up(_kinds(), mine)
        left = 9 - F.bit_count(f"__f{q}")
        found += [(left if q else unfused(left)).alias(f"__n{q}"), kind.alias(f"__k{q}"), F.least(kind.bitwiseAND(lit(3)), looked_up(_kinds(), theirs).bitwiseAND(lit(3))).alias(f"__b{q}"), looked_up(_kinds(), theirs).bitwiseAND(lit(3)).alias(f"__t{q}")]
        found += [(looked_up([digits[x] for x in t], theirs) + looked_up([digits[x] for x in t], mine) * 2).alias(f"__v{q}_{d}") for d, t in turned.items()]
        for k, side in (("x", mine), ("y", theirs)):
            held = g.held_lines(q)
            found += [looked_up([held[x] for x in g.turned_states(d)], side).alias(f"__{k}{q}_{d}") for d in (0, 1, 3)]
        for d, t in turned.items():
            found += [F.col(k).bitwiseAND(lit(~g.LANE[q])).bitwiseOR(F.shiftleft(looked_up(t, F.col(f"__{lane_of}{q}")), 16 * q)).alias(f"__{name}{q}_{d}") for k, lane_of, name in (("__us", "m", "s"), ("__all", "f", "o"))]
    rows = rows.select(*df.columns, *[f"__f{q}" for q in quads], *found)
    own, sums, over = [], [], []
    total = sum(F.col(f"__n{q}") for q in quads)
    for q in quads:
        others = [p for p in quads if p != q]
        n, kind, theirs = F.col(f"__n{q}"), F.col(f"__k{q}"), F.col(f"__t{q}")
        bit = lambda i, kind=kind: F.shiftright(kind, i).bitwiseAND(lit(1))
        ways = sum(2 - F.col(f"__b{p}") for p in others)
        both = F.when(theirs == 0, lit(0)).when(kind.bitwiseAND(lit(3)) > 0, n).otherwise(bit(2))
        unturned = F.when(theirs < 2, n).when(kind.bitwiseAND(lit(3)) == 2, lit(0)).otherwise(n - 2 * bit(3) + bit(4))
        own.append((n * ways + 2 * n - both + F.when(F.greatest(*[F.col(f"__b{p}") for p in others]) == 2, unturned).otherwise(lit(0))).alias(f"__c{q}"))
        # Every other state of this quadrant comes up an even number of times.
        v1, v3 = F.col(f"__v{q}_1"), F.col(f"__v{q}_3")
        placed = lambda d, i, q=q: F.col(f"__v{q}_{d}") + 2 * digits[turned[d][1 << i]]
        stones_in = [F.when(F.col(f"__f{q}").bitwiseAND(lit(1 << i)) == 0, placed(1, i).bitwiseXOR(placed(3, i))).otherwise(lit(0)) for i in range(9)]
        odd = F.when((total - n) % 2 == 1, v1.bitwiseXOR(v3)).otherwise(lit(0))
        sums.append(reduce(lambda x, y: x.bitwiseXOR(y), stones_in, odd).alias(f"__z{q}"))
        for d in turned:
            fives = [reduce(lambda x, y: x.bitwiseAND(y), [F.col(f"__{k}{p}_0") for p in others], F.col(f"__{k}{q}_{d}")) for k in "xy"]
            last = stones(completing(F.col(f"__s{q}_{d}")).bitwiseAND(F.bitwise_not(F.col(f"__o{q}_{d}"))))
            over.append(F.when(any_of(fives) != 0, total).otherwise(last).alias(f"__w{q}_{d}"))
    rows = rows.select(*df.columns, unfused(total).alias("__n"), *own, *sums, *over)
    add = lambda names: reduce(lambda x, y: x + y, [F.col(c) for c in names]).cast("long")
    rows = rows.select(*df.columns, unfused(F.col("__n")).alias("__n"), add([f"__c{q}" for q in quads]).alias("boards"), any_of([F.shiftleft(f"__z{q}", 16 * q) for q in quads]).alias("checksum"), add([f"__w{q}_{d}" for q in quads for d in turned]).alias("over"))
    # A filter on a generator's row isn't pushed below the columns it is made of.
    out = rows.select(*df.columns, F.explode_outer(F.when(F.col("__n") > 0, F.array((F.col("__n") * 8).cast("long")))).alias("moves"), "boards", "checksum", "over")
    return out.where("moves IS NOT NULL")
