"""Exact values of endgames for all 256 rotations of the quadrants at once.

The stones that go on a root's empty cells are what makes a position; how its quadrants are turned is one of 256 bits. So with k
empty cells there are sum(comb(k, n) * comb(n, n // 2)) positions to a root, 35 for k = 4 and 267 for k = 6, each with two sets of rotations: those
where the mover wins, and those where the mover doesn't lose.

From the full boards back, a level is one grouped bit_or: a position gives its values to the positions with one stone of the
side that moved less. For the side that moved, rotations after the turn are won where it alone has five, or neither has and the
other side doesn't get away; one turn leads there from all their neighbours; and a five by the stone itself needs no turn. The minimum over
replies is a complement, the maximum over moves the OR. Nothing is joined; rows are keyed by root and position, and levels are written.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import supers
from ..functions.boards import any_of, lit, unfused
from ..functions.subsets import members, with_subset
from ..operators.moves import empty_bits
from .tables import materialize

WORDS = range(4)


def full_boards(roots: DataFrame, empties: int) -> DataFrame:
    """key, free (the root's empty cells), mover, other: each way to fill the cells, the side on turn first. Its rows are numbers of subsets, unranked."""
    first = (empties + 1) // 2
    rows = roots.select("key", "us", "them", unfused(empty_bits(F.col("us"), F.col("them"))).alias("cells"))
    rows = rows.select("*", F.explode(F.sequence(lit(0), lit(comb(empties, first) - 1))).alias("number"))
    rows = with_subset(rows, "number", empties, first, "mine")
    free = any_of([F.get("cells", F.lit(j)) for j in range(empties)])
    rows = rows.select("key", "us", "them", free.alias("free"), members(F.col("mine"), F.col("cells"), empties).alias("placed"))
    us, them = F.col("us").bitwiseOR(F.col("placed")), F.col("them").bitwiseOR(F.col("free").bitwiseXOR(F.col("placed")))
    return rows.select("key", "free", *([us.alias("mover"), them.alias("other")] if empties % 2 == 0 else [them.alias("mover"), us.alias("other")]))


def step_back(level: DataFrame, last: bool) -> DataFrame:
    """From positions (key, free, mover, other, win0-3, safe0-3) those with one stone of `other` less, `other` being on turn. last: the boards are full, without values."""
    rows = supers.with_fives(supers.with_fives(level, "other", "a"), "mover", "b")
    neither = lambda k, x: f"~(a{k} | b{k})" + ("" if last else f" & ~{x}{k}")
    won = [(f"a{k} & ~b{k}" if last else f"(a{k} & ~b{k}) | ({neither(k, 'safe')})") + f" AS w{k}" for k in WORDS]
    held = [f"a{k} | ({neither(k, 'win')}) AS h{k}" for k in WORDS]
    rows = rows.selectExpr("key", "free", "mover", "other", *[f"a{k}" for k in WORDS], *won, *held)
    values = [f"a{k} | {c} AS {name}{k}" for name, x in (("win", "w"), ("safe", "h")) for k, c in enumerate(supers.near([f"{x}{k}" for k in WORDS]))]
    placed = "array_compact(array(" + ", ".join(f"if(other & free & {1 << i}L != 0L, {1 << i}L, null)" for i in g.BITS) + "))"
    rows = rows.selectExpr("key", "free", "mover", "other", f"get(transform(array({placed}), x -> x), 0) AS stones", *values)
    rows = rows.select("*", F.explode_outer("stones").alias("stone")).where("stone IS NOT NULL")
    rows = rows.select("key", "free", F.col("other").bitwiseXOR(F.col("stone")).alias("__mover"), F.col("mover").alias("__other"), *[f"{v}{k}" for v in ("win", "safe") for k in WORDS])
    out = rows.groupBy("key", "free", "__mover", "__other").agg(*[F.bit_or(f"{v}{k}").alias(f"{v}{k}") for v in ("win", "safe") for k in WORDS])
    return out.withColumnRenamed("__mover", "mover").withColumnRenamed("__other", "other")


def levels(roots: DataFrame, empties: int) -> list[DataFrame]:
    """Values of all positions below roots (key, us, them), from one stone short of full boards to the roots: each a table of step_back's columns.

    Values of rotations that have a five before the move are those of going on without it; see `with_decided`.
    """
    level, out = materialize(full_boards(roots, empties), "packed-full"), []
    for n in range(empties, 0, -1):
        level = materialize(step_back(level, n == empties), f"packed-{n - 1}")
        out.append(level)
    return out


def with_decided(level: DataFrame) -> DataFrame:
    """Adds over0 to over3: the rotations under which a side has five before the move."""
    rows = supers.with_fives(supers.with_fives(level, "mover", "__a"), "other", "__b")
    return rows.select(*level.columns, *[F.col(f"__a{k}").bitwiseOR(F.col(f"__b{k}")).alias(f"over{k}") for k in WORDS])


def value(rotation: int = 0):
    """1, 0 or -1 for the mover of a row of `levels` under a rotation."""
    bit = lambda name: F.shiftrightunsigned(f"{name}{rotation // 64}", rotation % 64).bitwiseAND(lit(1))
    return bit("win") + bit("safe") - 1
