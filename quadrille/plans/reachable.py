"""Which positions can be reached from the empty board without a five on the way, for all 256 rotations at once.

A turn puts a stone, which must leave no five, and then turns a quadrant. So a board is reached if before its last turn, which was one
of eight, neither side had five and the board without one stone of the side that moved last was reached. The reference walks back from each
board; here a level holds, for every pair of parts of a root's two sides, the set of rotations in which these stones are reached. A level follows from the one
before by one grouped bit_or, a mask of fives and one turn of the set: parts met on many ways are one row, and nothing is
searched twice. Positions grow with the number of pairs of parts (924 in all for ten stones), so this is for openings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import supers
from .tables import materialize

WORDS = range(4)


def reachable(roots: DataFrame, most: int) -> DataFrame:
    """key, black, white of roots of at most `most` stones, and reached: whether a legal game leads there. Black has as many stones as white, or one more."""
    every = "bit_count(black) + bit_count(white)"
    roots = roots.selectExpr("key", "black", "white", f"cast({every} AS int) AS stones").where(f"stones <= {most}").distinct()
    level = roots.selectExpr("key", "black", "white", "stones", "0L AS last", "0L AS other", *[f"-1L AS r{k}" for k in WORDS])
    done = [level.where("stones = 0")]
    for n in range(most):
        mover = "black" if n % 2 == 0 else "white"
        left = f"{mover} & ~other"
        stones = "array_compact(array(" + ", ".join(f"if({left} & {1 << i}L != 0L, {1 << i}L, null)" for i in g.BITS) + "))"
        rows = level.where(f"stones > {n}").selectExpr("*", f"get(transform(array({stones}), x -> x), 0) AS __stones")
        rows = rows.select("*", F.explode_outer("__stones").alias("stone")).where("stone IS NOT NULL")
        # The side that moves now was `other` before.
        rows = rows.selectExpr("key", "black", "white", "stones", "other | stone AS mine", "last AS theirs", *[f"r{k}" for k in WORDS])
        met = rows.groupBy("key", "black", "white", "stones", "mine", "theirs").agg(*[F.bit_or(f"r{k}").alias(f"r{k}") for k in WORDS])
        met = supers.with_fives(supers.with_fives(met, "mine", "a"), "theirs", "b")
        met = met.selectExpr("key", "black", "white", "stones", "mine", "theirs", *[f"r{k} & ~(a{k} | b{k}) AS q{k}" for k in WORDS])
        turned = supers.near([f"q{k}" for k in WORDS])
        level = met.selectExpr("key", "black", "white", "stones", "mine AS last", "theirs AS other", *[f"{w} AS r{k}" for k, w in enumerate(turned)])
        level = materialize(level, f"reached-{n + 1}")
        done.append(level.where(f"stones = {n + 1}"))
    found = done[0]
    for level in done[1:]:
        found = found.unionByName(level)
    return found.selectExpr("key", "black", "white", "(r0 & 1L) = 1L AS reached")
