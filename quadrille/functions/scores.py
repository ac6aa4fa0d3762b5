"""Scores of a search: the depth to which a value is known, and the value (0 loss, 1 tie, 2 win) in its two lowest bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boards import lit

#: Fixed value: a depth from which a value is exact, as no game has more stones.
EXACT = 36


def score(depth: Column, value: Column) -> Column:
    return F.shiftleft(depth.cast("long"), 2).bitwiseOR(value.cast("long"))


def exact(value: Column) -> Column:
    return score(lit(EXACT), value)


def parts(scored: Column) -> tuple[Column, Column]:
    """Depth and value."""
    return F.shiftright(scored, 2), scored.bitwiseAND(lit(3))


def lift(scored: Column) -> Column:
    """A move's score for the side that makes it, from that of the side to move after it."""
    depth, value = parts(scored)
    return score(depth + 1, lit(2) - value)


def winner(value: Column, stones: Column) -> Column:
    """0 tie, 1 the first side wins, 2 the second, from the value (-1, 0, 1) of the side to move."""
    first = stones % 2 == 0
    return F.when(value == 0, lit(0)).when((value == 1) == first, lit(1)).otherwise(lit(2))


def of_mover(won_by: Column, stones: Column) -> Column:
    """The value of the side to move, from who wins."""
    first = stones % 2 == 0
    return F.when(won_by == 0, lit(0)).when((won_by == 1) == first, lit(1)).otherwise(lit(-1))
