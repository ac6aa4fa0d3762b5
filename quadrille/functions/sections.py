"""Sections: how many stones of each side each quadrant holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g
from .boards import lit


def counts(side0: Column, side1: Column) -> list[tuple[Column, Column]]:
    return [tuple(F.bit_count(s.bitwiseAND(lit(m))).cast("long") for s in (side0, side1)) for m in g.LANE]


def sig(parts: list[tuple[Column, Column]]) -> Column:
    """Eight counts as the bytes of a long, quadrant 0 lowest, first side before second."""
    flat = [c for pair in parts for c in pair]
    return reduce(lambda a, b: a + b, [c * lit(1 << 8 * i) for i, c in enumerate(flat)])


def sig_counts(signature: Column) -> list[tuple[Column, Column]]:
    at = lambda i: F.shiftrightunsigned(signature, 8 * i).bitwiseAND(lit(0xFF))
    return [(at(2 * q), at(2 * q + 1)) for q in range(g.QUADRANTS)]


def standard(parts: list[tuple[Column, Column]]) -> Column:
    """The least signature under the symmetries of the square."""
    return F.least(*[sig([parts[s] for s in source]) for source in g.quadrant_sources()])


def images(parts: list[tuple[Column, Column]]) -> Column:
    """How many different sections the symmetries make of this one."""
    return F.size(F.array_distinct(F.array(*[sig([parts[s] for s in source]) for source in g.quadrant_sources()]))).cast("long")


def standard_of(signature: str) -> str:
    """SQL of the least signature under the symmetries of the square, from a signature's name: a quadrant's two counts are 16 bits that move together."""
    pair = [f"(shiftrightunsigned({signature}, {16 * q}) & 65535L)" for q in range(g.QUADRANTS)]
    return "least(" + ", ".join(" | ".join(f"shiftleft({pair[s]}, {16 * q})" for q, s in enumerate(source)) for source in g.quadrant_sources()) + ")"


def total_of(signature: str) -> str:
    """SQL of the number of stones."""
    return "(" + " + ".join(f"(shiftrightunsigned({signature}, {8 * i}) & 255L)" for i in range(8)) + ")"


def total(parts: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a + b, [c for pair in parts for c in pair])


def valid(parts: list[tuple[Column, Column]]) -> Column:
    """At most nine stones a quadrant, and the sides even or the first one ahead by one."""
    lead = reduce(lambda a, b: a + b, [a - b for a, b in parts])
    return reduce(lambda a, b: a & b, [a + b <= 9 for a, b in parts]) & lead.isin(0, 1)


def child(parts: list[tuple[Column, Column]], q: int) -> tuple[Column, Column]:
    """The section after the mover's stone in quadrant q, and whether there is room for it."""
    first = total(parts) % 2 == 0
    a, b = parts[q]
    grown = [*parts]
    grown[q] = (a + F.when(first, 1).otherwise(0), b + F.when(first, 0).otherwise(1))
    return standard(grown), a + b < 9
