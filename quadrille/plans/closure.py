"""Sections that can follow from given ones, stone by stone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import sections as sec
from .tables import materialize


def children(sections: DataFrame, stones: int) -> DataFrame:
    """section: the standard sections one stone later than sections of so many stones. A stone more is one more in a byte of the signature."""
    room = lambda q: f"(shiftrightunsigned(section, {16 * q}) & 255L) + (shiftrightunsigned(section, {16 * q + 8}) & 255L) < 9"
    grown = ", ".join(f"if({room(q)}, section + {1 << 16 * q + 8 * (stones % 2)}L, null)" for q in range(g.QUADRANTS))
    rows = sections.selectExpr(f"explode_outer(array({grown})) AS grown").where("grown IS NOT NULL")
    return rows.selectExpr(f"{sec.standard_of('grown')} AS section")


def descendants(roots: DataFrame, most: int = 36) -> DataFrame:
    """slice, section: all standard sections of at most `most` stones that roots (section, any signatures) lead to, themselves included, each once.

    What follows from a section has one stone more, so the fixpoint goes by numbers of stones: a level is the roots of that many stones and what the level before
    leads to, each once. Nothing seen can come back at a later level, so a level is one distinct and is compared with no other. Levels are written.
    """
    rows = roots.selectExpr(f"{sec.standard_of('section')} AS section").distinct().selectExpr("section", f"cast({sec.total_of('section')} AS int) AS slice")
    rows = materialize(rows, "closure-roots")  # no filter before: it would be pushed down, with the signature's terms in full for each of its own
    first = rows.agg(F.min("slice")).first()[0]
    levels: list[DataFrame] = []
    for n in range(most + 1 if first is None else first, most + 1):
        level = rows.where(F.col("slice") == n).select("section")
        if levels:
            level = level.unionByName(children(levels[-1], n - 1)).distinct()
        levels.append(materialize(level, f"closure-{n}"))
    out = [level.select(F.lit(n).cast("long").alias("slice"), "section") for n, level in enumerate(levels, first or 0)]
    return reduce(DataFrame.unionByName, out) if out else rows.select(F.col("slice").cast("long"), "section")
