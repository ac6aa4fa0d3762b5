"""Exact values of positions by backward induction.

Positions are expanded level by level, a stone and a turn each, without repeats inside a
root's tree; the levels are then joined backwards. A level is one explode, one distinct
and one write; a step back is one join and one grouped maximum. All of them are keyed by
root and position, so the work spreads over roots and over positions of one root alike.

A stone that makes five wins before any turn. After a turn, both five is a tie, one five
decides, and a full board without five is a tie. Values are 1, 0, -1 for the mover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.boards import lit, won
from ..operators.moves import placements, turns
from .tables import materialize

STATE = ["key", "us", "them"]


def edges(level: DataFrame) -> DataFrame:
    """All moves of the positions (key, us, them): cell, turn (null if the stone decides), value for the mover if decided, else the child."""
    placed = placements(level).withColumn("five", won(F.col("placed")))
    decided = placed.where("five").select(*STATE, "cell", F.lit(None).cast("int").alias("turn"), lit(1).alias("value"), F.lit(None).cast("long").alias("next_us"), F.lit(None).cast("long").alias("next_them"))
    turned = turns(placed.where("NOT five")).withColumn("f", won(F.col("mine"))).withColumn("h", won(F.col("theirs")))
    full = F.col("mine").bitwiseOR(F.col("theirs")) == lit(g.FULL)
    value = F.when(F.col("f") | F.col("h"), F.col("f").cast("long") - F.col("h").cast("long")).when(full, lit(0))
    turned = turned.withColumn("value", value)
    open_ = F.col("value").isNull()
    return decided.unionByName(turned.select(*STATE, "cell", "turn", "value", F.when(open_, F.col("theirs")).alias("next_us"), F.when(open_, F.col("mine")).alias("next_them")))


def best(moves: DataFrame, children: DataFrame | None) -> DataFrame:
    """Values of the moves' positions from those of their children."""
    if children is not None:
        c = children.select(F.col("key").alias("c_key"), F.col("us").alias("c_us"), F.col("them").alias("c_them"), F.col("value").alias("c_value"))
        moves = moves.join(c, (F.col("key") == F.col("c_key")) & (F.col("next_us") == F.col("c_us")) & (F.col("next_them") == F.col("c_them")), "left")
        moves = moves.withColumn("value", F.coalesce("value", -F.col("c_value")))
    return moves


def solve(roots: DataFrame, empties: int) -> tuple[DataFrame, DataFrame]:
    """(root values, values of the roots' moves) for roots (key, us, them) without five, all with `empties` empty cells."""
    levels = []
    level = roots.select(*STATE).distinct()
    for n in range(empties, 0, -1):
        found = materialize(edges(level), f"edges-{n}")
        levels.append(found)
        level = found.where("value IS NULL").select("key", F.col("next_us").alias("us"), F.col("next_them").alias("them")).distinct()
    children = None
    for n, found in enumerate(reversed(levels), 1):
        valued = best(found, children)
        children = materialize(valued.groupBy(*STATE).agg(F.max("value").alias("value")), f"values-{n}")
    return children, valued.select(*STATE, "cell", "turn", "value")
