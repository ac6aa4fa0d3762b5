"""Subsets of a few things numbered in colex order: by their largest member, then the next one."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boards import any_of, lit, looked_up


def rank(mask: Column, n: int) -> Column:
    """The number of a subset (a mask of n bits) among those of its size: each member j that is the i-th smallest has comb(j, i) sets before it."""
    table = [comb(j, i) for j in range(n) for i in range(n + 1)]
    terms = [F.when(mask.bitwiseAND(lit(1 << j)) != 0, looked_up(table, F.bit_count(mask.bitwiseAND(lit((2 << j) - 1))) + j * (n + 1))).otherwise(lit(0)) for j in range(n)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def with_subset(df: DataFrame, index: str, n: int, k: int, name: str) -> DataFrame:
    """Adds the mask of the k-subset of n with a number. The largest member is found first, what is left is the number of the rest: a projection for each member."""
    rows = df.select("*", F.col(index).alias("__left"), lit(0).alias("__mask"))
    for i in range(k, 0, -1):
        before = [comb(j, i) for j in range(n)]
        member = sum((F.col("__left") >= lit(c)).cast("long") for c in before) - 1
        rows = rows.select(*df.columns, "__left", "__mask", member.alias("__j"))
        rows = rows.select(*df.columns, (F.col("__left") - looked_up(before, F.col("__j"))).alias("__left"), F.col("__mask").bitwiseOR(looked_up([1 << j for j in range(n)], F.col("__j"))).alias("__mask"))
    return rows.select(*df.columns, F.col("__mask").alias(name))


def members(mask: Column, things: Column, n: int) -> Column:
    """The OR of those of an array's n longs that a mask names."""
    return any_of([F.when(mask.bitwiseAND(lit(1 << j)) != 0, F.get(things, F.lit(j))).otherwise(lit(0)) for j in range(n)])
