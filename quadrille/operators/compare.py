"""Tables of values compared row by row, block by block first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(columns: list[str]) -> Column:
    """A row's 128 bits, as two longs, nulls told from values."""
    text = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"})
    return F.struct(F.xxhash64(text, F.lit(1)).alias("a"), F.xxhash64(text, F.lit(2)).alias("b"))


def block_digests(df: DataFrame, keys: list[str], values: list[str], block: Column) -> DataFrame:
    """block, n, a, b: rows and digest of each block, one partial aggregate. Exclusive or doesn't see a pair of equal rows, so n and a sum of halves go with it."""
    rows = df.select(block.alias("block"), digest([*keys, *values]).alias("d"))
    return rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("d.a").alias("a"), F.sum(F.shiftrightunsigned("d.b", 32)).alias("b"))


def differences(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], block: Column) -> DataFrame:
    """keys, what (`changed`, `left only` or `right only`), and each value as left_ and right_ columns: rows of two tables that differ.

    Blocks' digests are compared first; only blocks that differ, or that one side lacks, have their rows joined. keys name a row; null keys are equal to each other.
    """
    a, b = block_digests(left, keys, values, block), block_digests(right, keys, values, block)
    same = F.expr("l.n <=> r.n AND l.a <=> r.a AND l.b <=> r.b")
    differ = a.alias("l").join(b.alias("r"), F.col("l.block").eqNullSafe(F.col("r.block")), "full_outer").where(~same).select(F.coalesce("l.block", "r.block").alias("__block"))
    pick = lambda df, side: df.withColumn("__at", block).join(differ, F.col("__at").eqNullSafe(F.col("__block")), "left_semi").select(*[F.col(k).alias(f"__{side}_{k}") for k in keys], *[F.col(v).alias(f"{side}_{v}") for v in values], F.lit(True).alias(f"__{side}"))
    x, y = pick(left, "left"), pick(right, "right")
    on = None
    for k in keys:
        one = F.col(f"__left_{k}").eqNullSafe(F.col(f"__right_{k}"))
        on = one if on is None else on & one
    both = x.join(y, on, "full_outer")
    equal = None
    for v in values:
        one = F.col(f"left_{v}").eqNullSafe(F.col(f"right_{v}"))
        equal = one if equal is None else equal & one
    what = F.when(F.col("__right").isNull(), "left only").when(F.col("__left").isNull(), "right only").when(~equal, "changed")
    names = [F.coalesce(f"__left_{k}", f"__right_{k}").alias(k) for k in keys]
    return both.select(*names, what.alias("what"), *[f"{s}_{v}" for v in values for s in ("left", "right")]).where("what IS NOT NULL")


def probe(samples: DataFrame, table: DataFrame, keys: list[str], values: list[str], block: Column) -> DataFrame:
    """keys, expected and found values of samples that the table contradicts or lacks. Only blocks that hold a sample are read into the join."""
    asked = samples.select(block.alias("__block")).distinct()
    rows = table.withColumn("__at", block).join(asked, F.col("__at").eqNullSafe(F.col("__block")), "left_semi").select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(v).alias(f"found_{v}") for v in values], F.lit(True).alias("__here"))
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = one if on is None else on & one
    met = samples.select(*keys, *[F.col(v).alias(f"expected_{v}") for v in values]).join(rows, on, "left")
    wrong = F.col("__here").isNull()
    for v in values:
        one = ~F.col(f"expected_{v}").eqNullSafe(F.col(f"found_{v}"))
        wrong = wrong | one
    return met.where(wrong).select(*keys, *[f"{s}_{v}" for v in values for s in ("expected", "found")])
