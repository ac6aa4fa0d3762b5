"""Intervals in time: merging, rasterising, and what came before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(df: DataFrame, keys: list[str], start: str, end: str, gap: int) -> DataFrame:
    """keys, start, end, n of intervals joined where the next starts at most `gap` after all before it ended (longs)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0)
    parts = df.withColumn("__new", new).withColumn("__part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*keys, "__part").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("__part")


def rasterize(df: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """keys, bucket, covered: how much of each bucket of `width` the intervals cover, summed; zero-length intervals cover nothing."""
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    rows = df.where(F.col(end) > F.col(start)).withColumn("bucket", F.explode(F.sequence(first, last)))
    cover = F.least(F.col(end), (F.col("bucket") + 1) * width) - F.greatest(F.col(start), F.col("bucket") * width)
    return rows.groupBy(*keys, "bucket").agg(F.sum(cover).alias("covered"))


def last_before(df: DataFrame, keys: list[str], time: str, tie: str, is_cause) -> DataFrame:
    """All rows with `cause`: the `tie` of the last earlier row of the same keys for which is_cause holds; null without one."""
    w = Window.partitionBy(*keys).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("cause", F.last(F.when(is_cause, F.col(tie)), ignorenulls=True).over(w))


def locate(rows: DataFrame, offsets: DataFrame, width: int) -> DataFrame:
    """Rows (with `linear`) joined to the offsets' interval [lo, hi) that holds it.

    A range join as an equi-join: intervals are dealt to every bucket of `width` they touch, so no side is
    broadcast and nothing is compared outside its bucket.
    """
    dealt = offsets.where("hi > lo").withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    probe = rows.withColumn("__bucket", F.floor(F.col("linear") / width))
    return probe.join(dealt, "__bucket").where("linear >= lo AND linear < hi").drop("__bucket")
