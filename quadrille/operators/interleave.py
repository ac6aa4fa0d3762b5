"""Epochs that mix slices of unlike sizes evenly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def strides(df: DataFrame, key: str, slices: str, epochs: int = 1, buckets: int = 256, digits: int = 3) -> DataFrame:
    """df's columns with epoch, bucket and place: every row once an epoch, slices interleaved in proportion to their sizes.

    Row j of a slice of n rows, in the order of a hash of epoch and key, has the virtual time (j - 1/2) / n; rows in the order of time make an epoch, and any prefix of it
    holds each slice's share within one row. Nothing is sorted as a whole: places in a slice are sums over cells of the hash, 16**digits of
    them, and a window inside a cell; the epoch is cut into buckets of time, and `place` orders a bucket. Read buckets in turn. Null slices are a slice.
    """
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("epoch", F.col("epoch").cast("long"))
    rows = rows.withColumn("__mark", F.md5(F.concat_ws(":", F.col("epoch").cast("string"), F.col(key).cast("string")))).withColumn("__cell", F.substring("__mark", 1, digits))
    cell = ["epoch", slices, "__cell"]
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("__count"))
    own = Window.partitionBy("epoch", slices)  # one row for each cell
    before = F.coalesce(F.sum("__count").over(own.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("epoch").alias("__epoch"), F.col(slices).alias("__slice"), F.col("__cell").alias("__of"), before.alias("__before"), F.sum("__count").over(own).alias("__n"))
    rows = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*cell).orderBy("__mark", key)))
    rows = rows.join(starts, (F.col("epoch") == F.col("__epoch")) & F.col(slices).eqNullSafe(F.col("__slice")) & (F.col("__cell") == F.col("__of")))
    twice = (F.col("__before") + F.col("__at")) * 2 - 1
    rows = rows.withColumn("__time", twice / F.col("__n")).withColumn("bucket", F.expr(f"(((__before + __at) * 2 - 1) * {buckets}) div (2 * __n)"))
    place = F.row_number().over(Window.partitionBy("epoch", "bucket").orderBy("__time", F.col(slices).asc_nulls_first(), key)).cast("long")
    return rows.select(*df.columns, "epoch", "bucket", place.alias("place"))
