"""Structured Streaming over a table of events.

Both read files as a stream, run until all of them are taken, and give the table that the
stream wrote. `folder` holds the stream's state and output: a query started again with the same folder takes up where it
ended and reads new files alone. Both aggregate in complete mode, so a batch's output is the whole table, and the last
batch's counts; state grows with keys and sessions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import shared_dir


def _run(stream: DataFrame, schema: str, spark: SparkSession, name: str, folder: str | None) -> DataFrame:
    """Each batch's rows go to a table of their own number, so a batch that is run again replaces itself."""
    base = folder or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write = lambda df, n: df.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{base}/out/b{n}")
    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(f"{schema}, batch long").option("recursiveFileLookup", "true").parquet(f"{base}/out")
    last = found.agg(F.max("batch")).first()[0]
    return found.where(F.col("batch") == F.lit(last)).drop("batch")


def _read(spark: SparkSession, path: str, files: int | None) -> DataFrame:
    """The files of a path as a stream, `files` a batch where given."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def sessions(spark: SparkSession, path: str, gap: str = "30 minutes", folder: str | None = None, files: int | None = None) -> DataFrame:
    """user_id, first, last, n: events of a user no further apart than `gap`."""
    events = _read(spark, path, files).withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    out = grouped.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")
    return _run(out, "user_id long, first timestamp_ntz, last timestamp_ntz, n long", spark, "sessions", folder)


def arrivals(spark: SparkSession, path: str, kinds: list[str], folder: str | None = None, files: int | None = None) -> DataFrame:
    """user_id, seen (a bit for each kind that arrived), complete: contributions gathered per key as a stream."""
    bit = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(1 << i)) for i, k in enumerate(kinds)], F.lit(0)).cast("long")
    grouped = _read(spark, path, files).groupBy("user_id").agg(F.bit_or(bit).alias("seen"))
    out = grouped.select("user_id", "seen", (F.col("seen") == (1 << len(kinds)) - 1).alias("complete"))
    return _run(out, "user_id long, seen long, complete boolean", spark, "arrivals", folder)
