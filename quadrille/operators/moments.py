"""Mean and deviation of a ratio over all units of its denominator, from three sums that merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ratio_moments(df: DataFrame, keys: list[str], whole: str, part: str) -> DataFrame:
    """keys, whole, mean, dev: of part / whole for a unit of `whole` drawn at random in the group.

    One partial and one final aggregation. Rows with a null in either or a whole that isn't above 0 have no units; a
    group without units has a null mean and deviation.
    """
    has = F.col(part).isNotNull() & (F.col(whole) > 0)
    w, p = F.when(has, F.col(whole).cast("double")), F.when(has, F.col(part).cast("double"))
    sums = df.groupBy(*keys).agg(F.sum(w).alias("__w"), F.sum(p).alias("__p"), F.sum(p * p / w).alias("__q"))
    mean = F.col("__p") / F.col("__w")
    return sums.select(*keys, F.coalesce("__w", F.lit(0.0)).alias("whole"), mean.alias("mean"), F.when(mean.isNotNull(), F.sqrt(F.greatest(F.col("__q") / F.col("__w") - mean * mean, F.lit(0.0)))).alias("dev"))
