"""Exact dedup by skew-safe combining.

Rows are deduplicated inside each input partition (the map-side half of the first
aggregation), the local winners of one digest are spread over salts and merged, and
the salt winners are combined globally. The grouping keys hold the whole normalised
text beside its digest, so every stage compares full content.

Defined results: a null text is the empty text; null ids come after all others (the
kept id is null only where a whole class has none); rows that repeat the kept id and
text are one document read more than once, all marked kept by `annotate`, of which
`deduplicate` returns one; empty input gives an empty result; other columns of the
input, whatever their names, are ignored by `annotate` and returned by `deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, body


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(body(text_col), SPACE, " ")


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per distinct text: digest, keep_id, group_size.

    A text that fills a third of all rows reaches the shuffle once per input partition,
    is merged in `salts` places, and ends as `salts` rows in the last stage.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    rows = rows.withColumn("digest", F.sha2("norm", 256))
    merged = rows.groupBy("digest", "salt", "norm").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    texts = merged.groupBy("digest", "norm").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    labels = texts.groupBy("digest").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    # Full content was compared above; two texts under one digest would stop the job rather than be merged.
    sole = F.when(F.col("texts") == 1, F.col("digest")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("string"))
    return labels.select(sole.alias("digest"), "keep_id", "group_size")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The second scan carries only ids and digests; a hot digest on that side is split by adaptive skew joins.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(text_col), 256).alias("digest"))
    found = rows.join(winners(docs, id_col, text_col, salts), "digest")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """The input rows that stay, with all their columns; of rows that repeat id and text, one."""
    labels = winners(docs, id_col, text_col, salts).select(F.col("digest").alias("__q_digest"), F.col("keep_id").alias("__q_keep"))
    rows = docs.withColumn("__q_digest", F.sha2(normalised(text_col), 256)).join(labels, "__q_digest")
    first = Window.partitionBy("__q_digest").orderBy(F.lit(1))
    stay = rows.where(F.col(id_col).eqNullSafe(F.col("__q_keep"))).withColumn("__q_row", F.row_number().over(first))
    return stay.where("__q_row = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_exact_dedup(spark, sf_dir):
    from .common import table

    return annotate(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id IS NULL) AS kept, text_sha256
FROM n JOIN g USING (text_sha256)
"""
