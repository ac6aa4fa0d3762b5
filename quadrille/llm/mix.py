"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected `target / source size` times. Those expectations,
as whole units of 1 / 2**24 copy so that sums are exact in any order, are prefix-summed
within the source; one offset per source is added, and a document is emitted once for
every whole copy its stretch of the sum crosses. Documents are laid out by size class
first, so that the taken words follow the target closely.

The prefix sum is distributed: cells (source, size class, slice of ids) are summed, the
cell sums are accumulated per source, and each cell is accumulated inside by itself. A
source with more than `cell_rows` documents has its cells cut into more slices, so that
neither a hot source nor one hot size meets in one task.

Defined results: a null or empty text has size 0 and takes 0 words; null source is a
source of its own, last in order; null ids and repeated rows are documents like others;
an empty table gives an empty result; extra columns are ignored (`mix` returns them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bits, body, materialize, table

UNITS = 1 << 24
WEIGHTS = (5, 2, 1)


def words(text_col: str = "text") -> Column:
    return F.regexp_count(body(text_col), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n_docs, target: `share` of all sizes dealt by weight, none above `most` times its source.

    Filling by weight until none overflows ends at one level: sources in the order of cap per
    weight overflow up to a point, and the level is the largest of the levels that follow from
    each possible point. One row per source is all that meets in one task here.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    full = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(full) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(full))
    return per.select("source", "source_size", "n_docs", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def size_class(size: Column) -> Column:
    """Sixteen classes to each doubling; sizes below 32 are classes of their own."""
    power = F.length(F.bin(size)) - 1
    return F.when(size < 32, size).otherwise(16 * power + F.expr("shiftright(size, length(bin(size)) - 5)").cast("long")).cast("long")


def copies(docs: DataFrame, seed: str = "mix", cell_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, copies for every row of docs."""
    sizes = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size")), "mix-sizes")
    to = targets(sizes).withColumn("expected", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNITS)).otherwise(F.lit(0)).cast("long"))
    to = to.withColumn("slices", F.floor(F.col("n_docs") / cell_rows) + 1).withColumnRenamed("source", "of")
    rows = sizes.join(to, sizes["source"].eqNullSafe(to["of"])).drop("of", "n_docs")
    rows = rows.withColumn("class", size_class(F.col("size"))).withColumn("slice", F.pmod(bits(F.col("doc_id")), F.col("slices")))

    cell = ["source", "class", "slice"]
    sums = rows.groupBy(*cell).agg(F.sum("expected").alias("units"))
    before = Window.partitionBy("source").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(F.col("source").alias("of"), F.col("class").alias("c"), F.col("slice").alias("s"), F.coalesce(F.sum("units").over(before), F.lit(0)).alias("start"))

    inside = Window.partitionBy(*cell).orderBy("size", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("expected").over(inside))
    rows = rows.join(start, F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("c")) & (F.col("slice") == F.col("s")))
    offset = F.pmod(bits(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("null")))), F.lit(UNITS))
    end = F.col("start") + F.col("upto") + offset
    crossed = F.shiftright(end, 24) - F.shiftright(end - F.col("expected"), 24)
    return rows.select("doc_id", "source", "size", "source_size", "target", crossed.alias("copies"))


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves with all columns, each as often as it is taken.

    Counts are per id, source and size; rows that share these share the copies in the order of their texts' digests.
    """
    taken = copies(docs, seed, id_col=id_col, text_col=text_col, source_col=source_col)
    same = Window.partitionBy("__q_id", "__q_source", "__q_size")
    keys = taken.select(F.col("doc_id").alias("__q_id"), F.col("source").alias("__q_source"), F.col("size").alias("__q_size"), F.col("copies").alias("__q_copies"))
    keys = keys.withColumn("__q_row", F.row_number().over(same.orderBy(F.desc("__q_copies")))).where("__q_copies > 0").alias("k")
    rows = docs.withColumn("__q_id", F.col(id_col)).withColumn("__q_source", F.col(source_col)).withColumn("__q_size", words(text_col))
    rows = rows.withColumn("__q_row", F.row_number().over(same.orderBy(F.md5(body(text_col))))).alias("d")
    on = F.expr("d.__q_id <=> k.__q_id AND d.__q_source <=> k.__q_source AND d.__q_size = k.__q_size AND d.__q_row = k.__q_row")
    each = rows.join(keys, on).withColumn("__q_copy", F.explode(F.sequence(F.lit(1), F.col("__q_copies").cast("int"))))
    return each.select(*[F.col(f"d.`{c}`") for c in docs.columns])


def op7_mix_sources(spark, sf_dir):
    found = copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
  [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source),
l AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM p),
f AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM l),
t AS (SELECT source, source_size, n_docs, least(cap, max(lev) OVER () * weight)::DOUBLE AS target FROM f),
e AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * 16777216)::BIGINT ELSE 0 END AS expected,
  CASE WHEN size < 32 THEN size ELSE 16 * (length(bin(size)) - 1) + (size >> (length(bin(size)) - 5)) END AS class,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % (n_docs // 1000000 + 1) AS slice,
  ('0x' || substr(md5('mix:' || coalesce(d.source, 'null')), 1, 8))::BIGINT % 16777216 AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (sum(expected) OVER (PARTITION BY source ORDER BY class, slice, size, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) + off)::BIGINT AS upto FROM e)
SELECT doc_id, size, source_size, target, (((upto >> 24) - ((upto - expected) >> 24)) * size)::BIGINT AS taken FROM c
"""
