"""Quality rules with adaptive thresholds.

Base statistics of each text are column expressions on its own row. Instead of one fixed
cutoff for each statistic, fences are drawn from its distribution among the documents of
the same language and source that pass the base rules: a mergeable quantile sketch counts
values in log-linear buckets (exact below 64, within 1/32 above), so sketches of parts add
up to the sketch of the whole in any order, and a hot source is counted by all tasks.
A group of fewer than `least` documents uses its language's sketch, or else that of all.
A fence lies `reach` quartile distances, or `slack` if that is more, beyond the quartile.
The fences, one row per language and source, are joined to the statistics.

Windows of three words are compared within a text by a 64-bit hash of the words.

Defined results: null and empty texts have no words and fail the base rules; null
language or source is a group of its own; repeated rows each get a row; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, body, materialize, table

#: Statistic: (expression over the features, slack, whether low values fail too). Per thousand; hundredths of a code point for word_length.
RATIOS = {
    "symbols": ("n_symbols * 1000 div greatest(n_words, 1)", 100, False),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", 300, False),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", 300, False),
    "capitals": ("n_capitals * 1000 div greatest(word_chars, 1)", 200, False),
    "word_length": ("word_chars * 100 div greatest(n_words, 1)", 200, True),
}


def _count(text: Column, others: str) -> Column:
    """Characters of a text that are left once runs of all others are gone."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, lang, source, and the counts the rules use. No shuffle, no Python.

    For words in repeated windows, a text's windows are sorted by hash, equal neighbours are
    marked, and the marked starts are swept in order: each adds the words that the start
    before it doesn't cover.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), body(text_col).alias("text"))
    rows = rows.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    n = F.size("words")
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("windows", F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")))))
    marked = F.transform("windows", lambda x, k: F.when((F.get("windows", k - 1)["h"] == x["h"]) | (F.get("windows", k + 1)["h"] == x["h"]), x["i"]))
    rows = rows.withColumn("marked", F.sort_array(F.filter(marked, lambda x: x.isNotNull())))
    covered = F.aggregate(F.transform("marked", lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get("marked", k - 1)))), F.lit(0), lambda a, x: a + x)
    return rows.select(
        "doc_id", "lang", "source",
        n.cast("long").alias("n_words"),
        _count(F.col("text"), r"[\x20\x09-\x0D]+").alias("word_chars"),
        _count(F.col("text"), r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _count(F.col("text"), r"[^\p{Lu}]+").alias("n_capitals"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bucket(v: Column) -> Column:
    """Lower edge of a value's bucket: the value below 64, else its six leading binary digits."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def fences(feats: DataFrame, least: int = 200, reach: float = 3.0) -> DataFrame:
    """One row per language and source: <statistic>_low and <statistic>_high."""
    good = feats.where(~base_failed())
    values = good.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), bucket(F.expr(x)).alias("v")) for k, (x, _, _) in RATIOS.items()])).alias("s"))
    sketch = values.groupBy("lang", "source", "s.stat", "s.v").agg(F.count(F.lit(1)).alias("n"))
    # Sketches add up: a language's is the sum of its sources', and that of all the sum of the languages'.
    of_lang = sketch.groupBy("lang", "stat", "v").agg(F.sum("n").alias("n"))
    of_all = of_lang.groupBy("stat", "v").agg(F.sum("n").alias("n"))

    def quartiles(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
        w = Window.partitionBy(*keys, "stat")
        run = df.withColumn("upto", F.sum("n").over(w.orderBy("v"))).withColumn("all", F.sum("n").over(w))
        at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("v")))
        return run.groupBy(*keys, "stat").agg(at(1).alias(f"{tag}1"), at(3).alias(f"{tag}3"), F.max("all").alias(f"{tag}n"))

    groups = feats.select("lang", "source").distinct()
    stats = F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), F.lit(float(s)).alias("slack"), F.lit(both).alias("both")) for k, (_, s, both) in RATIOS.items()]))
    g = groups.withColumn("s", stats).select("lang", "source", "s.*").alias("g")
    a, b, c = quartiles(sketch, ["lang", "source"], "a").alias("a"), quartiles(of_lang, ["lang"], "b").alias("b"), quartiles(of_all, [], "c").alias("c")
    g = g.join(a, F.expr("g.lang <=> a.lang AND g.source <=> a.source AND g.stat = a.stat"), "left")
    g = g.join(b, F.expr("g.lang <=> b.lang AND g.stat = b.stat"), "left").join(c, F.expr("g.stat = c.stat"), "left")
    q = lambda i: F.when(F.col("an") >= least, F.col(f"a{i}")).when(F.col("bn") >= least, F.col(f"b{i}")).otherwise(F.col(f"c{i}"))
    g = g.select(F.col("g.lang"), F.col("g.source"), F.col("g.stat"), "slack", "both", q(1).alias("q1"), q(3).alias("q3"))
    gap = F.greatest((F.col("q3") - F.col("q1")) * F.lit(reach), F.col("slack"))
    g = g.select("lang", "source", "stat", F.when(F.col("both"), F.col("q1") - gap).alias("low"), (F.col("q3") + gap).alias("high"))
    pick = lambda k, side: F.max(F.when(F.col("stat") == k, F.col(side))).alias(f"{k}_{side}")
    return g.groupBy("lang", "source").agg(*[pick(k, side) for k in RATIOS for side in ("low", "high")])


def judge(docs: DataFrame, least: int = 200, reach: float = 3.0, **cols: str) -> DataFrame:
    """The features of every row with base_failed and kept."""
    feats = materialize(features(docs, **cols), "quality-features")
    f = fences(feats, least, reach).withColumnRenamed("lang", "of_lang").withColumnRenamed("source", "of_source")
    rows = feats.join(f, feats["lang"].eqNullSafe(f["of_lang"]) & feats["source"].eqNullSafe(f["of_source"]), "left")
    beyond = F.lit(False)
    for k, (x, _, both) in RATIOS.items():
        beyond = beyond | (F.expr(x) > F.col(f"{k}_high"))
        if both:
            beyond = beyond | (F.expr(x) < F.col(f"{k}_low"))
    failed = base_failed()
    kept = F.when(failed, False).otherwise(~F.coalesce(beyond, F.lit(False)))
    return rows.select(*feats.columns, failed.alias("base_failed"), kept.alias("kept"))


def op10_quality_rules(spark, sf_dir):
    found = judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SQL_RATIO = {k: x.replace(" div ", " // ") for k, (x, _, _) in RATIOS.items()}


def sql(least: int = 200, reach: float = 3.0) -> str:
    """The same rules in DuckDB's SQL."""
    unpivot = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS stat, ({x})::BIGINT AS v FROM f WHERE NOT base_failed" for k, x in _SQL_RATIO.items())
    quart = lambda keys: f"SELECT {keys}stat, min(v) FILTER (upto * 4 >= n) AS q1, min(v) FILTER (upto * 4 >= n * 3) AS q3, max(n) AS n FROM (SELECT {keys}stat, v, count(*) OVER (PARTITION BY {keys}stat ORDER BY v) AS upto, count(*) OVER (PARTITION BY {keys}stat) AS n FROM b) GROUP BY ALL"
    fence = "UNION ALL ".join(f"SELECT '{k}' AS stat, {float(s)} AS slack, {str(both).lower()} AS both_sides " for k, (_, s, both) in RATIOS.items())
    test = " OR ".join([f"coalesce(({x}) > t.{k}_high, false)" + (f" OR coalesce(({x}) < t.{k}_low, false)" if RATIOS[k][2] else "") for k, x in _SQL_RATIO.items()])
    pick = ", ".join(f"max(q{i} {sign} gap) FILTER (stat = '{k}'{' AND both_sides' if side == 'low' else ''}) AS {k}_{side}" for k in RATIOS for i, sign, side in ((1, "-", "low"), (3, "+", "high")))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT r, i, a || ' ' || lead(a, 1) OVER s || ' ' || lead(a, 2) OVER s AS t FROM p WINDOW s AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i FROM (SELECT r, i, t, count(*) OVER (PARTITION BY r, t) AS n FROM g WHERE t IS NOT NULL) WHERE n > 1),
c AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM h) GROUP BY r),
e AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
f0 AS (SELECT d.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals
  FROM d JOIN w USING (r) LEFT JOIN c USING (r) LEFT JOIN e USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f0),
u AS ({unpivot}),
b AS (SELECT lang, source, stat, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS v FROM u),
qa AS ({quart("lang, source, ")}), qb AS ({quart("lang, ")}), qc AS ({quart("")}),
s AS ({fence}),
q AS (SELECT k.lang, k.source, s.*, CASE WHEN qa.n >= {least} THEN qa.q1 WHEN qb.n >= {least} THEN qb.q1 ELSE qc.q1 END AS q1,
  CASE WHEN qa.n >= {least} THEN qa.q3 WHEN qb.n >= {least} THEN qb.q3 ELSE qc.q3 END AS q3
  FROM (SELECT DISTINCT lang, source FROM f) k CROSS JOIN s
  LEFT JOIN qa ON qa.lang IS NOT DISTINCT FROM k.lang AND qa.source IS NOT DISTINCT FROM k.source AND qa.stat = s.stat
  LEFT JOIN qb ON qb.lang IS NOT DISTINCT FROM k.lang AND qb.stat = s.stat LEFT JOIN qc ON qc.stat = s.stat),
t AS (SELECT lang, source, {pick} FROM (SELECT *, greatest((q3 - q1) * {reach}, slack) AS gap FROM q) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN false ELSE NOT ({test}) END AS kept
FROM f JOIN t ON f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source
"""
