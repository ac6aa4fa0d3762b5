"""Secret scans through a trigram inverted index.

Each rule's regular expression gives a Boolean query over the trigrams that any match must
hold. The postings of those trigrams, (trigram, document), are intersected for each
alternative of a query; documents that satisfy one are candidates, and only they are read
by that rule's expression. Rules without a mandatory trigram read every text.

An alternative asks for the `asked` rarest of its trigrams, by how common their letters are; each is mandatory, so
fewer of them only add candidates.

Everything is a DataFrame expression. One scan of the texts, by one expression for all asked trigrams, makes the postings. They are
intersected by counting, for each rule, alternative and document, the asked trigrams that meet; a
trigram that a third of all documents hold never meets in one task. A second scan reads the texts with the candidates' ids,
which are broadcast if they are at most `broadcast_rows`, and else joined by a shuffle.

Spans are in code points, the end exclusive. An expression's matches are leftmost and
non-overlapping for each rule; those whose `group` is shorter than `least` are dropped after matching.

Defined results: a null text is the empty text and holds nothing; null ids and rows that
repeat an id are scanned each by itself; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, materialize, table
from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Base rules first. `[0-9a-f]{24,}` finds just the runs of `[0-9a-f]+` that have 24 characters or more, as both take whole runs; so does access.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosted_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


#: Letters from the most to the least common in English; anything else counts as rarer.
RUN = 256  # matches whose places are added up together
COMMON = "etaoinshrdlucmfwygpbvkjxqz"


def asked_of(way: frozenset[str], most: int) -> list[str]:
    """The rarest trigrams of an alternative."""
    rarity = lambda t: sum(COMMON.find(c) if c in COMMON else len(COMMON) for c in t)
    return sorted(way, key=lambda t: (-rarity(t), t))[:most]


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of the given trigrams: id, mark and trigram, one row for each that a text holds."""
    one = "(?i)(?=(" + "|".join(re.escape(t) for t in trigrams) + "))"  # at most one of them begins at any place
    held = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(one), F.lit(1)), F.lower))
    return rows.select("id", "mark", F.explode(held).alias("trigram"))


def candidates(rows: DataFrame, rules: tuple[Rule, ...], asked: int) -> DataFrame:
    """id, mark, kinds: the indexed rules some alternative of whose query a text satisfies."""
    ways = [(r.kind, i, asked_of(way, asked)) for r in rules for i, way in enumerate(trigram_query(r.pattern))]
    trigrams = sorted({t for *_, way in ways for t in way})
    # Which alternatives ask for a trigram: a column, as the rules are few.
    asking = F.create_map(*[x for t in trigrams for x in (F.lit(t), F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("way"), F.lit(len(w)).alias("need")) for k, i, w in ways if t in w]))])
    lists = postings(rows, trigrams).select("id", "mark", F.inline(asking[F.col("trigram")]))
    met = lists.groupBy("kind", "way", "need", "id", "mark").agg(F.count(F.lit(1)).alias("n"))
    # Rows that repeat id and text count their trigrams once more each.
    met = met.where("n >= need")
    return met.groupBy("id", "mark").agg(F.collect_set("kind").alias("kinds"))


def spans_of(rule: Rule, text: Column) -> Column:
    """array<struct<kind, start, end>> of a rule's matches in a text."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    before = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    steps = F.transform(F.arrays_zip(whole.alias("w"), part.alias("p"), before.alias("b")), lambda x: F.struct(F.length(x["b"]).alias("skip"), F.length(x["w"]).alias("size"), F.length(x["p"]).alias("part")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    none = F.array().cast("array<struct<at:int,steps:array<struct<skip:int,size:int,part:int>>>>")
    end_of = lambda chunk, at: F.aggregate(chunk, at, lambda a, x: a + x["skip"] + x["size"])

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["skip"]
        end = start + x["size"]
        one = F.array(F.struct(F.lit(rule.kind).alias("kind"), start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["part"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def spread(all_: Column) -> Column:
        """Matches are taken RUN at a time, so that what grows by one match is never longer than that."""
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda c: F.slice(all_, c * RUN + 1, F.lit(RUN)))
        begun = F.aggregate(runs, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda a, r: F.struct(end_of(r, a["at"]).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), r.alias("steps")))).alias("out")), lambda a: a["out"])
        return F.flatten(F.transform(begun, lambda r: F.aggregate(r["steps"], F.struct(r["at"].alias("at"), empty.alias("out")), add, lambda a: a["out"])))

    # Bound once: an expression that a lambda names is else computed again for each element.
    bound = F.get(F.transform(F.array(steps), spread), F.lit(0))
    return F.when(F.regexp_instr(text, F.lit(rule.pattern)) > 0, bound).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, asked: int = 2, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans array<struct<kind, start, end>> by start, then by kind as listed."""
    rows = docs.select(F.col(id_col).alias("id"), body(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    found = materialize(candidates(rows, rules, asked).withColumnRenamed("id", "of").withColumnRenamed("mark", "of_mark"), "secret-candidates")
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    indexed = [r for r in rules if trigram_query(r.pattern)]
    plain = [r for r in rules if not trigram_query(r.pattern)]
    both = rows.join(found, rows["id"].eqNullSafe(found["of"]) & (rows["mark"] == found["of_mark"]), "left")
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    verified = [F.when(F.array_contains("kinds", r.kind), spans_of(r, F.col("text"))).otherwise(empty) for r in indexed]
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    every = F.transform(F.concat(*verified, *[spans_of(r, F.col("text")) for r in plain]), lambda x: F.struct(x["start"].alias("start"), place[x["kind"]].alias("place"), x["end"].alias("end"), x["kind"].alias("kind")))
    return both.select(F.col("id").alias("doc_id"), F.transform(F.sort_array(every), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_secret_scan(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*[r.kind for r in BASE]))
    return found.select("doc_id", *[of(r.kind) for r in BASE], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """All rules over all texts in DuckDB's SQL, without an index."""
    one = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        one.append(f"""SELECT r, {i} AS place, '{r.kind}' AS kind, start, start + size AS stop FROM (
  SELECT r, i, part, len(w) AS size, sum(len(b)) OVER (PARTITION BY r ORDER BY i) + sum(len(w)) OVER (PARTITION BY r ORDER BY i) - len(w) AS start FROM (
    SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w, unnest(ps) AS part, unnest(bs[1:len(ws)]) AS b FROM (
      SELECT r, regexp_extract_all(text, '{p}', 0) AS ws, regexp_extract_all(text, '{p}', {r.group}) AS ps, regexp_split_to_array(text, '{p}') AS bs FROM d) WHERE len(ws) > 0))
WHERE len(part) >= {r.least}""")
    names = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(one)}),
g AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, place) AS spans,
  string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, place) FILTER (kind IN ({names})) AS base FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""
