"""Queries on finished positions, scores, written boards, ratios and ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boards as b
from ..functions import geometry as g
from ..functions import ranges, scores, supers
from ..functions import sections as sec
from ..operators.moments import ratio_moments
from ..plans.retrograde import solve
from ..sources.positions import positions, table
from . import sqltext as t
from .games import _ANY_SIDE, _ONE, _TURNED, _roots


def winning_lines(spark, sf_dir):
    """Each line of five that either side of an order's position holds."""
    p = positions(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").distinct()
    each = p.select("key", F.explode(F.array(*[F.struct(b.lit(k).alias("side"), b.fives(F.col(f"s{k}")).alias("lines")) for k in (0, 1)])).alias("of"))
    return each.select("key", "of.side", F.inline("of.lines"))


_LINES = ", ".join(f"({m}, '{','.join(f'{x}{y}' for x, y in g.CELLS if m >> g.bit_of(x, y) & 1)}')" for m in g.win_masks())
WINNING_LINES = f"""WITH {t.positions("orders", "o_orderkey")}, k AS (SELECT DISTINCT key, s0, s1 FROM p), l(line, cells) AS (VALUES {_LINES})
SELECT key, side::BIGINT AS side, line::BIGINT AS line, cells FROM (SELECT key, 0 AS side, s0 AS s FROM k UNION ALL SELECT key, 1, s1 FROM k), l WHERE (s & line) = line"""


def board_text(spark, sf_dir):
    """Each order's position as a picture, and read back from its digits; those of a pending order lack their last digit and stay unread."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("key"), "o_orderstatus").distinct()
    p = positions(o, "key").distinct().join(o, "key")
    p = p.select(b.unfused(F.col("key")).alias("key"), "o_orderstatus", b.pack(F.col("s0"), F.col("s1")).alias("board"))
    p = p.select(b.unfused(F.col("key")).alias("key"), "o_orderstatus", b.table_text(F.col("board")).alias("digits"))
    given = F.when(F.col("o_orderstatus") == "P", F.substring("digits", 1, 35)).otherwise(F.col("digits"))
    p = p.select(b.unfused(F.col("key")).alias("key"), "digits", b.unfused(given).alias("given"))
    return p.select(b.unfused(F.col("key")).alias("key"), b.picture(F.col("digits")).alias("picture"), F.coalesce(b.read_table_text(F.col("given")), b.lit(-1)).alias("board"))


_ROWS = " || chr(10) || ".join(f"'{name}  ' || " + " || ".join(f"digits[{6 * x + 6 - i}]" for x in range(6)) for i, name in enumerate("abcdef"))
BOARD_TEXT = f"""WITH {t.positions("orders", "o_orderkey")}, k AS (SELECT DISTINCT key, {t.pack("s0", "s1")} AS board, bit_count(s0) AS n0, bit_count(s1) AS n1 FROM p),
d AS (SELECT key, string_agg(c::VARCHAR, '' ORDER BY i) AS digits FROM (SELECT DISTINCT key, i, c FROM h) GROUP BY key),
o AS (SELECT DISTINCT o_orderkey, o_orderstatus FROM orders)
SELECT key, 'counts: 0s = ' || n0 || ', 1s = ' || n1 || chr(10) || chr(10) || translate({_ROWS}, '012', '_01') || chr(10) || chr(10) || '   123456' AS picture,
CASE WHEN o_orderstatus = 'P' THEN -1 ELSE board END AS board FROM k JOIN d USING (key) JOIN o ON key = o_orderkey"""


def section_endings(spark, sf_dir):
    """By section, over all turns of quadrants of each customer's position: how many give neither side five, the first alone, the second alone, both."""
    p = positions(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").distinct()
    p = p.select("s0", "s1", sec.standard(sec.counts(F.col("s0"), F.col("s1"))).alias("section"))
    w = supers.with_fives(supers.with_fives(p, "s0", "a"), "s1", "b")
    first, second = ([F.col(f"{x}{k}") for k in range(4)] for x in "ab")
    both = supers.popcount([x.bitwiseAND(y) for x, y in zip(first, second, strict=True)])
    w = w.select("section", supers.popcount(first).alias("n0"), supers.popcount(second).alias("n1"), both.alias("n2"))
    sums = w.groupBy("section").agg(F.count(F.lit(1)).alias("positions"), F.sum(256 - F.col("n0") - F.col("n1") + F.col("n2")).alias("neither"), F.sum(F.col("n0") - F.col("n2")).alias("first"), F.sum(F.col("n1") - F.col("n2")).alias("second"), F.sum("n2").alias("both"))
    return sums


SECTION_ENDINGS = f"""WITH {t.positions("customer", "c_custkey")}, {_TURNED}, f AS (SELECT key, {t.standard(t.counts())} AS section, {_ANY_SIDE("s0")} AS a, {_ANY_SIDE("s1")} AS b FROM k, r),
e AS (SELECT key, section, {t.won("a")} AS x, {t.won("b")} AS y FROM f)
SELECT section, count(DISTINCT key) AS positions, count(*) FILTER (NOT x AND NOT y) AS neither, count(*) FILTER (x AND NOT y) AS first, count(*) FILTER (y AND NOT x) AS second, count(*) FILTER (x AND y) AS both FROM e GROUP BY section"""


def value_scores(spark, sf_dir):
    """Each customer's position with one empty cell: its exact score, that of a move to it, who wins, and the mover's value again from that."""
    _, moves = solve(_roots(spark, sf_dir, "customer", "c_custkey", 1), 1)
    best = moves.groupBy("key", "us", "them").agg(F.max("value").cast("long").alias("value"))
    stones = b.stones(F.col("us").bitwiseOR(F.col("them")))
    best = best.select("key", "value", stones.alias("stones"), scores.exact(F.col("value") + 1).alias("score"), scores.winner(F.col("value"), stones).alias("winner"))
    return best.select("key", "value", "score", scores.lift(F.col("score")).alias("lifted"), "winner", scores.of_mover(F.col("winner"), F.col("stones")).alias("mover"))


VALUE_SCORES = f"""WITH {_ONE}, m AS (SELECT key, max(value)::BIGINT AS value FROM v GROUP BY key, us, them)
SELECT key, value, 4 * 36 + value + 1 AS score, 4 * 37 + 1 - value AS lifted, CASE value WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS winner, value AS mover FROM m"""


def price_moments(spark, sf_dir):
    """By return flag and line status, the price of a unit drawn at random from all line items: mean and deviation."""
    m = ratio_moments(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")
    return m.select("l_returnflag", "l_linestatus", F.round("whole", 2).alias("units"), F.round("mean", 3).alias("mean"), F.round("dev", 3).alias("dev"))


PRICE_MOMENTS = """WITH s AS (SELECT l_returnflag, l_linestatus, sum(l_quantity::DOUBLE) AS w, sum(l_extendedprice::DOUBLE) AS p, sum(l_extendedprice::DOUBLE * l_extendedprice::DOUBLE / l_quantity::DOUBLE) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus)
SELECT l_returnflag, l_linestatus, round(w, 2) AS units, round(p / w, 3) AS mean, round(sqrt(greatest(q / w - (p / w) * (p / w), 0)), 3) AS dev FROM s"""


def even_ranges(spark, sf_dir):
    """An even split of as many steps as an order's key among as many workers as its day of the month: one worker's range, who owns its ends, and a range read from text."""
    day = F.dayofmonth("o_orderdate").cast("long")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("key"), day.alias("workers"), (F.col("o_custkey") % day).cast("long").alias("worker"))
    low, high = ranges.even_range(F.col("key"), F.col("workers"), F.col("worker"))
    o = o.select("*", low.alias("low"), high.alias("high"))
    said = F.when(F.col("key") % 7 == 0, F.concat(F.col("high").cast("string"), F.lit("-"))).otherwise(F.concat(F.when(F.col("key") % 4 == 0, "").otherwise(F.col("low").cast("string")), F.lit(":"), F.when(F.col("key") % 3 == 0, "").otherwise(F.col("high").cast("string"))))
    o = o.select("*", said.alias("said"))
    first, end = ranges.read_range(F.col("said"), F.col("key"))
    own = lambda i: F.when(F.col("low") < F.col("high"), ranges.owner(F.col("key"), F.col("workers"), i)).otherwise(b.lit(-1))
    return o.select("key", "workers", "worker", "low", "high", own(F.col("low")).alias("owner_low"), own(F.col("high") - 1).alias("owner_high"), "said", F.coalesce(first, b.lit(-1)).alias("read_low"), F.coalesce(end, b.lit(-1)).alias("read_high"))


EVEN_RANGES = """WITH o AS (SELECT o_orderkey::BIGINT AS key, day(o_orderdate)::BIGINT AS workers, (o_custkey % day(o_orderdate))::BIGINT AS worker FROM orders),
r AS (SELECT *, (key // workers) * worker + least(key % workers, worker) AS low, (key // workers) * (worker + 1) + least(key % workers, worker + 1) AS high FROM o)
SELECT key, workers, worker, low, high, CASE WHEN low < high THEN worker ELSE -1 END AS owner_low, CASE WHEN low < high THEN worker ELSE -1 END AS owner_high,
CASE WHEN key % 7 = 0 THEN high || '-' ELSE CASE WHEN key % 4 = 0 THEN '' ELSE low::VARCHAR END || ':' || CASE WHEN key % 3 = 0 THEN '' ELSE high::VARCHAR END END AS said,
CASE WHEN key % 7 = 0 THEN -1 WHEN key % 4 = 0 THEN 0 ELSE low END AS read_low, CASE WHEN key % 7 = 0 THEN -1 WHEN key % 3 = 0 THEN key ELSE high END AS read_high FROM r"""

QUERIES = {
    "winning_lines": (winning_lines, WINNING_LINES),
    "board_text": (board_text, BOARD_TEXT),
    "section_endings": (section_endings, SECTION_ENDINGS),
    "value_scores": (value_scores, VALUE_SCORES),
    "price_moments": (price_moments, PRICE_MOMENTS),
    "even_ranges": (even_ranges, EVEN_RANGES),
}
