"""Queries on the given tables: joins, windows, shards, samples, intervals, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.boards import lit
from ..operators import intervals, shards
from ..sources.positions import table
from ..streaming import events as stream

BITS, SHARDS = 48, 64  # keys under 2**48


def shard_permute(spark, sf_dir):
    """Order keys shuffled by an invertible permutation, with shard and place, and the keys got back."""
    o = shards.with_permuted(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "shuffled", BITS)
    shard, place = shards.shard_of(F.col("shuffled"), SHARDS)
    return shards.with_unpermuted(o.select("o_orderkey", "shuffled", shard.alias("shard"), place.alias("place")), "shuffled", "back", BITS)


def _permute_sql(x: str) -> str:
    sql, n = f"SELECT o_orderkey, {x} AS x FROM orders", 0
    for kind, s in shards.STEPS:
        step = f"xor(x, x >> {s})" if kind == "xor" else f"(x + ((x & {(1 << BITS - s) - 1}) << {s})) & {(1 << BITS) - 1}"
        sql, n = f"SELECT o_orderkey, {step} AS x FROM ({sql}) AS t{n}", n + 1
    return sql


SHARD_PERMUTE = f"SELECT o_orderkey, x AS shuffled, x & {SHARDS - 1} AS shard, x >> 6 AS place, o_orderkey AS back FROM ({_permute_sql('o_orderkey')})"


def shard_balance(spark, sf_dir):
    """How evenly order lines fall into shards, by shard: lines, orders, and the share of the mean in thousandths."""
    lines = shards.with_permuted(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey", "shuffled", BITS)
    shard, _ = shards.shard_of(F.col("shuffled"), SHARDS)
    per = lines.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("l_orderkey").alias("orders"))
    whole = Window.partitionBy(F.lit(0))  # one row per shard
    return per.select("shard", "lines", "orders", F.call_function("div", F.col("lines") * 1000 * F.count(F.lit(1)).over(whole), F.sum("lines").over(whole)).alias("of_mean"), F.min("lines").over(whole).alias("least"), F.max("lines").over(whole).alias("most"))


SHARD_BALANCE = f"""WITH s AS (SELECT x & {SHARDS - 1} AS shard, count(*) AS lines, count(DISTINCT o_orderkey) AS orders FROM ({_permute_sql('o_orderkey').replace('FROM orders', 'FROM (SELECT l_orderkey AS o_orderkey FROM lineitem)')}) GROUP BY 1)
SELECT shard, lines, orders, (lines * 1000 * count(*) OVER () // sum(lines) OVER ())::BIGINT AS of_mean, min(lines) OVER () AS least, max(lines) OVER () AS most FROM s"""


def epoch_shuffle(spark, sf_dir):
    """Two epochs of all orders in shuffled order: shard by shard, each epoch with an order of its own. No global sort."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(lit(0), lit(1))).alias("epoch"))
    mark = F.md5(F.concat_ws(":", F.col("epoch").cast("string"), F.col("o_orderkey").cast("string")))
    o = o.withColumn("mark", mark).withColumn("shard", F.conv(F.substring("mark", 1, 2), 16, 10).cast("long"))
    return o.select("epoch", "shard", F.row_number().over(Window.partitionBy("epoch", "shard").orderBy("mark")).cast("long").alias("place"), "o_orderkey")


EPOCH_SHUFFLE = """WITH m AS (SELECT o_orderkey, epoch, md5(epoch || ':' || o_orderkey) AS mark FROM orders, (SELECT unnest([0, 1])::BIGINT AS epoch)), s AS (SELECT *, ('0x' || substr(mark, 1, 2))::BIGINT AS shard FROM m)
SELECT epoch, shard, row_number() OVER (PARTITION BY epoch, shard ORDER BY mark) AS place, o_orderkey FROM s"""


def offset_join(spark, sf_dir):
    """Order lines whose linear index falls in a part's interval: sizes summed to offsets, then a range join by buckets."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("long").alias("size"))
    total = parts.groupBy("p_brand").agg(F.sum("size").alias("total"))
    before = Window.orderBy("p_brand").rowsBetween(Window.unboundedPreceding, -1)  # one row per brand
    base = total.select(F.col("p_brand").alias("brand"), F.coalesce(F.sum("total").over(before), lit(0)).alias("base"))
    # A brand's parts are summed by thousands of keys first, so no window sorts all of a brand.
    cell = F.expr("p_partkey div 1000")
    cells = parts.groupBy(F.col("p_brand").alias("of"), cell.alias("at")).agg(F.sum("size").alias("held"))
    ahead = F.sum("held").over(Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.select("of", "at", F.coalesce(ahead, lit(0)).alias("ahead")).join(base, F.col("of") == F.col("brand")).select("of", "at", (F.col("ahead") + F.col("base")).alias("first"))
    inside = Window.partitionBy("p_brand", "cell").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, -1)
    spots = parts.withColumn("cell", cell).withColumn("start", F.coalesce(F.sum("size").over(inside), lit(0)))
    spots = spots.join(starts, (F.col("p_brand") == F.col("of")) & (F.col("cell") == F.col("at"))).withColumn("lo", F.col("first") + F.col("start"))
    spots = spots.select("p_partkey", "lo", (F.col("lo") + F.col("size")).alias("hi"))
    whole = parts.agg(F.sum("size")).first()[0] or 1
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % lit(whole)).alias("linear"))
    return intervals.locate(lines, spots, 256).select("l_orderkey", "l_linenumber", "linear", "p_partkey", (F.col("linear") - F.col("lo")).alias("within"))


OFFSET_JOIN = """WITH s AS (SELECT p_partkey, sum(p_size) OVER (ORDER BY p_brand, p_partkey) - p_size AS lo, sum(p_size) OVER (ORDER BY p_brand, p_partkey) AS hi FROM part),
l AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 7919 + l_linenumber * 104729) % (SELECT greatest(sum(p_size), 1)::BIGINT FROM part) AS linear FROM lineitem)
SELECT l_orderkey, l_linenumber, linear, p_partkey, (linear - lo)::BIGINT AS within FROM l JOIN s ON linear >= lo AND linear < hi"""


def completeness(spark, sf_dir):
    """Keys that one of two tables lacks: customers without an order, orders without a customer, orders without a line."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    a = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("customer without order").alias("what"), F.col("c_custkey").alias("key"))
    b = o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("order without customer").alias("what"), F.col("o_orderkey").alias("key"))
    d = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.lit("order without line").alias("what"), F.col("o_orderkey").alias("key"))
    return a.unionByName(b).unionByName(d)


COMPLETENESS = """SELECT 'customer without order' AS what, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'order without customer', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'order without line', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""


def compare_tables(spark, sf_dir):
    """A full comparison of what orders and lines say of each order: both, or one side only, and how many lines."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    both = o.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "full_outer")
    side = F.when(F.col("l_orderkey").isNull(), "order").when(F.col("o_orderkey").isNull(), "line").otherwise("both")
    return both.groupBy(side.alias("side"), F.coalesce("lines", lit(0)).alias("lines")).agg(F.count(F.lit(1)).alias("n"))


COMPARE_TABLES = """SELECT CASE WHEN l_orderkey IS NULL THEN 'order' WHEN o_orderkey IS NULL THEN 'line' ELSE 'both' END AS side, coalesce(lines, 0) AS lines, count(*) AS n
FROM orders FULL JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY ALL"""


def sample_per_group(spark, sf_dir):
    """Sixteen orders of each status and priority, by a hash of the key (a sampling operator)."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("mark"))
    w = Window.partitionBy("o_orderstatus", "o_orderpriority").orderBy("mark")
    return o.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 16").drop("mark")


SAMPLE_PER_GROUP = """SELECT o_orderstatus, o_orderpriority, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY md5(o_orderkey::VARCHAR)) AS place FROM orders) WHERE place <= 16"""


def entropy_by_group(spark, sf_dir):
    """Bits of entropy of return flags by line status and ship mode of the month, with the hand-made rollup as one; in millionths."""
    g = table(spark, sf_dir, "lineitem").select("l_linestatus", F.month("l_shipdate").cast("long").alias("month"), "l_returnflag")
    n = g.groupBy("l_linestatus", "month", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    rolled = n.groupingSets([["l_linestatus", "month", "l_returnflag"], ["l_linestatus", "l_returnflag"], ["l_returnflag"]], "l_linestatus", "month", "l_returnflag").agg(F.sum("n").alias("n"))
    rolled = rolled.select(F.coalesce("l_linestatus", F.lit("all")).alias("status"), F.coalesce("month", lit(0)).alias("month"), "n")
    per = rolled.groupBy("status", "month").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    return per.select("status", "month", "n", F.round((F.log2(F.col("n").cast("double")) - F.col("s") / F.col("n")) * 1000000).cast("long").alias("micro_bits"))


ENTROPY_BY_GROUP = """WITH n AS (SELECT l_linestatus, month(l_shipdate) AS month, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT l_linestatus AS status, month, l_returnflag, n FROM n UNION ALL SELECT l_linestatus, 0, l_returnflag, sum(n) FROM n GROUP BY 1, 3 UNION ALL SELECT 'all', 0, l_returnflag, sum(n) FROM n GROUP BY 3),
p AS (SELECT status, month::BIGINT AS month, sum(n)::BIGINT AS n, sum(n * log2(n)) AS s FROM r GROUP BY status, month)
SELECT status, month, n, round((log2(n) - s / n) * 1000000)::BIGINT AS micro_bits FROM p"""


def _spans(spark, sf_dir):
    """Events as intervals: from their time, as many seconds as their value."""
    e = table(spark, sf_dir, "events")
    start = F.unix_timestamp("ts")
    return e.select("user_id", "event_id", "event_type", start.alias("start"), (start + F.floor(F.coalesce(F.abs("value"), F.lit(0.0)))).alias("end"))


_SPANS = "s AS (SELECT user_id, event_id, event_type, epoch(date_trunc('second', ts))::BIGINT AS start, epoch(date_trunc('second', ts))::BIGINT + floor(coalesce(abs(value), 0))::BIGINT AS stop FROM events)"


def interval_merge(spark, sf_dir):
    return intervals.merge(_spans(spark, sf_dir), ["user_id"], "start", "end", 3600)


INTERVAL_MERGE = f"""WITH {_SPANS}, b AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
p AS (SELECT *, sum(CASE WHEN before IS NULL OR start - before > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS part FROM b)
SELECT user_id, min(start) AS start, max(stop) AS "end", count(*) AS n FROM p GROUP BY user_id, part"""


def interval_rasterize(spark, sf_dir):
    return intervals.rasterize(_spans(spark, sf_dir), ["event_type"], "start", "end", 60)


INTERVAL_RASTERIZE = f"""WITH {_SPANS}, b AS (SELECT event_type, start, stop, unnest(range(start // 60, (stop - 1) // 60 + 1)) AS bucket FROM s WHERE stop > start)
SELECT event_type, bucket, sum(least(stop, (bucket + 1) * 60) - greatest(start, bucket * 60))::BIGINT AS covered FROM b GROUP BY event_type, bucket"""


def event_causes(spark, sf_dir):
    """Each event with its user's last earlier view, as edges of a history; -1 without one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    found = intervals.last_before(e, ["user_id"], "ts", "event_id", F.col("event_type") == "view")
    return found.select("event_id", "user_id", F.coalesce("cause", lit(-1)).alias("cause"))


EVENT_CAUSES = """SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS cause FROM events"""


def text_functions(spark, sf_dir):
    """Digests, encodings and grouped digits of customers."""
    c = table(spark, sf_dir, "customer")
    cents = F.round(F.abs("c_acctbal") * 100).cast("long")
    return c.select("c_custkey", F.sha1("c_name").alias("sha1"), F.sha2("c_name", 256).alias("sha256"), F.base64(F.col("c_name").cast("binary")).alias("base64"), F.translate(F.format_number(cents, 0), ",", "_").alias("grouped"), F.get_json_object(F.to_json(F.struct("c_custkey", "c_name")), "$.c_name").alias("name"))


TEXT_FUNCTIONS = r"""SELECT c_custkey, sha1(c_name) AS sha1, sha256(c_name) AS sha256, base64(c_name::BLOB) AS base64, regexp_replace(reverse(regexp_replace(reverse(round(abs(c_acctbal) * 100)::BIGINT::VARCHAR), '(\d{3})', '\1_', 'g')), '^_', '') AS grouped, c_name AS name FROM customer"""


def approx_distinct(spark, sf_dir):
    """Distinct keys of each status by a mergeable sketch."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.02).alias("customers"), F.approx_count_distinct("o_orderkey", 0.02).alias("orders"))


def stream_sessions(spark, sf_dir):
    return stream.sessions(spark, f"{sf_dir}/events.parquet*")


STREAM_SESSIONS = """WITH b AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
p AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM b)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM p GROUP BY user_id, part"""


def stream_arrivals(spark, sf_dir):
    return stream.arrivals(spark, f"{sf_dir}/events.parquet*", ["view", "click", "purchase"])


STREAM_ARRIVALS = """SELECT user_id, bit_or(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 ELSE 0 END)::BIGINT AS seen, bit_or(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 ELSE 0 END) = 7 AS complete FROM events GROUP BY user_id"""

QUERIES = {
    "shard_permute": (shard_permute, SHARD_PERMUTE),
    "shard_balance": (shard_balance, SHARD_BALANCE),
    "epoch_shuffle": (epoch_shuffle, EPOCH_SHUFFLE),
    "offset_join": (offset_join, OFFSET_JOIN),
    "completeness": (completeness, COMPLETENESS),
    "compare_tables": (compare_tables, COMPARE_TABLES),
    "sample_per_group": (sample_per_group, SAMPLE_PER_GROUP),
    "entropy_by_group": (entropy_by_group, ENTROPY_BY_GROUP),
    "interval_merge": (interval_merge, INTERVAL_MERGE),
    "interval_rasterize": (interval_rasterize, INTERVAL_RASTERIZE),
    "event_causes": (event_causes, EVENT_CAUSES),
    "text_functions": (text_functions, TEXT_FUNCTIONS),
    "approx_distinct": (approx_distinct, None),
    "stream_sessions": (stream_sessions, STREAM_SESSIONS),
    "stream_arrivals": (stream_arrivals, STREAM_ARRIVALS),
}
