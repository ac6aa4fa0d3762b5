"""Queries on shuffles of any range, interleaved slices, comparisons of tables, closures and reachability."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boards as b
from ..functions import geometry as g
from ..functions import sections as sec
from ..operators import compare, intervals, interleave, shards
from ..plans.closure import descendants
from ..plans.reachable import reachable
from ..plans.tables import materialize
from ..sources.positions import positions, table
from . import sqltext as t


def range_permute(spark, sf_dir):
    """Part keys shuffled within 0 .. their largest, whatever that is, and got back."""
    keys = table(spark, sf_dir, "part").select("p_partkey")
    n = (keys.agg(F.max("p_partkey")).first()[0] or 0) + 1
    return shards.with_inverse(shards.with_bijection(keys, "p_partkey", "shuffled", n, 5), "shuffled", "back", n, 5)


def _permuted_sql(source: str, n: str, seed: int) -> str:
    """Recursive CTE w(id, x, i): x after i passes over a grid of n cells, n a scalar CTE g(n, a, b)."""
    step, keys = "x // b AS l, x % b AS r", shards.round_keys(seed)
    sql = f"SELECT id, i + 1 AS i, n, a, b, {step} FROM w WHERE i = 0 OR x >= n"
    for i, (m, c) in enumerate(keys):
        of = "r" if i % 2 == 0 else "l"
        by = f"(((({of} % {shards.FIELD}) * ({of} % {shards.FIELD}) % {shards.FIELD}) * {m} + {c}) % {shards.FIELD})"
        sql = f"SELECT id, i, n, a, b, {f'(l + {by}) % a AS l, r' if i % 2 == 0 else f'l, (r + {by}) % b AS r'} FROM ({sql})"
    return f"""g AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, ceil(sqrt(n))::BIGINT AS a FROM ({n}))),
w AS (SELECT id, 0 AS i, n, a, b, id AS x FROM ({source}), g UNION ALL SELECT id, i, n, a, b, l * b + r FROM ({sql})),
p AS (SELECT id, arg_max(x, i) AS shuffled FROM w GROUP BY id)"""


RANGE_PERMUTE = f"""WITH RECURSIVE {_permuted_sql("SELECT DISTINCT p_partkey AS id FROM part", "SELECT max(p_partkey) + 1 AS n FROM part", 5)}
SELECT p_partkey, shuffled, p_partkey AS back FROM part JOIN p ON id = p_partkey"""
GATHERED, SHARDS = range(3, 6), 16


def shard_gather(spark, sf_dir):
    """Three of sixteen shards of all places of all parts (as many as a part's size): shard and place lead back to the part and the place in it."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"))
    cell = F.expr("p_partkey div 1000")
    sums = parts.groupBy(cell.alias("cell")).agg(F.sum("size").alias("total"))
    base = sums.select("cell", F.coalesce(F.sum("total").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), b.lit(0)).alias("base"))  # a row for each thousand of parts
    inside = Window.partitionBy("cell").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, -1)
    spots = parts.withColumn("cell", cell).join(base, "cell").withColumn("lo", F.col("base") + F.coalesce(F.sum("size").over(inside), b.lit(0)))
    spots = spots.select("p_partkey", "lo", (F.col("lo") + F.col("size")).alias("hi"))
    total = parts.agg(F.sum("size")).first()[0] or 0
    found = shards.gather(spark, GATHERED, SHARDS, total, 9)
    return intervals.locate(found, spots, 256).select("shard", "place", "p_partkey", (F.col("linear") - F.col("lo")).alias("within"))


SHARD_GATHER = f"""WITH RECURSIVE s AS (SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY p_partkey) - p_size AS lo FROM part),
e AS (SELECT p_partkey, (lo + k)::BIGINT AS id, k::BIGINT AS within FROM s, LATERAL (SELECT unnest(range(p_size)) AS k)),
{_permuted_sql("SELECT id FROM e", "SELECT sum(p_size)::BIGINT AS n FROM part", 9)}
SELECT shuffled % {SHARDS} AS shard, shuffled // {SHARDS} AS place, p_partkey, within FROM e JOIN p USING (id) WHERE shuffled % {SHARDS} BETWEEN {GATHERED.start} AND {GATHERED.stop - 1}"""


def slice_interleave(spark, sf_dir):
    """Two epochs of all orders with their priorities mixed in proportion to their numbers."""
    return interleave.strides(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", epochs=2, buckets=64)


SLICE_INTERLEAVE = """WITH m AS (SELECT o_orderkey, o_orderpriority, epoch, md5(epoch || ':' || o_orderkey) AS mark FROM orders, (SELECT unnest([0, 1])::BIGINT AS epoch)),
r AS (SELECT *, 2 * row_number() OVER (PARTITION BY epoch, o_orderpriority ORDER BY mark, o_orderkey) - 1 AS twice, count(*) OVER (PARTITION BY epoch, o_orderpriority) AS n FROM m),
k AS (SELECT *, (twice * 64) // (2 * n) AS bucket FROM r)
SELECT o_orderkey, o_orderpriority, epoch, bucket, row_number() OVER (PARTITION BY epoch, bucket ORDER BY twice::DOUBLE / n::DOUBLE, o_orderpriority, o_orderkey) AS place FROM k"""


def _edition(orders, edition: int):
    """Two editions of a table of order values: the second lacks some orders, has others anew and others changed."""
    price = F.round(F.col("o_totalprice") * 100).cast("long")
    if not edition:
        return orders.where("o_orderkey % 97 <> 5").select("o_orderkey", "o_custkey", price.alias("cents"), "o_orderstatus")
    return orders.where("o_orderkey % 89 <> 7").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 101 == 3, price + 1).otherwise(price).alias("cents"), F.when(F.col("o_orderkey") % 103 == 4, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


def table_differences(spark, sf_dir):
    """Where two editions of the orders differ, row by row; blocks of 64 keys are compared by digests first."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    found = compare.differences(_edition(o, 0), _edition(o, 1), ["o_orderkey"], ["o_custkey", "cents", "o_orderstatus"], F.expr("o_orderkey div 64"))
    none = lambda c: F.coalesce(c, F.lit("none") if c.endswith("status") else F.lit(-1)).alias(c)
    return found.select("o_orderkey", "what", *[none(c) for c in found.columns[2:]])


_EDITIONS = """a AS (SELECT o_orderkey, o_custkey, round(o_totalprice * 100)::BIGINT AS cents, o_orderstatus FROM orders WHERE o_orderkey % 97 <> 5),
z AS (SELECT o_orderkey, o_custkey, round(o_totalprice * 100)::BIGINT + CASE WHEN o_orderkey % 101 = 3 THEN 1 ELSE 0 END AS cents, CASE WHEN o_orderkey % 103 <> 4 THEN o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 89 <> 7)"""
TABLE_DIFFERENCES = f"""WITH {_EDITIONS}, j AS (SELECT coalesce(a.o_orderkey, z.o_orderkey) AS o_orderkey, CASE WHEN z.o_orderkey IS NULL THEN 'left only' WHEN a.o_orderkey IS NULL THEN 'right only'
  WHEN a.o_custkey IS DISTINCT FROM z.o_custkey OR a.cents IS DISTINCT FROM z.cents OR a.o_orderstatus IS DISTINCT FROM z.o_orderstatus THEN 'changed' END AS what,
  a.o_custkey AS left_o_custkey, z.o_custkey AS right_o_custkey, a.cents AS left_cents, z.cents AS right_cents, a.o_orderstatus AS left_o_orderstatus, z.o_orderstatus AS right_o_orderstatus FROM a FULL JOIN z ON a.o_orderkey = z.o_orderkey)
SELECT o_orderkey, what, coalesce(left_o_custkey, -1) AS left_o_custkey, coalesce(right_o_custkey, -1) AS right_o_custkey, coalesce(left_cents, -1) AS left_cents, coalesce(right_cents, -1) AS right_cents,
coalesce(left_o_orderstatus, 'none') AS left_o_orderstatus, coalesce(right_o_orderstatus, 'none') AS right_o_orderstatus FROM j WHERE what IS NOT NULL"""


def sample_probe(spark, sf_dir):
    """Order lines as samples of what the second edition of the orders should hold: those that it contradicts or lacks."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    asked = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    samples = _edition(o, 0).join(asked, "o_orderkey", "left_semi").select("o_orderkey", "cents")
    return compare.probe(samples, _edition(o, 1), ["o_orderkey"], ["cents"], F.expr("o_orderkey div 64")).withColumn("found_cents", F.coalesce("found_cents", F.lit(-1)))


SAMPLE_PROBE = f"""WITH {_EDITIONS} SELECT a.o_orderkey, a.cents AS expected_cents, coalesce(z.cents, -1) AS found_cents FROM a LEFT JOIN z ON a.o_orderkey = z.o_orderkey
WHERE a.o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) AND (z.o_orderkey IS NULL OR a.cents <> z.cents)"""


def section_closure(spark, sf_dir):
    """All sections that those of the orders' positions lead to, up to full boards, by number of stones."""
    p = positions(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return descendants(p.select(sec.sig(sec.counts(F.col("s0"), F.col("s1"))).alias("section")).distinct())


def _grown(q: int) -> str:
    parts = [(f"c{2 * i}", f"c{2 * i + 1}") for i in range(4)]
    parts[q] = (f"(c{2 * q} + first)", f"(c{2 * q + 1} + 1 - first)")
    return f"(CASE WHEN c{2 * q} + c{2 * q + 1} < 9 THEN {t.standard(parts)} END)"


_SIG = [f"((section >> {8 * i}) & 255)" for i in range(8)]
_SUM = " + ".join(_SIG)
SECTION_CLOSURE = f"""WITH RECURSIVE {t.positions("orders", "o_orderkey")}, s AS (SELECT DISTINCT {t.standard(t.counts())}::BIGINT AS section FROM p),
d AS (SELECT section FROM s UNION SELECT unnest([{", ".join(_grown(q) for q in range(4))}])::BIGINT FROM (SELECT {", ".join(f"{x} AS c{i}" for i, x in enumerate(_SIG))}, 1 - ({_SUM}) % 2 AS first FROM d WHERE section IS NOT NULL))
SELECT ({_SUM})::BIGINT AS slice, section FROM d WHERE section IS NOT NULL"""


def crossed_lines(df, key: str):
    """key, black, white: a line of five for each side out of the key, where they share no cell; less a stone or two of the sides by turns, by key."""
    lines = g.win_masks()
    k = F.col(key).cast("long")
    rows = df.select(k.alias("key"), b.looked_up(lines, k * 7 % 32).alias("black"), b.looked_up(lines, F.call_function("div", k * 5, b.lit(3)) % 32).alias("white")).where("black & white = 0")
    low = lambda c: F.col(c).bitwiseAND(-F.col(c))
    return rows.select("key", F.when(k_mod() == 2, F.col("black").bitwiseXOR(low("black"))).otherwise(F.col("black")).alias("black"), F.when(k_mod() >= 1, F.col("white").bitwiseXOR(low("white"))).otherwise(F.col("white")).alias("white"))


def k_mod():
    return F.col("key") % 5


def reachable_share(spark, sf_dir):
    """Suppliers' positions with lines of five: by number of stones, how many can be reached without an intermediate five, each weighted by the symmetries of the square that leave it as it is, with sums of squares."""
    roots = materialize(crossed_lines(table(spark, sf_dir, "supplier").select("s_suppkey").distinct(), "s_suppkey"), "reachable-roots")
    found = reachable(roots, 10)
    c = F.call_function("div", b.lit(8), b.orbit_size(F.col("black"), F.col("white")))
    found = found.select((b.stones(F.col("black")) + b.stones(F.col("white"))).alias("stones"), b.unfused(c).alias("c"), F.col("reached").cast("long").alias("r"))
    sums = {"n": F.col("c"), "reached": F.col("c") * F.col("r"), "missed": F.col("c") * (1 - F.col("r"))}
    return found.groupBy("stones").agg(F.count(F.lit(1)).alias("boards"), *[F.sum(x).alias(k) for k, x in sums.items()], *[F.sum(x * x).alias(f"{k}_squares") for k, x in sums.items()])


def _reachable_sql() -> str:
    lanes = lambda side: " | ".join("(CASE (i >> " + str(2 * q) + ") & 3 " + " ".join(f"WHEN {k} THEN {t.moved(side, g.quarter_turn(q, k))} & {g.LANE[q]}" for k in range(4)) + " END)" for q in range(4))
    lines = ", ".join(map(str, g.win_masks()))
    part = lambda cells: "".join(f" | (CASE WHEN m & {1 << j} <> 0 THEN {cells}[{j + 1}] ELSE 0 END)" for j in range(5))
    parts = [
        f"l AS (SELECT DISTINCT s_suppkey::BIGINT AS key, [{lines}][s_suppkey * 7 % 32 + 1] AS b0, [{lines}][(s_suppkey * 5 // 3) % 32 + 1] AS w0 FROM supplier)",
        "q AS (SELECT key, CASE WHEN key % 5 = 2 THEN xor(b0, b0 & -b0) ELSE b0 END AS black, CASE WHEN key % 5 >= 1 THEN xor(w0, w0 & -w0) ELSE w0 END AS white FROM l WHERE b0 & w0 = 0)",
        f"c AS (SELECT key, black, white, list(1::BIGINT << bit ORDER BY bit) FILTER (black & (1::BIGINT << bit) <> 0) AS bc, list(1::BIGINT << bit ORDER BY bit) FILTER (white & (1::BIGINT << bit) <> 0) AS wc FROM q, (SELECT unnest([{', '.join(map(str, g.BITS))}]) AS bit) GROUP BY ALL)",
        "m AS (SELECT unnest(range(32)) AS m), rot AS (SELECT unnest(range(256)) AS i)",
        f"fb AS (SELECT key, m, i, {t.won('x')} AS f FROM (SELECT key, m, i, {lanes('s')} AS x FROM (SELECT key, m, 0{part('bc')} AS s FROM c, m WHERE m < 1 << len(bc)), rot))",
        f"fw AS (SELECT key, m, i, {t.won('x')} AS f FROM (SELECT key, m, i, {lanes('s')} AS x FROM (SELECT key, m, 0{part('wc')} AS s FROM c, m WHERE m < 1 << len(wc)), rot))",
        "near AS (SELECT i, (i & ~(3 << (2 * q))) | ((((i >> (2 * q)) + d) & 3) << (2 * q)) AS j FROM rot, (SELECT unnest([0, 1, 2, 3]) AS q), (SELECT unnest([1, 3]) AS d))",
        "r0 AS (SELECT key, 0 AS mb, 0 AS mw, i FROM c, rot)",
    ]
    for n in range(10):
        own = "mb" if n % 2 == 0 else "mw"
        grown = f"SELECT DISTINCT r.key, {'r.mb | bit' if own == 'mb' else 'r.mb'} AS mb, {'r.mw | bit' if own == 'mw' else 'r.mw'} AS mw, r.i FROM r{n} r JOIN c USING (key), (SELECT unnest([1, 2, 4, 8, 16]) AS bit) WHERE r.{own} & bit = 0 AND bit < 1 << len({'bc' if own == 'mb' else 'wc'})"
        parts.append(f"r{n + 1} AS (SELECT DISTINCT key, mb, mw, e.j AS i FROM ({grown}) x JOIN near e USING (i) JOIN fb ON fb.key = x.key AND fb.m = mb AND fb.i = x.i AND NOT fb.f JOIN fw ON fw.key = x.key AND fw.m = mw AND fw.i = x.i AND NOT fw.f)".replace("SELECT DISTINCT key,", "SELECT DISTINCT x.key,", 1))
    every = " UNION ALL ".join(f"SELECT key, mb, mw, i FROM r{n}" for n in range(11))
    images = ", ".join(t.pack(t.moved("black", m), t.moved("white", m)) for m in g.square_symmetries())
    return f"""WITH {', '.join(parts)}, f AS (SELECT key, black, white, len(bc) + len(wc) AS stones, 8 // len(list_distinct([{images}])) AS c FROM c),
a AS (SELECT f.*, (SELECT count(*) FROM ({every}) y JOIN c USING (key) WHERE y.key = f.key AND y.i = 0 AND y.mb = (1 << len(bc)) - 1 AND y.mw = (1 << len(wc)) - 1) > 0 AS reached FROM f)
SELECT stones::BIGINT AS stones, count(*) AS boards, sum(c)::BIGINT AS n, sum(c * reached::INT)::BIGINT AS reached, sum(c * (1 - reached::INT))::BIGINT AS missed, sum(c * c)::BIGINT AS n_squares, sum(c * c * reached::INT)::BIGINT AS reached_squares, sum(c * c * (1 - reached::INT))::BIGINT AS missed_squares FROM a GROUP BY stones"""


REACHABLE_SHARE = _reachable_sql()

QUERIES = {
    "range_permute": (range_permute, RANGE_PERMUTE),
    "shard_gather": (shard_gather, SHARD_GATHER),
    "slice_interleave": (slice_interleave, SLICE_INTERLEAVE),
    "table_differences": (table_differences, TABLE_DIFFERENCES),
    "sample_probe": (sample_probe, SAMPLE_PROBE),
    "section_closure": (section_closure, SECTION_CLOSURE),
    "reachable_share": (reachable_share, REACHABLE_SHARE),
}
