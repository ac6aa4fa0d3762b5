"""Queries on single positions and on sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boards as b
from ..functions import geometry as g
from ..functions import sections as sec
from ..operators import moves
from ..sources.positions import positions, read_names, table, write_names
from . import sqltext as t

P = t.positions("orders", "o_orderkey")


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


def board_pack_unpack(spark, sf_dir):
    """The packed board, its quadrants, its digits, and the sides read back."""
    p = _positions(spark, sf_dir).withColumn("board", b.pack(F.col("s0"), F.col("s1")))
    return p.select(b.unfused(F.col("key")).alias("key"), "board", *[b.quadrant(F.col("board"), q).alias(f"q{q}") for q in range(4)], b.unpack(F.col("board"), 0).alias("s0"), b.unpack(F.col("board"), 1).alias("s1"), b.table_text(F.col("board")).alias("digits"), b.valid_board(F.col("board")).alias("valid"))


BOARD_PACK_UNPACK = f"""WITH {P}, q AS (SELECT key, s0, s1, {t.pack("s0", "s1")} AS board FROM p),
d AS (SELECT DISTINCT key, i, c FROM h), e AS (SELECT key, string_agg(c::VARCHAR, '' ORDER BY i) AS digits FROM d GROUP BY key)
SELECT key, board, {", ".join(f"{t.quadrant('board', i)} AS q{i}" for i in range(4))}, s0, s1, digits, true AS valid FROM q JOIN e USING (key)"""


def board_status(spark, sf_dir):
    p = _positions(spark, sf_dir)
    s0, s1 = F.col("s0"), F.col("s1")
    return p.select("key", b.stones(s0).alias("stones0"), b.stones(s1).alias("stones1"), b.won(s0).alias("won0"), b.won(s1).alias("won1"), b.status(s0, s1).cast("long").alias("status"), (b.stones(s0) == b.stones(s1)).alias("first_to_move"), b.pack(s1, s0).alias("flipped"))


BOARD_STATUS = f"""WITH {P}, w AS (SELECT *, {t.won("s0")} AS won0, {t.won("s1")} AS won1 FROM p)
SELECT key, bit_count(s0)::BIGINT AS stones0, bit_count(s1)::BIGINT AS stones1, won0, won1,
CASE WHEN NOT won0 AND NOT won1 AND (s0 | s1) = {g.FULL} THEN 3 ELSE won0::BIGINT + 2 * won1::BIGINT END::BIGINT AS status, bit_count(s0) = bit_count(s1) AS first_to_move, {t.pack("s1", "s0")} AS flipped FROM w"""


def rotated_status(spark, sf_dir):
    """Five with at most one turn, for both sides."""
    p = _positions(spark, sf_dir)
    return p.select(b.unfused(F.col("key")).alias("key"), b.rotated_won(F.col("s0")).alias("near0"), b.rotated_won(F.col("s1")).alias("near1"))


_TURNED = " UNION ALL ".join(f"SELECT key, {i} AS turn, {t.moved('s0', m)} AS a, {t.moved('s1', m)} AS b FROM p" for i, m in enumerate([{}, *g.rotations()]))
ROTATED_STATUS = f"WITH {P}, r AS ({_TURNED}) SELECT key, bool_or({t.won('a')}) AS near0, bool_or({t.won('b')}) AS near1 FROM r GROUP BY key"


def canonical_d4(spark, sf_dir):
    p = _positions(spark, sf_dir)
    return p.select(b.unfused(F.col("key")).alias("key"), b.canonical(F.col("s0"), F.col("s1")).alias("canonical"), b.orbit_size(F.col("s0"), F.col("s1")).alias("orbit"))


_SYMMETRIC = " UNION ALL ".join(f"SELECT key, a * 0 + {t.pack('a', 'b')} AS board FROM (SELECT key, {t.moved('s0', m)} AS a, {t.moved('s1', m)} AS b FROM p)" for m in g.square_symmetries())
CANONICAL_D4 = f"WITH {P}, r AS ({_SYMMETRIC}) SELECT key, min(board) AS canonical, count(DISTINCT board) AS orbit FROM r GROUP BY key"


def canonical_witness(spark, sf_dir):
    """The least board of the eight symmetries with the first symmetry that gives it, and the same for its section."""
    p = _positions(spark, sf_dir)
    p = p.select(b.unfused(F.col("key")).alias("key"), "s0", "s1", F.array(*b.symmetric_boards(F.col("s0"), F.col("s1"))).alias("boards"))
    parts = sec.counts(F.col("s0"), F.col("s1"))
    images = F.array(*[sec.sig([parts[x] for x in source]) for source in g.quadrant_sources()])
    p = p.select(b.unfused(F.col("key")).alias("key"), "boards", images.alias("sections"))
    first = lambda c: (F.array_position(c, F.array_min(c)) - 1).cast("long")
    return p.select("key", F.array_min("boards").alias("canonical"), first("boards").alias("symmetry"), F.array_min("sections").alias("section"), first("sections").alias("section_symmetry"))


_WITNESS = " UNION ALL ".join(f"SELECT key, {i} AS i, {t.pack('a', 'b')} AS board, {t.sig([t.counts()[x] for x in source])} AS sig FROM (SELECT key, s0, s1, {t.moved('s0', m)} AS a, {t.moved('s1', m)} AS b FROM p)" for i, (m, source) in enumerate(zip(g.square_symmetries(), g.quadrant_sources(), strict=True)))
CANONICAL_WITNESS = f"""WITH {P}, r AS ({_WITNESS}), m AS (SELECT *, min(board) OVER w AS canonical, min(sig) OVER w AS section FROM r WINDOW w AS (PARTITION BY key))
SELECT key, canonical, min(i) FILTER (board = canonical)::BIGINT AS symmetry, section, min(i) FILTER (sig = section)::BIGINT AS section_symmetry FROM m GROUP BY key, canonical, section"""


def canonical_turns(spark, sf_dir):
    """The least board of all 2048 symmetries, and how many turns of quadrants leave the position as it is."""
    p = b.with_super_canonical(_positions(spark, sf_dir), "s0", "s1", "canonical")
    p = b.with_turned(p, "s0", "s1", "t")
    return p.select(b.unfused(F.col("key")).alias("key"), "canonical", b.stabilizer_log([F.col(f"t{i}") for i in range(4)]).cast("long").alias("stabilizer_log"))


def _least_turned(a: str, c: str) -> str:
    parts = []
    for q in range(4):
        turned = [t.quadrant(t.pack(t.moved(a, g.quarter_turn(q, k)), t.moved(c, g.quarter_turn(q, k))), q) for k in range(4)]
        parts.append(f"(least({', '.join(turned)}) << {16 * q})")
    return "(" + " | ".join(parts) + ")"


_SUPER = " UNION ALL ".join(f"SELECT key, {_least_turned('a', 'b')} AS board FROM (SELECT key, {t.moved('s0', m)} AS a, {t.moved('s1', m)} AS b FROM p)" for m in g.square_symmetries())
_STAB = " + ".join(f"CASE WHEN v{q}0 = v{q}1 THEN 2 WHEN v{q}0 = v{q}2 THEN 1 ELSE 0 END" for q in range(4))
_V = ", ".join(f"{t.quadrant(t.pack(t.moved('s0', g.quarter_turn(q, k)), t.moved('s1', g.quarter_turn(q, k))), q)} AS v{q}{k}" for q in range(4) for k in range(3))
CANONICAL_TURNS = f"""WITH {P}, r AS ({_SUPER}), v AS (SELECT key, {_V} FROM p), m AS (SELECT key, min(board) AS canonical FROM r GROUP BY key)
SELECT key, canonical, ({_STAB})::BIGINT AS stabilizer_log FROM m JOIN v USING (key)"""


def distinct_positions(spark, sf_dir):
    """How many different boards there are, as they stand and up to symmetries, by number of stones."""
    p = _positions(spark, sf_dir).select((b.stones(F.col("s0")) + b.stones(F.col("s1"))).alias("stones"), b.pack(F.col("s0"), F.col("s1")).alias("board"), b.canonical(F.col("s0"), F.col("s1")).alias("mod8"))
    return p.groupBy("stones").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("board").alias("mod1"), F.count_distinct("mod8").alias("mod8"))


DISTINCT_POSITIONS = f"""WITH {P}, r AS ({_SYMMETRIC}), c AS (SELECT key, min(board) AS mod8 FROM r GROUP BY key)
SELECT (bit_count(s0) + bit_count(s1))::BIGINT AS stones, count(*) AS n, count(DISTINCT {t.pack("s0", "s1")}) AS mod1, count(DISTINCT mod8) AS mod8 FROM p JOIN c USING (key) GROUP BY 1"""


def _sections(p: DataFrame) -> DataFrame:
    parts = sec.counts(F.col("s0"), F.col("s1"))
    return p.select("key", "s0", "s1", sec.sig(parts).alias("sig"), sec.standard(parts).alias("section"), sec.total(parts).alias("slice"), sec.images(parts).alias("images"), sec.valid(parts).alias("valid"))


def section_profile(spark, sf_dir):
    return _sections(_positions(spark, sf_dir)).drop("s0", "s1")


_LEAD = " + ".join(f"({a} - {c})" for a, c in t.counts())
_TOTAL = " + ".join(f"{a} + {c}" for a, c in t.counts())
SECTIONS = f"s AS (SELECT key, s0, s1, {t.sig(t.counts())} AS sig, {t.standard(t.counts())} AS section, ({_TOTAL})::BIGINT AS slice, {t.images(t.counts())}::BIGINT AS images, ({_LEAD}) IN (0, 1) AS valid FROM p)"
SECTION_PROFILE = f"WITH {P}, {SECTIONS} SELECT key, sig, section, slice, images, valid FROM s"


def section_counts(spark, sf_dir):
    """By section: positions, wins of either side, and positions weighted by the section's images."""
    s = _sections(_positions(spark, sf_dir)).withColumn("won0", b.won(F.col("s0")).cast("long")).withColumn("won1", b.won(F.col("s1")).cast("long"))
    return s.groupBy("slice", "section").agg(F.count(F.lit(1)).alias("total"), F.sum("won0").alias("won0"), F.sum("won1").alias("won1"), F.sum(F.col("won0") * F.col("won1")).alias("both"), F.sum("images").alias("weighted"))


SECTION_COUNTS = f"""WITH {P}, {SECTIONS}, w AS (SELECT *, {t.won("s0")}::BIGINT AS won0, {t.won("s1")}::BIGINT AS won1 FROM s)
SELECT slice, section, count(*) AS total, sum(won0)::BIGINT AS won0, sum(won1)::BIGINT AS won1, sum(won0 * won1)::BIGINT AS both, sum(images)::BIGINT AS weighted FROM w GROUP BY slice, section"""


def section_rollup(spark, sf_dir):
    """Sections, slices and all together, with a section's offset in its slice."""
    s = section_counts(spark, sf_dir)
    order = Window.partitionBy("slice").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("offset", F.coalesce(F.sum("total").over(order), F.lit(0)))
    rolled = s.rollup("slice", "section").agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("sections"), F.max("total").alias("largest"), F.max("offset").alias("offset"), (F.grouping("slice") + F.grouping("section")).cast("long").alias("level"))
    return rolled.select(F.coalesce("slice", F.lit(-1)).alias("slice"), F.coalesce("section", F.lit(-1)).alias("section"), "total", "sections", "largest", "offset", "level")


SECTION_ROLLUP = f"""WITH {P}, {SECTIONS}, c AS (SELECT slice, section, count(*) AS total FROM s GROUP BY slice, section),
o AS (SELECT *, coalesce(sum(total) OVER (PARTITION BY slice ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM c)
SELECT coalesce(o.slice, -1) AS slice, coalesce(o.section, -1) AS section, sum(total)::BIGINT AS total, count(*) AS sections, max(total) AS largest, max("offset")::BIGINT AS "offset", (grouping(o.slice) + grouping(o.section))::BIGINT AS level FROM o GROUP BY ROLLUP (o.slice, o.section)"""


def section_children(spark, sf_dir):
    """The sections one stone beyond those that occur, with how many lead there."""
    now = _sections(_positions(spark, sf_dir)).select("section").distinct()
    parts = sec.sig_counts(F.col("section"))
    rows = [sec.child(parts, q) for q in range(4)]
    each = F.array(*[F.struct(c.alias("child"), room.alias("room")) for c, room in rows])
    found = now.select("section", b.unfused(each).alias("each")).select("section", F.explode_outer("each").alias("c"))
    return found.where("c.room").groupBy(F.col("c.child").alias("child")).agg(F.count_distinct("section").alias("parents"))


def _sig_counts(s: str) -> list[tuple[str, str]]:
    at = lambda i: f"(({s} >> {8 * i}) & 255)"
    return [(at(2 * q), at(2 * q + 1)) for q in range(4)]


def _child_sql(q: int) -> str:
    parts = [(f"c{2 * i}", f"c{2 * i + 1}") for i in range(4)]
    parts[q] = (f"(c{2 * q} + first)", f"(c{2 * q + 1} + 1 - first)")
    return f"SELECT section, {t.standard(parts)} AS child FROM c WHERE c{2 * q} + c{2 * q + 1} < 9"


SECTION_CHILDREN = f"""WITH {P}, {SECTIONS}, n AS (SELECT DISTINCT section FROM s),
c AS (SELECT *, 1 - ({" + ".join(f"c{i}" for i in range(8))}) % 2 AS first FROM (SELECT section, {", ".join(f"{x} AS c{i}" for i, x in enumerate(x for pair in _sig_counts("section") for x in pair))} FROM n)),
k AS ({" UNION ALL ".join(_child_sql(q) for q in range(4))}) SELECT child, count(DISTINCT section) AS parents FROM k GROUP BY child"""


def least_quadrants(spark, sf_dir):
    """Quadrants up to their own turns: stones of each side, and how often each least form occurs, in which place."""
    p = b.with_turned(_positions(spark, sf_dir), "s0", "s1", "t")
    turned = [F.col(f"t{i}") for i in range(4)]
    rows = p.select(F.inline(F.array(*[F.struct(F.lit(q).cast("long").alias("place"), F.least(*b.turned_quadrants(turned, q)).alias("least"), F.bit_count(F.col("s0").bitwiseAND(b.lit(g.LANE[q]))).cast("long").alias("first"), F.bit_count(F.col("s1").bitwiseAND(b.lit(g.LANE[q]))).cast("long").alias("second")) for q in range(4)])))
    return rows.groupBy("first", "second", "least").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"))


_LQ = " UNION ALL ".join(f"SELECT {q} AS place, least({', '.join(t.quadrant(t.pack(t.moved('s0', g.quarter_turn(q, k)), t.moved('s1', g.quarter_turn(q, k))), q) for k in range(4))}) AS lq, bit_count(s0 & {g.LANE[q]})::BIGINT AS a, bit_count(s1 & {g.LANE[q]})::BIGINT AS b FROM p" for q in range(4))
LEAST_QUADRANTS = f'WITH {P}, l AS ({_LQ}) SELECT a AS first, b AS second, lq AS "least", count(*) AS n, min(place)::BIGINT AS first_place FROM l GROUP BY a, b, lq'


def placements_summary(spark, sf_dir):
    """Each position's placements by the first side: how many, how many make five, and a checksum of the boards."""
    rows = moves.placements(_positions(spark, sf_dir), "s0", "s1")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("moves"), F.sum(b.won(F.col("placed")).cast("long")).alias("fives"), F.bit_xor(b.pack(F.col("s1"), F.col("placed"))).alias("checksum"))


_CELLS = "c AS (SELECT p.*, 1::BIGINT << bit AS cell FROM p, (SELECT unnest([" + ", ".join(map(str, g.BITS)) + "]) AS bit) WHERE ((s0 | s1) & (1::BIGINT << bit)) = 0)"
PLACEMENTS_SUMMARY = f"WITH {P}, {_CELLS} SELECT key, count(*) AS moves, sum({t.won('(s0 | cell)')}::BIGINT)::BIGINT AS fives, bit_xor({t.pack('s1', '(s0 | cell)')}) AS checksum FROM c GROUP BY key"


def moves_summary(spark, sf_dir):
    """Each position's full moves, stone and turn: how many, how many different boards, a checksum, and how many leave a five."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a row is a few bytes and much work, so keys are spread however the file is cut
    keys = table(spark, sf_dir, "orders").select("o_orderkey").repartition(parts, "o_orderkey").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("times"))
    each = moves.summary(positions(keys, "o_orderkey", "times"), "s0", "s1")
    return each.select("key", (F.col("moves") * F.col("times")).alias("moves"), "boards", F.when(F.col("times") % 2 == 1, F.col("checksum")).otherwise(b.lit(0)).alias("checksum"), (F.col("over") * F.col("times")).alias("over"))


_MOVES = "m AS (" + " UNION ALL ".join(f"SELECT key, {t.moved('(s0 | cell)', r)} AS a, {t.moved('s1', r)} AS b FROM c" for r in g.rotations()) + ")"
MOVES_SUMMARY = f"WITH {P}, {_CELLS}, {_MOVES}, n AS (SELECT key, {t.pack('b', 'a')} AS board, ({t.won('a')} OR {t.won('b')})::BIGINT AS over_ FROM m) SELECT key, count(*) AS moves, count(DISTINCT board) AS boards, bit_xor(board) AS checksum, sum(over_)::BIGINT AS over FROM n GROUP BY key"


def win_closeness(spark, sf_dir):
    p = _positions(spark, sf_dir)
    p = b.with_closeness(b.with_closeness(p, F.col("s0"), F.col("s1"), "close0"), F.col("s1"), F.col("s0"), "close1")
    return p.select("key", "close0", "close1")


def _closeness_sql(black: str, white: str) -> str:
    return f"SELECT key, CASE WHEN min(d) = 6 THEN 0 ELSE (6 - min(d)) * 65536 + count(*) FILTER (d = least_) END AS close FROM (SELECT *, min(d) OVER (PARTITION BY key) AS least_ FROM (SELECT key, CASE WHEN ({white} & mask) <> 0 THEN 6 ELSE 5 - bit_count({black} & mask) END AS d FROM p, (SELECT unnest([{', '.join(map(str, g.win_masks()))}]) AS mask))) GROUP BY key"


WIN_CLOSENESS = f"WITH {P}, a AS ({_closeness_sql('s0', 's1')}), b AS ({_closeness_sql('s1', 's0')}) SELECT key, a.close::BIGINT AS close0, b.close::BIGINT AS close1 FROM a JOIN b USING (key)"


def topk_placements(spark, sf_dir):
    """Each position's three placements that come closest to five, ties by cell (a top-k report)."""
    rows = b.with_closeness(moves.placements(_positions(spark, sf_dir), "s0", "s1"), F.col("placed"), F.col("s1"), "close")
    best = Window.partitionBy("key").orderBy(F.desc("close"), "cell")
    return rows.select("key", "cell", "close", F.row_number().over(best).cast("long").alias("place")).where("place <= 3")


TOPK_PLACEMENTS = f"""WITH {P}, {_CELLS}, d AS (SELECT key, cell, CASE WHEN (s1 & mask) <> 0 THEN 6 ELSE 5 - bit_count((s0 | cell) & mask) END AS d FROM c, (SELECT unnest([{', '.join(map(str, g.win_masks()))}]) AS mask)),
l AS (SELECT key, cell, min(d) AS m FROM d GROUP BY key, cell), n AS (SELECT key, cell, m, count(*) AS n FROM d JOIN l USING (key, cell) WHERE d = m GROUP BY key, cell, m),
k AS (SELECT key, cell, CASE WHEN m = 6 THEN 0 ELSE (6 - m) * 65536 + n END::BIGINT AS close FROM n)
SELECT key, cell, close, place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY close DESC, cell) AS place FROM k) WHERE place <= 3"""


def position_names(spark, sf_dir):
    """Names written from boards and read back; an order's status picks whether a turn is due, and broken names stay unread."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    p = positions(o, "o_orderkey").join(o.withColumnRenamed("o_orderkey", "key"), "key")
    name = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("x"), b.pack(F.col("s0"), F.col("s1")).cast("string"))).otherwise(write_names(b.pack(F.col("s0"), F.col("s1")), F.col("o_orderstatus") == "F"))
    return read_names(p.select(name.alias("name")), "name").withColumn("board", F.coalesce("board", F.lit(-1)))


POSITION_NAMES = f"""WITH {P}, n AS (SELECT key, {t.pack("s0", "s1")} AS board FROM p)
SELECT CASE WHEN o_orderstatus = 'P' THEN 'x' || board ELSE board || CASE WHEN o_orderstatus = 'F' THEN 'm' ELSE '' END END AS name,
CASE WHEN o_orderstatus <> 'P' THEN board ELSE -1 END AS board, o_orderstatus = 'F' AS middle, o_orderstatus <> 'P' AS well_formed FROM n JOIN orders ON key = o_orderkey"""

QUERIES = {
    "board_pack_unpack": (board_pack_unpack, BOARD_PACK_UNPACK),
    "board_status": (board_status, BOARD_STATUS),
    "rotated_status": (rotated_status, ROTATED_STATUS),
    "canonical_d4": (canonical_d4, CANONICAL_D4),
    "canonical_witness": (canonical_witness, CANONICAL_WITNESS),
    "canonical_turns": (canonical_turns, CANONICAL_TURNS),
    "distinct_positions": (distinct_positions, DISTINCT_POSITIONS),
    "section_profile": (section_profile, SECTION_PROFILE),
    "section_counts": (section_counts, SECTION_COUNTS),
    "section_rollup": (section_rollup, SECTION_ROLLUP),
    "section_children": (section_children, SECTION_CHILDREN),
    "least_quadrants": (least_quadrants, LEAST_QUADRANTS),
    "placements_summary": (placements_summary, PLACEMENTS_SUMMARY),
    "moves_summary": (moves_summary, MOVES_SUMMARY),
    "win_closeness": (win_closeness, WIN_CLOSENESS),
    "topk_placements": (topk_placements, TOPK_PLACEMENTS),
    "position_names": (position_names, POSITION_NAMES),
}
