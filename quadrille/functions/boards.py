"""Column functions on sides and boards.

Where a projection has so many terms that one generated method would pass what the JVM compiles, one of its columns is
`unfused`: Spark then generates the projection by itself, as many small methods.

`side` is a long of 36 bits (see geometry), `board` the packed long of four 16-bit quadrants, each
nine base-3 digits: 0 empty, 1 first side, 2 second side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as g


def lit(n: int) -> Column:
    return F.lit(n).cast("long")


def unfused(c: Column) -> Column:
    """c itself, through a lambda. Spark fuses no projection that holds a lambda with the operators around it."""
    return F.get(F.transform(F.array(c), lambda x: x), F.lit(0))


def entry(table: list[int], at: Column) -> Column:
    """table[at], null outside of it. The table is one literal in the plan, so an expression stays small however often it looks up."""
    return F.get(F.expr(f"cast(split('{','.join(map(str, table))}', ',') as array<bigint>)"), at)


def looked_up(table: list[int], at: Column) -> Column:
    """As `entry`, but 0 in place of null."""
    return F.coalesce(entry(table, at), lit(0))


def lane(side: Column, q: int) -> Column:
    """The nine bits of quadrant q."""
    return F.shiftrightunsigned(side, 16 * q).bitwiseAND(lit(0x1FF))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def quadrant(state: Column, q: int) -> Column:
    return F.shiftrightunsigned(state, 16 * q).bitwiseAND(lit(0xFFFF))


def quadrants(parts: list[Column]) -> Column:
    return any_of([F.shiftleft(p.cast("long"), 16 * q) for q, p in enumerate(parts)])


def pack(side0: Column, side1: Column) -> Column:
    """The board of two sides, from a table of a quadrant's 512 states."""
    digits = g.ternary()
    return quadrants([looked_up(digits, lane(side0, q)) + looked_up(digits, lane(side1, q)) * 2 for q in range(g.QUADRANTS)])


def unpack(board: Column, side: int) -> Column:
    """One side of a board."""
    parts = []
    for q in range(g.QUADRANTS):
        lane = quadrant(board, q)
        for i in range(9):
            digit = F.call_function("div", lane, lit(3**i)) % 3
            parts.append(F.when(digit == side + 1, lit(1 << 16 * q + i)).otherwise(lit(0)))
    return any_of(parts)


def valid_board(board: Column) -> Column:
    return reduce(lambda a, b: a & b, [quadrant(board, q) < 3**9 for q in range(g.QUADRANTS)])


def moved(side: Column, table: dict[int, int]) -> Column:
    """A side with its bits moved; bits the table doesn't name stay."""
    named = sum(1 << b for b in table)
    parts = [side.bitwiseAND(lit(~named & g.FULL))] if named != g.FULL else []
    for d, mask in sorted(g.shifts(table).items()):
        part = side.bitwiseAND(lit(mask))
        parts.append(part if d == 0 else F.shiftleft(part, d) if d > 0 else F.shiftrightunsigned(part, -d))
    return any_of(parts)


def stones(side: Column) -> Column:
    return F.bit_count(side).cast("long")


def won(side: Column) -> Column:
    """Whether a side has five: some line's cells are held in every quadrant."""
    return reduce(lambda a, b: a.bitwiseAND(b), [looked_up(g.held_lines(q), lane(side, q)) for q in range(g.QUADRANTS)]) != 0


def completing(side: Column) -> Column:
    """The cells, as a side, that would make a five of four."""
    missing = [lit(m).bitwiseAND(F.bitwise_not(side)) for m in g.win_masks()]
    return any_of([F.when(F.bit_count(m) == 1, m).otherwise(lit(0)) for m in missing])


def rotated_won(side: Column) -> Column:
    """Whether a side has five after at most one turn of one quadrant."""
    return reduce(lambda a, b: a | b, [won(side), *[won(moved(side, t)) for t in g.rotations()]])


def status(side0: Column, side1: Column) -> Column:
    """Bit 0: the first side has five; bit 1: the second; 3 for a full board without either."""
    bits = won(side0).cast("int") + 2 * won(side1).cast("int")
    return F.when((bits == 0) & (side0.bitwiseOR(side1) == lit(g.FULL)), 3).otherwise(bits)


def symmetric_boards(side0: Column, side1: Column) -> list[Column]:
    """The board under the eight symmetries of the square."""
    return [pack(moved(side0, t), moved(side1, t)) for t in g.square_symmetries()]


def canonical(side0: Column, side1: Column) -> Column:
    """The smallest board of the eight."""
    return F.least(*symmetric_boards(side0, side1))


def orbit_size(side0: Column, side1: Column) -> Column:
    return F.size(F.array_distinct(F.array(*symmetric_boards(side0, side1)))).cast("long")


def all_turned(side0: Column, side1: Column) -> list[Column]:
    """The boards with every quadrant turned in place by 0 to 3 quarter turns: all four lanes move at once."""
    tables = [{a: b for q in range(g.QUADRANTS) for a, b in g.quarter_turn(q, t).items()} for t in range(4)]
    return [pack(moved(side0, t), moved(side1, t)) for t in tables]


def with_turned(df: DataFrame, side0: str, side1: str, prefix: str) -> DataFrame:
    """Adds prefix0 to prefix3, the boards of `all_turned`; functions of them then name short columns."""
    return df.select("*", *[(c if t else unfused(c)).alias(f"{prefix}{t}") for t, c in enumerate(all_turned(F.col(side0), F.col(side1)))])


def turned_quadrants(turned: list[Column], q: int) -> list[Column]:
    """Quadrant q's base-3 value after 0 to 3 quarter turns, from the boards of `all_turned`."""
    return [quadrant(c, q) for c in turned]


def with_super_canonical(df: DataFrame, side0: str, side1: str, name: str) -> DataFrame:
    """Adds the smallest board over the symmetries of the square and all turns of single quadrants, 2048 in all.

    A turn of the whole board only moves the quadrants' least values to other places, so they are found once,
    and once more for the mirrored board.
    """
    mirror = g.square_symmetries()[4]
    out = df.select("*", moved(F.col(side0), mirror).alias("__m0"), moved(F.col(side1), mirror).alias("__m1"))
    out = with_turned(with_turned(out, side0, side1, "__p"), "__m0", "__m1", "__r")
    least = lambda k, q: F.least(*turned_quadrants([F.col(f"__{k}{t}") for t in range(4)], q))
    out = out.select("*", *[(least(k, q) if q else unfused(least(k, q))).alias(f"__{k}q{q}") for k in "pr" for q in range(g.QUADRANTS)])
    boards = [quadrants([F.col(f"__{k}q{source}") for source in sources]) for k in "pr" for sources in g.quadrant_sources()[:4]]
    return out.select(*[F.col(c) for c in df.columns], unfused(F.least(*boards)).alias(name))


def stabilizer_log(turned: list[Column]) -> Column:
    """Base-2 logarithm of the number of quadrant turns that leave the board as it is, from the boards of `all_turned`."""
    out = []
    for q in range(g.QUADRANTS):
        v = turned_quadrants(turned, q)
        out.append(F.when(v[0] == v[1], 2).when(v[0] == v[2], 1).otherwise(0))
    return reduce(lambda a, b: a + b, out)


def with_closeness(df: DataFrame, black: Column, white: Column, name: str) -> DataFrame:
    """Adds (6 - stones missing from the nearest line) * 65536 + the number of such lines; 0 if every line is blocked.

    Each open line with n black stones adds 64**n to one number; its leading base-64 digit is the answer,
    since there are 32 lines.
    """
    add = [F.when(white.bitwiseAND(lit(m)) != 0, lit(0)).otherwise(F.call_function("shiftleft", lit(1), 6 * F.bit_count(black.bitwiseAND(lit(m))))) for m in g.win_masks()]
    lines = df.withColumn("__lines", reduce(lambda a, b: a + b, add))
    most = F.call_function("div", F.length(F.bin("__lines")) - 1, F.lit(6))
    lines = lines.withColumn("__most", most)
    ways = F.call_function("shiftright", F.col("__lines"), (6 * F.col("__most")).cast("int"))
    return lines.withColumn(name, F.when(F.col("__lines") == 0, lit(0)).otherwise((F.col("__most") + 1) * 65536 + ways)).drop("__lines", "__most")


def table_text(board: Column) -> Column:
    """The 36 digits of a board, column x by column x."""
    digits = []
    for b in g.BITS:
        digits.append((F.call_function("div", quadrant(board, b // 16), lit(3 ** (b % 16))) % 3).cast("string"))
    return F.concat(*digits)


def read_table_text(text: Column) -> Column:
    """The board of 36 digits as `table_text` writes them; null for any other text."""
    digit = lambda b: F.substring(text, g.BITS.index(b) + 1, 1).try_cast("long")
    lanes = [reduce(lambda a, c: a + c, [digit(16 * q + i) * 3**i for i in range(9)]) for q in range(g.QUADRANTS)]
    return F.when(text.rlike("^[012]{36}$") & ~text.contains("\n"), quadrants(lanes))


def picture(text: Column) -> Column:
    """The board of `table_text` as lines of text: stones counted, rows from the top, columns numbered."""
    count = lambda d: F.length(text) - F.length(F.replace(text, F.lit(d), F.lit("")))
    rows = [F.concat(F.lit(f"{name}  "), *[F.substring(text, 6 * x + 6 - i, 1) for x in range(g.SIZE)]) for i, name in enumerate("abcdef")]
    head = F.concat(F.lit("counts: 0s = "), count("1").cast("string"), F.lit(", 1s = "), count("2").cast("string"))
    # Only the signs of cells are digits in a row.
    return F.concat(head, F.lit("\n\n"), F.translate(F.concat_ws("\n", *rows), "012", "_01"), F.lit("\n\n   123456"))


def fives(side: Column) -> Column:
    """The lines of five that a side holds, as an array of (line, cells), in the order of their masks."""
    cells = lambda m: ",".join(f"{x}{y}" for x, y in g.CELLS if m >> g.bit_of(x, y) & 1)
    lines = F.array(*[F.struct(lit(m).alias("line"), F.lit(cells(m)).alias("cells")) for m in g.win_masks()])
    return F.filter(lines, lambda x: side.bitwiseAND(x["line"]) == x["line"])
