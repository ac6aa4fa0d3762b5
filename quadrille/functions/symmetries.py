"""The 2048 symmetries of a board with free quadrants, as numbers in columns.

Symmetry 256 * s + t turns each quadrant q in place by the base-4 digit q of t (quarter turns,
counter-clockwise), then moves the whole board by symmetry s of the square: s = 4 * mirrored + turns, mirrored
first. They are a group: local turns can be carried through a symmetry of the square, where they go with
their quadrants and are turned round by a mirror. Products and inverses are looked up in tables made from that rule.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as g
from .boards import any_of, entry, lane, lit, looked_up, moved, pack, quadrant, quadrants, unfused

COUNT = 2048


def square(s: Column) -> Column:
    return F.shiftright(s, 8)


def local(s: Column) -> Column:
    return s.bitwiseAND(lit(255))


def digit(t: Column, q: int) -> Column:
    return F.shiftright(t, 2 * q).bitwiseAND(lit(3))


def from_digits(digits: list[Column]) -> Column:
    return any_of([F.shiftleft(d.bitwiseAND(lit(3)), 2 * q) for q, d in enumerate(digits)])


@lru_cache
def _carried() -> list[int]:
    """For each symmetry s of the square and local turns t, at 256 * s + t, the local turns u so that turning by t after s is s after turning by u."""
    out = []
    for s, m in enumerate(g.square_symmetries()):
        place = [m[16 * p + 4] // 16 for p in range(g.QUADRANTS)]
        turn = -1 if s >> 2 else 1
        out += [sum((turn * (t >> 2 * place[p]) & 3) << 2 * p for p in range(g.QUADRANTS)) for t in range(256)]
    return out


@lru_cache
def _squares() -> list[int]:
    """For symmetries a, b of the square, at 8 * a + b, the number of b, then a."""
    every = g.square_symmetries()
    return [every.index({x: a[y] for x, y in b.items()}) for a in every for b in every]


def _undone(s: int) -> int:
    """The number of the symmetry that undoes s."""
    back = _squares()[8 * (s >> 8) : 8 * (s >> 8) + 8].index(0)
    u = _carried()[256 * back + (s & 255)]
    return 256 * back + sum((-(u >> 2 * q) & 3) << 2 * q for q in range(g.QUADRANTS))


@lru_cache
def _inverses() -> list[int]:
    return [_undone(s) for s in range(COUNT)]


def carried(s: Column, t: Column) -> Column:
    """Local turns u so that turning by t after the square part of s is the square part of s after turning by u."""
    return entry(_carried(), F.shiftleft(square(s), 8).bitwiseOR(t))


def with_product(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the number of the symmetry that is b, then a."""
    x, y = F.col(a), F.col(b)
    rows = df.select("*", carried(y, local(x)).alias("__c"))
    u, v = F.col("__c"), local(y)
    # Four sums modulo 4 at once: low bits carry into high ones, whose own carry is left out.
    added = (u.bitwiseAND(lit(0x55)) + v.bitwiseAND(lit(0x55))).bitwiseXOR(u.bitwiseXOR(v).bitwiseAND(lit(0xAA)))
    whole = entry(_squares(), F.shiftleft(square(x), 3).bitwiseOR(square(y)))
    return rows.select(*df.columns, F.shiftleft(whole, 8).bitwiseOR(added).alias(name))


def with_inverse(df: DataFrame, a: str, name: str) -> DataFrame:
    """Adds the number of the symmetry that undoes a."""
    return df.select("*", entry(_inverses(), F.col(a)).alias(name))


def with_moved(df: DataFrame, side: str, symmetry: str, name: str) -> DataFrame:
    """Adds a side moved by a symmetry."""
    x, s = F.col(side), F.col(symmetry)
    table = [state for r in range(4) for state in g.turned_states(r)]
    turned = any_of([F.shiftleft(looked_up(table, digit(s, q) * 512 + lane(x, q)), 16 * q) for q in range(g.QUADRANTS)])
    rows = df.select("*", unfused(turned).alias("__m"))
    every = g.square_symmetries()
    for i, k in ((10, 4), (8, 1), (9, 2)):
        step = F.when(s.bitwiseAND(lit(1 << i)) != 0, moved(F.col("__m"), every[k])).otherwise(F.col("__m"))
        rows = rows.select(*df.columns, unfused(step).alias("__m"))
    return rows.withColumnRenamed("__m", name)


def with_witness(df: DataFrame, side0: str, side1: str, name: str, witness: str) -> DataFrame:
    """Adds the least board of all symmetries and the first symmetry that gives it.

    A quadrant's turns are free of each other, so its least value over four turns is found once as it stands and once mirrored,
    with the first turn that gives it and the period with which turns repeat. What a symmetry of the square has turned already, the local turn leaves out.
    """
    mirror = g.square_symmetries()[4]
    rows = df.select("*", moved(F.col(side0), mirror).alias("__m0"), moved(F.col(side1), mirror).alias("__m1"))
    for k, a, b in (("p", side0, side1), ("r", "__m0", "__m1")):
        tables = [{x: y for q in range(g.QUADRANTS) for x, y in g.quarter_turn(q, t).items()} for t in range(4)]
        boards = [pack(moved(F.col(a), m), moved(F.col(b), m)) for m in tables]
        rows = rows.select("*", *[(c if t else unfused(c)).alias(f"__{k}{t}") for t, c in enumerate(boards)])
    found = []
    for k in "pr":
        for q in range(g.QUADRANTS):
            v = [quadrant(F.col(f"__{k}{t}"), q) for t in range(4)]
            least = F.least(*[F.struct(c.alias("v"), lit(t).alias("t")) for t, c in enumerate(v)])
            found.append((least if found else unfused(least)).alias(f"__{k}q{q}"))
            found.append(F.when(v[0] == v[1], lit(0)).when(v[0] == v[2], lit(1)).otherwise(lit(3)).alias(f"__{k}s{q}"))
    rows = rows.select(*df.columns, *found)
    # Quadrant q of the mirrored board is the mirror's source quadrant of the board itself.
    of = g.quadrant_sources()[4]
    choices = []
    for s, sources in enumerate(g.quadrant_sources()):
        k, turned = "pr"[s >= 4], s % 4
        places = g.quadrant_sources()[s % 4] if s >= 4 else sources
        board = quadrants([F.col(f"__{k}q{src}.v") for src in places])
        digits: list[Column] = [lit(0)] * g.QUADRANTS
        for src in range(g.QUADRANTS):
            left = F.col(f"__{k}q{src}.t") - turned if s < 4 else lit(turned) - F.col(f"__{k}q{src}.t")
            digits[src if s < 4 else of[src]] = (left + 4).bitwiseAND(F.col(f"__{k}s{src}"))
        choices.append(F.struct(board.alias("board"), (lit(256 * s) + from_digits(digits)).alias("symmetry")))
    rows = rows.select(*df.columns, unfused(F.array_min(F.array(*choices))).alias("__w"))
    return rows.select(*df.columns, F.col("__w.board").alias(name), F.col("__w.symmetry").alias(witness))
