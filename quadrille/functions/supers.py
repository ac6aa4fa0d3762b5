"""Sets of the 256 ways to turn four quadrants, as four longs.

The rotation with quarter turns (r0, r1, r2, r3) is bit r0 + 4 r1 + 16 r2 of word r3.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as g
from .boards import any_of, lit, unfused


def _mask(group: int, keep: int) -> int:
    """The `keep` low bits of every `group` bits of a signed long."""
    m = sum(((1 << keep) - 1) << i for i in range(0, 64, group))
    return m - (1 << 64) if m >> 63 else m


def _turn(word: Column, step: int) -> Column:
    """Both neighbours along the turns that are `step` bits apart, inside groups of 4 * step bits."""
    group = 4 * step
    low, rest = _mask(group, step), _mask(group, 3 * step)
    up = F.shiftleft(word.bitwiseAND(lit(rest)), step).bitwiseOR(F.shiftrightunsigned(word, 3 * step).bitwiseAND(lit(low)))
    down = F.shiftrightunsigned(word, step).bitwiseAND(lit(rest)).bitwiseOR(F.shiftleft(word.bitwiseAND(lit(low)), 3 * step))
    return up.bitwiseOR(down)


def rmax(words: list[Column]) -> list[Column]:
    """All rotations that one turn of one quadrant leads from, to a rotation in the set."""
    out = []
    for i, w in enumerate(words):
        near = words[(i + 1) % 4].bitwiseOR(words[(i + 3) % 4])
        out.append(_turn(w, 1).bitwiseOR(_turn(w, 4)).bitwiseOR(_turn(w, 16)).bitwiseOR(near))
    return out


def popcount(words: list[Column]) -> Column:
    return sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0])).cast("long")


@lru_cache
def _part_turns(part: int) -> list[int]:
    """For each state of a quadrant, the turns (bits 0 to 3) after which it holds all cells of a part."""
    turned = [g.turned_states(r) for r in range(4)]
    return [sum(1 << r for r in range(4) if turned[r][state] & part == part) for state in range(512)]


@lru_cache
def _spread(turns: int, step: int, bits: int) -> int:
    """All numbers under `bits` whose base-4 digit at `step` (1, 4 or 16) is one of the turns, as a set."""
    return sum(1 << i for i in range(bits) if turns >> i // step % 4 & 1)


@lru_cache
def _lines_by_quadrants() -> dict[tuple[int, ...], list[int]]:
    """Lines of five by the quadrants that they touch: two for most, three for four of them."""
    out: dict[tuple[int, ...], list[int]] = {}
    for m in g.win_masks():
        out.setdefault(tuple(q for q in range(g.QUADRANTS) if m & g.LANE[q]), []).append(m)
    return out


def _table(values: list[int], at: str) -> str:
    """SQL of `looked_up`."""
    return f"coalesce(get(cast(split('{','.join(map(str, values))}', ',') as array<bigint>), {at}), 0L)"


def _unfused(sql: str) -> str:
    """SQL of `unfused`."""
    return f"get(transform(array({sql}), x -> x), 0)"


@lru_cache
def _fives_sql(side: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """The projections of `with_fives` as SQL: parts looked up, pairs' sets, what all words share, and single words."""
    at = [f"(shiftrightunsigned({side}, {16 * q}) & 511L)" for q in range(g.QUADRANTS)]
    first, second, pairs, triples = [], [], {}, []
    for quads, masks in _lines_by_quadrants().items():
        parts = {m: {q: _part_turns(m >> 16 * q & 0x1FF) for q in quads} for m in masks}
        if len(quads) == 2:
            pairs[quads] = []
            for i in range(0, len(masks), 4):
                some = list(enumerate(masks[i : i + 4]))
                tables = [[_signed(sum(_spread(parts[m][q][x], step, 16) << 16 * j for j, m in some)) for x in range(512)] for q, step in zip(quads, (1, 4), strict=True)]
                both = f"{_table(tables[0], at[quads[0]])} & {_table(tables[1], at[quads[1]])}"
                pairs[quads].append(f"__s{len(first)}")
                first.append(f"{both if first else _unfused(both)} AS __s{len(first)}")
        else:
            for m in masks:
                name = f"__t{len(triples)}"
                triples.append((name, 3 in quads))
                second.append(" & ".join(_table([_signed(_spread(parts[m][q][x], 4**q, 64)) for x in range(512)], at[q]) for q in quads if q < 3) + f" AS {name}")
                if 3 in quads:
                    second.append(f"{_table(parts[m][3], at[3])} AS {name}w")
    sets = []
    for (low, high), names in pairs.items():  # each pair's set is the OR of its four parts of 16 bits
        whole = f"({' | '.join(names)})"
        sets.append(" | ".join(f"shiftrightunsigned({whole}, {16 * j}) & 65535L" for j in range(4)) + f" AS __p{low}{high}")

    pick = lambda c, k: f"(shiftrightunsigned({c}, {4 * k}) & 15L)"
    same, each = [], [[] for _ in range(4)]  # terms of all words alike, and of single words
    for low, high in pairs:
        c = f"__p{low}{high}"
        if high == 1:
            same += [f"shiftleft({c}, {16 * j})" for j in range(4)]
        elif high == 2:
            same += [f"shiftleft({_table([_spread(x, 4**low, 16) for x in range(16)], pick(c, k))}, {16 * k})" for k in range(4)]
        else:
            for k in range(4):
                each[k].append(_table([_signed(_spread(x, 4**low, 64)) for x in range(16)], pick(c, k)))
    for name, last in triples:
        if not last:
            same.append(name)
        else:
            for k in range(4):
                each[k].append(f"if({name}w & {1 << k}L != 0L, {name}, 0L)")
    return first, sets + second, [f"{_unfused(' | '.join(same))} AS __all"], [" | ".join(["__all", *terms]) for terms in each]


def with_fives(df: DataFrame, side: str, name: str) -> DataFrame:
    """Adds name0 to name3: the rotations under which a side has five.

    Where a line touches two quadrants, the turns that hold its parts give a set of 16 pairs of turns. Four lines' parts are looked up at once,
    as four sets in one long, so that one AND meets them. A pair's set is then spread over all turns of the other quadrants;
    lines in three quadrants are met as whole sets. One row stays one row, and no projection has more than a few dozen short terms.
    """
    first, second, shared, words = _fives_sql(side)
    keep = [f"`{c}`" for c in df.columns]
    rows = df.selectExpr("*", *first).selectExpr(*keep, *second).selectExpr("*", *shared)
    return rows.selectExpr(*keep, *[f"{w} AS {name}{k}" for k, w in enumerate(words)])


def near(words: list[str]) -> list[str]:
    """`rmax` of four named words, as SQL: expressions of many terms are built faster as one text."""

    def turned(w: str, step: int) -> str:
        low, rest = f"{_mask(4 * step, step)}L", f"{_mask(4 * step, 3 * step)}L"
        up = f"shiftleft({w} & {rest}, {step}) | (shiftrightunsigned({w}, {3 * step}) & {low})"
        return f"{up} | (shiftrightunsigned({w}, {step}) & {rest}) | shiftleft({w} & {low}, {3 * step})"

    return [" | ".join([*[turned(w, step) for step in (1, 4, 16)], words[(i + 1) % 4], words[(i + 3) % 4]]) for i, w in enumerate(words)]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _digit_turn(word: Column, step: int, by: int) -> Column:
    """A word's set with `by` (1 to 3) added to the turn whose bits are `step` apart, modulo 4."""
    group = 4 * step
    stay, wrap = _mask(group, (4 - by) * step), _mask(group, by * step)
    return F.shiftleft(word.bitwiseAND(lit(stay)), by * step).bitwiseOR(F.shiftrightunsigned(word, (4 - by) * step).bitwiseAND(lit(wrap)))


def _staged(df: DataFrame, names: list[str], words: list[Column]) -> DataFrame:
    """df with the named words replaced: a projection of their own, so that steps don't multiply."""
    words = [unfused(words[0]), *words[1:]]
    return df.select(*[c for c in df.columns if c not in names], *[w.alias(n) for n, w in zip(names, words, strict=True)])


def with_transformed(df: DataFrame, name: str, symmetry: Column, out: str) -> DataFrame:
    """Adds out0 to out3: for a set name0 to name3 of rotations under which something holds of a board, those under which it
    holds of the board moved by a symmetry (see `symmetries`; a column of numbers).

    A rotation r of the moved board is the rotation conj(r) + local of the board. So local turns are taken off each turn of the set, inside words for three
    quadrants and from word to word for the last; then the turns change places as the quadrants do, and are turned round by a mirror. Amounts come from the column, bit by bit: each step is done or not.
    """
    names = [f"{out}{k}" for k in range(4)]
    rows = df.select("*", symmetry.alias("__s"), *[F.col(f"{name}{k}").alias(n) for k, n in enumerate(names)])
    words = [F.col(n) for n in names]
    bit = lambda i: F.col("__s").bitwiseAND(lit(1 << i)) != 0
    for q in range(3):
        for b in (0, 1):
            rows = _staged(rows, names, [F.when(bit(2 * q + b), _digit_turn(w, 4**q, (4 - (1 << b)) % 4)).otherwise(w) for w in words])
    for b in (0, 1):
        rows = _staged(rows, names, [F.when(bit(6 + b), words[(k + (1 << b)) % 4]).otherwise(words[k]) for k in range(4)])
    # The symmetry is mirrored first, then turned: one fixed permutation for each bit of its number.
    mirror, once, twice = (image_of(m) for m in (g.square_symmetries()[i] for i in (4, 1, 2)))
    for i, to in ((10, mirror), (8, once), (9, twice)):
        rows = _staged(rows, names, [F.when(bit(i), c).otherwise(w) for c, w in zip(permuted(words, to), words, strict=True)])
    return rows.select(*df.columns, *names)


def image_of(symmetry: dict[int, int]) -> list[int]:
    """Where each rotation goes when the board is moved by a symmetry of the square first.

    The quadrants' turns move with the quadrants, and a mirror turns them the other way round.
    """
    to = [symmetry[16 * q + 4] // 16 for q in range(g.QUADRANTS)]
    corner, after = symmetry[0], symmetry[g.quarter_turn(0)[0]]
    turn = g.quarter_turn(to[0])
    back = turn[corner] != after
    out = []
    for i in range(256):
        digits = [i >> 2 * q & 3 for q in range(g.QUADRANTS)]
        out.append(sum(((4 - digits[q]) % 4 if back else digits[q]) << 2 * to[q] for q in range(g.QUADRANTS)))
    return out


def permuted(words: list[Column], to: list[int]) -> list[Column]:
    """The set with each rotation i replaced by to[i]: bits that move alike move together."""
    groups: dict[tuple[int, int, int], int] = {}
    for i, j in enumerate(to):
        key = (j // 64, i // 64, j % 64 - i % 64)
        groups[key] = groups.get(key, 0) | 1 << i % 64
    out = []
    for k in range(4):
        parts = []
        for (dst, src, shift), mask in sorted(groups.items()):
            if dst == k:
                part = words[src].bitwiseAND(lit(_signed(mask)))
                parts.append(part if not shift else F.shiftleft(part, shift) if shift > 0 else F.shiftrightunsigned(part, -shift))
        out.append(any_of(parts))
    return out
