"""The 6 x 6 board of four quadrants, as plain Python numbers that column functions turn into masks.

A side is 36 bits in a long: quadrant q = 2 * (x // 3) + y // 3 has the 16-bit lane q, and
cell (x, y) the bit 3 * (x % 3) + y % 3 of it. Everything below follows from that rule.
"""

from __future__ import annotations

from functools import lru_cache

SIZE, QUADRANTS = 6, 4
#: One bit in each lane.
LANES = sum(1 << 16 * q for q in range(QUADRANTS))


def bit_of(x: int, y: int) -> int:
    return 16 * (2 * (x // 3) + y // 3) + 3 * (x % 3) + y % 3


CELLS = [(x, y) for x in range(SIZE) for y in range(SIZE)]
BITS = [bit_of(x, y) for x, y in CELLS]
FULL = sum(1 << b for b in BITS)
LANE = [0x1FF << 16 * q for q in range(QUADRANTS)]


@lru_cache
def win_masks() -> list[int]:
    """All lines of five."""
    out = []
    for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)):
        for x, y in CELLS:
            line = [(x + i * dx, y + i * dy) for i in range(5)]
            if all(0 <= a < SIZE and 0 <= b < SIZE for a, b in line):
                out.append(sum(1 << bit_of(a, b) for a, b in line))
    return sorted(out)


@lru_cache
def held_lines(q: int) -> list[int]:
    """For each of the 512 states of quadrant q in one side, the lines of five (bits, in the order of `win_masks`) whose cells in q are all held."""
    parts = [m >> 16 * q & 0x1FF for m in win_masks()]
    return [sum(1 << i for i, p in enumerate(parts) if p & state == p) for state in range(512)]


@lru_cache
def ternary() -> list[int]:
    """For each of the 512 states of a quadrant in one side, the sum of 3**i over its bits i."""
    return [sum(3**i for i in range(9) if state >> i & 1) for state in range(512)]


def quarter_turn(q: int, turns: int = 1) -> dict[int, int]:
    """Where the bits of quadrant q go in counter-clockwise quarter turns: (x, y) to (2 - y, x)."""
    out = {}
    for x in range(3):
        for y in range(3):
            a, b = x, y
            for _ in range(turns % 4):
                a, b = 2 - b, a
            out[16 * q + 3 * x + y] = 16 * q + 3 * a + b
    return out


@lru_cache
def rotations() -> list[dict[int, int]]:
    """The eight moves of one quadrant: each quadrant's turn to the left, then to the right."""
    return [quarter_turn(q, t) for q in range(QUADRANTS) for t in (1, 3)]


@lru_cache
def turned_states(turns: int) -> list[int]:
    """The 512 states of a quadrant in one side after quarter turns."""
    table = quarter_turn(0, turns)
    return [sum(1 << table[i] for i in range(9) if state >> i & 1) for state in range(512)]


@lru_cache
def square_symmetries() -> list[dict[int, int]]:
    """The eight symmetries of the whole board."""
    out = []
    for flip in (False, True):
        for turns in range(4):
            table = {}
            for x, y in CELLS:
                a, b = (y, x) if flip else (x, y)
                for _ in range(turns):
                    a, b = SIZE - 1 - b, a
                table[bit_of(x, y)] = bit_of(a, b)
            out.append(table)
    return out


@lru_cache
def quadrant_sources() -> list[list[int]]:
    """For each symmetry of the board, the quadrant whose stones come to quadrant 0, 1, 2 and 3."""
    out = []
    for table in square_symmetries():
        where = {table[16 * q + 4] // 16: q for q in range(QUADRANTS)}
        out.append([where[q] for q in range(QUADRANTS)])
    return out


def shifts(table: dict[int, int]) -> dict[int, int]:
    """A table of moved bits as masks by shift distance, to the left where positive."""
    out: dict[int, int] = {}
    for a, b in sorted(table.items()):
        out[b - a] = out.get(b - a, 0) | 1 << a
    return out
