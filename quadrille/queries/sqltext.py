"""Pieces of SQL for the oracle's side: bit expressions spelled out from the geometry."""

from __future__ import annotations

from ..functions import geometry as g
from ..sources.positions import MULTIPLIER, PRIME

BIT = "(16 * (2 * (i // 18) + (i % 6) // 3) + 3 * ((i // 6) % 3) + i % 3)"


def hashed(key: str) -> str:
    return f"((({key} % {PRIME}) * ((2 * i + 1) * {MULTIPLIER} % {PRIME})) % {PRIME})"


def positions(table: str, key: str) -> str:
    """CTE p(key, s0, s1)."""
    return f"""h AS (SELECT rn, {key}::BIGINT AS key, i, {BIT} AS bit, {hashed(key)} % 3 AS c FROM (SELECT *, row_number() OVER () AS rn FROM {table}), (SELECT unnest(range(36)) AS i)),
p AS (SELECT key, sum(CASE WHEN c = 1 THEN 1::BIGINT << bit ELSE 0 END)::BIGINT AS s0, sum(CASE WHEN c = 2 THEN 1::BIGINT << bit ELSE 0 END)::BIGINT AS s1 FROM h GROUP BY rn, key)"""


def endgames(table: str, key: str, empties: int) -> str:
    """CTE r(key, us, them)."""
    us, them = (1, 0) if (36 - empties) % 2 else (0, 1)
    return f"""h AS (SELECT {key}::BIGINT AS key, {BIT} AS bit, row_number() OVER (PARTITION BY {key} ORDER BY {hashed(key)}, i) - 1 - {empties} AS j FROM {table}, (SELECT unnest(range(36)) AS i)),
r AS (SELECT key, coalesce(sum(1::BIGINT << bit) FILTER (j >= 0 AND j % 2 = {us}), 0)::BIGINT AS us, coalesce(sum(1::BIGINT << bit) FILTER (j >= 0 AND j % 2 = {them}), 0)::BIGINT AS them FROM h GROUP BY key)"""


def won(side: str) -> str:
    return "(" + " OR ".join(f"({side} & {m}) = {m}" for m in g.win_masks()) + ")"


def moved(side: str, table: dict[int, int]) -> str:
    named = sum(1 << b for b in table)
    parts = [f"({side} & {~named & g.FULL})"] if named != g.FULL else []
    for d, mask in sorted(g.shifts(table).items()):
        parts.append(f"({side} & {mask})" if d == 0 else f"(({side} & {mask}) << {d})" if d > 0 else f"(({side} & {mask}) >> {-d})")
    return "(" + " | ".join(parts) + ")"


def pack(a: str, b: str) -> str:
    return "(" + " + ".join(f"((({a} >> {i}) & {g.LANES}) + 2 * (({b} >> {i}) & {g.LANES})) * {3**i}" for i in range(9)) + ")"


def quadrant(x: str, q: int) -> str:
    return f"(({x} >> {16 * q}) & 65535)"


def counts(a: str = "s0", b: str = "s1") -> list[tuple[str, str]]:
    return [(f"bit_count({a} & {m})::BIGINT", f"bit_count({b} & {m})::BIGINT") for m in g.LANE]


def sig(parts: list[tuple[str, str]]) -> str:
    flat = [c for p in parts for c in p]
    return "(" + " + ".join(f"{c} * {1 << 8 * i}" for i, c in enumerate(flat)) + ")"


def standard(parts: list[tuple[str, str]]) -> str:
    return "least(" + ", ".join(sig([parts[s] for s in source]) for source in g.quadrant_sources()) + ")"


def images(parts: list[tuple[str, str]]) -> str:
    return "len(list_distinct([" + ", ".join(sig([parts[s] for s in source]) for source in g.quadrant_sources()) + "]))"
