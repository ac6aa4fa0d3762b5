"""Invertible shuffles of a range and their split into shards.

A range of k-bit numbers is permuted by steps that lose nothing: x ^ (x >> s) and x + (x << s)
modulo 2**k. A number's shard is its low bits after the permutation, its place in the shard the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boards import lit

STEPS = (("xor", 7), ("add", 5), ("xor", 11), ("add", 3), ("xor", 9), ("add", 13))


def with_permuted(df: DataFrame, x: str, name: str, bits: int, steps=STEPS) -> DataFrame:
    """Adds `name`, a permutation of 0 .. 2**bits - 1 applied to column x.

    A step names its input twice, so each is a projection of its own and expressions don't multiply.
    The shifted term is masked before the shift and the sum after it, so nothing overflows.
    """
    df, c = df.withColumn(name, F.col(x)), F.col(name)
    for kind, s in steps:
        df = df.withColumn(name, _xor(c, s) if kind == "xor" else _add(c, s, bits))
    return df


def with_unpermuted(df: DataFrame, x: str, name: str, bits: int, steps=STEPS) -> DataFrame:
    """The inverse: each step is undone by doubling its shift until it leaves the range."""
    df, c = df.withColumn(name, F.col(x)), F.col(name)
    for kind, s in reversed(steps):
        if kind == "add":
            df = df.withColumn(name, (c - _shifted(c, s, bits)).bitwiseAND(lit((1 << bits) - 1)))
            s *= 2
        while s < bits:
            df = df.withColumn(name, _xor(c, s) if kind == "xor" else _add(c, s, bits))
            s *= 2
    return df


def _xor(c: Column, s: int) -> Column:
    return c.bitwiseXOR(F.shiftright(c, s))


def _shifted(c: Column, s: int, bits: int) -> Column:
    return F.shiftleft(c.bitwiseAND(lit((1 << max(bits - s, 0)) - 1)), s)


def _add(c: Column, s: int, bits: int) -> Column:
    return (c + _shifted(c, s, bits)).bitwiseAND(lit((1 << bits) - 1))


def shard_of(x: Column, shards: int) -> tuple[Column, Column]:
    """Shard and place of a permuted number; shards is a power of two."""
    power = shards.bit_length() - 1
    if shards != 1 << power:
        raise ValueError("the number of shards must be a power of two")
    return x.bitwiseAND(lit(shards - 1)), F.shiftright(x, power)


def shard_size(total: int, shard: int, shards: int) -> int:
    """Numbers of 0 .. total - 1 that fall in a shard."""
    return (total + shards - 1 - shard) // shards


# Any range, not only a power of two: a Feistel network on a grid of about n cells.

ROUNDS = 6
FIELD = (1 << 31) - 1
WALKS = 64


def grid(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest grid of at least n cells with a = ceil(sqrt(n)): fewer than a cells are too many."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, -(-n // a) or 1


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Two numbers below FIELD for each round."""
    return [tuple(1 + (seed * 1103515245 + (2 * i + j + 1) * 1640531527) % (FIELD - 1) for j in (0, 1)) for i in range(ROUNDS)]


def _round(left: Column, right: Column, key: tuple[int, int], i: int, a: int, b: int, sign: int) -> tuple[Column, Column]:
    """One side is shifted by a number out of the other one."""
    of = right if i % 2 == 0 else left
    by = ((of % lit(FIELD)) * (of % lit(FIELD)) % lit(FIELD) * lit(key[0]) + lit(key[1])) % lit(FIELD)
    if i % 2 == 0:
        return F.pmod(left + by * sign, lit(a)), right
    return left, F.pmod(right + by * sign, lit(b))


def _walked(df: DataFrame, x: str, name: str, n: int, seed: int, sign: int) -> DataFrame:
    a, b = grid(n)
    keys = list(enumerate(round_keys(seed)))[::sign]
    rows = df.select("*", F.call_function("div", F.col(x), lit(b)).alias("__l"), (F.col(x) % lit(b)).alias("__r"))
    for i, key in keys:
        left, right = _round(F.col("__l"), F.col("__r"), key, i, a, b, sign)
        rows = rows.select(*df.columns, left.alias("__l"), right.alias("__r"))
    rows = rows.select(*df.columns, (F.col("__l") * lit(b) + F.col("__r")).alias("__x"))

    # A number beyond n goes on until it comes back; the cells beyond n are fewer than a, and few rows get here at all.
    table = F.array(*[F.struct(lit(i).alias("i"), lit(k[0]).alias("m"), lit(k[1]).alias("c")) for i, k in keys])

    def turn(acc: Column, k: Column) -> Column:
        of = F.when(k["i"] % 2 == 0, acc["r"]).otherwise(acc["l"]) % lit(FIELD)
        by = (of * of % lit(FIELD) * k["m"] + k["c"]) % lit(FIELD) * sign
        return F.struct(F.when(k["i"] % 2 == 0, F.pmod(acc["l"] + by, lit(a))).otherwise(acc["l"]).alias("l"), F.when(k["i"] % 2 == 1, F.pmod(acc["r"] + by, lit(b))).otherwise(acc["r"]).alias("r"))

    def once(x: Column) -> Column:
        start = F.struct(F.call_function("div", x, lit(b)).alias("l"), (x % lit(b)).alias("r"))
        return F.aggregate(table, start, turn, lambda acc: acc["l"] * lit(b) + acc["r"])

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.col("__x"), lambda x, _: F.when(x >= lit(n), once(x)).otherwise(x))
    rows = rows.select(*df.columns, F.when(F.col("__x") >= lit(n), walk).otherwise(F.col("__x")).alias("__x"))
    late = F.raise_error(F.lit("a number didn't come back into its range"))
    return rows.select(*df.columns, F.when(F.col("__x") >= lit(n), late.cast("long")).otherwise(F.col("__x")).alias(name))


def with_bijection(df: DataFrame, x: str, name: str, n: int, seed: int = 0) -> DataFrame:
    """Adds `name`, a permutation of 0 .. n - 1 applied to column x (null stays null), for any n up to 2**60.

    Rounds shift the two coordinates of a grid of n cells and a few more by each other, which can be undone; a
    projection for each. A number that falls on one of the cells too many is permuted again until it doesn't: the walk visits fewer than sqrt(n) + 1 cells,
    so WALKS steps are always enough for n up to WALKS**2, and beyond fail with probability WALKS**-WALKS, which is an error then, not a wrong number.
    """
    return _walked(df, x, name, n, seed, 1)


def with_inverse(df: DataFrame, x: str, name: str, n: int, seed: int = 0) -> DataFrame:
    """Adds `name`, what with_bijection makes x of."""
    return _walked(df, x, name, n, seed, -1)


def gather(spark, shards_: range, shards: int, total: int, seed: int = 0) -> DataFrame:
    """shard, place, linear of all numbers below total whose shard is in a range: made from the shards' own places, so that no row of another shard ever exists."""
    places = -(-total // shards)
    rows = spark.range(shards_.start * places, shards_.stop * places).select(F.call_function("div", F.col("id"), lit(places)).alias("shard"), (F.col("id") % lit(places)).alias("place"))
    rows = rows.select("*", (F.col("place") * lit(shards) + F.col("shard")).alias("__p")).where(F.col("__p") < lit(total))
    return with_inverse(rows, "__p", "linear", total, seed).drop("__p")
