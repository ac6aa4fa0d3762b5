"""Positions derived from the keys of any table, names of positions, and arrays in .npy files.

Both engines can repeat the derivation: the cell with number i (6 x + y) of key k hashes to
k * (2 i + 1) * 2654435 modulo 1000003, both factors reduced first, so no key overflows.
"""

from __future__ import annotations

import io
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.boards import lit, unfused, valid_board
from ..functions.subsets import with_subset

MULTIPLIER, PRIME = 2654435, 1000003


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cell_hash(key: Column, i: int) -> Column:
    return (key % lit(PRIME)) * lit((2 * i + 1) * MULTIPLIER % PRIME) % lit(PRIME)


def positions(df: DataFrame, key: str, *keep: str) -> DataFrame:
    """key, s0, s1 and the columns to keep for each row: every cell empty, first or second side by its hash modulo 3. Stone counts need not be legal."""
    k = F.col(key).cast("long")
    hashed = df.select(unfused(k).alias("key"), *keep, *[(cell_hash(k, i) % 3).alias(f"c{i}") for i in range(36)])
    side = lambda s: reduce(lambda a, b: a + b, [F.when(F.col(f"c{i}") == s, lit(1 << b)).otherwise(lit(0)) for i, b in enumerate(g.BITS)])
    return hashed.select(unfused(F.col("key")).alias("key"), side(1).alias("s0"), side(2).alias("s1"), *keep)  # what is under a lambda is not compiled


def endgames(df: DataFrame, key: str, empties: int) -> DataFrame:
    """key, us, them: legal positions with `empties` empty cells and the owner of `us` to move.

    Cells are put in the order of their hash; the first are empty, the rest go to the two sides in turn.
    With an odd number of stones, the side that isn't to move is ahead by one.
    """
    k = F.col(key).cast("long")
    cells = F.array_sort(F.array(*[F.struct(cell_hash(k, i).alias("h"), F.lit(i).alias("i"), lit(1 << b).alias("bit")) for i, b in enumerate(g.BITS)]))
    full = df.select(k.alias("key"), F.slice(cells, empties + 1, 36 - empties).alias("cells"))
    bits = lambda odd: F.aggregate(F.filter("cells", lambda c, j: j % 2 == odd), lit(0), lambda a, c: a + c["bit"])
    us, them = (1, 0) if (36 - empties) % 2 else (0, 1)
    return full.select("key", bits(us).alias("us"), bits(them).alias("them"))


def every_board(spark: SparkSession, stones: int) -> DataFrame:
    """black, white: all boards of so many stones, the first side even or one ahead. A board is a number, out of which its cells and then the first side's among them are unranked; so any range of boards is made where it is needed."""
    first = (stones + 1) // 2
    rows = spark.range(comb(36, stones) * comb(stones, first))
    rows = rows.select(F.call_function("div", F.col("id"), lit(comb(stones, first))).alias("of"), (F.col("id") % lit(comb(stones, first))).alias("which"))
    rows = with_subset(with_subset(rows, "of", 36, stones, "cells"), "which", max(stones, 1), first, "mine")
    held = lambda i: F.col("cells").bitwiseAND(lit(1 << i)) != 0
    own = lambda i: F.call_function("shiftright", F.col("mine"), F.bit_count(F.col("cells").bitwiseAND(lit((1 << i) - 1)))).bitwiseAND(lit(1))
    side = lambda k: reduce(lambda a, b: a + b, [F.when(held(i) & (own(i) == k), lit(1 << x)).otherwise(lit(0)) for i, x in enumerate(g.BITS)])
    return rows.select(unfused(side(1)).alias("black"), side(0).alias("white"))


def read_names(df: DataFrame, name: str) -> DataFrame:
    """name, board, middle, well_formed of position names: decimal digits, `m` behind them between a stone and its turn.

    A name that isn't well formed has a null board.
    """
    ok = F.coalesce(F.col(name).rlike(r"^\d{1,19}m?$"), F.lit(False))
    board = F.when(ok, F.regexp_extract(name, r"^(\d+)", 1).cast("decimal(38,0)"))
    fits = F.when(board <= F.lit(5540271966595842048), board.cast("long"))
    good = fits.isNotNull() & valid_board(fits)
    return df.select(F.col(name).alias("name"), F.when(good, fits).alias("board"), F.coalesce(F.col(name).endswith("m"), F.lit(False)).alias("middle"), F.coalesce(good, F.lit(False)).alias("well_formed"))


def write_names(board: Column, middle: Column) -> Column:
    return F.concat(board.cast("string"), F.when(middle, "m").otherwise(""))


def read_npy(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of two-dimensional arrays of 64-bit integers in .npy files, one file a task."""
    import numpy as np
    import pandas as pd

    def rows(batches):
        for batch in batches:
            for content in batch["content"]:
                array = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame(array.astype(np.int64), columns=columns)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(rows, ", ".join(f"{c} long" for c in columns))

