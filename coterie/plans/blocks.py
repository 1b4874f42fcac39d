"""All-against-all reductions over a grid of bounded sides.

Some measures depend on the distance to every other row (the silhouette), so no
pair can be skipped.  Rows are split by ID hash into sides, and each unordered pair of
sides is one co-group whose kernel, run block by block, returns sums per row.  A side
holds as many blocks as there are sides, so a row is sent square root of n / block_rows
times, unless that many rows would take more than SIDE_BYTES.  Pairs of rows are never
materialised, and no task holds more than two sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.plans.cells import together

BLOCK_ROWS = 2048
#: What the vectors of one side may take in a task.
SIDE_BYTES = 128 << 20


def n_sides(n_rows: int, row_bytes: int, block_rows: int = BLOCK_ROWS, least: int = 1) -> int:
    """Sides of the grid: how often each row is sent."""
    blocks = max(1, -(-n_rows // block_rows))
    return max(least, math.ceil(math.sqrt(blocks)), -(-n_rows * row_bytes // SIDE_BYTES))


def block_pairs(rows: DataFrame, n_rows: int, row_bytes: int, key: str, kernel: Callable, schema: str,
                block_rows: int = BLOCK_ROWS, min_sides: int = 1, merge: Callable | None = None) -> DataFrame:
    """Union over pairs of blocks of ``kernel(left, right, same)``, where ``same`` says
    that both are one block; each unordered pair of rows meets once.

    ``merge`` shortens the rows that a task has so far, so that it holds what its rows
    come to and not what all its pairs of blocks do."""
    sides = n_sides(n_rows, row_bytes, block_rows, min_sides)
    keyed = rows.withColumn("_side", F.pmod(F.xxhash64(key), F.lit(sides)).cast("int"))
    left = keyed.withColumn("_a", F.col("_side")).withColumn(
        "_b", F.explode(F.sequence("_side", F.lit(sides - 1)))).drop("_side")
    right = keyed.withColumn("_b", F.col("_side")).withColumn(
        "_a", F.explode(F.sequence(F.lit(0), "_side"))).filter("_a <> _b").drop("_side")

    # Both sides come from one DataFrame: give one of them its own columns.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def blocks(side: pd.DataFrame) -> list[pd.DataFrame]:
        return [side.iloc[lo:lo + block_rows] for lo in range(0, len(side), block_rows)]

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        mine = blocks(a)
        theirs, own = (mine, True) if key[0] == key[1] else (blocks(b), False)
        found: list[pd.DataFrame] = []
        for i, x in enumerate(mine):
            found += [kernel(x, y, own and i == j) for j, y in enumerate(theirs) if not own or i <= j]
            if merge and len(found) > 1:
                found = [merge(together(found))]
        found = found or [kernel(a, a, True)]
        return together(found)

    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(run, schema)
