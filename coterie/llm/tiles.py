"""Groups of rows to be compared pairwise, dealt out as bounded tiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.session import written

#: Rows of a tile; a group with more is split into tiles that meet pair by pair.
TILE_ROWS = 4096


def deal(df: DataFrame, keys: Sequence[str], row: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``df`` with ``tile``, ``a`` and ``b``, partitioned and sorted by the keys, a
    and b: any two rows of a group meet in exactly one (keys, a, b).

    Groups of up to ``tile_rows`` rows stay as they are.  A larger one is dealt by a
    hash of ``row`` into t tiles, and every row goes to the t pairs its tile has, so
    no task gets more than two tiles at a time.
    """
    keys = list(keys)
    large = df.groupBy(*keys).count().where(F.col("count") > tile_rows)
    large = written(large.select(*keys, F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles")))
    own = F.coalesce(F.pmod(F.xxhash64(row, F.lit("tile")), F.col("tiles")).cast("int"), F.lit(0))
    meets = F.transform(F.sequence(F.lit(0), F.coalesce(F.col("tiles"), F.lit(1)) - 1), lambda t: F.struct(
        F.least(t, F.col("tile")).alias("a"), F.greatest(t, F.col("tile")).alias("b")))
    dealt = df.join(large, keys, "left").withColumn("tile", own).withColumn("meets", F.explode(meets))
    dealt = dealt.select(*df.columns, "tile", "meets.a", "meets.b")
    return dealt.repartition(*keys, "a", "b").sortWithinPartitions(*keys, "a", "b")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from sorted batches, about ``least`` rows or more each."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < least:
            continue
        table = pa.concat_tables(held).combine_chunks()
        cut = group_starts(table, keys)[-1]
        if cut:
            yield table.slice(0, cut)
        held = [table.slice(cut)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The first row of each run of equal keys; keys are numbers without nulls."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def small_pairs(starts: np.ndarray, n: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, inside the groups of up to ``most`` rows, by distance."""
    sizes = np.diff(np.concatenate([starts, [n]]))
    last = np.repeat(starts + sizes, sizes)
    row = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= most), sizes))
    for distance in range(1, most):
        row = row[row + distance < last[row]]
        if not len(row):
            return
        yield row, row + distance
