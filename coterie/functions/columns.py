"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_or_null(col: Column) -> Column:
    """Text (or any scalar) to double; NULL when it is no number or NaN."""
    text = col.cast("string")
    # Java also parses the literals "1d" and "2.5f"; a data file means text there.
    x = F.when(~F.coalesce(text.rlike(r"[0-9.][dDfF]\s*$"), F.lit(False)), text).try_cast("double")
    return F.when(~F.isnan(x), x)


def not_nan(col: Column) -> Column:
    """NaN to NULL for a column that is numeric already."""
    x = col.cast("double")
    return F.when(~F.isnan(x), x)


def contains_any(col: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | col.contains(word)
    return hit


def unit_hash(*cols: Column) -> Column:
    """Deterministic uniform draw in [0, 1) from a key; the same on every retry."""
    return F.pmod(F.xxhash64(*cols), F.lit(2**31)) / F.lit(float(2**31))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v
    )


def dense_index(df: DataFrame, ord_col: str, by: Sequence[str] = (), name: str = "idx",
                bucket_rows: int = 1 << 16) -> DataFrame:
    """0-based position of each row by the integer column ``ord_col`` (unique
    within ``by``), without sorting a whole group in one task.

    Rows are ranked inside buckets of consecutive ``ord_col`` values; only the
    table of bucket counts (rows / ``bucket_rows``) is accumulated in order.
    """
    keys = list(by)
    bucketed = df.withColumn("_bucket", F.floor(F.col(ord_col) / F.lit(bucket_rows)))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, "_bucket").count()
        .withColumn("_offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ord_col)
    ranked = bucketed.withColumn("_rank", F.row_number().over(inside) - 1)
    return (
        ranked.join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_offset") + F.col("_rank")).cast("long"))
        .drop("_bucket", "_rank", "_offset")
    )
