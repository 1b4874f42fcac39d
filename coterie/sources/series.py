"""Per-sample tables: column discovery and assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.functions.columns import number_or_null
from coterie.sources.matrix import numeric_shares

# Words that mark the identifier column and the value column.
ID_WORDS = ("id_ref", "probe_id", "probe", "id", "gene")
VALUE_WORDS = ("value", "fpkm", "tpm", "rpkm", "rpm", "count", "signal", "intensity",
               "expression", "log2", "ratio", "norm", "reads", "cpm")


def _named(col: str, words: Sequence[str]) -> bool:
    return any(w in col.lower() for w in words)


def detect_columns(tables: DataFrame | Sequence[DataFrame]) -> tuple[str, str] | None:
    """(identifier column, value column) of the first table that has both.

    The identifier is the first column named like one, else the first column.
    The value is the first value-named column that is wholly numeric, else the
    first column with more than 80 % numbers.  Wholly numeric means that every
    text that is there is a number: NULL and blank texts are missing and don't
    count, but a text such as ``n/a`` is no number (readers make it NULL).
    """
    for df in [tables] if isinstance(tables, DataFrame) else tables:
        if not df.columns:
            continue
        id_col = next((c for c in df.columns if _named(c, ID_WORDS)), df.columns[0])
        others = [c for c in df.columns if c != id_col]
        share = {r.column: r for r in numeric_shares(df, others).collect()} if others else {}
        if not share:
            continue
        value_col = (next((c for c in others if _named(c, VALUE_WORDS) and share[c].n_texts == 0), None)
                     or next((c for c in others if share[c].share > 0.8), None))
        if value_col:
            return id_col, value_col
    return None


def pivot_samples(tables: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """Rows of all sample tables, keyed by ``sample_id``, as (sample_id, gene,
    value); repeated IDs of a sample are averaged."""
    cells = tables.select("sample_id", F.col(id_col).cast("string").alias("gene"),
                          number_or_null(F.col(value_col)).alias("value"))
    return cells.groupBy("sample_id", "gene").agg(F.avg("value").alias("value"))


def require_rows(expr: DataFrame, what: str) -> DataFrame:
    if expr.isEmpty():
        raise ValueError(f"{what}: all sample tables are empty")
    return expr
