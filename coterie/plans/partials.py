"""Sums of per-task partial results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Partials of this many tasks are added on the driver; of more, on Spark first.
FEW_TASKS = 64


def sum_partials(points: DataFrame, partial, keys: dict[str, str], n_tasks: int) -> pd.DataFrame:
    """Add up the rows (keys..., v) that ``partial`` yields once per task of
    ``points``.  The result has one row per key, a bounded number."""
    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", v double"
    rows = points.mapInPandas(partial, schema)
    names = list(keys)
    if n_tasks > FEW_TASKS:
        rows = rows.groupBy(*names).agg(F.sum("v").alias("v"))
    return rows.toPandas().groupby(names, as_index=False)["v"].sum()
