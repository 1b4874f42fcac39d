"""Exact neighbour search where distance bounds rule little out.

With many dimensions and no clusters every query may be near any point, and a tree would
send each query to nearly all leaves.  Here queries and points are split by ID hash into
sides, and every pair of sides is one co-group: a query is sent once per side of points (as
few as POINT_BYTES allows), a point once per side of queries (at most QUERY_SIDES, fewer where
there are several sides of points, unless these exceed QUERY_BYTES).  A task goes through its pairs in blocks that fit the caches and
keeps the cheapest points of each query; what it sends on is as long as its answer.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of vectors that a side may hold; sides of queries, and queries that make one.
POINT_BYTES, QUERY_BYTES, QUERY_SIDES, SIDE_QUERIES = 24 << 20, 24 << 20, 24, 512
#: Queries and points that meet at a time in a task.
QUERY_STEP, POINT_STEP = 512, 2048
#: A block with more candidates than one in so many pairs is measured again in double precision.
FEW = 64


def n_sides(n_queries: int, n_points: int, row_bytes: int, cores: int = 8) -> tuple[int, int]:
    """Sides of the queries and of the points.  Points are sent once per side of queries, so
    there are no more of these than give each core some pairs of sides."""
    of_points = max(1, -(-n_points * row_bytes // POINT_BYTES))
    few = min(QUERY_SIDES, -(-n_queries // SIDE_QUERIES), -(-max(QUERY_SIDES, 3 * cores) // of_points))
    return max(1, few, -(-n_queries * row_bytes // QUERY_BYTES)), of_points


def across(queries: DataFrame, points: DataFrame, sides: tuple[int, int], kernel: Callable, schema: str) -> DataFrame:
    """``kernel(points, queries)`` on every pair of sides of ``queries(qid, features, w)``
    and ``points(pid, features, w)``."""
    n_q, n_p = sides
    pts = points.select(F.pmod(F.xxhash64("pid"), F.lit(n_p)).cast("int").alias("_p"), F.explode(F.sequence(
        F.lit(0), F.lit(n_q - 1))).alias("_q"), *[F.col(c).alias(c) for c in ("pid", "features", "w")])
    qs = queries.select(F.pmod(F.xxhash64("qid", F.lit(7)), F.lit(n_q)).cast("int").alias("_q"), F.explode(F.sequence(
        F.lit(0), F.lit(n_p - 1))).alias("_p"), *[F.col(c).alias(c) for c in ("qid", "features", "w")])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return kernel(a, b)

    return pts.groupBy("_q", "_p").cogroup(qs.groupBy("_q", "_p")).applyInPandas(run, schema)


class Cheapest:
    """The ``m`` cheapest of each of ``n`` rows, fed in pieces: ``cost`` and ``at``, the
    number of the point; of equal costs the smaller number.  Free places cost infinity."""

    def __init__(self, n: int, m: int):
        self.cost, self.at = np.full((n, m), np.inf), np.full((n, m), -1)

    @property
    def reach(self) -> np.ndarray:
        return self.cost[:, -1]

    def add(self, row: np.ndarray, at: np.ndarray, cost: np.ndarray) -> None:
        m = self.cost.shape[1]
        fits = cost <= self.reach[row]
        row, at, cost = row[fits], at[fits], cost[fits]
        if not len(row):
            return
        touched = np.unique(row)
        row = np.concatenate([np.repeat(touched, m), row])
        at, cost = np.concatenate([self.at[touched].ravel(), at]), np.concatenate([self.cost[touched].ravel(), cost])
        order = np.lexsort((at, cost, row))
        first = np.searchsorted(row[order], touched)
        keep = order[(first[:, None] + np.arange(m)).ravel()]
        self.at[touched], self.cost[touched] = at[keep].reshape(-1, m), cost[keep].reshape(-1, m)


class Products:
    """Squared distances between blocks of ``a`` and ``b`` by one product, in units of
    ``unit``: in single precision, or after ``sharpen`` in double.  ``left`` and ``right``
    are the factors, ``a2`` and ``b2`` what the rounding of a row goes with."""

    def __init__(self, left: np.ndarray, right: np.ndarray, a2: np.ndarray, b2: np.ndarray):
        self.unit = max(a2.max(initial=0.0), b2.max(initial=0.0)) or 1.0
        self.a2, self.b2 = a2 / self.unit, b2 / self.unit
        self.wide = left, right
        self.sharpen(False)

    def sharpen(self, sharp: bool = True) -> None:
        self.sharp = sharp
        self.kind = np.float64 if sharp else np.float32
        self.left, self.right = (m.astype(self.kind) for m in self.wide)
        # Every term is rounded, and so is every sum of them.
        self.eps = 2 * (self.left.shape[1] + 8) * float(np.finfo(self.kind).eps)

    def block(self, q: slice, p: slice) -> tuple[np.ndarray, np.ndarray]:
        """Distances and, per query, how far they may be off."""
        off = self.eps * (self.a2[q] + self.b2[p].max(initial=0.0)) + 1e-30
        return self.left[q] @ self.right[p].T, off

    def at_most(self, rough: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The places in a block (flat) of what does not exceed the limit of its row."""
        return np.flatnonzero(rough <= np.nextafter(limit.astype(self.kind), self.kind(np.inf))[:, None])


def euclidean(a: np.ndarray, b: np.ndarray) -> Products:
    """For squared Euclidean distances."""
    a2, b2 = (a**2).sum(1), (b**2).sum(1)
    unit = max(a2.max(initial=0.0), b2.max(initial=0.0)) or 1.0
    root = math.sqrt(unit)
    return Products(np.column_stack([-2 * a / root, a2 / unit, np.ones(len(a))]),
                    np.column_stack([b / root, np.ones(len(b)), b2 / unit]), a2, b2)


def candidates(products: Products, q: slice, p: slice, k: int, reach: np.ndarray, least: np.ndarray,
               factor: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) in a block of all pairs that can be among the k cheapest of their row.

    The cost is the distance times ``factor(rows)``, which is at least ``least`` for the row;
    ``reach`` is the k-th cost so far.  A row without one gets a bound from this block."""
    while True:
        rough, off = products.block(q, p)
        limit = reach / products.unit
        free = np.flatnonzero(np.isinf(limit))
        if len(free) and k <= rough.shape[1]:
            bound = np.partition((rough[free] + off[free, None]) * factor(free), k - 1, axis=1)[:, k - 1]
            limit[free] = np.where(np.isnan(bound), np.inf, bound)
        with np.errstate(over="ignore"):
            at = products.at_most(rough, limit / least + off)
        if products.sharp or len(at) <= 4 * k * len(rough) + rough.size // FEW:
            return np.divmod(at, rough.shape[1])
        products.sharpen()
