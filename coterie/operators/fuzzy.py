"""Fuzzy c-means.

State between passes is the centres alone (clusters x features).  A pass is one
job: each task turns its rows into memberships with numpy and returns sums per
cluster; the memberships of the previous pass are recomputed from the previous
centres, so no samples x clusters table is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.functions.columns import unit_hash
from coterie.plans.cells import matrix
from coterie.plans.partials import sum_partials

# Fuzziness, stopping change, pass limit.
FUZZINESS, ERROR, MAX_PASSES = 2.0, 0.005, 1000
_EPS = float(np.finfo(float).eps)
# Slots of a pass summary beside the feature sums.
_MASS, _CHANGE, _COST, _CRISP, _ROWS = -1, -2, -3, -4, -5


def memberships_of(x: np.ndarray, centres: np.ndarray, m: float = FUZZINESS) -> tuple[np.ndarray, np.ndarray]:
    """(u, squared distances), each rows x clusters."""
    d2 = np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)
    d = np.maximum(np.sqrt(d2), _EPS)
    inv = (d / d.min(1, keepdims=True)) ** (-2.0 / (m - 1.0))
    return inv / inv.sum(1, keepdims=True), d2


def _summarise(x, w, u0, centres, previous, m) -> dict[tuple[int, int], float]:
    """Weighted sums of one batch for the next centres and the stopping rule."""
    if centres is None:
        u, d2 = u0 / u0.sum(1, keepdims=True), np.zeros_like(u0)
        before = u
    else:
        u, d2 = memberships_of(x, centres, m)
        before = memberships_of(x, previous, m)[0] if previous is not None else u0 / u0.sum(1, keepdims=True)
    um = np.maximum(u, _EPS) ** m * w[:, None]
    out = {}
    for c in range(u.shape[1]):
        out.update({(c, i): v for i, v in enumerate(um[:, c] @ x)})
        out[c, _MASS] = um[:, c].sum()
        out[c, _CHANGE] = (w * (u[:, c] - before[:, c]) ** 2).sum()
        out[c, _COST] = (um[:, c] * d2[:, c]).sum()
        out[c, _CRISP] = (w * u[:, c] ** 2).sum()
        out[c, _ROWS] = w.sum()
    return out


def _distributed_pass(points: DataFrame, centres, previous, m, n_tasks) -> dict[tuple[int, int], float]:
    def partial(batches):
        total: dict = {}
        for pdf in batches:
            if len(pdf):
                part = _summarise(matrix(pdf["features"]), pdf["w"].to_numpy(),
                                  matrix(pdf["u0"]), centres, previous, m)
                for key, v in part.items():
                    total[key] = total.get(key, 0.0) + v
        yield pd.DataFrame([(c, i, v) for (c, i), v in total.items()], columns=["c", "i", "v"])

    sums = sum_partials(points, partial, {"c": "int", "i": "int"}, n_tasks)
    return {(r.c, r.i): r.v for r in sums.itertuples()}


@dataclass
class FuzzyResult:
    centres: np.ndarray
    objective: float
    passes: int
    partition_coefficient: float
    m: float

    def memberships(self, samples: DataFrame) -> DataFrame:
        """(sample_id, u)."""
        return memberships(samples, self.centres, self.m)


def memberships(samples: DataFrame, centres: np.ndarray, m: float = FUZZINESS) -> DataFrame:
    @F.pandas_udf("array<double>")
    def u_of(features: pd.Series) -> pd.Series:
        return pd.Series(list(memberships_of(matrix(features), centres, m)[0]))

    return samples.select("sample_id", u_of("features").alias("u"))


def _next_centres(sums: dict, k: int, d: int) -> np.ndarray:
    return np.array([[sums[c, i] / sums[c, _MASS] for i in range(d)] for c in range(k)])


def iterate(run_pass, k: int, d: int, error: float, max_passes: int, m: float) -> FuzzyResult:
    """Alternate centres and memberships until ||U - U_previous|| < error."""
    previous, centres = None, _next_centres(run_pass(None, None), k, d)
    for passes in range(1, max_passes + 1):
        sums = run_pass(centres, previous)
        total = {slot: sum(sums[c, slot] for c in range(k)) for slot in (_CHANGE, _COST, _CRISP)}
        if total[_CHANGE] ** 0.5 < error or passes == max_passes:
            break
        previous, centres = centres, _next_centres(sums, k, d)
    return FuzzyResult(centres, total[_COST], passes, total[_CRISP] / sums[0, _ROWS], m)


def with_start(samples: DataFrame, k: int, seed: int) -> DataFrame:
    """Add the random start memberships, drawn from a hash of the sample ID."""
    w = F.col("w").cast("double") if "w" in samples.columns else F.lit(1.0)
    draws = [unit_hash(F.col("sample_id"), F.lit(c), F.lit(seed)) + 1e-6 for c in range(k)]
    return samples.select("sample_id", "features", w.alias("w"), F.array(*draws).alias("u0"))


def fuzzy_cmeans(samples: DataFrame, k: int, m: float = FUZZINESS, error: float = ERROR,
                 max_passes: int = MAX_PASSES, seed: int = 42) -> FuzzyResult:
    """Fuzzy c-means of ``samples(sample_id, features[, w])``; ``w`` is a weight."""
    points = with_start(samples, k, seed).persist()
    n_tasks = points.rdd.getNumPartitions()
    d = points.select(F.size("features").alias("d")).first().d
    try:
        return iterate(lambda c, p: _distributed_pass(points, c, p, m, n_tasks), k, d, error, max_passes, m)
    finally:
        points.unpersist()


def fcm_pass(samples: DataFrame, centres: np.ndarray, m: float = FUZZINESS) -> np.ndarray:
    """Centres after one pass from the given ones."""
    points = with_start(samples, len(centres), 0)
    at = np.asarray(centres, dtype=float)
    return _next_centres(_distributed_pass(points, at, at, m, points.rdd.getNumPartitions()), *at.shape)
