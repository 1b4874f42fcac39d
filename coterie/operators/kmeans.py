"""k-means with many starts, all of them advanced by one pass over the data.

Library k-means reads the data again for every start and every k.  Here a pass is
one job that serves all starts and all k at once: each task assigns its rows to
the centres of every fit with one matrix product and returns sums per centre.
What reaches the driver is the centres (fits x k x features).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.operators.labels import canonical
from coterie.plans.cells import matrix
from coterie.plans.partials import sum_partials

# Seed, starts, passes per start, centre movement (relative to the
# mean feature variance) that ends a fit.
SEED, N_INIT, MAX_ITER, TOL = 42, 10, 300, 1e-4



def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform draws in (0, 1) from 64-bit keys: the same row draws the same
    number wherever and however often it is read."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    shift = centres.mean(0)  # keeps the products below small
    x, centres = x - shift, centres - shift
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :], 0.0)


def _spread_starts(points: DataFrame, k: int, seeds: list[int]) -> list[np.ndarray]:
    """k-means++ starts for every seed: k passes, each drawing one row per seed
    with probability proportional to weight x squared distance.  The row with the
    smallest exponential draw wins, so drawing needs no running totals."""
    chosen: list[list[np.ndarray]] = [[] for _ in seeds]
    for step in range(k):
        now = [np.array(c) for c in chosen]

        def draw(batches):
            best: dict[int, tuple[float, list]] = {}
            for pdf in batches:
                if not len(pdf):
                    continue
                x, w, h = matrix(pdf["features"]), pdf["w"].to_numpy(), pdf["h"].to_numpy()
                for i, s in enumerate(seeds):
                    mass = w * _squared(x, now[i]).min(1) if step else w
                    with np.errstate(divide="ignore"):
                        key = np.where(mass > 0, -np.log(_uniform(h, s * 1009 + step)) / mass, np.inf)
                    at = int(key.argmin())
                    if i not in best or key[at] < best[i][0]:
                        best[i] = (float(key[at]), x[at].tolist())
            yield pd.DataFrame([(i, k, f) for i, (k, f) in best.items()], columns=["i", "key", "features"])

        rows = points.mapInPandas(draw, "i int, key double, features array<double>").groupBy("i").agg(
            F.min_by("features", "key").alias("features"))
        for r in rows.collect():
            chosen[r.i].append(np.array(r.features))
    return [np.array(c) for c in chosen]


def _lloyd_pass(points: DataFrame, fits: dict[int, np.ndarray], n_tasks: int) -> dict[int, np.ndarray]:
    """Sums per (fit, centre): features, mass, cost, squared norms."""
    ids = list(fits)
    stacked = np.vstack([fits[f] for f in ids])
    d = stacked.shape[1]
    bounds = np.cumsum([0] + [len(fits[f]) for f in ids])

    def partial(batches):
        total = np.zeros((len(stacked), d + 3))
        for pdf in batches:
            if not len(pdf):
                continue
            x, w = matrix(pdf["features"]), pdf["w"].to_numpy()
            d2 = _squared(x, stacked)
            full = np.column_stack([x, np.ones(len(x)), np.zeros(len(x)), (x**2).sum(1)]) * w[:, None]
            for a, b in zip(bounds[:-1], bounds[1:]):
                near = d2[:, a:b].argmin(1)
                hot = np.eye(b - a)[near]
                total[a:b] += hot.T @ full
                total[a:b, d + 1] += hot.T @ (w * d2[np.arange(len(x)), a + near])
        row, col = np.nonzero(total)
        yield pd.DataFrame({"c": row.astype("int32"), "i": col.astype("int32"), "v": total[row, col]})

    sums = sum_partials(points, partial, {"c": "int", "i": "int"}, n_tasks)
    table = np.zeros((len(stacked), d + 3))
    table[sums["c"], sums["i"]] = sums["v"]
    return {f: table[a:b] for f, a, b in zip(ids, bounds[:-1], bounds[1:])}


def kmeans_centres(samples: DataFrame, ks: list[int], seed: int = SEED, n_init: int = N_INIT,
                   max_iter: int = MAX_ITER, tol: float = TOL) -> dict[int, np.ndarray]:
    """The centres of the least-cost fit for every k.  ``samples(sample_id,
    features[, w])``; ``w`` is a weight."""
    w = F.col("w").cast("double") if "w" in samples.columns else F.lit(1.0)
    points = samples.select("features", w.alias("w"), F.xxhash64("sample_id").alias("h")).persist()
    n_tasks = points.rdd.getNumPartitions()
    seeds = [seed + i for i in range(n_init)]
    starts = _spread_starts(points, max(ks), seeds)
    jobs = [(k, i) for k in ks for i in range(n_init)]
    active = {f: starts[i][:k] for f, (k, i) in enumerate(jobs)}
    centres = dict(active)
    for _ in range(max_iter):
        if not active:
            break
        moved = {}
        for f, table in _lloyd_pass(points, active, n_tasks).items():
            d = table.shape[1] - 3
            mass = table[:, d : d + 1]
            old = active[f]
            new = np.where(mass > 0, table[:, :d] / np.maximum(mass, 1e-300), old)
            mean = table[:, :d].sum(0) / mass.sum()
            variance = max(table[:, d + 2].sum() / mass.sum() - (mean**2).sum(), 0.0) / d
            centres[f] = new
            if ((new - old) ** 2).sum() > tol * variance:
                moved[f] = new
        active = moved
    # The starts are judged by the centres that they ended with.
    cost = {f: table[:, table.shape[1] - 2].sum() for f, table in _lloyd_pass(points, centres, n_tasks).items()}
    points.unpersist()
    best = {}
    for f, (k, i) in enumerate(jobs):
        if k not in best or cost[f] < cost[best[k]] * (1 - 1e-12):
            best[k] = f
    return {k: centres[f] for k, f in best.items()}


def nearest_centres(samples: DataFrame, centres: list[np.ndarray]) -> DataFrame:
    """(sample_id, clusters): per set of centres the index of the nearest one, the
    lowest on a tie."""

    @F.pandas_udf("array<int>")
    def nearest(features: pd.Series) -> pd.Series:
        x = matrix(features)
        out = [np.stack([((x - c) ** 2).sum(1) for c in cs], 1).argmin(1) for cs in centres]
        return pd.Series(list(np.stack(out, 1).astype("int32")))

    return samples.select("sample_id", nearest("features").alias("clusters"))


def nearest_centre(samples: DataFrame, centres: np.ndarray) -> DataFrame:
    """(sample_id, cluster): index of the nearest of the given centres."""
    return nearest_centres(samples, [np.asarray(centres, dtype=float)]).select(
        "sample_id", F.col("clusters")[0].alias("cluster"))


def kmeans(samples: DataFrame, k: int, seed: int = SEED, n_init: int = N_INIT) -> DataFrame:
    """(sample_id, cluster) of the best of ``n_init`` k-means++ starts."""
    return canonical(nearest_centre(samples, kmeans_centres(samples, [k], seed, n_init)[k]))


def kmeans_sweep(samples: DataFrame, ks: list[int], seed: int = SEED, n_init: int = N_INIT) -> DataFrame:
    """(run, sample_id, cluster) for every k, ``run`` = k, from one set of passes."""
    best = kmeans_centres(samples, ks, seed, n_init)
    each = nearest_centres(samples, [best[k] for k in ks]).select(
        "sample_id", F.posexplode("clusters").alias("at", "cluster"))
    return canonical(each.select(F.get(F.lit(list(ks)), F.col("at")).alias("run"), "sample_id", "cluster"), ("run",))


