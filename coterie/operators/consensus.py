"""Consensus of several clusterings.

Row i of the samples x samples co-association matrix depends only on the tuple of
labels (the signature) of sample i, so the matrix is never formed:

* for R runs of k clusters there are at most k^R signatures, kept with counts;
* the matrix is (1/R) B B' with B the one-hot labels, R k columns wide, so the
  distance between two (scaled) rows is a quadratic form in R k dimensions.

Both are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.operators.cluster import spectral, ward
from coterie.operators.fuzzy import fuzzy_cmeans, memberships
from coterie.operators.kmeans import N_INIT, SEED, kmeans
from coterie.operators.labels import canonical, defuzzify
from coterie.plans.blocks import block_pairs
from coterie.plans.cells import no_rows, together
from coterie.session import at_once, cut_lineage


def wide_labels(labels: DataFrame) -> DataFrame:
    """(run, sample_id, cluster) to (sample_id, sig) with one label per run, in
    run order.  The array is as long as the number of runs."""
    return labels.groupBy("sample_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("run", "cluster"))), lambda s: s["cluster"]).alias("sig"))


def signatures(labels: DataFrame) -> DataFrame:
    """(sig, n): the distinct label tuples and how many samples share each."""
    wide = labels if "sig" in labels.columns else wide_labels(labels)
    return wide.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))


def coassociation(labels: DataFrame) -> DataFrame:
    """Co-association of all samples in compressed form: (sig_i, sig_j, n_i, n_j,
    co), co = share of runs in which samples with these label tuples agree.

    Its size follows the number of signatures (at most k^R), not of samples.
    Pairs that never agree are absent, as zeros.
    """
    sigs = signatures(labels)
    n_runs = F.size("sig")
    cells = sigs.select("sig", "n", n_runs.alias("r"), F.posexplode("sig").alias("run", "cluster"))
    left = cells.select("run", "cluster", "r", F.col("sig").alias("sig_i"), F.col("n").alias("n_i"))
    right = cells.select("run", "cluster", F.col("sig").alias("sig_j"), F.col("n").alias("n_j"))
    return left.join(right, ["run", "cluster"]).groupBy("sig_i", "sig_j", "n_i", "n_j").agg(
        (F.count(F.lit(1)) / F.first("r")).alias("co"))


def coassociation_pairs(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, co) for the given sample pairs: one join per side, so the work
    follows the pairs asked for (the edges of a graph, say)."""
    wide = wide_labels(labels)
    i = wide.select(F.col("sample_id").alias("i"), F.col("sig").alias("_a"))
    j = wide.select(F.col("sample_id").alias("j"), F.col("sig").alias("_b"))
    agree = F.aggregate(F.zip_with("_a", "_b", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    return pairs.select("i", "j").join(i, "i").join(j, "j").select("i", "j", (agree / F.size("_a")).alias("co"))


def coassociation_degree(labels: DataFrame) -> DataFrame:
    """(sample_id, degree): each sample's row sum of the co-association matrix,
    from cluster sizes alone."""
    sizes = labels.groupBy("run", "cluster").agg(F.count(F.lit(1)).alias("n"))
    n_runs = labels.agg(F.count_distinct("run")).scalar()
    return labels.join(sizes, ["run", "cluster"]).groupBy("sample_id").agg(
        (F.sum("n") / n_runs).alias("degree"))


def scaled_coassociation(labels: DataFrame) -> DataFrame:
    """Compressed co-association with each column scaled to [0, 1] by its minimum
    and maximum over all samples: (sig_i, sig_j, co).

    The largest entry of a column is 1, its own row.  The smallest is 0 unless
    the column agrees with every signature.
    """
    co = coassociation(labels)
    n_sigs = signatures(labels).agg(F.count(F.lit(1))).scalar()
    low = co.groupBy("sig_j").agg(
        F.when(F.count(F.lit(1)) == n_sigs, F.min("co")).otherwise(0.0).alias("lo"))
    scaled = F.when(F.col("lo") < 1, (F.col("co") - F.col("lo")) / (1 - F.col("lo"))).otherwise(0.0)
    return co.join(low, "sig_j").select("sig_i", "sig_j", scaled.alias("co"))


def _lowest_agreement(sigs: DataFrame, n_sigs: int, weights: np.ndarray) -> DataFrame:
    """(sig, lo): least co-association of each signature with any other."""

    def kernel(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        if not len(a) or not len(b):
            return no_rows("sig", "lo")
        x, y = np.array(a["sig"].tolist()), np.array(b["sig"].tolist())
        co = sum(w * (x[:, r][:, None] == y[:, r][None, :]) for r, w in enumerate(weights)) / weights.sum()
        out = [pd.DataFrame({"sig": a["sig"], "lo": co.min(1)})]
        if not same:
            out.append(pd.DataFrame({"sig": b["sig"], "lo": co.min(0)}))
        return together(out)

    lows = block_pairs(sigs.select("sig"), n_sigs, 4 * len(weights), "sig", kernel, "sig array<int>, lo double")
    return lows.groupBy("sig").agg(F.min("lo").alias("lo"))


def consensus_features(labels: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(sig, w, features): per signature its number of samples and coordinates
    whose Euclidean distances equal those between rows of the min-max scaled
    samples x samples co-association matrix.

    ``weights`` counts each run as often as it is repeated.
    """
    weights = np.asarray(weights, dtype=float)
    sigs = cut_lineage(signatures(labels).withColumn("sig", F.col("sig").cast("array<int>")))
    n_sigs = sigs.count()
    lows = _lowest_agreement(sigs, n_sigs, weights)
    # Column j of the matrix is stretched by 1 / (1 - lo_j); collect the weight
    # of every pair of one-hot columns over all samples.
    stretch = F.when(F.col("lo") < 1, 1 / ((1 - F.col("lo")) * (1 - F.col("lo")))).otherwise(1.0)
    rows = sigs.join(lows, "sig").select("sig", (F.col("n") * stretch).alias("m"))
    one = rows.select("m", "sig", F.posexplode("sig").alias("r1", "c1")).select(
        "m", "r1", "c1", F.posexplode("sig").alias("r2", "c2"))
    table = one.groupBy("r1", "c1", "r2", "c2").agg(F.sum("m").alias("m")).toPandas()
    columns = sorted({(r, c) for r, c in zip(table["r1"], table["c1"])})
    at = {rc: i for i, rc in enumerate(columns)}
    g = np.zeros((len(columns), len(columns)))
    for r in table.itertuples():
        g[at[r.r1, r.c1], at[r.r2, r.c2]] = r.m
    omega = np.array([weights[r] for r, _ in columns]) / weights.sum()
    lam, q = np.linalg.eigh(omega[:, None] * g * omega[None, :])
    good = lam > max(lam.max(), 0) * 1e-13
    factor = (q[:, good] * np.sqrt(lam[good])) if good.any() else np.zeros((len(columns), 1))

    @F.pandas_udf("array<double>")
    def coordinates(sig: pd.Series) -> pd.Series:
        return pd.Series([factor[[at[r, c] for r, c in enumerate(s)]].sum(0) for s in sig])

    return sigs.select("sig", F.col("n").cast("double").alias("w"), coordinates("sig").alias("features"))


def base_runs(samples: DataFrame, k: int, seed: int = SEED, n_init: int = N_INIT,
              distinct_seeds: int = 0, runs: dict[str, DataFrame] | None = None) -> DataFrame:
    """(run, sample_id, cluster) of k-means, Ward and spectral clustering.  With
    ``distinct_seeds`` = m there are m k-means runs from different seeds."""
    runs = runs or {}
    steps = [lambda i=i: runs["kmeans"] if i == 0 and "kmeans" in runs else kmeans(samples, k, seed + 1000 * i, n_init)
             for i in range(max(1, distinct_seeds))]
    steps.append(lambda: runs["ward"] if "ward" in runs else ward(samples, k))
    steps.append(lambda: runs["spectral"] if "spectral" in runs else spectral(samples, k, seed=seed, n_init=n_init))

    def labelled(i: int, step: Callable[[], DataFrame]) -> DataFrame:
        # Labels are small; written once, they keep the plans built on them short.
        return cut_lineage(step().select(F.lit(i).alias("run"), "sample_id", "cluster"))

    parts = at_once(samples.sparkSession, *[partial(labelled, i, step) for i, step in enumerate(steps)])
    return reduce(DataFrame.unionByName, parts)


def _spread(labels: DataFrame, by_signature: DataFrame) -> DataFrame:
    """Signature clusters back to samples."""
    wide = wide_labels(labels).withColumn("sig", F.col("sig").cast("array<int>"))
    named = by_signature.withColumnRenamed("sample_id", "sig")
    return canonical(wide.join(named, "sig").select("sample_id", "cluster"))


def fuzzy_consensus(labels: DataFrame, k: int, weights: Sequence[float], seed: int = SEED) -> DataFrame:
    """Fuzzy c-means on the scaled co-association rows, defuzzified."""
    points = cut_lineage(consensus_features(labels, weights).withColumnRenamed("sig", "sample_id"))
    fit = fuzzy_cmeans(points, k, seed=seed)
    return _spread(labels, defuzzify(memberships(points, fit.centres)))


def hard_consensus(labels: DataFrame, k: int, weights: Sequence[float], seed: int = SEED,
                   n_init: int = N_INIT) -> DataFrame:
    """Weighted k-means on the scaled co-association rows."""
    points = cut_lineage(consensus_features(labels, weights).withColumnRenamed("sig", "sample_id"))
    return _spread(labels, kmeans(points, k, seed, n_init))


# Fixed value: how often the k-means run counts in the fuzzy ensemble.
KMEANS_VOTES = 5


def fuzzy_ensemble(samples: DataFrame, k: int, seed: int = SEED, n_init: int = N_INIT,
                   distinct_seeds: bool = False, runs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Consensus of five k-means runs, Ward and spectral clustering by fuzzy
    c-means.  Five runs from one seed are identical, so by default one run counts
    five times; ``distinct_seeds`` makes five."""
    m = KMEANS_VOTES if distinct_seeds else 0
    labels = base_runs(samples, k, seed, n_init, m, runs)
    weights = [1.0] * (m + 2) if m else [float(KMEANS_VOTES), 1.0, 1.0]
    return cut_lineage(fuzzy_consensus(labels, k, weights, seed))


def hard_ensemble(samples: DataFrame, k: int, seed: int = SEED, n_init: int = N_INIT,
                  runs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Consensus of one k-means run, Ward and spectral clustering by k-means."""
    labels = base_runs(samples, k, seed, n_init, 0, runs)
    return cut_lineage(hard_consensus(labels, k, [1.0, 1.0, 1.0], seed, n_init))
