"""Choice of k, hold-out classification, ablation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.operators.cluster import spectral, ward
from coterie.operators.consensus import fuzzy_ensemble, hard_ensemble
from coterie.operators.forest import random_forest
from coterie.operators.fuzzy import fuzzy_cmeans
from coterie.operators.kmeans import N_INIT, SEED, kmeans, kmeans_sweep
from coterie.operators.labels import canonical, defuzzify
from coterie.operators.metrics import evaluate, silhouette
from coterie.operators.neighbors import knn
from coterie.operators.svm import train_svm
from coterie.plans.cells import BLOCK_ROWS
from coterie.session import at_once, cut_lineage

# Fixed value: held-out share of the samples.
TEST_SIZE = 0.3


def choose_k(scores: DataFrame) -> DataFrame:
    """One row (k, silhouette): the best score, the smaller k on a tie; k = 2
    with score -1 when no score exceeds that."""
    best = scores.agg(F.max_by(
        F.struct("k", "silhouette"), F.struct("silhouette", -F.col("k"))).alias("b")).select(
        F.when(F.col("b.silhouette") > -1, F.col("b.k")).otherwise(2).alias("k"),
        F.when(F.col("b.silhouette") > -1, F.col("b.silhouette")).otherwise(-1.0).alias("silhouette"))
    return best


def score_k(samples: DataFrame, k_min: int = 2, k_max: int = 4, seed: int = SEED,
            n_init: int = N_INIT, block_rows: int = BLOCK_ROWS, metric: str = "euclidean") -> DataFrame:
    """(k, silhouette) of k-means for each k; distances are measured once for all."""
    runs = cut_lineage(kmeans_sweep(samples, list(range(k_min, k_max + 1)), seed, n_init))
    return silhouette(samples, runs, block_rows, metric).withColumnRenamed("run", "k")


def find_best_k(samples: DataFrame, k_min: int = 2, k_max: int = 4, seed: int = SEED,
                n_init: int = N_INIT, block_rows: int = BLOCK_ROWS, metric: str = "euclidean") -> int:
    return choose_k(score_k(samples, k_min, k_max, seed, n_init, block_rows, metric)).first().k


def train_test_split(samples: DataFrame, test_size: float = TEST_SIZE, seed: int = SEED,
                     small: int = 10_000) -> DataFrame:
    """Add ``is_test``: the ceil(test_size x n) samples with the smallest
    ``md5(sample_id:seed)``.

    The cut-off is found by counting hash prefixes (at most 4096 counts per pass)
    until few hashes share one; the split itself is then a plain comparison.  Rows
    of one ``sample_id`` stay together, so repeated ones can make the test side larger.
    """
    hashed = samples.withColumn(
        "_h", F.md5(F.concat(F.col("sample_id").cast("string"), F.lit(f":{seed}"))))
    hashes = hashed.select("_h")
    prefix, need, inside = "", None, None
    while inside is None or (inside > small and len(prefix) < 32):
        part = F.substring("_h", 1, len(prefix) + 3)
        counts = sorted(
            (r.p, r["count"]) for r in
            hashes.filter(F.col("_h").startswith(prefix)).groupBy(part.alias("p")).count().collect())
        if need is None:
            need = math.ceil(test_size * sum(c for _, c in counts))
        if need <= 0:
            return hashed.withColumn("is_test", F.lit(False)).drop("_h")
        for p, c in counts:
            if need <= c:
                prefix, inside = p, c
                break
            need -= c
    if len(prefix) >= 32:  # a whole hash
        return hashed.withColumn("is_test", F.col("_h") <= prefix).drop("_h")
    last = hashes.filter(F.col("_h").startswith(prefix)).orderBy("_h").limit(need).agg(F.max("_h")).first()[0]
    return hashed.withColumn("is_test", F.col("_h") <= last).drop("_h")


def classify_rf(train: DataFrame, test: DataFrame, seed: int = SEED, n_trees: int = 100) -> DataFrame:
    """(sample_id, cluster, predicted) by random forest (see ``forest``): square root of
    the features per split, depth up to 30, the same for any partitioning."""
    return random_forest(train, n_trees, seed).predict(test).select(
        "sample_id", F.col("cluster").cast("int").alias("cluster"), "predicted")


def classify_svm(train: DataFrame, test: DataFrame, seed: int = SEED, c: float = 1.0,
                 n_random: int = 500) -> DataFrame:
    """(sample_id, cluster, predicted) by support vector machines with an RBF kernel,
    trained to a duality gap (see ``svm``), the same for any partitioning."""
    return train_svm(train, seed, c, n_random).predict(test).select(
        "sample_id", F.col("cluster").cast("int").alias("cluster"), "predicted")


def classify_knn(train: DataFrame, test: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Majority cluster of the k nearest training samples, the smallest on a tie."""
    near = knn(test, train, k, block_rows)
    votes = near.join(train.select(F.col("sample_id").alias("neighbor_id"), "cluster"), "neighbor_id")
    won = votes.groupBy("sample_id").agg(F.mode("cluster", True).alias("predicted"))
    return test.select("sample_id", "cluster").join(won, "sample_id")


def accuracy(predictions: DataFrame, model: str) -> DataFrame:
    right = F.sum((F.col("cluster") == F.col("predicted")).cast("long"))
    return predictions.agg(
        (right / F.count(F.lit(1))).alias("accuracy"), right.alias("n_correct"),
        F.count(F.lit(1)).alias("n_test")).select(F.lit(model).alias("model"), "accuracy", "n_correct", "n_test")


def classifier_test(samples: DataFrame, labels: DataFrame, seed: int = SEED, n_trees: int = 100,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(model, accuracy, n_correct, n_test) of three classifiers trained to
    predict the clusters of held-out samples."""
    split = train_test_split(
        samples.select("sample_id", "features").join(labels.select("sample_id", "cluster"), "sample_id"), seed=seed)
    split = cut_lineage(split)
    train, test = split.filter("NOT is_test"), split.filter("is_test")
    forest, svm, near = at_once(
        samples.sparkSession,
        lambda: accuracy(classify_rf(train, test, seed, n_trees), "RandomForest"),
        lambda: accuracy(classify_svm(train, test, seed), "SVM"),
        lambda: accuracy(classify_knn(train, test, block_rows=block_rows), "KNN"))
    return forest.unionByName(svm).unionByName(near)


METHODS = ("KMeans", "Fuzzy C-Means", "Ensemble (no Fuzzy)", "Fuzzy Ensemble")


def base_clusterings(samples: DataFrame, k: int, seed: int = SEED, n_init: int = N_INIT,
                     block_rows: int = BLOCK_ROWS) -> dict[str, DataFrame]:
    """The clusterings that the ensembles combine, by name, each computed once."""
    found = at_once(
        samples.sparkSession,
        lambda: cut_lineage(kmeans(samples, k, seed, n_init)),
        lambda: cut_lineage(ward(samples, k, block_rows=block_rows)),
        lambda: cut_lineage(spectral(samples, k, seed=seed, n_init=n_init, block_rows=block_rows)))
    return dict(zip(("kmeans", "ward", "spectral"), found))


def ablation_labels(samples: DataFrame, k: int, seed: int = SEED, n_init: int = N_INIT,
                    block_rows: int = BLOCK_ROWS, runs: dict[str, DataFrame] | None = None) -> DataFrame:
    """(run, sample_id, cluster) of the four methods; the base clusterings are
    computed once and shared by both ensembles, or given as ``runs``."""
    runs = runs or base_clusterings(samples, k, seed, n_init, block_rows)
    parts = (runs["kmeans"], *at_once(
        samples.sparkSession,
        lambda: canonical(defuzzify(fuzzy_cmeans(samples, k, seed=seed).memberships(samples))),
        lambda: hard_ensemble(samples, k, seed, n_init, runs),
        lambda: fuzzy_ensemble(samples, k, seed, n_init, runs=runs)))
    out = None
    for i, part in enumerate(parts):
        one = part.select(F.lit(i).alias("run"), "sample_id", "cluster")
        out = one if out is None else out.unionByName(one)
    return out


def ablation(samples: DataFrame, k: int, y: DataFrame, seed: int = SEED, n_init: int = N_INIT,
             block_rows: int = BLOCK_ROWS, runs: dict[str, DataFrame] | None = None,
             labels: DataFrame | None = None, each: DataFrame | None = None) -> DataFrame:
    """(method, silhouette, davies_bouldin, ari) of k-means, fuzzy c-means, and
    the ensemble without and with the fuzzy step.  ``labels`` are the ``ablation_labels`` and
    ``each`` the ``silhouette_samples`` of these, where they are known."""
    labels = cut_lineage(ablation_labels(samples, k, seed, n_init, block_rows, runs)) if labels is None else labels
    scores = evaluate(samples, labels, y, block_rows, each=each)
    name = F.get(F.lit(list(METHODS)), F.col("run"))
    return scores.select(F.col("run").alias("ord"), name.alias("method"), "silhouette", "davies_bouldin", "ari")
