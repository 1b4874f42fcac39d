"""Clustering quality.

``labels(sample_id, cluster)`` holds one clustering, or ``labels(run, sample_id,
cluster)`` several over the same samples; the results then carry ``run``, and
the silhouette measures each distance once for all runs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.columns import squared_distance
from coterie.plans.blocks import BLOCK_ROWS, block_pairs
from coterie.plans.cells import matrix, no_rows, together
from coterie.session import written


def _with_run(labels: DataFrame) -> tuple[DataFrame, bool]:
    many = "run" in labels.columns
    return (labels if many else labels.withColumn("run", F.lit(0))), many


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; those too small for the product form are measured
    from the differences."""
    shift = b.mean(0)
    a, b = a - shift, b - shift
    a2, b2 = (a**2).sum(1), (b**2).sum(1)
    d2 = np.column_stack([-2 * a, a2, np.ones(len(a))]) @ np.column_stack([b, np.ones(len(b)), b2]).T
    rows, cols = np.divmod(np.flatnonzero(d2 < 1e-5 * (a2 + b2.max(initial=0.0))[:, None]), max(1, len(b)))
    for s in range(0, len(rows), 1 << 16):
        r, c = rows[s : s + (1 << 16)], cols[s : s + (1 << 16)]
        d2[r, c] = ((a[r] - b[c]) ** 2).sum(1)
    return np.sqrt(np.maximum(d2, 0.0, out=d2), out=d2)


def _cluster_sums(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
    cols = ["sample_id", "run_at", "own", "cluster", "s"]
    if not len(a) or not len(b):
        return no_rows(*cols)
    dist = _distances(matrix(a["features"]), matrix(b["features"]))
    if same:
        np.fill_diagonal(dist, 0.0)
    sides = [(a, b, dist)] if same else [(a, b, dist), (b, a, dist.T)]
    out = []
    for mine, theirs, d in sides:
        la, lb = np.array(mine["clusters"].tolist()), np.array(theirs["clusters"].tolist())
        ids, found = mine["sample_id"].to_numpy(), [np.unique(lb[:, r]) for r in range(lb.shape[1])]
        # One product for all runs: a column per run and cluster.
        sums = d @ np.column_stack([lb[:, r][:, None] == names[None, :] for r, names in enumerate(found)]).astype(float)
        at = np.cumsum([0, *map(len, found)])
        for r, names in enumerate(found):
            out.append(pd.DataFrame({
                "sample_id": np.repeat(ids, len(names)), "run_at": r, "own": np.repeat(la[:, r], len(names)),
                "cluster": np.tile(names, len(ids)), "s": sums[:, at[r]:at[r + 1]].ravel()}))
    return together(out)[cols]


def _added_up(sums: pd.DataFrame) -> pd.DataFrame:
    return sums.groupby(["sample_id", "run_at", "own", "cluster"], as_index=False, sort=False, dropna=False)["s"].sum()


def _linear_sums(rows: DataFrame) -> DataFrame:
    """The same sums of squared distances from one pass over the rows: those to a cluster
    of n rows, mean c and sum of squares q around it are n x d(c)^2 + q."""
    each = rows.select("sample_id", "features", F.posexplode("clusters").alias("run_at", "own"))
    summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("features"))
    stats = each.groupBy("run_at", F.col("own").alias("cluster")).agg(summary.alias("s")).select(
        "run_at", F.struct("cluster", F.col("s.count").alias("n"), vector_to_array("s.mean").alias("centre"), (F.aggregate(
            vector_to_array("s.variance"), F.lit(0.0), lambda t, v: t + v) * (F.col("s.count") - 1)).alias("q")).alias("c"))
    # One row per run, of one entry per cluster.
    stats = written(stats.groupBy("run_at").agg(F.collect_list("c").alias("stats")), "cluster-stats")
    meets = each.join(F.broadcast(stats), "run_at").withColumn("c", F.explode("stats"))
    s = F.col("c.n") * squared_distance(F.col("features"), F.col("c.centre")) + F.col("c.q")
    return meets.select("sample_id", "run_at", "own", F.col("c.cluster").alias("cluster"), s.alias("s"))


METRICS = ("euclidean", "sqeuclidean")


def silhouette_samples(samples: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS,
                       metric: str = "euclidean") -> DataFrame:
    """([run,] sample_id, cluster, silhouette): (b - a) / max(a, b) over mean distances;
    0 for a sample alone in its cluster.  NULL with one cluster, or with as many clusters
    as samples.

    Exact.  With Euclidean distances it is quadratic by definition: blocks of rows meet
    in pairs, and only sums per sample and cluster leave a task.  With ``sqeuclidean``
    (squared distances) it takes one pass and the clusters' means, linear in samples.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    lab, many = _with_run(labels)
    packed = lab.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct("run", "cluster"))).alias("_l"))
    rows = written(samples.select("sample_id", "features").join(packed, "sample_id").select(
        "sample_id", "features", F.transform("_l", lambda x: x["cluster"].cast("int")).alias("clusters")), "labelled")
    if metric == "sqeuclidean":
        sums = _linear_sums(rows)
    else:
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).first()
        sid = rows.schema["sample_id"].dataType.simpleString()
        sums = block_pairs(rows, size.n, 8 * (size.d or 1), "sample_id", _cluster_sums,
                           f"sample_id {sid}, run_at int, own int, cluster int, s double", block_rows,
                           min_sides=max(1, min(6, size.n // 128)), merge=_added_up)
    sums = sums.groupBy("sample_id", "run_at", "own", "cluster").agg(F.sum("s").alias("s"))
    sizes = lab.groupBy("run", "cluster").agg(F.count(F.lit(1)).alias("n"))
    # One row per run and cluster: number the runs as the packed arrays do.
    run_no = F.dense_rank().over(Window.orderBy("run")) - 1
    sizes = sizes.withColumn("run_at", run_no).withColumn(
        "n_clusters", F.count(F.lit(1)).over(Window.partitionBy("run"))).withColumn(
        "n_all", F.sum("n").over(Window.partitionBy("run")))
    mean = sums.join(sizes, ["run_at", "cluster"])
    inside = F.col("own") == F.col("cluster")
    score = mean.groupBy("run", "sample_id", F.col("own").alias("cluster")).agg(
        F.max(F.when(inside, F.col("n"))).alias("n"),
        F.max(F.when(inside, F.try_divide("s", F.col("n") - 1))).alias("a"),
        F.min(F.when(~inside, F.col("s") / F.col("n"))).alias("b"),
        F.first("n_clusters").alias("n_clusters"), F.first("n_all").alias("n_all"))
    value = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    valid = (F.col("n_clusters") > 1) & (F.col("n_clusters") < F.col("n_all"))
    score = score.withColumn("silhouette", F.when(valid, F.when(F.col("n") == 1, 0.0).otherwise(value)))
    return score.select(*(["run"] if many else []), "sample_id", "cluster", "silhouette")


def silhouette(samples: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS,
               metric: str = "euclidean", each: DataFrame | None = None) -> DataFrame:
    """Mean silhouette, one row (per run).  ``each`` are the ``silhouette_samples`` of these
    labels, where they are known."""
    each = silhouette_samples(samples, labels, block_rows, metric) if each is None else each
    return each.groupBy(*[c for c in each.columns if c == "run"]).agg(F.avg("silhouette").alias("silhouette"))


def davies_bouldin(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean over clusters of the largest (S_i + S_j) / d(c_i, c_j); NULL with one
    cluster or as many clusters as samples."""
    lab, many = _with_run(labels)
    rows = samples.select("sample_id", "features").join(lab, "sample_id")
    dims = rows.select("run", "cluster", F.posexplode("features").alias("pos", "x")).groupBy(
        "run", "cluster", "pos").agg(F.avg("x").alias("c"))
    centres = dims.groupBy("run", "cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda s: s["c"]).alias("centre"))
    spread = rows.join(centres, ["run", "cluster"]).groupBy("run", "cluster").agg(
        F.avg(F.sqrt(squared_distance(F.col("features"), F.col("centre")))).alias("s"),
        F.count(F.lit(1)).alias("n"))
    # From here on: one row per run and cluster.
    c = spread.join(centres, ["run", "cluster"])
    other = c.select("run", F.col("cluster").alias("_o"), F.col("s").alias("_s"), F.col("centre").alias("_c"))
    gap = F.sqrt(squared_distance(F.col("centre"), F.col("_c")))
    ratio = F.when(gap > 0, (F.col("s") + F.col("_s")) / gap).otherwise(0.0)
    worst = c.join(other, "run").filter(F.col("cluster") != F.col("_o")).groupBy("run", "cluster").agg(
        F.max(ratio).alias("r"), F.first("n").alias("n"))
    out = worst.groupBy("run").agg(
        F.when(F.count(F.lit(1)) < F.sum("n"), F.avg("r")).alias("davies_bouldin"))
    runs = lab.select("run").distinct().join(out, "run", "left")
    return runs if many else runs.drop("run")


def adjusted_rand(y: DataFrame, labels: DataFrame) -> DataFrame:
    """Adjusted Rand index of ``y(sample_id, y)`` and the clusters."""
    lab, many = _with_run(labels)
    table = lab.join(y.select("sample_id", "y"), "sample_id").groupBy("run", "y", "cluster").agg(
        F.count(F.lit(1)).cast("double").alias("n"))

    def pairs(n):
        return F.sum(n * (n - 1) / 2)

    def margin(col):
        return table.groupBy("run", col).agg(F.sum("n").alias("n")).groupBy("run").agg(
            pairs(F.col("n")).alias(f"p_{col}"))

    both = table.groupBy("run").agg(pairs(F.col("n")).alias("p"), F.sum("n").alias("t"))
    a, b, p = F.col("p_y"), F.col("p_cluster"), F.col("p")
    expected = F.try_divide(a * b, F.col("t") * (F.col("t") - 1) / 2)
    ari = F.coalesce(F.try_divide(p - expected, (a + b) / 2 - expected), F.lit(1.0))
    out = both.join(margin("y"), "run").join(margin("cluster"), "run").select("run", ari.alias("ari"))
    return out if many else out.drop("run")


def evaluate(samples: DataFrame, labels: DataFrame, y: DataFrame, block_rows: int = BLOCK_ROWS,
             metric: str = "euclidean", each: DataFrame | None = None) -> DataFrame:
    """One row (per run): silhouette, davies_bouldin, ari; ``each`` as for ``silhouette``."""
    lab, many = _with_run(labels)
    each = each if each is None else _with_run(each)[0]
    out = silhouette(samples, lab, block_rows, metric, each).join(davies_bouldin(samples, lab), "run").join(
        adjusted_rand(y, lab), "run")
    return out if many else out.drop("run")
