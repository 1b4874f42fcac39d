"""Tables behind the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.operators.cluster import spectral_embedding
from coterie.operators.features import pca
from coterie.operators.kmeans import SEED
from coterie.operators.neighbors import knn_affinity
from coterie.session import cut_lineage


def ablation_bars(scores: DataFrame) -> DataFrame:
    """(method, silhouette, text with three decimals)."""
    return scores.select("method", "silhouette", F.format_number("silhouette", 3).alias("text"))


def sort_by_cluster(labels: DataFrame) -> DataFrame:
    return labels.orderBy("cluster", "sample_id")


def cluster_ranks(labels: DataFrame) -> DataFrame:
    """(sample_id, cluster, rank): 0-based row of each sample in a table sorted by
    cluster, inside a cluster by ``md5(sample_id)``.

    Ranks are counted inside hash buckets, plus the sizes of all earlier buckets,
    so no task sorts a whole cluster.
    """
    h = F.md5(F.col("sample_id").cast("string"))
    keyed = labels.select("sample_id", "cluster", h.alias("_h"), F.substring(h, 1, 3).alias("_b"))
    before = Window.orderBy("cluster", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("cluster", "_b").count().select(
        "cluster", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("cluster", "_b").orderBy("_h")
    ranked = keyed.withColumn("_r", F.row_number().over(inside) - 1)
    return ranked.join(offsets, ["cluster", "_b"]).select(
        "sample_id", "cluster", (F.col("_o") + F.col("_r")).alias("rank"))


def heatmap_cells(samples: DataFrame, labels: DataFrame, max_rows: int = 200) -> DataFrame:
    """(tile, component, value): the matrix sorted by cluster, its rows averaged
    into at most ``max_rows`` equal tiles."""
    ranked = cluster_ranks(labels.select("sample_id", "cluster"))
    n = labels.agg(F.count(F.lit(1))).scalar()
    tile = F.floor(F.col("rank") * F.least(n, F.lit(max_rows)) / n).cast("int")
    rows = samples.select("sample_id", "features").join(ranked.withColumn("tile", tile), "sample_id")
    return rows.select("tile", F.posexplode("features").alias("component", "x")).groupBy(
        "tile", "component").agg(F.avg("x").alias("value"))


def project_2d(samples: DataFrame, labels: DataFrame, method: str = "pca", seed: int = SEED) -> DataFrame:
    """(sample_id, x, y, cluster): the first two principal components, or two
    eigenvectors of the nearest-neighbour graph after the trivial one."""
    if method == "pca":
        plane = pca(samples, n=2)
        at = (0, 1)
    else:
        edges = cut_lineage(knn_affinity(samples))
        plane = spectral_embedding(edges, samples, 3, seed=seed)
        at = (1, 2)
    return plane.join(labels, "sample_id").select(
        "sample_id", F.get("features", F.lit(at[0])).alias("x"),
        F.get("features", F.lit(at[1])).alias("y"), "cluster")


def silhouette_histogram(values: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, lo, hi, n, mean): equal bins between the extremes, the last closed;
    empty bins included; the mean of all values on every row.  As in common
    histogram routines, one distinct value v spans v - 0.5 to v + 0.5."""
    v = F.col("silhouette")
    all_of = values.agg(F.min(v).alias("a"), F.max(v).alias("b"), F.avg(v).alias("mean")).select(
        F.when(F.col("a") < F.col("b"), F.col("a")).otherwise(F.col("a") - 0.5).alias("a"),
        F.when(F.col("a") < F.col("b"), F.col("b")).otherwise(F.col("b") + 0.5).alias("b"), "mean")
    r = all_of.select(F.struct("a", "b", "mean")).scalar()
    w = (F.col("r.b") - F.col("r.a")) / bins
    binned = values.filter(v.isNotNull()).select(v.alias("silhouette"), r.alias("r")).withColumn(
        "bin", F.least(F.floor((v - F.col("r.a")) / w), F.lit(bins - 1)).cast("int")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))
    # ``bins`` rows derived from the one-row range.
    frame = all_of.select(F.struct("a", "b", "mean").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(binned, "bin", "left").select(
        "bin", (F.col("r.a") + F.col("bin") * w).alias("lo"), (F.col("r.a") + (F.col("bin") + 1) * w).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"), F.col("r.mean").alias("mean"))
