"""Feature scoring, selection, scaling and projection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from coterie.functions.tables import to_wide
from coterie.plans.cells import matrix
from coterie.session import cut_lineage, written

# A selection of this size is safe to broadcast as a list of keys.
MAX_SELECTED = 100_000


def shift_nonneg(expr: DataFrame) -> DataFrame:
    """Subtract the global minimum from every value when it is negative."""
    lowest = expr.agg(F.least(F.min("value"), F.lit(0.0))).scalar()
    return expr.withColumn("value", F.col("value") - lowest)


def log1p_values(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.log1p("value"))


def select_numeric(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The numeric columns (and ``keep``)."""
    return df.select(*[f.name for f in df.schema
                       if f.name in keep or isinstance(f.dataType, NumericType)])


def drop_null_columns(df: DataFrame, how: str = "any", keep: Sequence[str] = ()) -> DataFrame:
    """Drop the columns holding any, or nothing but, missing values: one aggregate."""
    cols = [c for c in df.columns if c not in keep]
    if not cols:
        return df

    def present(field):
        col = F.col(f"`{field.name}`")
        is_float = field.dataType.typeName() in ("double", "float")
        return F.count(F.when(col.isNotNull() & ~F.isnan(col), 1) if is_float else col).alias(field.name)

    row = df.agg(F.count(F.lit(1)).alias("_n"), *[present(f) for f in df.schema if f.name in cols]).first()
    bad = [c for c in cols if (row[c] < row["_n"] if how == "any" else row[c] == 0)]
    return df.drop(*bad)


def anova_f(expr: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One-way ANOVA F of every gene over the classes ``y``; missing values skip.

    ``expr`` carries ``y`` itself, or ``labels(sample_id, y)`` is joined.  The
    only shuffle of the data is the partial aggregate per (gene, y).
    """
    data = expr if labels is None else expr.join(labels.select("sample_id", "y"), "sample_id")
    per_class = data.filter("value IS NOT NULL AND y IS NOT NULL").groupBy("gene", "y").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    gene = Window.partitionBy("gene")
    grand = F.sum(F.col("n") * F.col("m")).over(gene) / F.sum("n").over(gene)
    sums = per_class.withColumn("g", grand).groupBy("gene").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"),
        F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("ssb"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"))
    between = F.try_divide("ssb", F.col("c") - 1)
    within = F.try_divide("ssw", F.col("n") - F.col("c"))
    score = F.when(within > 0, between / within).when((within == 0) & (between > 0), float("inf"))
    return sums.select("gene", score.alias("f"))


def top_k_features(scores: DataFrame, k: int = 500) -> DataFrame:
    """The k best scores; of equal scores the later gene is taken."""
    return scores.orderBy(F.desc_nulls_last("f"), F.desc("gene")).limit(k)


def select_genes(expr: DataFrame, labels: DataFrame | None = None, k: int = 500) -> DataFrame:
    """Cells of the k genes with the largest ANOVA F."""
    top = top_k_features(anova_f(expr, labels), k).select("gene")
    # k rows at most, so the key list may be broadcast whatever the data size.
    return expr.join(F.broadcast(top) if k <= MAX_SELECTED else top, "gene", "left_semi")


def standardize(expr: DataFrame, keep_flat: bool = True) -> DataFrame:
    """Mean 0 and population std 1 per gene.  A constant gene is divided by 1, or
    left out without ``keep_flat``."""
    stats = expr.groupBy("gene").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"))
    # Written, so that it is broadcast when small and the cells stay in place.
    stats = written(stats if keep_flat else stats.filter(F.col("_sd") > 0), "stats")
    scaled = (F.col("value") - F.col("_mean")) / F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    return expr.join(stats, "gene").withColumn("value", scaled).drop("_mean", "_sd")


def variance_threshold(expr: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Cells of the genes whose population variance exceeds the threshold."""
    good = expr.groupBy("gene").agg(F.var_pop("value").alias("v")).filter(F.col("v") > threshold)
    return expr.join(written(good.select("gene"), "genes"), "gene", "left_semi")


def minmax_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each column to [0, 1]; a constant column becomes 0."""
    bounds = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in cols])
    out = df.withColumn("_b", bounds.select(F.struct(*cols)).scalar())

    def scaled(c):
        lo, hi = F.col("_b")[c]["lo"], F.col("_b")[c]["hi"]
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).when(F.col(c).isNotNull(), 0.0)

    return out.withColumns({c: scaled(c) for c in cols}).drop("_b")


def preprocess(expr: DataFrame, k_neighbours: int = 5, threshold: float = 0.01) -> DataFrame:
    """Shift to non-negative, log1p, impute, standardise, drop flat genes."""
    from coterie.operators.impute import knn_impute

    filled = knn_impute(log1p_values(shift_nonneg(expr)), k_neighbours)
    if 0 <= threshold < 1:
        # A standardised gene has variance 1, a constant one 0.
        return standardize(filled, keep_flat=False)
    return variance_threshold(standardize(filled), threshold)


#: Vectors in a block of the Krylov basis beyond the components that are asked for, and
#: features of a product that are added up together.
OVERSAMPLING, SUMMED_FEATURES = 8, 256


def _gram_times(samples: DataFrame, mean: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A'(A v) for the centred rows A: each task sends one product of the size of ``v``,
    which is added up on Spark in the order of the tasks."""
    wide = v.shape[1]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(v.shape)
        for pdf in batches:
            if len(pdf):
                a = matrix(pdf["features"]) - mean
                total += a.T @ (a @ v)
        task = TaskContext.get().partitionId()
        at = range(0, len(mean), SUMMED_FEATURES)
        yield pd.DataFrame({"at": at, "task": task, "part": [total[lo:lo + SUMMED_FEATURES].tobytes() for lo in at]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(raw) for raw in pdf.sort_values("task")["part"]]
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "part": [sum(parts[1:], parts[0]).tobytes()]})

    rows = samples.select("features").mapInPandas(partial, "at int, task int, part binary").groupBy("at").applyInPandas(
        add, "at int, part binary").orderBy("at").collect()
    return np.concatenate([np.frombuffer(r.part).reshape(-1, wide) for r in rows])


def principal_axes(samples: DataFrame, mean: np.ndarray, n: int, tol: float = 1e-10, seed: int = 42) -> np.ndarray:
    """(features, n): the leading eigenvectors of the covariance, largest first.

    A random block is multiplied by the covariance again and again, and the products span
    a growing basis (block Krylov); the covariance itself is never formed.  Every product
    is one pass over the rows.  It ends when the residuals of the n axes are below ``tol``
    of the largest eigenvalue, or when the basis spans all features or cannot grow, in
    both of which cases the axes are exact.  The driver holds the basis."""
    d = len(mean)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, n + OVERSAMPLING))))[0]
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    while True:
        product = _gram_times(samples, mean, block)
        basis, image = np.hstack([basis, block]), np.hstack([image, product])
        small = basis.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-theta)[:n]
        theta, y = theta[order], y[:, order]
        axes = basis @ y
        residual = np.sqrt(((image @ y - axes * theta) ** 2).sum(0)).max()
        if residual <= tol * max(theta[0], 1e-300) or basis.shape[1] == d:
            return axes
        for _ in range(2):  # once more for what rounding leaves
            product = product - basis @ (basis.T @ product)
        u, size, _ = np.linalg.svd(product, full_matrices=False)
        block = u[:, size > 1e-13 * max(theta[0], 1e-300)][:, :d - basis.shape[1]]
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
            block = np.linalg.qr(block)[0]
        if not block.shape[1]:
            return axes


def pca(samples: DataFrame, n: int | None = None, max_components: int = 50) -> DataFrame:
    """Principal component scores of centred features; the largest loading of
    each component is positive.

    Means and count are one aggregate, the components come from a few passes (see
    ``principal_axes``); no features x features matrix is formed.
    """
    stats = samples.select(Summarizer.metrics("mean", "count").summary(array_to_vector("features")).alias("s")).select(
        vector_to_array("s.mean").alias("mean"), F.col("s.count").alias("n")).first()
    mean = np.array(stats.mean)
    n_comp = n or max(1, min(max_components, min(stats.n, len(mean)) - 1))
    axes = principal_axes(samples, mean, min(n_comp, len(mean)))
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] >= 0, 1.0, -1.0)

    @F.pandas_udf("array<double>")
    def scores(features: pd.Series) -> pd.Series:
        return pd.Series(list((matrix(features) - mean) @ axes))

    return samples.select("sample_id", scores("features").alias("features"))


def reduce_dim(expr: DataFrame, max_components: int = 50) -> DataFrame:
    """Complete long cells to (sample_id, component scores)."""
    # Written once: the fits below read the rows several times.
    samples = cut_lineage(to_wide(expr)[0])
    return pca(samples, max_components=max_components)
