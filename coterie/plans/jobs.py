"""End-to-end jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.operators.consensus import fuzzy_ensemble
from coterie.operators.features import preprocess, reduce_dim, select_genes
from coterie.operators.figures import ablation_bars, heatmap_cells, project_2d, silhouette_histogram
from coterie.operators.ids import align_labels, convert_prefixed_ids, map_probes
from coterie.operators.kmeans import N_INIT, SEED
from coterie.operators.metrics import evaluate, silhouette_samples
from coterie.operators.qc import batch_zscore, merge_datasets, qc_filter, shape_report
from coterie.operators.validate import METHODS, ablation, ablation_labels, base_clusterings, classifier_test, find_best_k
from coterie.session import cut_lineage, written
from coterie.sources.sinks import write_result


@dataclass
class Dataset:
    """How to get one data set.  ``load`` returns long cells (sample_id, gene,
    value), with ``gene_info`` also ``ord``, the place of the gene in its file;
    ``labels`` (sample_id, y, ord); the mappings are optional.
    ``sample_order(sample_id, ord)`` gives the order of the samples, needed only
    where label IDs match none of them and labels are taken by position."""

    name: str
    load: Callable[[SparkSession], DataFrame]
    labels: Callable[[SparkSession], DataFrame]
    gene_info: DataFrame | None = None
    probe_map: DataFrame | None = None
    sample_order: DataFrame | None = None


def load_datasets(spark: SparkSession, specs: Sequence[Dataset]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(expr, labels, load_report) of all data sets that load: converted to
    symbols, filtered, z-scored, merged on common genes when there are several.

    A data set that fails is left out and its error recorded: each one's converted
    cells and labels are written by themselves, so an error in any row of it, in a
    mapping or in a label is its own.  Cleaning then runs for all of them in one plan
    keyed by ``dataset``.  Two data sets of one name are an error.
    """
    names = [spec.name for spec in specs]
    if len(set(names)) < len(names):
        raise ValueError(f"data sets of one name: {sorted({n for n in names if names.count(n) > 1})}")
    parts, labels, places, report = [], [], [], []
    for i, spec in enumerate(specs):
        try:
            expr = spec.load(spark)
            if expr is None or expr.isEmpty():
                raise ValueError("no usable matrix")
            # ``dataset`` sorts in the order the data sets were given.
            named = expr.select(F.lit(spec.name).alias("dataset"), "sample_id", "gene", "value",
                                *["ord"] * (spec.gene_info is not None))
            if spec.gene_info is not None:
                named = convert_prefixed_ids(named, spec.gene_info, "ord")
            named = map_probes(named, spec.probe_map) if spec.probe_map is not None else named
            y = spec.labels(spark).select(F.lit(spec.name).alias("dataset"), F.lit(i).alias("dataset_ord"),
                                          "sample_id", "y", "ord")
            order = y if spec.sample_order is None else spec.sample_order
            order = order.select(F.lit(spec.name).alias("dataset"), "sample_id", F.col("ord").cast("long").alias("ord"))
            part = [written(df, "data-set") for df in (named, y, order)]
            for group, df in zip((parts, labels, places), part):
                group.append(df)
            report.append((i, spec.name, True, None))
        except Exception as error:  # one bad data set must not stop the others
            report.append((i, spec.name, False, f"{type(error).__name__}: {error}"))
    if not parts:
        raise ValueError(f"no data set could be loaded: {report}")
    expr, y, place = (reduce(DataFrame.unionByName, group) for group in (parts, labels, places))
    clean = written(batch_zscore(qc_filter(expr)), "clean")
    alive = {r.dataset for r in clean.select("dataset").distinct().collect()}
    if not alive:
        raise ValueError("no cell of any data set passed conversion and quality control")
    # An emptied data set is reported, not merged: it would leave no common gene.
    report = [(i, name, ok and name in alive, error if not ok or name in alive else
               "no cell left after ID conversion and quality control") for i, name, ok, error in report]
    place = place.groupBy("dataset", "sample_id").agg(F.min("ord").alias("ord"))
    surviving = clean.select("dataset", "sample_id").distinct().join(place, ["dataset", "sample_id"])
    order = y.select("dataset", "dataset_ord").distinct()
    kept = align_labels(y, surviving).join(order, "dataset")
    if len(alive) > 1:
        clean, kept = merge_datasets(clean, kept, "dataset_ord", unique=True)
    key = F.concat_ws("/", "dataset", "sample_id").alias("sample_id")
    summary = spark.createDataFrame(report, "ord int, dataset string, loaded boolean, error string")
    return (clean.select("dataset", key, "gene", "value"),
            kept.select("dataset", key, "y"), summary)


def analyse(expr: DataFrame, y: DataFrame, k_genes: int = 500, k_range: tuple[int, int] = (2, 4),
            seed: int = SEED, n_init: int = N_INIT, n_trees: int = 100, figures: bool = True) -> dict[str, DataFrame]:
    """Select genes, clean, reduce, choose k, cluster, evaluate, validate.

    ``expr(sample_id, gene, value)``, ``y(sample_id, y)``.  Returns the result
    tables by name.
    """
    # At most k_genes genes are left here; the whole input is read for this only.
    chosen = written(select_genes(expr.select("sample_id", "gene", "value"), y, k_genes), "chosen")
    samples = cut_lineage(reduce_dim(preprocess(chosen)))
    k = find_best_k(samples, *k_range, seed=seed, n_init=n_init)
    # The ensemble and the ablation combine the same clusterings.
    runs = base_clusterings(samples, k, seed, n_init)
    labels = cut_lineage(fuzzy_ensemble(samples, k, seed, n_init, runs=runs))
    compared = cut_lineage(ablation_labels(samples, k, seed, n_init, runs=runs))
    # Every distance is measured once for all of these clusterings.
    last = len(METHODS)
    every = written(silhouette_samples(samples, compared.unionByName(
        labels.select(F.lit(last).alias("run"), "sample_id", "cluster"))), "silhouettes")
    each = every.filter(F.col("run") == last).drop("run")
    out = {
        "samples": samples,
        "labels": labels,
        "metrics": evaluate(samples, labels, y, each=each),
        "classifiers": classifier_test(samples, labels, seed, n_trees),
        "ablation": cut_lineage(ablation(samples, k, y, seed, n_init, runs=runs, labels=compared, each=every.filter(F.col("run") < last))),
    }
    if figures:
        out |= {
            "ablation_bars": ablation_bars(out["ablation"]),
            "heatmap": heatmap_cells(samples, labels),
            "plane": project_2d(samples, labels),
            "silhouettes": each,
            "silhouette_histogram": silhouette_histogram(each),
        }
    return out


def run_single(expr: DataFrame, y: DataFrame, **options) -> dict[str, DataFrame]:
    """The analysis of one labelled data set."""
    return analyse(expr, y, **options)


def run_multi(spark: SparkSession, specs: Sequence[Dataset], **options) -> dict[str, DataFrame]:
    """The analysis of several data sets merged on their common genes."""
    expr, y, report = load_datasets(spark, specs)
    out = analyse(expr, y, **options)
    out["load_report"] = report
    out["shape"] = shape_report(expr, "merged")
    return out


def write_results(results: dict[str, DataFrame], path: str) -> None:
    for name, df in results.items():
        write_result(df, f"{path.rstrip('/')}/{name}")
