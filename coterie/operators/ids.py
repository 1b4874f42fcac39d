"""Feature identifiers: duplicates, mappings, common genes, label alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.functions.columns import dense_index
from coterie.session import dealt, written

CELL = ("dataset", "sample_id", "gene")


def _cell(df: DataFrame) -> list[str]:
    return [c for c in CELL if c in df.columns]


def dedup_mean(expr: DataFrame) -> DataFrame:
    """One row per cell: the mean of its present values."""
    return expr.groupBy(*_cell(expr)).agg(F.avg("value").alias("value"))


def dedup_report(expr: DataFrame, dataset_sample_row: str = "sample_id") -> DataFrame:
    """Gene rows before and after ``dedup_mean``: the row count of a gene is the
    largest number of values any sample has for it."""
    per_cell = expr.groupBy("dataset", dataset_sample_row, "gene").count()
    per_gene = per_cell.groupBy("dataset", "gene").agg(F.max("count").alias("n"))
    return per_gene.groupBy("dataset").agg(
        F.sum("n").alias("n_before"), F.count(F.lit(1)).alias("n_after")
    )


def first_per_key(df: DataFrame, key: str, ord_col: str) -> DataFrame:
    """The row with the smallest ``ord_col`` of each key."""
    rest = [c for c in df.columns if c != key]
    row = df.groupBy(key).agg(F.min_by(F.struct(*rest), ord_col).alias("_row"))
    return row.select(key, "_row.*").select(*df.columns)


def last_per_key(df: DataFrame, key: str, value: str, ord_col: str) -> DataFrame:
    """The value with the largest ``ord_col`` of each key (later rows overwrite)."""
    return df.groupBy(key).agg(F.max_by(value, ord_col).alias(value))


def starts_with_prefix(expr: DataFrame, prefix: str, ord_col: str, by: str | None = None) -> DataFrame:
    """Whether the first gene (by ``ord_col``, the place in the file) has the prefix;
    one row, or one per ``by``."""
    first = F.min_by(F.col("gene").cast("string"), ord_col)
    out = first.startswith(prefix).alias("has_prefix")
    return expr.groupBy(by).agg(out) if by else expr.agg(out)


def convert_ids(expr: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace each gene by its symbol; genes without one, or with an empty one, are
    dropped.  IDs must match exactly, and an empty mapping leaves nothing."""
    named = mapping.where("symbol <> ''").select(F.col("id").alias("gene"), "symbol")
    # No broadcast hint: the optimizer broadcasts the mapping when it measures small.
    mapped = expr.withColumn("gene", F.col("gene").cast("string")).join(named, "gene", "inner")
    return dedup_mean(mapped.drop("gene").withColumnRenamed("symbol", "gene"))


def convert_prefixed_ids(expr: DataFrame, mapping: DataFrame, ord_col: str, prefix: str = "ENSG") -> DataFrame:
    """``convert_ids`` for the data sets whose first gene (by ``ord_col``) carries the
    prefix; the others pass through unchanged.  An empty symbol is none."""
    # One row per data set: as many as the caller named.
    has = F.broadcast(starts_with_prefix(expr, prefix, ord_col, "dataset").where("has_prefix"))
    named = mapping.where("symbol <> ''").select(F.col("id").alias("gene"), "symbol")
    cells = expr.withColumn("gene", F.col("gene").cast("string")).drop(*{ord_col} - {"gene"})
    mapped = cells.join(has, "dataset", "left").join(named, "gene", "left").where("has_prefix IS NULL OR symbol IS NOT NULL")
    gene = F.when(F.col("has_prefix"), F.col("symbol")).otherwise(F.col("gene"))
    return dedup_mean(mapped.withColumn("gene", gene).drop("symbol", "has_prefix"))


def unmapped_ids(expr: DataFrame, mapping: DataFrame) -> DataFrame:
    """Genes a mapping does not know."""
    genes = expr.select(F.col("gene").cast("string").alias("gene")).distinct()
    return genes.join(mapping.select(F.col("id").alias("gene")), "gene", "left_anti")


def map_probes(expr: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace each probe by its symbol; probes without one keep their ID."""
    named = mapping.select(F.col("id").alias("gene"), "symbol")
    mapped = expr.withColumn("gene", F.col("gene").cast("string")).join(named, "gene", "left")
    return dedup_mean(mapped.withColumn("gene", F.coalesce("symbol", "gene")).drop("symbol"))


def map_by_position(expr: DataFrame, mapping: DataFrame, ord_col: str = "ord",
                    fallback: str = "golub_") -> DataFrame:
    """Give the i-th gene row (by ``ord_col``) the i-th symbol of the mapping (by
    its ``ord``); rows beyond the mapping get ``fallback`` + i."""
    rows = dense_index(expr.select(ord_col).distinct(), ord_col)
    symbols = dense_index(mapping.select("ord", "symbol"), "ord").select("idx", "symbol")
    named = rows.join(symbols, "idx", "left").select(
        ord_col, F.coalesce("symbol", F.concat(F.lit(fallback), F.col("idx"))).alias("gene")
    )
    return dedup_mean(expr.drop("gene").join(named, ord_col).drop(ord_col))


def common_genes(expr: DataFrame) -> DataFrame:
    """Genes present in every data set."""
    pairs = expr.select("dataset", "gene").distinct()
    n_datasets = expr.select("dataset").distinct().agg(F.count(F.lit(1))).scalar()
    return pairs.groupBy("gene").count().filter(F.col("count") == n_datasets).select("gene")


def intersect_genes(expr: DataFrame) -> DataFrame:
    """Cells of the genes present in every data set; many cells are dealt out by cell, so
    that what a task averages of them doesn't grow with their number."""
    counts = written(expr.groupBy("dataset", "gene").agg(F.count(F.lit(1)).alias("n")), "gene-counts")
    n_datasets = counts.select("dataset").distinct().count()
    common = counts.groupBy("gene").agg(F.count(F.lit(1)).alias("in"), F.sum("n").alias("n")).filter(F.col("in") == n_datasets)
    n_cells = common.agg(F.sum("n")).first()[0] or 0
    kept = expr.join(common.select("gene"), "gene", "left_semi")
    return dealt(kept, n_cells, *_cell(kept))


def merge_diagnosis(expr: DataFrame, n_first: int = 5) -> DataFrame:
    """Gene count and first gene names of each data set."""
    from pyspark.sql import Window

    genes = expr.select("dataset", F.col("gene").cast("string").alias("gene")).distinct()
    order = Window.partitionBy("dataset").orderBy("gene")
    # A rank limit is applied before the shuffle as well, so no group is collected.
    head = genes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_first)
    names = head.groupBy("dataset").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gene"))),
                                 lambda r: r["gene"]), ",").alias("first_genes")
    )
    return genes.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_genes")).join(names, "dataset")


def duplicate_cells(expr: DataFrame) -> DataFrame:
    return expr.groupBy(*_cell(expr)).count().filter("count > 1")


def assert_unique(expr: DataFrame) -> DataFrame:
    """``expr`` itself, or an error when a data set still repeats a cell."""
    if not duplicate_cells(expr).isEmpty():
        raise ValueError("duplicate gene labels remain after deduplication")
    return expr


def align_labels(labels: DataFrame, samples: DataFrame) -> DataFrame:
    """Labels of the surviving samples, joined on (dataset, sample_id).  A data
    set in which no ID matches is aligned by position instead.

    ``labels(dataset, sample_id, y, ord)``, ``samples(dataset, sample_id, ord)``.
    """
    matched = labels.join(samples.select("dataset", "sample_id"), ["dataset", "sample_id"])
    unmatched = samples.join(matched.select("dataset").distinct(), "dataset", "left_anti")
    by_position = dense_index(labels, "ord", ["dataset"]).select("dataset", "idx", "y")
    fallback = dense_index(unmatched, "ord", ["dataset"]).join(by_position, ["dataset", "idx"])
    cols = ["dataset", "sample_id", "y"]
    return matched.select(*cols).unionByName(fallback.select(*cols))


def when_empty(value: Column, default: Column) -> Column:
    return F.when(F.size(value) > 0, value).otherwise(default)
