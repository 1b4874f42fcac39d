"""Loaders of one data set: a series of sample tables with files to fall back on, and a
labelled matrix whose genes are known by position."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.operators.ids import convert_prefixed_ids, dedup_mean, map_by_position, map_probes
from coterie.operators.labels import encode_labels, label_text_for
from coterie.session import written
from coterie.sources.catalog import rank_candidate_files
from coterie.sources.mappings import read_probe_map
from coterie.sources.matrix import accept_matrix, orient, read_matrix
from coterie.sources.series import detect_columns, pivot_samples, require_rows

TRACE = "ord int, source string, name string, used boolean, outcome string"


@dataclass
class Series:
    """What there is of a series.

    ``tables``: tables of one layout each, with ``sample_id`` and the columns of the
    sample tables (and ``ord``, the place of a row, if it is known); ``catalog(url,
    source, ord)``, candidate files; ``meta(sample_id, characteristics, source_name,
    title)``; ``annotation``, the platform's table with ``ord``, or None; ``landed``,
    where the file of a URL was put, or None if it wasn't.
    """

    accession: str
    tables: Sequence[DataFrame]
    catalog: DataFrame
    meta: DataFrame
    annotation: DataFrame | None = None
    landed: Callable[[str], str | None] = lambda url: url


def _from_tables(series: Series) -> tuple[DataFrame, str]:
    """Cells (sample_id, gene, value, ord) of the sample tables, and where they stood."""
    for at, table in enumerate(series.tables):
        found = detect_columns(table.drop("sample_id", "ord"))
        if found is None:
            continue
        cells = pivot_samples(table, *found)
        if "ord" in table.columns:
            place = table.groupBy(F.col(found[0]).cast("string").alias("gene")).agg(F.min("ord").alias("ord"))
        else:
            place = cells.select("gene").distinct().withColumn("ord", F.col("gene"))
        cells = written(cells.join(place, "gene"), "sample-tables")
        return require_rows(cells, series.accession), f"table {at}: {found[0]}, {found[1]}"
    raise ValueError("no table with an identifier and a value column")


def _from_files(spark: SparkSession, series: Series, trace: list[tuple], min_rows: int, min_cols: int) -> DataFrame | None:
    """Cells of the first candidate file, in order of preference, that is a large enough
    matrix; every try is noted, and an error in a file is its own.  A series has few
    files, and their names are all that the driver gets."""
    for row in rank_candidate_files(series.catalog).select("url").collect():
        used, outcome = False, "no usable matrix"
        try:
            path = series.landed(row.url)
            if path is None:
                outcome = "not there"
            else:
                cells = read_matrix(spark, path, min_rows=min_rows, min_cols=min_cols, with_order=True)
                if cells is not None:
                    cells = written(cells, "matrix-file")
                    used = accept_matrix(cells, min_rows, min_cols)
                    outcome = "matrix" if used else "too small"
        except Exception as error:  # a bad file must not stop the next
            outcome = type(error).__name__
        trace.append((len(trace), "file", row.url, used, outcome))
        if used:
            return cells
    return None


def load_series(spark: SparkSession, series: Series, gene_info: DataFrame | None = None, min_rows: int = 10,
                min_cols: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(expr, labels, trace) of a series.

    ``expr(sample_id, gene, value)`` comes from the sample tables if one has a value
    column, else from the first candidate file that fits, in the order in which
    ``rank_candidate_files`` puts them.  Ensembl IDs become symbols by ``gene_info(id,
    symbol)`` if the first gene is one, probes by the platform's annotation; genes that
    meet are averaged.  ``labels(sample_id, label, y, ord)`` are the samples' label texts,
    numbered in the order of the samples' IDs; samples without metadata are ``unknown``.
    ``trace(ord, source, name, used, outcome)`` has a row for each source that was tried.
    If none serves, the error names them all.
    """
    trace: list[tuple] = []
    try:
        cells, name = _from_tables(series)
        trace.append((0, "tables", name, True, "matrix"))
    except Exception as error:
        trace.append((0, "tables", series.accession, False, str(error).split("\n")[0]))
        cells = _from_files(spark, series, trace, min_rows, min_cols)
    if cells is None:
        raise ValueError(f"{series.accession}: no source has a usable matrix; tried {[(t[2], t[4]) for t in trace]}")
    if gene_info is not None:
        cells = convert_prefixed_ids(cells.withColumn("dataset", F.lit(series.accession)), gene_info, "ord").drop("dataset")
    cells = cells.drop("ord")
    probes = None if series.annotation is None else read_probe_map(series.annotation)
    cells = dedup_mean(cells) if probes is None else map_probes(cells, probes.select("id", "symbol"))
    expr = written(cells.select("sample_id", "gene", "value"), "series")
    # A sort by ranges numbers the samples in order, with gaps.
    samples = expr.select("sample_id").distinct().orderBy("sample_id").withColumn("ord", F.monotonically_increasing_id())
    samples = written(samples, "series-samples")
    text = label_text_for(samples, series.meta).select(F.lit(series.accession).alias("dataset"), "sample_id", "label", "ord")
    labels = encode_labels(text).select("sample_id", "label", "y", "ord")
    return expr, labels, spark.createDataFrame(trace, TRACE)


def load_labelled(cells: DataFrame, labels: DataFrame, symbols: DataFrame | None = None,
                  fallback: str = "gene_") -> tuple[DataFrame, DataFrame]:
    """(expr, y) of a matrix known only by its rows and columns.

    ``cells(row, row_ord, col, col_ord, value)``: columns without any value are dropped,
    the longer side holds the genes, and the i-th gene takes the i-th symbol of
    ``symbols(symbol, ord)``, or ``fallback`` and its number where these end; genes that
    meet are averaged.  ``labels(sample_id, label, ord)`` get numbers by first appearance.
    """
    full = cells.groupBy("col").agg(F.count("value").alias("n")).where("n > 0").select("col")
    sides = cells.join(full, "col", "left_semi").select(
        F.struct("row_ord", "row").alias("row"), F.struct("col_ord", "col").alias("col"), "value")
    turned = orient(sides, "row", "col")
    ord_of = lambda side: F.col(side)[turned.schema[side].dataType[0].name]
    name_of = lambda side: F.col(side)[turned.schema[side].dataType[1].name]
    named = turned.select(name_of("sample_id").alias("sample_id"), ord_of("gene").alias("ord"), F.lit("").alias("gene"), "value")
    if symbols is None:
        symbols = cells.sparkSession.createDataFrame([], "symbol string, ord int")
    expr = map_by_position(written(named, "labelled-cells"), symbols, fallback=fallback)
    texts = labels.select(F.lit("").alias("dataset"), "sample_id", F.col("label").cast("string").alias("label"), "ord")
    y = encode_labels(texts).join(expr.select("sample_id").distinct(), "sample_id", "left_semi")
    return expr.select("sample_id", "gene", "value"), y.select("sample_id", "y")
