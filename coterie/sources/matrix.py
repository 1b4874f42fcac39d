"""Measurement matrices: delimited files and labelled tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.functions.columns import not_nan, number_or_null
from coterie.operators.features import drop_null_columns, select_numeric
from coterie.operators.ids import dedup_mean

# The layouts tried, in order, as (comment character, separator).
LAYOUTS = (("!", "\t"), ("!", ","), (None, "\t"), (None, ","))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _cells(df: DataFrame, id_col: str, names: Sequence[str], *keep: str) -> DataFrame:
    """(gene, pos, value) of a wide text table; the plan does not grow with the
    number of columns."""
    texts = F.array(*[F.col(_quoted(c)).cast("string") for c in names])
    return df.select(F.col(_quoted(id_col)).alias("gene"), *keep, F.posexplode(texts).alias("pos", "text")).select(
        "gene", *keep, "pos", number_or_null(F.col("text")).alias("value"))


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text columns to double, NULL where the text is no number."""
    return df.withColumns({c: number_or_null(F.col(_quoted(c))) for c in cols})


def keep_mostly_numeric(df: DataFrame, cols: Sequence[str], min_frac: float = 0.5) -> DataFrame:
    """Coerce ``cols`` and keep those with more than ``min_frac`` numbers."""
    parsed = coerce_numeric(df, cols)
    row = parsed.agg(*[F.avg(F.col(_quoted(c)).isNotNull().cast("int")).alias(c) for c in cols]).first()
    return parsed.drop(*[c for c in cols if not (row[c] or 0) > min_frac])


def numeric_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of parseable numbers of each column, and how many of its texts are there
    but are no numbers, as (column, share, n_texts)."""
    kv = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), number_or_null(F.col(_quoted(c))).alias("value"),
                 F.col(_quoted(c)).cast("string").alias("text")) for c in cols]))
    cells = df.select(kv.alias("kv")).select("kv.*")
    missing = F.trim(F.coalesce("text", F.lit(""))).isin("", "NaN")
    return cells.groupBy("column").agg(F.avg(F.col("value").isNotNull().cast("int")).alias("share"),
                                       F.count_if(F.col("value").isNull() & ~missing).alias("n_texts"))


def read_matrix(spark: SparkSession, path: str, id_col: str | None = None,
                min_rows: int = 10, min_cols: int = 1, with_order: bool = False,
                max_columns: int = 200_000) -> DataFrame | None:
    """A gene x sample text matrix (plain or gzip) as (sample_id, gene, value).

    The layouts are tried in turn and the first that gives more than ``min_rows``
    rows and at least ``min_cols`` mostly numeric columns wins; the first column
    holds the gene unless ``id_col`` names another.  Duplicate genes are averaged.
    ``None`` when no layout fits.  A comment is a line starting with ``!``.
    ``with_order`` adds ``ord``, by which the genes sort as their rows in the file.
    A file of more than ``max_columns`` columns is an error.
    """
    for comment, sep in LAYOUTS:
        reader = spark.read.option("header", True).option("sep", sep).option("maxColumns", max_columns)
        df = (reader.option("comment", comment) if comment else reader).csv(path)
        key = id_col or (df.columns[0] if df.columns else None)
        names = [c for c in df.columns if c != key]
        if key not in df.columns or not names:
            continue
        if with_order:
            place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
            cells = _cells(df.select("*", place.alias("__ord")), key, names, "__ord")
        else:
            cells = _cells(df, key, names)
        shares = cells.groupBy("pos").agg(
            F.count(F.lit(1)).alias("n"), F.count("value").alias("present")).collect()
        kept = [r.pos for r in shares if r.present / r.n > 0.5]
        n_rows = shares[0].n if shares else 0
        if len(kept) >= min_cols and n_rows > min_rows:
            sample = F.element_at(F.lit(names), F.col("pos") + 1)
            good = cells if len(kept) == len(names) else cells.filter(F.col("pos").isin(kept))
            if with_order:
                return good.groupBy(sample.alias("sample_id"), "gene").agg(
                    F.avg("value").alias("value"), F.min("__ord").alias("ord"))
            return dedup_mean(good.select(sample.alias("sample_id"), "gene", "value"))
    return None


def matrix_shape(expr: DataFrame, min_rows: int = 10, min_cols: int = 1) -> DataFrame:
    """Distinct genes and samples and whether the matrix is large enough."""
    sizes = expr.agg(F.count_distinct("gene").alias("n_genes"),
                     F.count_distinct("sample_id").alias("n_samples"))
    return sizes.withColumn(
        "accepted", (F.col("n_genes") > min_rows) & (F.col("n_samples") >= min_cols))


def accept_matrix(expr: DataFrame, min_rows: int = 10, min_cols: int = 1) -> bool:
    return bool(matrix_shape(expr, min_rows, min_cols).first().accepted)


def first_acceptable(spark: SparkSession, paths: Sequence[str], min_rows: int = 10,
                     min_cols: int = 2) -> DataFrame:
    """The first of the ranked candidate files that parses to a large enough matrix."""
    for path in paths:
        expr = read_matrix(spark, path)
        if expr is not None and accept_matrix(expr, min_rows, min_cols):
            return expr
    raise ValueError(f"no parseable matrix file; tried {list(paths)}")


def load_labelled_matrix(df: DataFrame, sample_id: str, label: str, drop_null: str = "any") -> DataFrame:
    """A wide table, one row per sample, as (sample_id, gene, value, y): numeric
    columns only, columns with any (or all) missing values dropped."""
    numeric = select_numeric(df, keep=(sample_id, label))
    numeric = drop_null_columns(numeric, drop_null, keep=(sample_id, label))
    genes = [c for c in numeric.columns if c not in (sample_id, label)]
    values = F.array(*[F.col(_quoted(c)).cast("double") for c in genes])
    rows = numeric.select(F.col(sample_id).alias("sample_id"), F.col(label).alias("y"),
                          F.posexplode(values).alias("pos", "value"))
    return rows.select("sample_id", F.element_at(F.lit(genes), F.col("pos") + 1).alias("gene"),
                       not_nan(F.col("value")).alias("value"), "y")


def orient(cells: DataFrame, row: str, col: str, value: str = "value") -> DataFrame:
    """(row, col, value) cells with the roles decided by shape: the longer axis
    holds the genes.  A transpose in the long layout is only a renaming."""
    n_row, n_col = cells.agg(F.count_distinct(row), F.count_distinct(col)).first()
    sample, gene = (col, row) if n_row > n_col else (row, col)
    return cells.select(F.col(sample).alias("sample_id"), F.col(gene).alias("gene"),
                        F.col(value).alias("value"))
