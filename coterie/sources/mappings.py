"""Identifier mappings: gene-info text and platform annotation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.operators.ids import last_per_key

# Words that mark the symbol column of an annotation table (the
# short list for the positional map, the long one for probe mapping) and the
# symbols that mean "none".
SYMBOL_WORDS = ("gene_symbol", "symbol", "gene_name")
SYMBOL_WORDS_WIDE = ("gene_symbol", "symbol", "gene_name", "gene_assignment", "official_symbol")
NO_SYMBOL = ("", "---", "nan")
XREF_PREFIX = "Ensembl:"


def _stripped(col: Column) -> Column:
    return F.regexp_replace(col.cast("string"), r"^\s+|\s+$", "")


def read_gene_info(spark: SparkSession, path: str) -> DataFrame:
    """mapping(id, symbol) of a tab-separated gene-info text: symbol in field 3,
    ``|``-separated cross references in field 6; later lines overwrite."""
    lines = spark.read.text(path).select(
        "value",
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                 F.monotonically_increasing_id().alias("line")).alias("ord"))
    fields = lines.filter(~F.col("value").startswith("#")).select(
        F.split("value", "\t").alias("f"), "ord").filter(F.size("f") >= 6)
    refs = fields.select(
        F.col("f")[2].alias("symbol"), F.posexplode(F.split(F.col("f")[5], r"\|")).alias("pos", "xref"), "ord")
    ids = refs.filter(F.col("xref").startswith(XREF_PREFIX)).select(
        F.split_part("xref", F.lit(":"), F.lit(2)).alias("id"), "symbol",
        F.struct("ord", "pos").alias("ord"))
    return last_per_key(ids, "id", "symbol", "ord")


def symbol_column(annotation: DataFrame, words: Sequence[str] = SYMBOL_WORDS_WIDE) -> str | None:
    return next((c for c in annotation.columns if any(w in c.lower() for w in words)), None)


def read_probe_map(annotation: DataFrame, ord_col: str = "ord",
                   words: Sequence[str] = SYMBOL_WORDS_WIDE) -> DataFrame | None:
    """mapping(id, symbol, ord) of a platform annotation table whose first column
    is the probe ID.  The symbol is the text before the first ``//``; ``ord`` is
    where a probe first appears, its symbol the last one given.  ``None`` when no
    column looks like symbols."""
    sym = symbol_column(annotation, words)
    if sym is None:
        return None
    rows = annotation.select(
        _stripped(F.col(annotation.columns[0])).alias("id"),
        _stripped(F.split_part(F.col(sym).cast("string"), F.lit("//"), F.lit(1))).alias("symbol"),
        F.col(ord_col).alias("ord"))
    named = rows.filter(~F.lower("symbol").isin(*NO_SYMBOL))
    return named.groupBy("id").agg(F.max_by("symbol", "ord").alias("symbol"), F.min("ord").alias("ord"))
