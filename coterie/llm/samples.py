"""Which labelled rows a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; rows of fold 1 are held out.  A null id counts
    as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, fold_is: Column | None = None,
                  one_each: bool = False) -> DataFrame:
    """(text, label) of at most ``most`` labelled rows that are not held out: those with
    the least hash of the id.  Labels other than 0 and 1 are ignored, as is an id that
    has both.

    Ids are chosen before any text moves, so only the chosen texts are joined.  Every row
    of a chosen id is taken, or with ``one_each`` the one with the least text; then the
    rows are no more than ``most`` and have doc_id too."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
    known = known.where((fold() != 1) if fold_is is None else fold_is)
    ids = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id", "label")), "doc_id").withColumn(
        "text", F.coalesce("text", F.lit("")))
    if one_each:
        return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return rows.select("text", "label")
