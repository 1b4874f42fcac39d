"""Sample labels: text from metadata, integer codes, offsets, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.columns import dense_index


def sample_label_text(meta: DataFrame) -> DataFrame:
    """First non-empty of characteristics, source name and title, joined by ``|``
    and lowercased; ``unknown`` when there is none."""

    def filled(name):
        return F.when(F.size(name) > 0, F.col(name))

    chosen = F.coalesce(
        filled("characteristics"), filled("source_name"), filled("title"),
        F.array(F.lit("unknown")),
    )
    keep = [c for c in meta.columns if c not in ("characteristics", "source_name", "title")]
    return meta.select(*keep, F.lower(F.array_join(chosen, "|")).alias("label"))


def label_text_for(samples: DataFrame, meta: DataFrame) -> DataFrame:
    """Label text of every sample; samples without metadata are ``unknown``."""
    text = sample_label_text(meta).select("sample_id", "label")
    return samples.join(text, "sample_id", "left").fillna("unknown", ["label"])


def encode_labels(labels: DataFrame) -> DataFrame:
    """0-based code per (dataset, label) by first appearance (smallest ``ord``)."""
    first = labels.groupBy("dataset", "label").agg(F.min("ord").alias("first_ord"))
    codes = dense_index(first, "first_ord", ["dataset"], name="y")
    codes = codes.select("dataset", "label", F.col("y").cast("int").alias("y"))
    return labels.join(codes, ["dataset", "label"])


def offset_labels(labels: DataFrame, dataset_ord: str = "dataset") -> DataFrame:
    """Shift each data set's codes past those of all earlier data sets."""
    tops = labels.groupBy(*{"dataset", dataset_ord}).agg((F.max("y") + 1).alias("n_codes"))
    # One row per data set reaches this window, whatever the number of samples.
    earlier = Window.orderBy(dataset_ord).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.select(
        "dataset", F.coalesce(F.sum("n_codes").over(earlier), F.lit(0)).cast("int").alias("offset")
    )
    return labels.join(offsets, "dataset").withColumn("y", F.col("y") + F.col("offset")).drop("offset")


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("y").agg(F.count(F.lit(1)).alias("n_samples"))


def canonical(labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Renumber clusters by their smallest ``sample_id`` (numbers are arbitrary)."""
    firsts = labels.groupBy(*keys, "cluster").agg(F.min("sample_id").alias("_first"))
    order = Window.partitionBy(*keys).orderBy("_first")
    codes = firsts.select(
        *keys, "cluster", (F.row_number().over(order) - 1).cast("int").alias("_code")
    )
    return (
        labels.join(codes, [*keys, "cluster"])
        .withColumn("cluster", F.col("_code")).drop("_code")
    )


def defuzzify(memberships: DataFrame) -> DataFrame:
    """Cluster of the largest membership; the lowest index wins a tie."""
    best = (F.array_position("u", F.array_max("u")) - 1).cast("int")
    return memberships.select("sample_id", best.alias("cluster"))
