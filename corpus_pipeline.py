"""A corpus pipeline: filter, deduplicate, decontaminate and tokenise ``documents``.

Each stage takes what its predecessor kept, as a DataFrame with the columns of
``documents``, and returns the same columns; the last returns tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.llm import bpe, decontaminate, quality, simhash, substrings
from coterie.llm.queries import PATTERN, RANKS
from coterie.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more.  It learns from the
    labels of the documents at hand; without any, all stay."""
    docs = docs.select(COLUMNS)
    field = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, field).where("score >= 0.5").select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id."""
    return simhash.one_of_each_group(docs.select(COLUMNS))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated passages.  A text that loses nothing stays as
    it is; another becomes its kept words, joined by one space, and ``n_chars`` follows.
    A document that loses all its words stays, with an empty text."""
    out = substrings.remove_duplicate_spans(docs.select(COLUMNS))
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept")).otherwise(F.col("text"))
    n_chars = F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages worth naming (see ``contamination``)."""
    return decontaminate.uncontaminated(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (``ids``, little-endian unsigned 32-bit numbers), their number, and the
    digests of the ids and of the decoded bytes."""
    encoded = bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), RANKS, PATTERN)
    decoded = bpe.decode_ids(encoded, RANKS, PATTERN)
    return decoded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", keep_good), ("simhash near-dedup", keep_one_of_near_copies),
          ("substring dedup", cut_repeated_passages), ("benchmark decontamination", drop_contaminated),
          ("byte-level bpe", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The classifier and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
