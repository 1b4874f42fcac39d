"""Toxicity by boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm import words
from coterie.llm.arrow import appended, flat_text, lists_of, map_batches, steps
from coterie.llm.samples import fold, training_rows
from coterie.session import written

#: Labelled rows that the lexicon, and that the trees and the calibration, learn from
#: at most; they come from different folds.
LEXICON_ROWS, TREE_ROWS = 20_000, 20_000
#: Terms of the lexicon at most, in how many toxic documents each must be, and its
#: least log odds.
LEXICON_TERMS, LEAST_DOCUMENTS, LEAST_ODDS = 1000, 3, 2.0
#: Bytes of the word beginnings that are terms, beside whole words.
PREFIXES = (4, 5, 6, 7, 8)
TREES, DEPTH = 10, 4

#: Pronouns and possessives of the second person in en, de, fr, es.
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine euch euer ihr vous votre vos toi ton ta tes tu "
                 "te ti usted ustedes vosotros tuyo tus").split()
_SYMBOL = words.byte_set((33, 33), (35, 38), (42, 43), (45, 46), (64, 64), (95, 95))
_UPPER = words.byte_set((65, 90))
_LETTER = words.byte_set((65, 90), (97, 122), (128, 255))
_SHOUT = words.byte_set((33, 33), (63, 63))
_PUNCT = words.byte_set((33, 47), (58, 64), (91, 96), (123, 126))
N_FEATURES = 18


@dataclass
class Lexicon:
    """Sorted term hashes and their log odds."""

    terms: np.ndarray
    odds: np.ndarray


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    constant: float = 0.0


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte Latin-1 capitals lower-cased."""
    out = words.lower_ascii(data)
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    capital = second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[capital] += 0x20
    return out


def _terms(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """words x (1 + prefixes) hashes; zero where a word is no longer than the prefix."""
    text = words.Sequence(words._BYTE[low], words._P)
    columns = [text.hash(starts, ends)]
    for n in PREFIXES:
        h = words.mix(text.hash(starts, np.minimum(starts + n, ends)) + np.uint64(n))
        columns.append(np.where(ends - starts > n, h, np.uint64(0)))
    return np.column_stack(columns).view(np.int64)


_YOU = None


def _second_person() -> np.ndarray:
    global _YOU
    if _YOU is None:
        data, offsets = flat_text(pa.array(SECOND_PERSON))
        _YOU = np.sort(_terms(data, offsets[:-1], offsets[1:])[:, 0])
    return _YOU


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms (whole words and word beginnings) of (text, label) rows that are far more
    frequent in documents with label 1.  Tasks count the documents of each class that
    hold a term; Spark adds the counts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column(0))
            label = batch.column(1).to_numpy()
            for lo, hi in steps(offsets):
                low = _lower(data[offsets[lo]:offsets[hi]])
                starts, ends, first = words.spans(low, offsets[lo:hi + 1] - offsets[lo], words.NOT_ALNUM)
                if not len(starts):
                    continue
                terms = _terms(low, starts, ends)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                each = np.unique(np.column_stack([np.repeat(doc, terms.shape[1]), terms.ravel()]), axis=0)
                each = each[each[:, 1] != 0]
                found, back = np.unique(each[:, 1], return_inverse=True)
                toxic = label[lo + each[:, 0]] == 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.bincount(back, toxic).astype(np.int64)),
                     pa.array(np.bincount(back, ~toxic).astype(np.int64))], names=["term", "toxic", "clean"])

    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    odds = F.log((F.col("toxic") + 0.5) / (sizes.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (sizes.get(0, 0) + 1))
    terms = sample.select("text", "label").transform(map_batches, count, "term long, toxic long, clean long")
    terms = terms.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(
        F.col("toxic") >= LEAST_DOCUMENTS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    rows = terms.orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "term").limit(LEXICON_TERMS).collect()
    rows.sort(key=lambda r: r.term)
    return Lexicon(np.array([r.term for r in rows], np.int64), np.array([r.odds for r in rows]))


def document_features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """texts x features: lexicon counts and densities, nearness of the second person,
    and rates of capitals, punctuation and obfuscation."""
    n = len(offsets) - 1
    low = _lower(data)
    starts, ends, first = words.spans(low, offsets, words.NOT_ALNUM)
    counts = np.diff(first)
    doc = np.repeat(np.arange(n), counts)
    terms = _terms(low, starts, ends) if len(starts) else np.zeros((0, 1 + len(PREFIXES)), np.int64)
    odds = np.zeros(len(starts))
    if len(lexicon.terms) and len(starts):
        at = np.minimum(np.searchsorted(lexicon.terms, terms), len(lexicon.terms) - 1)
        odds = np.where(lexicon.terms[at] == terms, lexicon.odds[at], 0.0).max(1)
    total = lambda values: np.bincount(doc, values, n)
    hit, strong = odds > 0, odds >= 3.5
    you = np.isin(terms[:, 0], _second_person()) if len(starts) else np.zeros(0, bool)
    # Words from each hit to the nearest second person of the same text.
    where = np.flatnonzero(you)
    gap = np.full(len(starts), 1e9)
    if len(where):
        k = np.searchsorted(where, np.arange(len(starts)))
        for near in (np.maximum(k - 1, 0), np.minimum(k, len(where) - 1)):
            same = doc[where[near]] == doc
            gap = np.minimum(gap, np.where(same, np.abs(where[near] - np.arange(len(starts))), 1e9))
    best = np.zeros(n)
    np.maximum.at(best, doc, odds)
    kinds = np.zeros(n)
    hits = np.flatnonzero(hit)
    if len(hits):
        kinds = np.bincount(np.unique(np.column_stack([doc[hits], terms[hits, 0]]), axis=0)[:, 0], minlength=n)
    some = np.maximum(counts, 1)
    size = np.maximum(np.diff(offsets), 1)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    inner = np.zeros(len(data), bool)
    if len(data) > 2:
        letter = _LETTER[data] | words.byte_set((48, 57))[data]
        inner[1:-1] = _SYMBOL[data[1:-1]] & letter[:-2] & letter[2:]
    letters = np.maximum(sums(_LETTER[data]), 1)
    n_hit, n_strong = total(hit), total(strong)
    return np.column_stack([
        np.log1p(n_hit), n_hit / some, np.log1p(n_strong), n_strong / some, total(odds), total(odds) / some, best, kinds,
        n_strong / np.sqrt(some), total(hit * np.exp(-gap / 5)), total(you) / some, sums(_UPPER[data]) / letters,
        sums(_SHOUT[data]) / some, sums(_PUNCT[data]) / size, sums(inner) / some, np.log1p(sums(inner)), np.log1p(counts),
        total((ends - starts).astype(float)) / some])


def with_features(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with ``features``."""
    def of(batch: pa.RecordBatch) -> dict:
        data, offsets = flat_text(batch.column(batch.schema.get_field_index(text)))
        parts = [document_features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], lexicon)
                 for lo, hi in steps(offsets)]
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
        return {"features": lists_of(pa.array(flat), np.full(len(batch), N_FEATURES))}

    out = appended(docs, "features array<double>", of, (text,))
    return out.withColumn("features", array_to_vector("features"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicityModel:
    """Learn from labelled rows outside the held-out fold: the lexicon from fold 0, the
    trees from fold 2, the calibration from the scores of either half of fold 2 by trees
    of the other half.  Without rows of both classes every score is the share of label
    1 there, or 0; without both in each half, scores are not calibrated."""
    words_from = written(training_rows(docs, labels, label, LEXICON_ROWS, fold() == 0), "toxic-words")
    lexicon = learn_lexicon(words_from)
    sample = training_rows(docs, labels, label, TREE_ROWS, fold() == 2)
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    rows = with_features(sample.withColumn("half", half), lexicon).withColumn("label", F.col("label").cast("double"))
    rows = written(rows.coalesce(4), "toxic-rows")  # at most TREE_ROWS short rows
    share = {(r.half, r.label): r.n for r in rows.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n = sum(x for (_, y), x in share.items() if y == 1), sum(share.values())
    if n_toxic in (0, n):
        return ToxicityModel(lexicon, None, None, n_toxic / max(1, n))
    grower = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.4, seed=5)
    curve = None
    if len(share) == 4:  # each half has both classes, so each is scored by the other's trees
        unseen = [grower.fit(rows.where(F.col("half") != k)).transform(rows.where(F.col("half") == k)) for k in (0, 1)]
        raw = unseen[0].unionByName(unseen[1]).select("label", vector_to_array("probability")[1].alias("raw"))
        curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw)
    return ToxicityModel(lexicon, grower.fit(rows), curve)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with ``score``, 0 to 1, higher if more likely toxic.
    A null or empty text has all features zero and is scored like any other.  Columns
    named ``score``, ``raw`` or ``features``, or like outputs of a classifier, are
    replaced."""
    docs = docs.drop("score", "raw", "rawPrediction", "probability", "prediction")
    rows = with_features(docs, model.lexicon, text)
    if model.trees is None:
        return rows.drop("features").withColumn("score", F.lit(float(model.constant)))
    rows = model.trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])
    if model.curve is None:
        return rows.withColumnRenamed("raw", "score").drop("features", "rawPrediction", "probability", "prediction")
    rows = model.curve.transform(rows).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))
    return rows.drop("features", "rawPrediction", "probability", "prediction", "raw")
