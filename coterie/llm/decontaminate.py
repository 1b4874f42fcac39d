"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm import words
from coterie.llm.arrow import appended, flat_text, lists_of, map_batches, steps
from coterie.session import written

#: Words of the shortest shared span, and of the grams that are winnowed.
WINDOW, GRAM = 13, 5
#: Bits of the filter that spares most fingerprints the join; its size is fixed.
FILTER_BITS = 1 << 20


class Winnow:
    """Fingerprints of texts: of every window the gram with the least hash, once for
    all neighbouring windows that have the same one.  Texts with a common window
    have a common fingerprint, and the windows behind it in common."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        data = words.lower_ascii(data)
        self.starts, self.ends, self.first = words.spans(data, offsets, words.NOT_ALNUM)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.sequence = words.Sequence(words.word_hashes(data, self.starts, self.ends))
        self.of(window)

    def of(self, window: int) -> None:
        """The windows of ``window`` words and their fingerprints."""
        gram = min(GRAM, window)
        at = np.arange(max(0, len(self.starts) - gram + 1))
        grams = self.sequence.hash(at, at + gram)
        best = words.sliding_argmin(grams, window - gram + 1)
        start = np.arange(len(best))
        inside = start + window <= self.first[1:][self.text[start]] if len(start) else np.zeros(0, bool)
        self.start, best = start[inside], best[inside]
        new = np.ones(len(best), bool)
        new[1:] = (best[1:] != best[:-1]) | (np.diff(self.start) != 1)
        self.lead = np.flatnonzero(new)
        self.count = np.diff(np.append(self.lead, len(best)))
        # A window of another length never meets this one.
        self.print = words.mix(grams[best[self.lead]] + np.uint64(window)).view(np.int64)
        self.hash = self.sequence.hash(self.start, self.start + window).view(np.int64)
        self.owner = self.text[self.start[self.lead]] if len(self.lead) else np.zeros(0, np.int64)
        self.place = self.start - self.first[:-1][self.text[self.start]] if len(self.start) else np.zeros(0, np.int64)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(fingerprint, window, hash, item_id) of every window of every item; an item of
    fewer words, but not none, is one window."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column(1))
            for lo, hi in steps(offsets):
                part, at = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                w = Winnow(part, at, window)
                sizes = np.minimum(np.diff(w.first), window)
                for size in np.unique(sizes[sizes > 0]).tolist():
                    w.of(size)
                    own = (sizes == size)[w.owner]
                    each = np.repeat(own, w.count)
                    owner = np.repeat(w.owner, w.count)[each]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(w.print, w.count)[each]), pa.array(np.full(len(owner), size), pa.int32()),
                         pa.array(w.hash[each]), batch.column(0).take(pa.array(lo + owner))],
                        names=["fingerprint", "window", "hash", "item_id"])

    items = items.select("item_id", "text")
    kind = items.schema["item_id"].dataType.simpleString()
    return items.transform(map_batches, of, f"fingerprint long, window int, hash long, item_id {kind}").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = 0.05,
                  with_hash: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids (sorted as
    strings), contaminated; ``text_hash``, if asked for, tells texts of one id apart.

    A window is ``window`` words of an item, or a whole shorter item.  A document
    word inside an occurrence of a window is hit; a document is contaminated if it
    has a hit and the hits are at least ``share`` of its words.

    Documents and items are winnowed; fingerprints meet in a join, and each hit is
    extended to the windows behind it, whose hashes confirm it.  A bitmap of fixed
    size keeps most foreign fingerprints from the join; it only spares work.  Spark
    broadcasts the items' fingerprints if they are small and shuffles them otherwise.

    Null or empty texts have no words and are clean; an item without an id can hit but
    is not listed.  Repeated rows each get a row; nothing else of ``docs`` is read.
    """
    known = written(item_windows(items, window), "item-windows")
    prints = written(known.select("fingerprint").distinct(), "item-fingerprints")
    bits = prints.select(F.expr(f"fingerprint & {FILTER_BITS - 1}").alias("bit")).distinct()
    bitmap = np.zeros(FILTER_BITS, bool)  # at most FILTER_BITS small numbers, whatever the input
    bitmap[[r.bit for r in bits.collect()]] = True
    sizes = sorted(r.window for r in known.select("window").distinct().collect())  # at most ``window`` numbers

    marks = docs.select("doc_id", "text").transform(map_batches,
        _Marks(np.packbits(bitmap), sizes, window),
        "doc_id long, text_hash long, n_words long, fingerprint long, window int, place int, hashes array<long>")
    prints = prints.withColumn("known", F.lit(True))
    found = marks.join(prints, "fingerprint", "left").where("known OR n_words IS NOT NULL")
    # From here on there is one row per document and per fingerprint that occurs.
    found = written(found.drop("known"), "contamination")
    hits = found.where("n_words IS NULL").select("doc_id", "text_hash", "fingerprint", "window", F.posexplode("hashes").alias(
        "at", "hash"), "place").withColumn("place", F.expr("place + at"))
    hits = hits.join(known, ["fingerprint", "window", "hash"]).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("place", "window")).alias("hits"), F.collect_set("item_id").alias("items"))
    hits = hits.select("doc_id", "text_hash", "items", F.aggregate(
        F.array_sort("hits"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda acc, h: F.struct(
            F.greatest(acc["end"], h["place"] + h["window"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), h["place"] + h["window"] - F.greatest(acc["end"], h["place"]))).alias("n")),
        lambda acc: acc["n"]).alias("n_hit"))
    every = found.where("n_words IS NOT NULL").select("doc_id", "text_hash", "n_words")
    both = every.alias("d").join(hits.alias("h"), F.expr("d.doc_id <=> h.doc_id AND d.text_hash = h.text_hash"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.array_sort(F.transform(F.coalesce("items", F.array()), lambda x: x.cast("string")))
    return both.select(
        "d.doc_id", *["d.text_hash"] * with_hash, "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
        ((n_hit > 0) & (n_hit >= F.lit(share).cast("decimal(10,6)") * F.col("n_words"))).alias("contaminated"))


def uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated.  Rows with one id and one text are
    judged as one; a document without an id stays if its text is clean."""
    found = contamination(docs, items, with_hash=True).where("contaminated").select("doc_id", "text_hash").distinct()
    found = written(found, "contaminated")  # known size: Spark broadcasts it if it is small
    marked = appended(docs, "text_hash long", _hashes)
    return marked.alias("d").join(found.alias("f"), F.expr("d.text_hash = f.text_hash AND d.doc_id <=> f.doc_id"),
                                  "left_anti").select(docs.columns)


def text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return words.text_hashes(data, offsets).view(np.int64)


def _hashes(batch: pa.RecordBatch) -> dict:
    data, offsets = flat_text(batch.column(batch.schema.get_field_index("text")))
    parts = [text_hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]) for lo, hi in steps(offsets)]
    return {"text_hash": pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))}


class _Marks:
    """Per document a row with n_words, under a fingerprint of its own, and a row for
    each of its fingerprints that passes the bitmap."""

    def __init__(self, packed, sizes, window):
        self.packed, self.sizes, self.window = packed, sizes, window

    def __call__(self, batches):
        bitmap = np.unpackbits(self.packed).astype(bool)
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()),
                            ("fingerprint", pa.int64()), ("window", pa.int32()), ("place", pa.int32()),
                            ("hashes", pa.list_(pa.int64()))])
        for batch in batches:
            data, offsets = flat_text(batch.column(1))
            ids = batch.column(0).cast(pa.int64())
            for lo, hi in steps(offsets):
                part, at = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                w = Winnow(part, at, self.window)
                whole = text_hashes(part, at)
                n = hi - lo
                nothing = pa.nulls(n, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), pa.array(whole), pa.array(np.diff(w.first)), pa.array(whole), nothing, nothing,
                     pa.nulls(n, pa.list_(pa.int64()))], schema=schema)
                for size in self.sizes:
                    w.of(size)
                    own = bitmap[w.print & (FILTER_BITS - 1)]
                    if not own.any():
                        continue
                    owner, lead, count = w.owner[own], w.lead[own], w.count[own]
                    hashes = w.hash[np.repeat(own, w.count)]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(lo + owner)), pa.array(whole[owner]), pa.nulls(len(owner), pa.int64()),
                         pa.array(w.print[own]), pa.array(np.full(len(owner), size), pa.int32()),
                         pa.array(w.place[lead], pa.int32()), lists_of(pa.array(hashes), count)], schema=schema)
