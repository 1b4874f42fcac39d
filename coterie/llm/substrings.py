"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

Every document is a reference to those behind it.  Its text is cut into blocks at places
that only the words around them decide, and the blocks are indexed by anchor and content.
A document is parsed from left to right: from the first block that stands in a reference,
the factor grows over block after block while these follow one another in the same
reference too.  Where the parse leaves a reference inside a block that shares its anchor
with others, the windows there are looked up one by one, so that no copy is missed at the
boundaries of factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm import words
from coterie.llm.arrow import appended, flat_text, lists_of, map_batches, steps
from coterie.session import written

#: Words of the shortest duplicate span, and of the anchors that index it.
WINDOW, ANCHOR = 20, 6


class Parse:
    """The reference blocks of some texts.

    A window's anchor is the first of its k-word sequences with the least hash, so
    equal windows have equal anchors at equal places.  The windows of one anchor are
    neighbours: their words together are a block, the unit that is indexed and that
    documents are factored into.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
        self.starts, self.ends, self.first = words.spans(data, offsets, words.WHITE)
        n = len(self.starts)
        self.window = window
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.sequence = words.Sequence(words.word_hashes(data, self.starts, self.ends))
        at = np.arange(max(0, n - anchor + 1))
        grams = self.sequence.hash(at, at + anchor)
        best = words.sliding_argmin(grams, window - anchor + 1)
        start = np.arange(len(best))
        inside = start + window <= self.first[1:][self.text[start]] if len(start) else np.zeros(0, bool)
        self.window_start = start[inside]
        best = best[inside]
        new = np.ones(len(best), bool)
        new[1:] = (best[1:] != best[:-1]) | (np.diff(self.window_start) != 1)
        lead = np.flatnonzero(new)
        self.block_of_window = np.cumsum(new) - 1
        #: Per block: text, first window (flat word number), windows, hashes of anchor and content.
        self.windows = np.diff(np.append(lead, len(best)))
        self.block_start = self.window_start[lead]
        self.block_text = self.text[self.block_start] if len(lead) else np.zeros(0, np.int64)
        self.anchor = grams[best[lead]].view(np.int64) if len(lead) else np.zeros(0, np.int64)
        self.content = self.sequence.hash(self.block_start, self.block_start + self.windows - 1 + window).view(np.int64)
        #: The block's first word in its own text.
        self.place = self.block_start - self.first[:-1][self.block_text]

    def own_origin(self) -> np.ndarray:
        """Per block the first one of its text with the same words, or -1."""
        order = np.lexsort((self.block_start, self.anchor, self.content, self.block_text))
        new = np.ones(len(order), bool)
        a, b = order[:-1], order[1:]
        new[1:] = (self.block_text[a] != self.block_text[b]) | (self.content[a] != self.content[b]) | (
            self.anchor[a] != self.anchor[b])
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
        out = np.full(len(order), -1)
        out[order[~new]] = first[~new]
        return out

    def window_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.sequence.hash(at, at + self.window)
        half = self.sequence.hash(at, at + self.window // 2)
        return h.view(np.int64), half.view(np.int64)


def reference_blocks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every block of every document: anchor, content (hashes), doc_id, place (its
    first word).  Blocks that a document repeats are listed once."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in steps(offsets):
                parse = Parse(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], window)
                own = np.flatnonzero(parse.own_origin() < 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parse.anchor[own]), pa.array(parse.content[own]),
                     pa.array(ids[lo + parse.block_text[own]], pa.int64()), pa.array(parse.place[own], pa.int32())],
                    names=["anchor", "content", "doc_id", "place"])

    return docs.select("doc_id", "text").transform(map_batches, of, "anchor long, content long, doc_id long, place int")


def remove_duplicate_spans(docs: DataFrame, window: int = WINDOW, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``kept`` (its words outside duplicate spans, joined by one
    space), ``n_words``, ``n_removed``, ``spans``, an array of (begin, end) word
    numbers that were removed, end exclusive, and ``factors``, the parse behind them:
    (begin, end, ref_doc, ref_begin), words that stand in the document ref_doc from its
    word ref_begin on, each factor grown as long as its reference goes on; the columns
    ``without`` are left out.

    A window of ``window`` words is a duplicate if its words also start earlier: in a
    document with a smaller doc_id, or earlier in the same one.  All its words go.

    A block (see ``Parse``) that is indexed at an earlier place is read from the first
    such place, and factors grow over such blocks (see ``grown_factors``).  Where an
    anchor is shared but the content is not, a factor ends; the windows around such
    boundaries are compared one by one, which makes the result exact.  All factors have
    ``window`` words at least and become spans.  Only blocks with a repeated anchor are
    kept after the first pass.

    A null or empty text has no words.  A document without an id stays whole and is
    nobody's reference.  Rows that repeat an id and a text are all treated as the
    first of them; spans are applied only where the content matches, so different
    texts under one id don't harm each other.  Columns of ``docs`` named like the results, or ``marks``, are
    replaced.
    """
    docs = docs.drop("marks", "kept", "n_words", "n_removed", "spans", "factors")
    named = docs.where("doc_id IS NOT NULL")
    blocks = reference_blocks(named, window)
    repeated = blocks.groupBy("anchor").count().where("count > 1").select("anchor")
    shared = written(blocks.join(repeated, "anchor"), "shared-blocks")
    place = F.struct("doc_id", "place")
    factors = shared.groupBy("anchor", "content").agg(F.min(place).alias("origin"))
    several = factors.groupBy("anchor").count().where("count > 1").select("anchor", F.lit(True).alias("boundary"))
    parsed = shared.join(factors, ["anchor", "content"]).join(several, "anchor", "left")
    parsed = written(parsed.select(
        "doc_id", F.struct("place", "content", F.lit(0).alias("kind"), F.col("origin.doc_id").alias("ref_doc"),
                           F.col("origin.place").alias("ref_place")).alias("mark"),
        (place > F.col("origin")).alias("copied"), F.coalesce("boundary", F.lit(False)).alias("boundary")), "parsed")

    boundary = parsed.where("boundary AND NOT copied").groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))
    windows = named.join(boundary, "doc_id").transform(map_batches,
        _BoundaryWindows(window), "hash long, half long, doc_id long, start int")
    earliest = windows.groupBy("hash", "half").agg(F.min(F.struct("doc_id", "start")).alias("origin"),
                                                   F.count("*").alias("n")).where("n > 1").drop("n")
    single = windows.join(earliest, ["hash", "half"]).where(F.struct("doc_id", "start") > F.col("origin")).select(
        "doc_id", F.struct(F.col("start").alias("place"), F.col("hash").alias("content"), F.lit(1).alias("kind"),
                           F.col("origin.doc_id").alias("ref_doc"), F.col("origin.start").alias("ref_place")).alias("mark"))
    marks = parsed.where("copied").select("doc_id", "mark").unionByName(single)
    marks = marks.groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))
    # Both joins need the same exchange of the texts by doc_id; Spark makes it once.
    marked = named.join(marks, "doc_id", "left").select(*docs.columns, "marks")
    unnamed = docs.where("doc_id IS NULL").withColumn("marks", F.lit(None).cast(marks.schema["marks"].dataType))
    out = appended(marked.unionByName(unnamed),
                   "kept string, n_words long, n_removed long, spans array<struct<begin:int,end:int>>, "
                   "factors array<struct<begin:int,end:int,ref_doc:long,ref_begin:int>>",
                   _Remover(window), without=("marks", *without))
    return out


def _marks_of(batch: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, ...]:
    """text, place, content, kind, ref_doc, ref_place of the marks of texts lo to hi."""
    column = batch.column(batch.schema.get_field_index("marks")).slice(lo, hi - lo)
    counts = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    inner = column.flatten()
    return (np.repeat(np.arange(hi - lo), counts), *(inner.field(k).to_numpy().astype(np.int64) for k in range(5)))


class _BoundaryWindows:
    """The windows of the marked blocks of each document, hashed."""

    def __init__(self, window):
        self.window = window

    def __call__(self, batches):
        for batch in batches:
            data, offsets = flat_text(batch.column(batch.schema.get_field_index("text")))
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy()
            for lo, hi in steps(offsets):
                parse = Parse(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], self.window)
                chosen = np.zeros(len(parse.place), bool)
                chosen[_matching_blocks(parse, *_marks_of(batch, lo, hi)[:3])[0]] = True
                at = parse.window_start[chosen[parse.block_of_window]]
                text = parse.text[at]
                h, half = parse.window_hashes(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(half), pa.array(ids[lo + text]),
                     pa.array(at - parse.first[:-1][text], pa.int32())], names=["hash", "half", "doc_id", "start"])


def _matching_blocks(parse: Parse, text, place, content) -> tuple[np.ndarray, np.ndarray]:
    """The blocks that the marks name (same text, same first word, same content), and
    which marks name one."""
    if not len(text) or not len(parse.place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = parse.first[:-1][text] + place
    at = np.minimum(np.searchsorted(parse.block_start, start), len(parse.place) - 1)
    fits = (parse.block_start[at] == start) & (parse.content[at] == content) & (parse.block_text[at] == text)
    return at[fits], np.flatnonzero(fits)


def grown_factors(window: int, text, begin, end, ref_doc, ref_begin) -> tuple[np.ndarray, ...]:
    """The factors of a left-to-right parse.  Pieces are word ranges of a text and where
    they stand in a reference; taken in order, a piece joins the factor before it if its
    first window follows the factor's last one, in the text and in the same reference."""
    # Rows that repeat an id and a text bring the same pieces; each is read once.
    text, begin, end, ref_doc, ref_begin = np.unique(np.stack([text, begin, end, ref_doc, ref_begin]), axis=1)
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(ref_doc) != 0) | (np.diff(ref_begin - begin) != 0) | (
        begin[1:] != end[:-1] - window + 1)
    lead = np.flatnonzero(new)
    return text[lead], begin[lead], end[np.append(lead, len(text))[1:] - 1], ref_doc[lead], ref_begin[lead]


class _Remover:
    def __init__(self, window):
        self.window = window

    def __call__(self, batch):
        data, offsets = flat_text(batch.column(batch.schema.get_field_index("text")))
        named = batch.column(batch.schema.get_field_index("doc_id")).is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column(batch.schema.get_field_index("doc_id")).fill_null(0).to_numpy().astype(np.int64)
        window, factors, n_factors = self.window, [], []
        kept, total, removed, begins, ends, counts = [], [], [], [], [], []
        for lo, hi in steps(offsets):
            part = data[offsets[lo]:offsets[hi]]
            parse = Parse(part, offsets[lo:hi + 1] - offsets[lo], self.window)
            text, place, content, kind, ref_doc, ref_place = _marks_of(batch, lo, hi)
            whole = np.flatnonzero(kind == 0)
            blocks, fits = _matching_blocks(parse, text[whole], place[whole], content[whole])
            whole = whole[fits]
            # Blocks that the text repeats itself are read from their first place in it.
            again = parse.own_origin()
            own = np.flatnonzero((again >= 0) & named[lo:hi][parse.block_text])
            single = np.flatnonzero(kind == 1)
            start = parse.first[:-1][text[single]] + place[single]
            fits = start + window <= parse.first[1:][text[single]]
            single, start = single[fits], start[fits]
            fits = parse.window_hashes(start)[0] == content[single]
            single, start = single[fits], start[fits]
            block = np.concatenate([blocks, own])
            begin = np.concatenate([parse.block_start[block], start])
            end = np.concatenate([parse.block_start[block] + parse.windows[block] - 1 + window, start + window])
            factor = grown_factors(
                window, parse.text[begin], begin, end,
                np.concatenate([ref_doc[whole], ids[lo + parse.block_text[own]], ref_doc[single]]),
                np.concatenate([ref_place[whole], parse.place[again[own]], ref_place[single]]))
            offset = parse.first[:-1][factor[0]]
            factors.append((factor[1] - offset, factor[2] - offset, *factor[3:]))
            n_factors.append(np.bincount(factor[0], minlength=hi - lo))
            gone = np.zeros(len(parse.starts) + 1, np.int64)
            np.add.at(gone, factor[1], 1)
            np.add.at(gone, factor[2], -1)
            gone = np.cumsum(gone)[:-1] > 0
            n = np.diff(parse.first)
            lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[parse.first])
            total.append(n)
            removed.append(lost)
            # A span ends where its text does.
            before = np.concatenate([[False], gone[:-1]])
            before[parse.first[:-1][parse.first[:-1] < len(gone)]] = False
            after = np.concatenate([gone[1:], [False]])[:len(gone)]
            after[parse.first[1:][parse.first[1:] > 0] - 1] = False
            begin, end = np.flatnonzero(gone & ~before[:len(gone)]), np.flatnonzero(gone & ~after) + 1
            of = parse.text[begin]
            begins.append(begin - parse.first[:-1][of])
            ends.append(end - parse.first[:-1][of])
            counts.append(np.bincount(of, minlength=hi - lo))
            raw, stay = part.tobytes(), ~gone
            for k in range(hi - lo):
                own = raw[offsets[lo + k] - offsets[lo]:offsets[lo + k + 1] - offsets[lo]].split()
                if lost[k]:
                    own = compress(own, stay[parse.first[k]:parse.first[k + 1]].tolist())
                kept.append(b" ".join(own))
        empty = np.zeros(0, np.int64)
        begins, ends = (np.concatenate(x or [empty]) for x in (begins, ends))
        spans = pa.StructArray.from_arrays([pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], ["begin", "end"])
        return {"kept": pa.array(kept, pa.binary()).cast(pa.string()),
                "n_words": pa.array(np.concatenate(total or [empty]), pa.int64()),
                "n_removed": pa.array(np.concatenate(removed or [empty]), pa.int64()),
                "spans": lists_of(spans, np.concatenate(counts or [empty])),
                "factors": lists_of(pa.StructArray.from_arrays(
                    [pa.array(np.concatenate(column), kind) for column, kind in zip(
                        zip(*(factors or [(empty,) * 4])), (pa.int32(), pa.int32(), pa.int64(), pa.int32()))],
                    ["begin", "end", "ref_doc", "ref_begin"]), np.concatenate(n_factors or [empty]))}
