"""Token counts from flat token files, by a scan for separators."""

from __future__ import annotations

import gzip

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coterie.llm.arrow import appended, map_batches

#: Ids of a block that one numpy step searches, and leading ids that hold a doc_id.
BLOCK, HEAD = 1 << 20, 5
#: A doc_id is written as HEAD ids of 13 bits, lowest first, so that no id of the
#: head can be the separator.
HEAD_BITS = 13


def write_token_files(docs: DataFrame, folder: str, separator: int) -> None:
    """Write ``ids`` (a binary of little-endian unsigned 32-bit numbers below 65,536)
    of every document to flat files of 16-bit numbers: HEAD ids of the doc_id, the
    token ids, the separator.  The files hold nothing else, and have no index; they
    are gzipped.

    One file per partition; a null ``ids`` is a document without tokens, a null doc_id
    is written as -1.  Ids that equal the separator raise an error.
    """
    def narrow(batch: pa.RecordBatch) -> dict:
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        out = []
        for doc, raw in zip(ids, batch.column(batch.schema.get_field_index("ids")).to_pylist()):
            tokens = np.frombuffer(raw or b"", "<u4")
            if (tokens == separator).any() or (tokens >> 16).any():
                raise ValueError("a token id is the separator or does not fit 16 bits")
            number = (-1 if doc is None else doc) & (2 ** 64 - 1)
            head = [number >> HEAD_BITS * k & (1 << HEAD_BITS) - 1 for k in range(HEAD)]
            out.append(np.concatenate([head, tokens]).astype("<u2").tobytes())
        return {"record": pa.array(out, pa.binary())}

    low, high = separator & 255, separator >> 8
    records = appended(docs.select("doc_id", "ids"), "record binary", narrow)
    # The text sink writes a string's bytes as they are; the line end is the separator.
    records.select(F.col("record").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", chr(low) + chr(high)).option("compression", "gzip").text(folder)


def scan_token_files(spark: SparkSession, folder: str, separator: int, head: int = 0, width: int = 2,
                     block: int = BLOCK) -> DataFrame:
    """One row per document of the flat token files in ``folder``: file, document (its
    number in the file), start (the place of its first id, head included), n_tokens
    (ids without head and separator) and head (its first ids).

    A document ends at a separator; ids after a file's last separator are one more
    document.  Two separators in a row enclose a document of no ids.  Ids are
    little-endian unsigned numbers of ``width`` bytes.  A file, gzipped if its name ends
    in ``.gz``, is read by one task, so write shards (Spark reads such a file up to
    2 GB); it is unpacked block by block, each block is searched in one numpy step, and a prefix scan over a file's
    blocks tells each where the document that it begins in has its start, and how many
    documents came before.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    blocks = files.transform(map_batches, _Scan(separator, head, width, block),
                              "file string, block long, bounds array<struct<at:long,head:array<int>>>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumns({"carried": F.last(F.try_element_at("bounds", F.lit(-1)), ignorenulls=True).over(before),
                               "done": F.coalesce(F.sum(F.size("bounds")).over(before), F.lit(0))})
    rows = rows.select("file", "done", "carried", "bounds", F.posexplode("bounds").alias("k", "bound"))
    last = F.when(F.col("k") == 0, F.col("carried")).otherwise(F.get("bounds", F.col("k") - 1))
    rows = rows.select("file", (F.col("done") + F.col("k") - 1).alias("document"), last.alias("last"), "bound.at")
    return rows.where("last IS NOT NULL").select(
        "file", "document", (F.col("last.at") + 1).alias("start"),
        F.greatest(F.col("at") - F.col("last.at") - 1 - head, F.lit(0)).alias("n_tokens"), "last.head")


class _Scan:
    """The bounds of a file's documents, block by block: its separators, and as ends
    of the outer documents the places before its first and after its last id.  With
    each bound go the first ids of the document that follows."""

    def __init__(self, separator, head, width, block):
        self.separator, self.head, self.block = separator, head, block
        self.type = {1: "u1", 2: "<u2", 4: "<u4"}[width]

    def __call__(self, batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                packed = pa.BufferReader(content.as_buffer())
                for number, row in enumerate(self._bounds(gzip.GzipFile(fileobj=packed) if path.endswith(".gz") else packed)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([number], pa.int64()), pa.array(
                            [row], pa.list_(pa.struct([("at", pa.int64()), ("head", pa.list_(pa.int32()))])))],
                        names=["file", "block", "bounds"])

    def _bounds(self, stream):
        """Per block its bounds; the ids after it are read on as far as a head goes."""
        lo, held, more = 0, np.zeros(0, self.type), True
        while True:
            if more:
                wanted = (self.block + self.head + 1 - len(held)) * held.itemsize
                raw = stream.read(wanted)
                more = len(raw) == wanted
                held = np.concatenate([held, np.frombuffer(raw, self.type)])
            if not len(held):
                return
            at = np.flatnonzero(held[:self.block] == self.separator)
            if lo == 0:
                at = np.append(-1, at)
            if len(held) <= self.block and held[-1] != self.separator:
                at = np.append(at, len(held))
            # A head ends where its document does.
            after = np.flatnonzero(held[self.block:] == self.separator)
            end = np.append(at[1:], self.block + after[0] if len(after) else len(held))
            first = at[:, None] + 1 + np.arange(self.head)
            yield [{"at": lo + int(x), "head": held[f[f < e]].tolist()} for x, f, e in zip(at, first, end)]
            lo, held = lo + self.block, held[self.block:]


def head_number(head: Column) -> Column:
    """The doc_id that a document's first HEAD ids hold."""
    return F.aggregate(F.transform(head, lambda x, k: F.call_function("shiftleft", x.cast("long"), k * HEAD_BITS)),
                       F.lit(0).cast("long"), lambda acc, x: acc + x)


def token_counts(docs: DataFrame, folder: str, separator: int) -> DataFrame:
    """(doc_id, n_tokens) of documents with ``ids``, by way of flat token files in
    ``folder``: the files are all that is read for the result."""
    write_token_files(docs, folder, separator)
    found = scan_token_files(docs.sparkSession, folder, separator, HEAD)
    return found.select(head_number(F.col("head")).alias("doc_id"), "n_tokens")
