"""Byte-level BPE: overlapping chunk encoding, and decoding."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm.arrow import appended, lists_of, map_batches

#: Characters of a chunk, and of the overlap in which two chunks must agree on a
#: pre-token boundary.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Characters after a pre-token that can decide where it ends, with room to spare;
#: runs of white space aside, which are never cut short.
LOOKAHEAD = 16
#: Encoded pieces that a worker remembers.
REMEMBERED = 1 << 15


@lru_cache(4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(f"{path} {pattern}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """``docs`` without ``text`` but with ``ids``, the token ids as little-endian unsigned 32-bit numbers
    in one binary, and ``n_tokens``.

    Every match of ``pattern`` is encoded by itself, by the ranks in ``path``, as the
    ``tiktoken`` library does without special tokens.  The file must be at ``path``
    on every machine.

    A text of up to ``chunk`` characters is one chunk.  A longer one is cut into
    chunks that overlap; tasks pre-tokenise the chunks of all texts in parallel; from
    the first boundary that both of two neighbouring chunks have in their overlap,
    their pre-tokens are the same, so there they are stitched.  Where they have none,
    as inside a very long word, the right one is pre-tokenised anew from the last
    stitch.  Then the pieces are encoded.

    A null or empty text has no tokens.  Repeated rows stay repeated.  Columns named
    ``ids`` or ``n_tokens`` are replaced.
    """
    docs = docs.drop("ids", "n_tokens")
    length = F.coalesce(F.length(text), F.lit(0))
    short = appended(docs.where(length <= chunk), "ids binary, n_tokens long", _ShortEncoder(path, pattern, text), (text,))
    long = docs.where(length > chunk)
    return short.unionByName(_encode_long(long, path, pattern, text, chunk, overlap))


class _ShortEncoder:
    def __init__(self, path, pattern, text):
        self.path, self.pattern, self.text = path, pattern, text

    def __call__(self, batch):
        encoder = encoding(self.path, self.pattern)
        ids = [np.asarray(encoder.encode_ordinary(t), "<u4") if t else np.zeros(0, "<u4")
               for t in batch.column(batch.schema.get_field_index(self.text)).to_pylist()]
        return {"ids": pa.array([x.tobytes() for x in ids], pa.binary()), "n_tokens": pa.array([len(x) for x in ids], pa.int64())}


def _encode_long(docs: DataFrame, path: str, pattern: str, text: str, chunk: int, overlap: int) -> DataFrame:
    """The chunks of long texts, dealt out one by one and stitched per text.

    A text is named by two hashes of it, so that equal texts are encoded once and
    every row finds its ids again."""
    named = docs.withColumns({"text_a": F.xxhash64(text), "text_b": F.sha2(text, 256)})
    chunks = named.select("text_a", "text_b", F.col(text).alias("whole")).transform(map_batches,
        _Chunker(chunk, overlap), "text_a long, text_b string, begin long, piece string, more boolean")
    chunks = chunks.dropDuplicates(["text_a", "text_b", "begin"])  # deals the chunks out, too
    cut = appended(chunks, "bounds array<int>", _Boundaries(pattern))
    stitcher = _Stitcher(path, pattern)

    def stitch(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return stitcher(key, table)

    ids = cut.groupBy("text_a", "text_b").applyInArrow(stitch, "text_a long, text_b string, ids binary, n_tokens long")
    return named.drop(text).join(ids, ["text_a", "text_b"]).drop("text_a", "text_b")


class _Chunker:
    def __init__(self, chunk, overlap):
        self.chunk, self.overlap = chunk, overlap

    def __call__(self, batches):
        for batch in batches:
            for a, b, whole in zip(*(batch.column(k).to_pylist() for k in range(3))):
                begins = list(range(0, len(whole), self.chunk))
                size = self.chunk + self.overlap
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a] * len(begins), pa.int64()), pa.array([b] * len(begins), pa.string()), pa.array(begins, pa.int64()),
                     pa.array([whole[k:k + size] for k in begins], pa.string()),
                     pa.array([k + size < len(whole) for k in begins])],
                    names=["text_a", "text_b", "begin", "piece", "more"])


def _ends(pattern: str, text: str, more: bool) -> np.ndarray:
    """The ends of the pre-tokens of a stretch of text.  If the text goes on, the last
    ones could end elsewhere there and are left out."""
    ends = np.array([m.end() for m in _pattern(pattern).finditer(text)], np.int64)
    return ends[ends < len(text) - LOOKAHEAD] if more else ends


class _Boundaries:
    def __init__(self, pattern):
        self.pattern = pattern

    def __call__(self, batch):
        column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
        bounds = [_ends(self.pattern, piece, more) for piece, more in zip(column("piece"), column("more"))]
        flat = np.concatenate(bounds) if bounds else np.zeros(0, np.int64)
        return {"bounds": lists_of(pa.array(flat, pa.int32()), np.array([len(b) for b in bounds], np.int64))}


class _Stitcher:
    """The chunks of one text, in order, to its token ids."""

    def __init__(self, path, pattern):
        self.path, self.pattern = path, pattern

    def __call__(self, key, table: pa.Table) -> pa.Table:
        rows = table.take(pa.array(np.argsort(table.column("begin").to_numpy())))
        begins, pieces, more = (rows.column(c).to_pylist() for c in ("begin", "piece", "more"))
        bounds = [np.asarray(b, np.int64) for b in rows.column("bounds").to_pylist()]
        encoder = encoding(self.path, self.pattern)
        # The text from its last stitch on, and the boundaries known in it.
        text, base, known = pieces[0], 0, bounds[0]
        out = []
        for piece, begin, ends, goes_on in zip(pieces[1:], begins[1:], bounds[1:], more[1:]):
            both = np.intersect1d(known[known + base >= begin] + base, np.append(ends, 0) + begin)
            if len(both):
                stitch = int(both[0])
                out.append(self._encode(encoder, text, known[known + base <= stitch]))
                text, base = piece[stitch - begin:], stitch
                known = ends[ends + begin > stitch] + begin - base
            else:  # no common boundary: both are one stretch
                text = text[:begin - base] + piece
                known = _ends(self.pattern, text, goes_on)
        out.append(self._encode(encoder, text, known))
        ids = np.concatenate(out)
        return pa.table({"text_a": pa.array([key[0].as_py()], pa.int64()), "text_b": pa.array([key[1].as_py()], pa.string()),
                         "ids": pa.array([ids.tobytes()], pa.binary()), "n_tokens": pa.array([len(ids)], pa.int64())})

    @staticmethod
    def _encode(encoder, text, ends):
        out, begin = [], 0
        for end in ends.tolist():
            out.extend(_encode_piece(encoder, text[begin:end]))
            begin = end
        return np.asarray(out, "<u4")


_pieces: dict = {}


def _encode_piece(encoder, piece: str):
    found = _pieces.get((encoder.name, piece))
    if found is None:
        found = encoder._encode_single_piece(piece)
        if len(_pieces) >= REMEMBERED:
            _pieces.clear()
        _pieces[encoder.name, piece] = found
    return found


def decode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``decoded``: the bytes of all tokens of ``ids``, concatenated; none
    for null."""
    def of(batch: pa.RecordBatch) -> dict:
        token = _token_bytes(path, pattern)
        out = []
        for raw in batch.column(batch.schema.get_field_index("ids")).to_pylist():
            out.append(b"".join([token[i] for i in np.frombuffer(raw or b"", "<u4").tolist()]))
        return {"decoded": pa.array(out, pa.binary())}

    return appended(docs, "decoded binary", of)


@lru_cache(4)
def _token_bytes(path: str, pattern: str) -> dict[int, bytes]:
    encoder = encoding(path, pattern)
    return {rank: token for token, rank in encoder._mergeable_ranks.items()}
