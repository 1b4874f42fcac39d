"""SimHash near-duplicates: fingerprints, and exact comparison tile by tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm import tiles, words
from coterie.llm.arrow import appended, flat_text, map_batches, steps
from coterie.llm.components import components, local_roots
from coterie.session import written

SEED = 42
#: Rows of the sub-tiles that one numpy step compares.
STEP_ROWS = 512
#: Groups up to this size are compared by shifted arrays, larger ones by sub-tiles.
SMALL_GROUP = 32


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``fingerprint`` (64 bits in a long).

    A-Z are lower-cased, words end at white space; a bit is set if it is set in over
    half of the XXH64 hashes (seed 42) of the shingles, repeats included.  Fewer
    words than a shingle make one shingle; an empty, blank or null text has
    fingerprint zero.
    """
    def of(batch: pa.RecordBatch) -> dict:
        data, offsets = flat_text(batch.column(batch.schema.get_field_index(text)))
        out = np.zeros(len(batch), np.uint64)
        for lo, hi in steps(offsets):
            part = words.lower_ascii(data[offsets[lo]:offsets[hi]])
            out[lo:hi] = _majority(part, offsets[lo:hi + 1] - offsets[lo], shingle)
        return {"fingerprint": pa.array(out.view(np.int64))}

    return appended(docs, "fingerprint long", of, without)


def _majority(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    starts, ends, first = words.spans(data, offsets, words.WHITE)
    counts = np.diff(first)
    out = np.zeros(len(counts), np.uint64)
    if not len(starts):
        return out
    # All words joined by single spaces; where each begins and ends there.
    lengths = ends - starts
    to = np.cumsum(lengths + 1) - 1
    at = to - lengths
    spaced = np.full(to[-1], 0x20, np.uint8)
    spaced[np.repeat(np.arange(len(at)), lengths) + np.arange(lengths.sum())] = data[~words.WHITE[data]]
    joined = spaced.tobytes()
    n = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(n)), n)
    head = first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    tail = head + np.minimum(counts[doc], shingle) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(at[head].tolist(), to[tail].tolist())), np.uint64, len(doc))
    some = np.flatnonzero(n)
    begin = (np.cumsum(n) - n)[some]
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    major = np.packbits(ones * 2 > n[some][:, None], axis=1, bitorder="little")
    out[some] = major.view(np.uint64)[:, 0]
    return out


def near_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v) between distinct ``fingerprint`` values at ``radius`` or fewer
    differing bits, thinned in each tile to a forest with the same components.

    Two such fingerprints agree on at least one of radius + 1 blocks of bits, so
    tiles are formed among the fingerprints that share a block; inside a tile they
    are ordered by population count, and sub-tiles whose counts differ by more than
    the radius are skipped.  The rest is compared exactly.
    """
    blocks = radius + 1
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fingerprint", edge[i]).bitwiseAND(
        F.lit((1 << (edge[i + 1] - edge[i])) - 1)).alias("value")) for i in range(blocks)])
    rows = prints.select("fingerprint").dropna().distinct().withColumn("part", F.explode(part))
    rows = rows.select("fingerprint", "part.block", "part.value")
    dealt = tiles.deal(rows, ["block", "value"], "fingerprint")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles.whole_groups(batches, ["block", "value", "a", "b"]):
            yield _compare(table, radius)

    return dealt.transform(map_batches, compare, "u long, v long").distinct()


def _compare(table: pa.Table, radius: int) -> pa.RecordBatch:
    starts = tiles.group_starts(table, ["block", "value", "a", "b"])
    prints = table.column("fingerprint").to_numpy().view(np.uint64)
    n = len(prints)
    ones = np.bitwise_count(prints)
    root = np.arange(n)
    for i, j in tiles.small_pairs(starts, n, SMALL_GROUP):
        near = np.bitwise_count(prints[i] ^ prints[j]) <= radius
        if near.any():
            root = local_roots(n, np.concatenate([np.arange(n), i[near]]), np.concatenate([root, j[near]]))
    for lo, hi in zip(starts, np.append(starts[1:], n)):
        if hi - lo > SMALL_GROUP:
            order = lo + np.argsort(ones[lo:hi], kind="stable")
            root = _sub_tiles(prints, ones, order, root, radius)
    away = np.flatnonzero(root != np.arange(n))
    values = prints.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(values[away]), pa.array(values[root[away]])], names=["u", "v"])


def _sub_tiles(prints, ones, order, root, radius):
    n = len(prints)
    own = np.arange(n)
    for at in range(0, len(order), STEP_ROWS):
        a = order[at:at + STEP_ROWS]
        for to in range(at, len(order), STEP_ROWS):
            b = order[to:to + STEP_ROWS]
            if int(ones[b[0]]) - int(ones[a[-1]]) > radius:
                break
            i, j = np.nonzero(np.bitwise_count(prints[a][:, None] ^ prints[b][None, :]) <= radius)
            if len(i):
                root = local_roots(n, np.concatenate([own, a[i]]), np.concatenate([root, b[j]]))
    return root


def near_groups(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest doc_id that is reachable by links.

    Documents with equal fingerprints are one node, whatever their number.  Ids may
    repeat.  A document without an id has no say in a component's id; its own is the
    smallest one reachable, or null.
    """
    prints = written(fingerprints(docs.select("doc_id", "text"), without=("text",)), "simhash")
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    # Only nodes that have a link are named here.
    root = written(components(near_links(prints, radius)), "simhash-roots")
    least = nodes.join(root, F.col("fingerprint") == F.col("node")).groupBy("root").agg(F.min("least").alias("least"))
    linked = root.join(least, "root").select(F.col("node").alias("fingerprint"), F.col("least").alias("across"))
    named = nodes.join(linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("across", "least").alias("component_id"))
    return prints.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, radius: int = 2) -> DataFrame:
    """The documents that stay: of each component the one with the smallest id, once
    even if its row is repeated.  Documents without an id stay."""
    kept = near_groups(docs, radius).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
