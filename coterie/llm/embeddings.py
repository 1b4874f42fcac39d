"""Embedding near-duplicates by E8 lattice hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm import tiles
from coterie.llm.arrow import map_batches
from coterie.llm.components import components, local_roots
from coterie.llm.words import mix
from coterie.session import written

#: Hash tables, neighbouring cells probed in each, and the size of a lattice cell
#: for unit vectors.  For finer cells in larger corpora raise the first two.
TABLES, PROBES, CELL = 3, 3, 1.5
SEED = 8
#: Pairs that one numpy step compares.
STEP_ROWS = 1024


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled to be whole numbers."""
    pairs = []
    for i, j in combinations(range(8), 2):
        for s, t in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = s, t
            pairs.append(v)
    halves = [v for v in product((1, -1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(pairs + halves)


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row, doubled."""
    def d8(y):
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
        if len(odd):
            off = y[odd] - r[odd]
            at = np.abs(off).argmax(1)
            r[odd, at] += np.where(off[np.arange(len(odd)), at] >= 0, 1, -1)
        return r

    whole, half = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.rint(2 * np.where(nearer[:, None], half, whole)).astype(np.int64)


class Lattice:
    """Cells of unit vectors of one dimension; the same on every machine."""

    def __init__(self, dim: int, tables: int, probes: int, cell: float):
        rng = np.random.default_rng([SEED, dim])
        self.tables, self.probes = tables, probes
        self.planes = rng.standard_normal((tables, dim, 8)) / cell
        self.shift = rng.random((tables, 8))
        self.weight = rng.integers(1, 2**63, 8, dtype=np.int64) | 1
        self.roots = _roots()

    def _key(self, points: np.ndarray, table: int) -> np.ndarray:
        h = (points * self.weight).sum(-1).view(np.uint64) + np.uint64(table * 0x9E3779B97F4A7C15 % 2**64)
        return mix(h).view(np.int64)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(row, table, 1 + probes): the home cell, then the nearest neighbour cells."""
        out = np.empty((len(unit), self.tables, 1 + self.probes), np.int64)
        for t in range(self.tables):
            x = unit @ self.planes[t] + self.shift[t]
            home = nearest_e8(x)
            out[:, t, 0] = self._key(home, t)
            if self.probes:
                toward = (2 * x - home) @ self.roots.T
                best = np.argsort(-toward, axis=1, kind="stable")[:, :self.probes]
                out[:, t, 1:] = self._key(home[:, None, :] + self.roots[best], t)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dimension(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for dim in np.unique(sizes).tolist():
        yield dim, np.flatnonzero(sizes == dim)


def near_vectors(vectors: DataFrame, cosine: float = 0.98, tables: int = TABLES, probes: int = PROBES,
                 cell: float = CELL) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly),
    component_id (the smallest vec_id reachable) and kept (it is its own
    component_id).

    ``vectors`` has vec_id, embedding and label.  Vectors with the same label, not
    null, and as many components are linked at a cosine of ``cosine`` or more, in
    double precision.  Equal vectors are one node with a multiplicity.  Nodes are
    projected at random to eight dimensions in several tables and put in the cell of
    the nearest E8 point; each also looks into the nearest neighbouring cells.  Pairs
    that meet are verified where they meet, and counted only at the first of the
    places where they do, which both rows' cells tell; so no pair leaves its task,
    only counts and a forest of links.

    Vectors that are null, empty, zero or hold null or non-finite components, have no
    label or no vec_id link with nothing; their component is their own vec_id.
    Repeated rows count as vectors of their own.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & finite & F.exists(
        v, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", "embedding").withColumns(
        {"usable": usable, "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    keys = ["label", "h1", "h2"]
    nodes = rows.where("usable").groupBy(*keys).agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    nodes = written(nodes, "vectors")

    place = nodes.select("node", "label", "copies", "embedding").transform(map_batches,
        _Places(tables, probes, cell), "cell long, tab int, home boolean, node long, label "
        f"{vectors.schema['label'].dataType.simpleString()}, copies long, embedding {vectors.schema['embedding'].dataType.simpleString()}")
    place = place.withColumn("bucket", F.xxhash64("label", "cell", F.size("embedding"))).drop("cell", "label")
    dealt = tiles.deal(place, ["bucket"], "node")
    found = written(dealt.transform(map_batches, _Meetings(cosine, tables, probes, cell), "u long, v long, n long"), "vector-links")

    counts = found.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.where("n = 0").select("u", "v"))
    named = nodes.join(counts, "node", "left").join(roots, "node", "left").select(
        *keys, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("component_id"))
    linked = rows.drop("embedding").join(named, keys, "left")
    own = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return linked.select(
        "vec_id", F.when(F.col("usable"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept"))


class _Places:
    """A row for the home cell of every node in every table and for each probe."""

    def __init__(self, *shape):
        self.shape = shape

    def __call__(self, batches):
        for batch in batches:
            sizes = batch.column(3).value_lengths().to_numpy()
            for dim, rows in _by_dimension(sizes):
                part = batch.take(pa.array(rows))
                cells = Lattice(dim, *self.shape).cells(_matrix(part.column(3)))
                n, tables, each = cells.shape
                row = pa.array(np.repeat(np.arange(n), tables * each))
                home = np.tile(np.arange(each) == 0, n * tables)
                tab = np.tile(np.repeat(np.arange(tables), each), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.ravel()), pa.array(tab, pa.int32()), pa.array(home),
                     *(part.column(k).take(row) for k in (0, 1, 2, 3))],
                    names=["cell", "tab", "home", "node", "label", "copies", "embedding"])


class _Meetings:
    """Counts of links (u, null, n) and a forest of links (u, v, 0) per task step."""

    def __init__(self, cosine, *shape):
        self.cosine, self.shape = cosine, shape

    def __call__(self, batches):
        for table in tiles.whole_groups(batches, ["bucket", "a", "b"], least=8_000):
            sizes = table.column("embedding").combine_chunks().value_lengths().to_numpy()
            for dim, rows in _by_dimension(sizes):
                yield self._compare(table.take(pa.array(rows)).combine_chunks(), dim)

    def _compare(self, table, dim):
        starts = tiles.group_starts(table, ["bucket", "a", "b"])
        n = table.num_rows
        unit = _matrix(table.column("embedding").combine_chunks())
        node, copies, home, tab, tile, a, b = (
            table.column(c).to_numpy() for c in ("node", "copies", "home", "tab", "tile", "a", "b"))
        cells = None
        links, root = np.zeros(n, np.int64), np.arange(n)

        def meet(i, j, near=None):
            """Keep the pairs that are links and meet here first."""
            nonlocal cells, root
            # Two tiles meet across; both on one tile meet where a = b.
            fit = (home[i] | home[j]) & (node[i] != node[j]) & ((tile[i] != tile[j]) | (a[i] == b[i]))
            if near is None:
                i, j = i[fit], j[fit]
                near = np.einsum("ij,ij->i", unit[i], unit[j]) >= self.cosine
            else:
                near = near & fit
            i, j = i[near], j[near]
            if not len(i):
                return
            if cells is None:
                cells = Lattice(dim, *self.shape).cells(unit)
            swap = node[i] > node[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            first = self._first(cells, tab, home, i, j)
            i, j = i[first], j[first]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = local_roots(n, np.concatenate([np.arange(n), i]), np.concatenate([root, j]))

        for i, j in tiles.small_pairs(starts, n, 32):
            meet(i, j)
        for lo, hi in zip(starts, np.append(starts[1:], n)):
            if hi - lo <= 32:
                continue
            for at in range(lo, hi, STEP_ROWS):
                for to in range(at, hi, STEP_ROWS):
                    i, j = np.nonzero(unit[at:min(at + STEP_ROWS, hi)] @ unit[to:min(to + STEP_ROWS, hi)].T >= self.cosine - 1e-9)
                    i, j = i + at, j + to
                    i, j = i[i < j], j[i < j]
                    for k in range(0, len(i), 1 << 18):
                        meet(i[k:k + (1 << 18)], j[k:k + (1 << 18)])
        some = np.flatnonzero(links)
        away = np.flatnonzero(root != np.arange(n))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([node[some], node[away]])),
             pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[root[away]])]),
             pa.array(np.concatenate([links[some], np.zeros(len(away), np.int64)]))], names=["u", "v", "n"])

    @staticmethod
    def _first(cells, tab, home, i, j):
        """Whether the pairs meet here first; the order in each table is: in a common
        home, in j's home, in i's home."""
        meets = np.stack([cells[i][:, :, 0] == cells[j][:, :, 0],
                          (cells[i][:, :, 1:] == cells[j][:, :, :1]).any(2),
                          (cells[j][:, :, 1:] == cells[i][:, :, :1]).any(2)], axis=2).reshape(len(i), -1)
        here = 3 * tab[i] + np.where(home[i], np.where(home[j], 0, 2), 1)
        return meets.argmax(1) == here
