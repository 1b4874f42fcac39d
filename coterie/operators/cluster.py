"""Ward and spectral clustering.  Each returns (sample_id, cluster) with clusters
numbered by their smallest sample."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.columns import unit_hash
from coterie.operators.kmeans import N_INIT, SEED, kmeans
from coterie.operators.labels import canonical
from coterie.operators.neighbors import FEW_BLOCKS, best_kernel, cheapest, knn_affinity, tree_pays
from coterie.plans.cells import BLOCK_ROWS, matrix
from coterie.plans.partials import sum_partials
from coterie.plans.tree import CELL, build_tree, column_type, merge_bounds
from coterie.session import cut_lineage, shuffle_width, written

# --- Ward -----------------------------------------------------------------

#: The top of the merge tree: this many cluster summaries are merged on the driver, or half
#: of the vectors where these are more, but no more than MOST_TOP_ROWS.
TOP_ROWS, MOST_TOP_ROWS = 512, 4096
#: Clusters that look for their nearest one at a time on the driver.
TOP_STEP = 512
#: Clustering features of the approximate mode.
SUMMARIES = 1024


def _last_rounds(top: pd.DataFrame) -> list[tuple]:
    """The remaining rounds of the clusters in ``top`` (id, features, w) as (gone, keep,
    cost, round): the same rounds as on Spark, with the same kernel and ties."""
    kernel = best_kernel(1, ward=True, skip_self=True)
    top = top.sort_values("id")
    ids, x, w = top["id"].to_numpy(), matrix(top["features"]), top["w"].to_numpy(dtype=float).copy()
    other, cost = np.full(len(ids), -1), np.zeros(len(ids))
    alive, merges, number = np.arange(len(ids)), [], 0

    def rows(key, at):
        return pd.DataFrame({key: at, "features": list(x[at]), "w": w[at]})

    while len(alive) > 1:
        dirty, points = alive[other[alive] < 0], rows("pid", alive)
        for lo in range(0, len(dirty), TOP_STEP):
            found = kernel(points, rows("qid", dirty[lo:lo + TOP_STEP]))
            other[found["qid"]], cost[found["qid"]] = found["pid"], found["cost"]
        keep = alive[(other[other[alive]] == alive) & (alive < other[alive])]
        gone = other[keep]
        merges += [(ids[g], ids[k], float(cost[k]), number) for g, k in zip(gone, keep)]
        total = w[keep] + w[gone]
        x[keep] = (x[keep] * w[keep][:, None] + x[gone] * w[gone][:, None]) / total[:, None]
        w[keep] = total
        other[np.isin(other, np.append(keep, gone))] = -1
        other[keep] = -1
        alive = np.setdiff1d(alive, gone)
        number += 1
    return merges


def _merge_round(state: DataFrame, n: int, block_rows: int, width: int, by_tree: bool) -> DataFrame:
    """One row per cluster that the round leaves: ``members`` holds the two that merge
    (the kept one first) or the one that stays, each with its nearest cluster.

    Clusters without a known nearest one search; two that name each other share the key
    of their pair, so one aggregate finds and unites them."""
    dirty = state.filter("other IS NULL")
    found = cheapest(dirty.select(F.col("id").alias("qid"), "features", "w"),
                     state.select(F.col("id").alias("pid"), "features", "w"),
                     1, ward=True, skip_self=True, block_rows=block_rows, n_points=n, n_queries=n, width=width, by_tree=by_tree)
    found = found.select(F.col("qid").alias("id"), F.col("pid").alias("other"), "cost")
    near = state.filter("other IS NOT NULL").unionByName(dirty.drop("other", "cost").join(found, "id"))
    pair = [F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi")]
    return near.groupBy(*pair).agg(F.array_sort(F.collect_list(
        F.struct("id", "features", "w", "other", "cost"))).alias("members")).select("members")


def _merges(left: DataFrame) -> DataFrame:
    """(gone, keep, cost) of a round."""
    return left.filter(F.size("members") == 2).select(
        F.col("members")[1]["id"].alias("gone"), F.col("members")[0]["id"].alias("keep"), F.col("members")[0]["cost"].alias("cost"))


def _next_state(left: DataFrame) -> DataFrame:
    """(id, features, w, other, cost) after a round: unions, and whoever's nearest cluster
    merged, have to search again."""
    a, b = F.col("members")[0], F.col("members")[1]
    total = a["w"] + b["w"]
    nothing = left.schema["members"].dataType.elementType
    unknown = [F.lit(None).cast(nothing[c].dataType).alias(c) for c in ("other", "cost")]
    united = left.filter(F.size("members") == 2).select(
        a["id"].alias("id"),
        F.zip_with(a["features"], b["features"], lambda x, y: (x * a["w"] + y * b["w"]) / total).alias("features"),
        total.alias("w"), *unknown)
    alone = left.filter(F.size("members") == 1).select(a.alias("c")).select("c.*")
    touched = _merges(left).select(F.explode(F.array("keep", "gone")).alias("other"), F.lit(True).alias("touched"))
    alone = alone.join(touched, "other", "left")
    known = [F.when(F.col("touched").isNull(), F.col(c)).alias(c) for c in ("other", "cost")]
    return united.unionByName(alone.select("id", "features", "w", *known))


def clustering_features(vectors: DataFrame, n: int, summaries: int = SUMMARIES) -> tuple[DataFrame, DataFrame]:
    """(id, cell) of ``vectors(id, features, w)`` and (id, features, w) of about
    ``summaries`` clustering features: weight and mean of the vectors in each leaf of a
    two-level pivot tree, named by their smallest id.  Features of two leaves add up, so
    clusters can be merged from them alone."""
    tree = build_tree(vectors.withColumnRenamed("id", "pid"), n, max(1, -(-n // summaries)))
    located = tree.points.select(F.col("pid").alias("id"), "features", "w", *CELL)
    mean = vector_to_array(Summarizer.mean(array_to_vector("features"), F.col("w")))
    cells = written(located.groupBy(*CELL).agg(
        F.min("id").alias("leaf_id"), mean.alias("features"), F.sum("w").alias("w")), "clustering-features")
    member = located.select("id", *CELL).join(cells.select(*CELL, "leaf_id"), CELL).select("id", F.col("leaf_id").alias("cluster"))
    return member, cells.select(F.col("leaf_id").alias("id"), "features", "w")


def top_of_tree(n: int) -> int:
    """How many of ``n`` clusters the driver goes on with."""
    return max(TOP_ROWS, min(n // 2, MOST_TOP_ROWS))


def ward(samples: DataFrame, k: int, top_rows: int | None = None, block_rows: int = BLOCK_ROWS, mode: str = "exact",
         summaries: int = SUMMARIES) -> DataFrame:
    """Agglomerative clustering with Ward linkage, cut at k clusters.

    The cost of a merge needs only sizes and centroids, and Ward linkage is reducible, so
    all pairs of mutual nearest clusters merge in the same round, and a cluster whose
    nearest one did not merge keeps it.  Rounds run on Spark, one written table each,
    until ``top_rows`` cluster summaries are left (see ``top_of_tree``); the driver goes on with
    the same rounds, so that number changes no merge, tied costs included.  Then the k - 1
    costliest merges are undone.  Copies merge at cost 0 and are one weighted row from
    the start.

    ``mode='exact'`` starts from all vectors, ``mode='summaries'`` from about
    ``summaries`` clustering features, so that its rounds don't grow with the samples.
    """
    if mode not in ("exact", "summaries"):
        raise ValueError(f"unknown mode {mode}")
    vectors = written(samples.groupBy("features").agg(
        F.min("sample_id").alias("id"), F.count(F.lit(1)).cast("double").alias("w")), "vectors")
    n = vectors.count()
    id_type = column_type(vectors, "id")
    member, state = vectors.select("id", F.col("id").alias("cluster")), vectors.select("id", "features", "w")
    if mode == "summaries" and n > summaries:
        member, state = clustering_features(state, n, summaries)
        member, n = written(member, "members"), state.count()
    state = state.select("*", F.lit(None).cast(id_type).alias("other"), F.lit(None).cast("double").alias("cost"))
    rounds: list[DataFrame] = []
    top_rows = top_of_tree(n) if top_rows is None else top_rows
    width = state.select(F.size("features").alias("d")).first().d if n else 1
    # The trial of the first round holds for the others.
    by_tree = n > FEW_BLOCKS * block_rows and tree_pays(
        build_tree(state.withColumnRenamed("id", "pid"), n, block_rows), state.withColumnRenamed("id", "qid"), 1,
        best_kernel(1, ward=True, skip_self=True), merge_bounds)
    while n > max(top_rows, 1):
        left = written(_merge_round(state, n, block_rows, width, by_tree), "ward-round")
        rounds.append(_merges(left))
        state, n = _next_state(left), left.count()

    # At most top_rows rows are left here.
    last = _last_rounds(state.select("id", "features", "w").toPandas()) if n else []
    merges = [df.select("gone", "keep", "cost", F.lit(i).alias("round")) for i, df in enumerate(rounds)]
    if last:
        merges.append(samples.sparkSession.createDataFrame(
            [(getattr(g, "item", lambda g=g: g)(), getattr(t, "item", lambda t=t: t)(), c, len(rounds) + i) for g, t, c, i in last],
            f"gone {id_type}, keep {id_type}, cost double, round int"))
    undone = []
    if merges and k > 1:
        every = reduce(DataFrame.unionByName, merges)
        undone = [m.gone for m in every.orderBy(F.desc("cost"), F.desc("round"), F.desc("gone")).limit(k - 1).collect()]
    for i in range(len(rounds) + bool(last)):
        steps = merges[i].filter(~F.col("gone").isin(undone)) if undone else merges[i]
        if i == len(rounds):  # the driver's rounds, each cluster with where it ends
            root: dict = {}
            for m in reversed(steps.orderBy("round").collect()):
                root[m.gone] = root.get(m.keep, m.keep)
            if not root:
                break
            steps = samples.sparkSession.createDataFrame(list(root.items()), f"gone {id_type}, keep {id_type}")
        member = member.join(steps.select(F.col("gone").alias("cluster"), "keep"), "cluster", "left").select(
            "id", F.coalesce("keep", "cluster").alias("cluster"))
        if i % 8 == 7:
            member = written(member, "members")
    named = vectors.select("features", "id").join(member, "id").select("features", "cluster")
    return canonical(samples.select("sample_id", "features").join(named, "features").select("sample_id", "cluster"))


# --- spectral -------------------------------------------------------------

#: Nodes of a vector block at least, edges that are packed into one row, and how many of the
#: smallest blocks a task multiplies where there are few nodes, and where there are many.
BLOCK_NODES, EDGES_PER_ROW, LEAST_BLOCKS, BLOCKS_PER_TASK = 512, 1 << 15, 4, 64
#: What the basis of a block may take.
BASIS_BYTES = 24 << 20


def _layout(n: int, row_bytes: int, width: int) -> tuple[int, int]:
    """(blocks, tasks) for ``n`` nodes with ``row_bytes`` of basis each.  Every block sends
    something to every other one, so a task gets one block if its basis is not too large:
    with blocks of one size, what is sent would grow with the square of the nodes."""
    least = max(1, -(-n // BLOCK_NODES))
    tasks = max(1, min(least // LEAST_BLOCKS, max(width, least // BLOCKS_PER_TASK)))
    nodes = max(BLOCK_NODES, min(-(-n // tasks), BASIS_BYTES // row_bytes))
    return max(1, -(-n // nodes)), tasks


def _start_columns(p: int, seed: int) -> list:
    """p start vectors: the square-rooted degrees (the leading eigenvector of a
    connected graph) and draws from a hash of the sample ID."""
    return [F.sqrt("deg")] + [unit_hash(F.col("sample_id"), F.lit(c), F.lit(seed)) - 0.5 for c in range(1, p)]


def _numbered(edges: DataFrame, nodes: DataFrame, blocks: int) -> DataFrame:
    """(sample_id, deg, block, pos) of the nodes: blocks by a hash, places by ID."""
    degree = edges.groupBy(F.col("i").alias("sample_id")).agg(F.sum("w").alias("deg"))
    base = nodes.select("sample_id").join(degree, "sample_id", "left").select(
        "sample_id", F.coalesce("deg", F.lit(0.0)).alias("deg"),
        F.pmod(F.xxhash64("sample_id", F.lit("block")), F.lit(blocks)).cast("int").alias("block"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("sample_id")) - 1
    return written(base.withColumn("pos", place), "nodes")


def _packed(edges: DataFrame, base: DataFrame) -> DataFrame:
    """The normalised graph as rows of at most about EDGES_PER_ROW edges that leave one
    block: (col_block, part, rows, row_block, col, w), the arrays as bytes, sorted by the
    node that they reach.  The edges of a busy node are dealt over several rows."""
    def ends(node: str, prefix: str) -> DataFrame:
        return base.where("deg > 0").select(F.col("sample_id").alias(node), F.sqrt("deg").alias(f"{prefix}_root"),
                                            F.col("block").alias(f"{prefix}_block"), F.col("pos").alias(prefix))

    linked = edges.join(ends("i", "row"), "i").join(ends("j", "col"), "j").select(
        "col_block", "row_block", "row", "col", (F.col("w") / (F.col("row_root") * F.col("col_root"))).alias("w"))
    linked = written(linked, "linked")
    parts = linked.groupBy("col_block").agg(F.ceil(F.count(F.lit(1)) / F.lit(EDGES_PER_ROW)).cast("int").alias("parts"))
    dealt = linked.join(parts, "col_block").withColumn("part", F.pmod(F.xxhash64("row_block", "row"), F.col("parts")).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_block", "row", "col"])
        kinds = {"row_block": "<i4", "row": "<i4", "col": "<i4", "w": "<f8"}
        return pd.DataFrame({"col_block": pdf["col_block"].iloc[:1], "part": pdf["part"].iloc[:1],
                             **{c: [pdf[c].to_numpy().astype(kind).tobytes()] for c, kind in kinds.items()}})

    return written(dealt.drop("parts").groupBy("col_block", "part").applyInPandas(
        pack, "col_block int, part int, row_block binary, row binary, col binary, w binary"), "edges")


def _products(p: int):
    """Of a vector block with the packed edges that leave it: to every block that these
    reach the sums of w x vector over the edges of each node (block, (source, rows, sums)),
    and the block's own basis."""
    def run(met: tuple) -> list[tuple]:
        block, (packed, state) = met
        out = []
        for n, v, basis in state:
            out.append((block, ("", n, basis)))
            v = np.frombuffer(v, "<f8").reshape(n, p)
            for part, *arrays, w in packed:
                to, row, col = (np.frombuffer(raw, "<i4") for raw in arrays)
                new = np.flatnonzero(np.concatenate([[True], (np.diff(to) != 0) | (np.diff(row) != 0)]))
                sums = np.add.reduceat(np.frombuffer(w, "<f8")[:, None] * v[col], new, axis=0)
                to, row = to[new], row[new]
                cut = np.flatnonzero(np.diff(to, prepend=-1))
                out += [(int(to[lo]), (f"{block}/{part}", row[lo:hi].tobytes(), sums[lo:hi].tobytes()))
                        for lo, hi in zip(cut, np.append(cut[1:], len(to)))]
        return out

    return run


def _grow(packed: RDD, state: RDD, p: int, j: int, n_parts: int) -> RDD:
    """``state(block, (n, v, basis))`` one multiplication on: T_{j+1} as ``v``, and
    appended to ``basis``, which holds T_0 to T_j of the block's nodes.  Edge blocks lie where
    the vector block is that they leave from, so only what they send to a block is shuffled,
    with the block's basis; it is added up there in a fixed order.  ``state`` is read once,
    so a chain of these stays a chain."""
    def gather(sent) -> tuple:
        (_, n, basis), *parts = sorted(sent, key=lambda s: s[0])
        basis = np.frombuffer(basis, "<f8").reshape(n, (j + 1) * p)
        v = np.zeros((n, p))
        for _, rows, sums in parts:
            v[np.frombuffer(rows, "<i4")] += np.frombuffer(sums, "<f8").reshape(-1, p)
        if j:
            v = 2 * v - basis[:, (j - 1) * p:j * p]
        return n, v.tobytes(), np.hstack([basis, v]).tobytes()

    return packed.cogroup(state, n_parts).flatMap(_products(p)).groupByKey(n_parts).mapValues(gather)


def _by_block(df: DataFrame, n_parts: int) -> RDD:
    """Rows as (first column, the others), dealt by the first."""
    return df.rdd.map(lambda r: (r[0], tuple(bytes(c) if isinstance(c, bytearray) else c for c in r[1:]))).partitionBy(n_parts)


_STATE = "block int, n int, v binary, basis binary"


def spectral_embedding(edges: DataFrame, nodes: DataFrame, k: int, steps: int = 8, tol: float = 1e-4,
                       max_restarts: int = 100, seed: int = SEED) -> DataFrame:
    """(sample_id, features): the k leading eigenvectors of the normalised graph,
    each divided by the square root of the degree.

    ``edges(i, j, w)`` is symmetric.  The vectors live in a table of blocks of nodes (see
    ``_layout``), the graph in one of packed edges; both are dealt out by block once, and
    multiplying is one shuffle of sums per block, at every size.  Each restart grows a Chebyshev basis
    (T_{j+1} = 2 A T_j - T_{j-1}) by ``steps`` multiplications and one checkpoint; the
    driver solves only the projected problem, (steps + 1) x (k + 2) wide.  An iteration
    that doesn't reach ``tol`` in ``max_restarts`` restarts raises an error.
    """
    n = nodes.count()
    p = min(k + 2, n)
    spark = edges.sparkSession
    # More tasks than cores would only send more.
    width = min(shuffle_width(spark), spark.sparkContext.defaultParallelism)
    blocks, n_parts = _layout(n, 8 * (steps + 2) * max(1, p), width)
    base = _numbered(edges, nodes, blocks)
    packed = _by_block(_packed(edges, base), n_parts).persist(StorageLevel.MEMORY_AND_DISK)

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        v = matrix(pdf.sort_values("pos")["v"]).astype("<f8")
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "n": [len(v)], "v": [v.tobytes()], "basis": [v.tobytes()]})

    state = base.select("block", "pos", F.array(*_start_columns(p, seed)).alias("v")).groupBy("block").applyInPandas(
        start, _STATE)
    for _ in range(max_restarts):
        vectors = _by_block(state, n_parts)
        for j in range(steps + 1):
            vectors = _grow(packed, vectors, p, j, n_parts)
        basis = written(edges.sparkSession.createDataFrame(
            vectors.map(lambda x: (x[0], x[1][0], x[1][2])), "block int, n int, basis binary", verifySchema=False), "basis")
        coef, residual = _ritz(_gram(basis, (steps + 2) * p), p, steps, k)
        state = _combine(basis, coef)
        if residual <= tol:
            break
    else:
        packed.unpersist()
        raise RuntimeError(f"eigenvectors have a residual of {residual} after {max_restarts} restarts")
    packed.unpersist()
    wide = min(k, p)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                v = np.frombuffer(r.v, "<f8").reshape(r.n, p)[:, :wide]
                yield pd.DataFrame({"block": r.block, "pos": np.arange(r.n), "v": list(v)})

    found = state.select("block", "n", "v").mapInPandas(rows, "block int, pos int, v array<double>")
    size = F.sqrt(F.when(F.col("deg") > 0, F.col("deg")).otherwise(1.0))
    return base.join(found, ["block", "pos"]).select("sample_id", F.transform("v", lambda x: x / size).alias("features"))


def _gram(basis: DataFrame, width: int) -> np.ndarray:
    """Inner products of the basis columns: width x width, summed on Spark."""

    def partial(batches):
        total = np.zeros((width, width))
        for pdf in batches:
            for r in pdf.itertuples():
                b = np.frombuffer(r.basis, "<f8").reshape(r.n, width)
                total += b.T @ b
        i, j = np.triu_indices(width)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "v": total[i, j]})

    rows = sum_partials(basis, partial, {"i": "int", "j": "int"}, basis.rdd.getNumPartitions())
    gram = np.zeros((width, width))
    gram[rows["i"], rows["j"]] = rows["v"]
    return gram + np.triu(gram, 1).T


def _ritz(gram: np.ndarray, p: int, steps: int, k: int) -> tuple[np.ndarray, float]:
    """Best p vectors in the span of T_0..T_steps from the Gram matrix of
    T_0..T_{steps+1}: coefficients over the whole basis, and the largest residual
    of the first k."""
    inner = (steps + 1) * p
    # A T_0 = T_1 and A T_j = (T_{j+1} + T_{j-1}) / 2.
    apply_a = np.zeros((gram.shape[0], inner))
    eye = np.eye(p)
    apply_a[p : 2 * p, :p] = eye
    for j in range(1, steps + 1):
        at = slice(j * p, (j + 1) * p)
        apply_a[(j + 1) * p : (j + 2) * p, at] = eye / 2
        apply_a[(j - 1) * p : j * p, at] += eye / 2
    unit = 1.0 / np.sqrt(np.maximum(np.diag(gram)[:inner], 1e-300))
    lam, q = np.linalg.eigh(gram[:inner, :inner] * unit[:, None] * unit[None, :])
    good = lam > lam.max() * 1e-11
    white = (unit[:, None] * q[:, good]) / np.sqrt(lam[good])
    small = white.T @ (gram[:inner, :] @ apply_a) @ white
    theta, y = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-theta)[:p]
    coef, theta = white @ y[:, order], theta[order]
    image = apply_a @ coef
    square = np.einsum("ij,ik,kj->j", image, gram, image) - theta**2
    residual = float(np.sqrt(np.maximum(square[:k], 0.0)).max())
    out = np.zeros((gram.shape[0], p))  # zero columns if the basis spans fewer
    out[:inner, : coef.shape[1]] = coef
    return out, residual


def _combine(basis: DataFrame, coef: np.ndarray) -> DataFrame:
    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = [(np.frombuffer(r.basis, "<f8").reshape(r.n, len(coef)) @ coef).tobytes() for r in pdf.itertuples()]
            yield pd.DataFrame({"block": pdf["block"], "n": pdf["n"], "v": v, "basis": v})

    return basis.mapInPandas(combine, _STATE)


def spectral(samples: DataFrame, k: int, n_neighbours: int = 10, seed: int = SEED,
             n_init: int = N_INIT, block_rows: int = BLOCK_ROWS, mode: str = "exact") -> DataFrame:
    """k-means on the spectral embedding of the nearest-neighbour graph; ``mode`` is that
    of the neighbour search."""
    edges = written(knn_affinity(samples, n_neighbours, block_rows, mode), "affinity")
    return kmeans(spectral_embedding(edges, samples, k, seed=seed), k, seed, n_init)
