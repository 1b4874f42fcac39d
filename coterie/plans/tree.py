"""Exact neighbour search by a two-level pivot tree.

n points have about n / block_rows leaves in about sqrt(leaves) branches, so the tree
grows with the points.  Only the branches (a square root of the leaves) are known to
the driver and every task; leaves are a table with one row per branch.  Pivots are
points drawn by a hash of their ID, so they lie as dense as the points do.

A query looks into its own leaf first.  What it finds there bounds its cost; distance
bounds rule out branches, then leaves, and what is left is visited in order of the
bound: the next few leaves, and with the cost reached by then the rest.

Work is shuffled in bounded blocks: the points of a leaf, and the queries that visit
it, are split by ID hash; each pair of blocks is one co-group that keeps at most k rows
per query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.plans.cells import BLOCK_ROWS, matrix, no_rows, pivot_distances
from coterie.session import written

#: Leaves visited between the first look and the last.
NEXT_LEAVES = 4
#: Blocks of points or queries that one task assigns to leaves.
ASSIGNED_BLOCKS = 16
#: Blocks of queries that meet the points of a tree of one leaf.
QUERY_BLOCKS = 8

CELL = ["branch", "leaf"]


def column_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def _other_columns(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own: both sides of a co-group may come from
    one DataFrame."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


@dataclass
class Tree:
    """``points(pid, features, w, branch, leaf, pblock)``; ``top``, the pivots of the
    branches, with ``radius`` and ``w_min`` per branch; ``leaves(branch, pivots, stats)``.
    A tree of one leaf has only its points."""

    points: DataFrame
    top: np.ndarray
    radius: np.ndarray
    w_min: np.ndarray
    leaves: DataFrame
    n_leaves: int
    block_rows: int
    fill: np.ndarray | None = None


def _nearest(pivots: np.ndarray):
    """The nearest pivot of a vector, and the distance."""

    @F.pandas_udf("branch int, branch_dist double")
    def nearest(features: pd.Series) -> pd.DataFrame:
        d2 = pivot_distances(matrix(features), pivots)
        at = d2.argmin(1)
        return pd.DataFrame({"branch": at.astype("int32"), "branch_dist": np.sqrt(d2[np.arange(len(at)), at])})

    return nearest


def _in_branches(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    return df.withColumn("_b", _nearest(pivots)("features")).select("*", "_b.*").drop("_b")


def _with_leaves(rows: DataFrame, key: str, sizes: dict[int, int], leaves: DataFrame, kernel: Callable, schema: str,
                 block_rows: int) -> DataFrame:
    """``kernel(rows, leaves of their branch)``; a branch with many rows is split by the
    hash of their key, its leaves go to every part."""
    most = ASSIGNED_BLOCKS * block_rows
    parts = [max(1, -(-sizes.get(b, 0) // most)) for b in range(max(sizes, default=0) + 1)]
    n = F.coalesce(F.get(F.lit(parts), F.col("branch")), F.lit(1))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(key), n).cast("int"))
    leaves = _other_columns(leaves).withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return kernel(a, b)

    return rows.groupBy("branch", "part").cogroup(leaves.groupBy("branch", "part")).applyInPandas(run, schema)


def _pivots(branch: pd.DataFrame, fill: np.ndarray | None) -> np.ndarray:
    """The leaves' pivots of a branch."""
    pivots = matrix(pd.Series(list(branch["pivots"].iloc[0])))
    return pivots if fill is None else np.where(np.isnan(pivots), fill, pivots)


def _counts(df: DataFrame) -> dict[int, int]:
    """Rows per branch: as many numbers as there are branches."""
    return {r.branch: r["count"] for r in df.groupBy("branch").count().collect()}


def build_tree(points: DataFrame, n_points: int, block_rows: int = BLOCK_ROWS, fill: np.ndarray | None = None) -> Tree:
    """A tree over ``points(pid, features, w)``.  Of points with gaps, the distance to a
    pivot runs over the features that are there; ``fill`` completes the pivots."""
    n_leaves = max(1, -(-n_points // block_rows))
    if n_leaves == 1:
        return Tree(points, np.zeros((1, 1)), np.zeros(1), np.zeros(1), points, 1, block_rows, fill)
    n_branches = int(np.ceil(np.sqrt(n_leaves)))
    drawn = points.select("features", F.xxhash64("pid").alias("h")).orderBy("h").limit(n_branches)
    top = matrix(drawn.toPandas()["features"])
    if fill is not None:
        top = np.where(np.isnan(top), fill, top)
    located = written(_in_branches(points.select("pid", "features", "w"), top), "branches")
    sizes = _counts(located)

    chance = (n_leaves - n_branches) / max(1, n_points)
    more = located.withColumn("h", F.xxhash64("pid", F.lit("leaf"))).where(
        F.pmod("h", F.lit(1 << 31)) < F.lit(int(chance * (1 << 31))))
    own = points.sparkSession.createDataFrame(
        [(b, pivot.tolist()) for b, pivot in enumerate(top)], "branch int, first array<double>")
    pivots = own.join(more.groupBy("branch").agg(F.array_sort(F.collect_list(F.struct("h", "features"))).alias("more")),
                      "branch", "left")
    rest = F.transform(F.coalesce("more", F.array().cast(more.select(F.array(F.struct("h", "features"))).schema[0].dataType)),
                       lambda x: x["features"])
    pivots = pivots.select("branch", F.concat(F.array("first"), rest).alias("pivots"))
    pivots = written(pivots, "pivots")
    pid = column_type(points, "pid")

    def assign(rows: pd.DataFrame, branch: pd.DataFrame) -> pd.DataFrame:
        cols = ["pid", "features", "w", "branch", "leaf", "branch_dist", "leaf_dist"]
        if not len(rows):
            return no_rows(*cols)
        d2 = pivot_distances(matrix(rows["features"]), _pivots(branch, fill))
        leaf = d2.argmin(1)
        return rows.assign(leaf=leaf, leaf_dist=np.sqrt(d2[np.arange(len(rows)), leaf]))[cols]

    located = _with_leaves(located, "pid", sizes, pivots, assign,
                           f"pid {pid}, features array<double>, w double, branch int, leaf int, branch_dist double, "
                           "leaf_dist double", block_rows)
    located = written(located, "leaves")
    stats = written(located.groupBy("branch", "leaf").agg(
        F.count(F.lit(1)).alias("n"), F.max("leaf_dist").alias("radius"), F.min("w").alias("w_min"),
        F.max("branch_dist").alias("branch_radius")), "leaf-stats")
    per_branch = stats.groupBy("branch").agg(
        F.max("branch_radius").alias("radius"), F.min("w_min").alias("w_min"),
        F.collect_list(F.struct("leaf", "n", "radius", "w_min")).alias("stats"))
    known = per_branch.select("branch", "radius", "w_min").toPandas().set_index("branch").reindex(range(len(top)))
    leaves = written(pivots.join(per_branch.select("branch", "stats"), "branch"), "tree")
    blocks = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    blocked = located.select("pid", "features", "w", *CELL).join(stats.select(*CELL, blocks.alias("pblocks")), CELL)
    blocked = blocked.withColumn("pblock", F.pmod(F.xxhash64("pid"), F.col("pblocks")).cast("int")).drop("pblocks")
    # An empty branch has no leaves and an infinite bound.
    return Tree(blocked, top, known["radius"].fillna(-np.inf).to_numpy(), known["w_min"].fillna(1.0).to_numpy(), leaves,
                n_leaves, block_rows, fill)


#: Lower bounds of the cost between each query (vectors, weights) and any point of each
#: group (pivots, radii, least weights).
Lower = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def distance_bounds(x: np.ndarray, w: np.ndarray, pivots: np.ndarray, radius: np.ndarray, w_min: np.ndarray) -> np.ndarray:
    """For squared distances: the bisector between two pivots, and the ball around one."""
    centre = pivots.mean(0)
    at = pivots - centre
    norms = (at**2).sum(1)
    d2 = pivot_distances(x, pivots)
    own = d2.argmin(1)
    gap = np.sqrt(np.maximum(norms[own][:, None] + norms[None, :] - 2 * at[own] @ at.T, 0.0))
    gap = np.where(gap > 1e-5 * np.sqrt(norms.max() + 1e-300), gap, np.inf)
    # Distances to pivots come from products; ``err`` covers their rounding.
    err = 1e-11 * (((x - centre) ** 2).sum(1)[:, None] + norms[None, :])
    bisector = (d2 - d2[np.arange(len(own)), own][:, None] - 2 * err) / (2 * gap * (1 + 1e-5))
    ball = np.sqrt(np.maximum(d2 - err, 0.0)) - radius[None, :] - np.sqrt(err)
    return np.maximum(np.maximum(bisector, ball), 0.0) ** 2


def merge_bounds(x: np.ndarray, w: np.ndarray, pivots: np.ndarray, radius: np.ndarray, w_min: np.ndarray) -> np.ndarray:
    """For the growth of the within-cluster sum of squares on merging."""
    return distance_bounds(x, w, pivots, radius, w_min) * (w[:, None] * w_min[None, :] / (w[:, None] + w_min[None, :]))


def meet(points: DataFrame, visits: DataFrame, kernel: Callable, schema: str, block_rows: int) -> DataFrame:
    """``kernel(points, queries)`` on every pair of blocks of each visited cell.

    ``points`` has a cell and ``pblock``; ``visits`` one row per query and cell, with the
    cell's number of ``pblocks``.  Queries are split into smaller blocks than points."""
    keys = [*CELL, "pblock", "qblock"]
    blocks = visits.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / F.lit(max(1, block_rows // 4))).cast("int").alias("qblocks"))
    visits = visits.join(blocks, CELL)
    qs = visits.withColumn("qblock", F.pmod(F.xxhash64("qid", F.lit(7)), F.col("qblocks")).cast("int")).withColumn(
        "pblock", F.explode(F.sequence(F.lit(0), F.col("pblocks") - 1))).select(*keys, "qid", "features", "w")
    pts = points.join(blocks, CELL).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1))).select(
        *keys, "pid", "features", "w")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return kernel(a, b)

    return _other_columns(pts).groupBy(*keys).cogroup(_other_columns(qs).groupBy(*keys)).applyInPandas(run, schema)


def _visits(tree: Tree, queries: DataFrame, lower: Lower | None) -> DataFrame:
    """(qid, features, w, branch, leaf, pblocks, low): without ``lower`` the nearest leaf
    of the nearest branch, else every other leaf whose lower bound ``low`` does not
    exceed the query's ``bound``."""
    schema = f"qid {column_type(queries, 'qid')}, features array<double>, w double, branch int, leaf int, pblocks int, low double"
    top, radius, w_min, block_rows, fill = tree.top, tree.radius, tree.w_min, tree.block_rows, tree.fill
    if lower is None:
        full = np.isfinite(radius)

        @F.pandas_udf("array<int>")
        def branches(features: pd.Series) -> pd.Series:
            d2 = np.where(full[None, :], pivot_distances(matrix(features), top), np.inf)
            return pd.Series(list(d2.argmin(1).astype("int32")[:, None]))

        chosen = branches("features")
    else:
        @F.pandas_udf("array<int>")
        def branches(features: pd.Series, w: pd.Series, bound: pd.Series) -> pd.Series:
            low = lower(matrix(features), w.to_numpy(), top, radius, w_min)
            near = (low <= _slack(bound.to_numpy())[:, None]) & np.isfinite(radius)[None, :]
            return pd.Series([np.flatnonzero(r).astype("int32") for r in near])

        chosen = branches("features", "w", "bound")
    rows = written(queries.withColumn("branch", F.explode(chosen)), "visited-branches")

    def leaves_of(rows: pd.DataFrame, branch: pd.DataFrame) -> pd.DataFrame:
        cols = ["qid", "features", "w", "branch", "leaf", "pblocks", "low"]
        if not len(rows) or not len(branch):
            return no_rows(*cols)
        x, w = matrix(rows["features"]), rows["w"].to_numpy()
        pivots = _pivots(branch, fill)
        stats = pd.DataFrame([(s["leaf"], s["n"], s["radius"], s["w_min"]) for s in branch["stats"].iloc[0]],
                             columns=["leaf", "n", "radius", "w_min"]).set_index("leaf").reindex(range(len(pivots)))
        held = stats["n"].notna().to_numpy()
        if lower is None:
            low = np.where(held[None, :], pivot_distances(x, pivots), np.inf)
            at, leaf = np.arange(len(x)), low.argmin(1)
        else:
            low = lower(x, w, pivots, stats["radius"].fillna(-np.inf).to_numpy(), stats["w_min"].fillna(1.0).to_numpy())
            near = (low <= _slack(rows["bound"].to_numpy())[:, None]) & held[None, :]
            seen = (rows["home_branch"] == rows["branch"]).to_numpy()
            near[np.flatnonzero(seen), rows["home_leaf"].to_numpy()[seen]] = False
            at, leaf = np.nonzero(near)
        out = rows[["qid", "features", "w", "branch"]].iloc[at].reset_index(drop=True)
        blocks = -(-stats["n"].fillna(0).to_numpy().astype(int) // block_rows)
        return out.assign(leaf=leaf, pblocks=blocks[leaf], low=low[at, leaf])[cols]

    return _with_leaves(rows, "qid", _counts(rows), tree.leaves, leaves_of, schema, tree.block_rows)


def _slack(bound: np.ndarray) -> np.ndarray:
    return bound * (1 + 1e-9) + 1e-12


def _steps(tree: Tree, queries: DataFrame, k: int, kernel: Callable, more: str, by: tuple[str, ...], needed: Column | None):
    """The schema of what is found, and the steps of a search."""
    schema = f"qid {column_type(queries, 'qid')}, pid {column_type(tree.points, 'pid')}, cost double{more}"
    order = Window.partitionBy(*by).orderBy("cost", "pid")
    needed = F.lit(1) if needed is None else needed

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def bounded(rows: DataFrame, reached: DataFrame) -> DataFrame:
        """With ``bound``, the k-th cost reached so far."""
        each = reached.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("cost").alias("far"))
        full = each.filter(F.col("n") >= k).groupBy("qid").agg(F.count(F.lit(1)).alias("full"), F.max("far").alias("far"))
        bound = F.when(F.col("full") >= needed, F.col("far")).otherwise(float("inf"))
        return rows.join(full, "qid", "left").withColumn("bound", bound).drop("full", "far")

    def found_in(visits: DataFrame) -> DataFrame:
        return meet(tree.points, visits, kernel, schema, tree.block_rows)

    return schema, best, bounded, found_in


def _bounded_visits(tree: Tree, queries: DataFrame, k: int, kernel: Callable, lower: Lower, more: str, by: tuple[str, ...],
                    needed: Column | None) -> tuple[DataFrame, DataFrame]:
    """What the queries find in their own leaves, and which others they have to visit."""
    _, best, bounded, found_in = _steps(tree, queries, k, kernel, more, by, needed)
    home = written(_visits(tree, queries.select("qid", "features", "w"), None), "home-leaves")
    reached = written(best(found_in(home)).drop("rank"), "reached")
    at_home = home.select("qid", "features", "w", F.col("branch").alias("home_branch"), F.col("leaf").alias("home_leaf"))
    return reached, _visits(tree, bounded(at_home, reached), lower)


def search(tree: Tree, queries: DataFrame, k: int, kernel: Callable, lower: Lower, more: str = "",
           by: tuple[str, ...] = ("qid",), needed: Column | None = None) -> DataFrame:
    """(qid, pid, cost, ..., rank): the k cheapest points of each query in ``queries(qid,
    features, w)``; ties go to the smaller ``pid``.  ``kernel`` gives the k cheapest of a
    pair of blocks, with the columns ``more``.

    A query may ask for the k cheapest in several groups, told apart by the columns
    ``by``: ``needed`` (over its columns) groups, each of which must have its k points
    before the query has a bound."""
    schema, best, bounded, found_in = _steps(tree, queries, k, kernel, more, by, needed)
    queries = queries.select("qid", "features", "w")
    if tree.n_leaves == 1:
        return best(_one_leaf(tree, queries, kernel, schema))
    reached, visits = _bounded_visits(tree, queries, k, kernel, lower, more, by, needed)
    visits = written(visits, "visits")
    near = visits.withColumn("turn", F.row_number().over(Window.partitionBy("qid").orderBy("low", *CELL)))
    first = near.where(F.col("turn") <= NEXT_LEAVES).drop("turn")
    reached = written(best(reached.unionByName(found_in(first))).drop("rank"), "reached")
    rest = bounded(near.where(F.col("turn") > NEXT_LEAVES).drop("turn"), reached)
    rest = rest.where(F.col("low") <= F.col("bound") * (1 + 1e-9) + 1e-12).drop("bound")
    return best(reached.unionByName(found_in(rest)))


def left_to_visit(tree: Tree, queries: DataFrame, k: int, kernel: Callable, lower: Lower, more: str = "",
                  by: tuple[str, ...] = ("qid",), needed: Column | None = None) -> int:
    """How many leaves in all the queries would go to after their own one."""
    if tree.n_leaves == 1:
        return 0
    return _bounded_visits(tree, queries, k, kernel, lower, more, by, needed)[1].count()


def _one_leaf(tree: Tree, queries: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """The search where all points are one block: it goes to every block of queries."""
    blocks = QUERY_BLOCKS
    pts = tree.points.select(F.col("pid").alias("pid"), F.col("features").alias("features"), F.col("w").alias("w"),
                             F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qblock"))
    qs = queries.select("qid", "features", "w", F.pmod(F.xxhash64("qid", F.lit(7)), F.lit(blocks)).cast("int").alias("qblock"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return kernel(a, b)

    return pts.groupBy("qblock").cogroup(qs.groupBy("qblock")).applyInPandas(run, schema)


def hashed_cells(df: DataFrame, sample: np.ndarray, bits: int, tables: int, seed: int) -> DataFrame:
    """A row per table, with the cell that random hyperplanes give a vector: ``bits``
    signs against the medians of ``sample``.  Neighbours often share a cell."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((sample.shape[1], tables * bits))
    level = np.median(sample @ planes, axis=0) if len(sample) else np.zeros(tables * bits)
    weight = 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf("array<int>")
    def cells(features: pd.Series) -> pd.Series:
        over = (matrix(features) @ planes > level).reshape(len(features), tables, bits)
        return pd.Series(list((over @ weight).astype("int32")))

    return df.select("*", F.posexplode(cells("features")).alias("branch", "leaf"))
