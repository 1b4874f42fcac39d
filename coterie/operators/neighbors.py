"""Nearest neighbours and the graph built from them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.plans.cells import BLOCK_ROWS, matrix, no_rows, together
from coterie.plans.grid import POINT_STEP, QUERY_SIDES, QUERY_STEP, Cheapest, across, candidates, euclidean, n_sides
from coterie.plans.tree import (
    CELL, Lower, Tree, build_tree, column_type, distance_bounds, hashed_cells, left_to_visit, meet, merge_bounds, search,
)
from coterie.session import written

# Candidates measured at a time.
CHUNK = 1 << 15
# Blocks of points that are searched without a tree, and queries that a tree is tried on.
FEW_BLOCKS, TRIED = 16, 512
# Hash tables of the approximate search, and points whose medians cut its cells.
LSH_TABLES, LSH_SAMPLE = 8, 4096


def best_kernel(k: int, ward: bool, skip_self: bool):
    """Per query of a block pair, its k cheapest points: (qid, pid, cost)."""

    def kernel(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return no_rows("qid", "pid", "cost")
        a, b = matrix(queries["features"]), matrix(points["features"])
        qid, pid = np.array(queries["qid"].tolist()), np.array(points["pid"].tolist())
        centre = b.mean(0)
        ac, bc = a - centre, b - centre
        a2, b2 = (ac**2).sum(1), (bc**2).sum(1)
        d2 = a2[:, None] + b2[None, :] - 2 * ac @ bc.T
        slack = 1e-10 * (a2[:, None] + b2[None, :])
        if ward:
            wa, wb = queries["w"].to_numpy()[:, None], points["w"].to_numpy()[None, :]
            factor = wa * wb / (wa + wb)
            d2, slack = d2 * factor, slack * factor
        if skip_self:
            d2 = np.where(qid[:, None] == pid[None, :], np.inf, d2)
        kk = min(k, len(pid))
        reach = np.partition(d2 + slack, kk - 1, axis=1)[:, kk - 1]
        # The products above round; every candidate within the rounding error of
        # the k-th is measured again from the differences.
        rows, cols = np.nonzero((d2 - slack <= reach[:, None]) & np.isfinite(d2))
        cost = np.empty(len(rows))
        for s in range(0, len(rows), CHUNK):
            at = slice(s, s + CHUNK)
            cost[at] = ((a[rows[at]] - b[cols[at]]) ** 2).sum(1)
        if ward:
            cost = cost * factor[rows, cols]
        order = np.lexsort((pid[cols], cost, rows))
        rows, cols, cost = rows[order], cols[order], cost[order]
        starts = np.searchsorted(rows, np.arange(len(qid)))
        keep = np.arange(len(rows)) - starts[rows] < kk
        return pd.DataFrame({"qid": qid[rows[keep]], "pid": pid[cols[keep]], "cost": cost[keep]})

    return kernel


def side_kernel(k: int, ward: bool, skip_self: bool):
    """Per query of a pair of sides, its k cheapest points: (qid, pid, cost, rank).  Points
    go by in blocks, from the lightest, against the k-th cost reached so far."""

    def kernel(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return no_rows("qid", "pid", "cost", "rank")
        points = points.sort_values("pid")
        a, b = matrix(queries["features"]), matrix(points["features"])
        qid, pid = np.array(queries["qid"].tolist()), np.array(points["pid"].tolist())
        wa, wb = queries["w"].to_numpy(dtype=float), points["w"].to_numpy(dtype=float)
        by_weight = np.argsort(wb, kind="stable") if ward else np.arange(len(b))
        light = wb[by_weight]
        centre = b.mean(0)
        products = euclidean(a - centre, (b - centre)[by_weight])
        out = []
        for lo in range(0, len(a), QUERY_STEP):
            q = slice(lo, lo + QUERY_STEP)
            best = Cheapest(len(a[q]), k)
            for s in range(0, len(b), POINT_STEP):
                p = slice(s, s + POINT_STEP)

                def factor(rows: np.ndarray, w: np.ndarray = light[p], own: np.ndarray = wa[q]) -> np.ndarray:
                    return own[rows, None] * w / (own[rows, None] + w) if ward else np.ones((1, 1))

                least = wa[q] * light[s] / (wa[q] + light[s]) if ward else np.ones(len(a[q]))
                rows, cols = candidates(products, q, p, k + skip_self, best.reach, least, factor)
                at = by_weight[s + cols]
                if skip_self:
                    other = qid[lo + rows] != pid[at]
                    rows, at = rows[other], at[other]
                cost = np.empty(len(rows))
                for c in range(0, len(rows), CHUNK):
                    i, j = lo + rows[c:c + CHUNK], at[c:c + CHUNK]
                    cost[c:c + CHUNK] = ((a[i] - b[j]) ** 2).sum(1)
                if ward:
                    cost = cost * (wa[lo + rows] * wb[at] / (wa[lo + rows] + wb[at]))
                best.add(rows, at, cost)
            rows, place = np.nonzero(best.at >= 0)
            out.append(pd.DataFrame({"qid": qid[lo + rows], "pid": pid[best.at[rows, place]],
                                     "cost": best.cost[rows, place], "rank": place + 1}))
        return together(out)

    return kernel


def search_sides(queries: DataFrame, points: DataFrame, k: int, ward: bool, skip_self: bool,
                 n_queries: int, n_points: int, width: int) -> DataFrame:
    """``cheapest`` without a tree, over pairs of sides (see ``plans.grid``)."""
    sides = n_sides(n_queries, n_points, 8 * max(1, width), points.sparkSession.sparkContext.defaultParallelism)
    schema = f"qid {column_type(queries, 'qid')}, pid {column_type(points, 'pid')}, cost double, rank int"
    found = across(queries, points, sides, side_kernel(k, ward, skip_self), schema)
    if sides[1] == 1:
        return found
    order = Window.partitionBy("qid").orderBy("cost", "pid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def some_queries(queries: DataFrame) -> DataFrame:
    """TRIED queries by a hash, to try a plan on."""
    some = queries.select("qid", "features", "w").orderBy(F.xxhash64("qid", F.lit("some")), "qid").limit(TRIED)
    return written(some, "some")


def tree_pays(tree: Tree, queries: DataFrame, k: int, kernel: Callable, lower: Lower) -> bool:
    """Whether bounds rule out so much that a query of a sample goes to fewer leaves than
    there are sides in a search without a tree.  Both searches give the same rows."""
    some = some_queries(queries)
    return left_to_visit(tree, some, k, kernel, lower) <= some.count() * QUERY_SIDES / 2


def cheapest(queries: DataFrame, points: DataFrame, k: int, ward: bool = False,
             skip_self: bool = False, block_rows: int = BLOCK_ROWS, n_points: int | None = None,
             n_queries: int | None = None, width: int | None = None, by_tree: bool | None = None) -> DataFrame:
    """(qid, pid, cost, rank): the k points of least cost for each query.

    ``queries(qid, features, w)``, ``points(pid, features, w)``.  The cost is the
    squared distance, or with ``ward`` the growth of the within-cluster sum of
    squares on merging.  Ties go to the smaller ``pid``.  Exact: by a tree where there are
    more than FEW_BLOCKS blocks of points and its bounds rule most of them out (see
    ``plans.tree``), else by going through all pairs (see ``plans.grid``).  ``by_tree`` says
    what an earlier trial came to.
    """
    n_points = points.count() if n_points is None else n_points
    if by_tree is not False and n_points > FEW_BLOCKS * block_rows:
        kernel, lower = best_kernel(k, ward, skip_self), merge_bounds if ward else distance_bounds
        tree = build_tree(points, n_points, block_rows)
        if by_tree or tree_pays(tree, queries, k, kernel, lower):
            return search(tree, queries, k, kernel, lower)
    if width is None:
        first = points.select(F.size("features").alias("d")).first()
        width = first.d if first else 1
    return search_sides(queries, points, k, ward, skip_self, queries.count() if n_queries is None else n_queries, n_points, width)


def near_cells(queries: DataFrame, points: DataFrame, k: int, n_points: int, block_rows: int = BLOCK_ROWS,
               tables: int = LSH_TABLES, seed: int = 42) -> DataFrame:
    """``cheapest`` by locality-sensitive hashing: (qid, pid, cost, rank) of the k nearest
    among the points that share a hash cell with the query in one of ``tables`` tables.

    A cell is the signs of random projections against the medians of a sample of at most
    LSH_SAMPLE points; there are enough signs for cells of about ``block_rows`` points, so
    a query meets tables x block_rows points however many there are.  Costs are exact; a
    neighbour that never shares a cell is missed.  Queries that found fewer than k are
    searched exactly.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, n_points) / block_rows))))
    drawn = points.select("features", F.xxhash64("pid", F.lit("sample")).alias("h")).orderBy("h").limit(LSH_SAMPLE)
    sample = drawn.toPandas()["features"]
    sample = matrix(sample) if len(sample) else np.zeros((0, 1))

    def hashed(df: DataFrame) -> DataFrame:
        return hashed_cells(df.select(df.columns[0], "features", "w"), sample, bits, tables if bits else 1, seed)

    inside = written(hashed(points), "hashed-points")
    sizes = inside.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("pblocks"))
    inside = inside.join(sizes, CELL).withColumn("pblock", F.pmod(F.xxhash64("pid"), F.col("pblocks")).cast("int"))
    visits = hashed(queries).join(sizes, CELL)
    schema = f"qid {column_type(queries, 'qid')}, pid {column_type(points, 'pid')}, cost double"
    found = meet(inside.drop("pblocks"), visits, best_kernel(k, False, False), schema, block_rows)
    order = Window.partitionBy("qid").orderBy("cost", "pid")
    found = written(found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "near-cells")
    short = queries.join(found.groupBy("qid").count().where(F.col("count") >= min(k, n_points)), "qid", "left_anti")
    short = written(short.select("qid", "features", "w"), "short")
    if short.isEmpty():
        return found
    exact = cheapest(short, points, k, block_rows=block_rows, n_points=n_points)
    return found.join(short.select("qid"), "qid", "left_anti").unionByName(exact)


def knn(queries: DataFrame, points: DataFrame, k: int, block_rows: int = BLOCK_ROWS, mode: str = "exact") -> DataFrame:
    """(sample_id, neighbor_id, dist, rank): the k nearest points by Euclidean
    distance, equal distances by smaller ``neighbor_id``; a point is no neighbour
    of itself.

    ``mode`` is ``exact`` or, for many points of so many dimensions that distance bounds
    rule little out, ``lsh`` (see ``near_cells``).  Equal vectors are searched once and
    stand for all their samples, so a group of copies costs one row of the search.
    """
    if mode not in ("exact", "lsh"):
        raise ValueError(f"unknown mode {mode}")
    by_id = Window.partitionBy("features").orderBy("sample_id")
    # k + 1 samples per vector suffice (one may be the query itself); the rank
    # limit also runs before the shuffle, so copies do not pile up in one task.
    few = points.select("sample_id", "features").withColumn(
        "_n", F.row_number().over(by_id)).filter(F.col("_n") <= k + 1)
    vectors = written(few.groupBy("features").agg(
        F.min("sample_id").alias("pid"), F.collect_list("sample_id").alias("ids"), F.lit(1.0).alias("w")), "vectors")
    if queries is points:
        asked = vectors.select("features", F.col("pid").alias("qid"), "w")
    else:
        asked = written(queries.select("sample_id", "features").groupBy("features").agg(
            F.min("sample_id").alias("qid"), F.lit(1.0).alias("w")), "asked")
    q, p = asked.select("qid", "features", "w"), vectors.select("pid", "features", "w")
    near = (cheapest(q, p, k + 1, block_rows=block_rows) if mode == "exact" else
            near_cells(q, p, k + 1, p.count(), block_rows))
    members = near.select("qid", "pid", "cost").join(
        vectors.select("pid", F.explode("ids").alias("neighbor_id")), "pid")
    order = Window.partitionBy("qid").orderBy("cost", "neighbor_id")
    lists = members.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("cost", "neighbor_id"))).alias("near"))
    answers = asked.select("features", "qid").join(lists, "qid").select("features", "near")
    own = queries.select("sample_id", "features").join(answers, "features")
    others = F.slice(F.filter("near", lambda c: c["neighbor_id"] != F.col("sample_id")), 1, k)
    return own.select("sample_id", F.posexplode(others).alias("pos", "c")).select(
        "sample_id", F.col("c.neighbor_id").alias("neighbor_id"), F.sqrt("c.cost").alias("dist"),
        (F.col("pos") + 1).alias("rank"))


def knn_affinity(samples: DataFrame, n_neighbours: int = 10, block_rows: int = BLOCK_ROWS,
                 mode: str = "exact") -> DataFrame:
    """Symmetric graph (i, j, w) with w = 1/2 for each direction in which one is
    among the other's nearest samples.  ``n_neighbours`` counts the sample itself,
    so the graph has n_neighbours - 1 others; self loops, which do not change the
    normalised graph, are left out."""
    n = samples.count()
    near = knn(samples, samples, min(n_neighbours, n - 1) - 1, block_rows, mode)
    i, j = F.col("sample_id").alias("i"), F.col("neighbor_id").alias("j")
    back = near.select(F.col("neighbor_id").alias("i"), F.col("sample_id").alias("j"))
    return near.select(i, j).unionByName(back).groupBy("i", "j").agg(
        (F.count(F.lit(1)) * F.lit(0.5)).alias("w"))
