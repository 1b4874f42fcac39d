"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.session import cut_lineage


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): root is the least node of
    its component.

    Large-star and small-star steps in turn hang every node on the least node near
    it, until all components are stars.  Each step is a grouped minimum (combined
    before the shuffle) and a join, so a node with very many links is no task's
    burden alone.  The links never leave the executors; each round is cut by a
    reliable checkpoint.  Self links and nulls are ignored.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges = cut_lineage(edges)
    seen = None
    for _ in range(most_rounds):
        count, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not count or (count, total) == seen:
            break
        seen = (count, total)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut_lineage(small)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The same for n rows of one task: the least row reachable from each."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        apart = lo != hi
        if not apart.any():
            return root
        i, j = i[apart], j[apart]
        np.minimum.at(root, hi[apart], lo[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
