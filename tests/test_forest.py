import numpy as np
import pytest
from pyspark.sql import functions as F

from coterie.operators import forest
from coterie.operators.validate import classify_rf

import helpers as h


def plain_tree(codes, y, w, edges, tree, seed, c):
    """Greedy splits of one tree, node by node in the order of levels: (feature, bin) of
    every inner node, in that order."""
    d, out, level, number = codes.shape[1], [], [(0, np.flatnonzero(w > 0))], 1
    while level:
        later = []
        for node, rows in level:
            best = None
            for f in forest.draw_features(d, tree, node, seed):
                for b in range(forest.BINS - 1):
                    low = codes[rows, f] <= b
                    sides = [np.bincount(y[rows[s]], w[rows[s]], c) for s in (low, ~low)]
                    if min(s.sum() for s in sides) == 0:
                        continue
                    whole = sides[0] + sides[1]
                    gain = sum((s**2).sum() / s.sum() for s in sides) - (whole**2).sum() / whole.sum()
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, f, b, rows[low], rows[~low])
            if best is None:
                continue
            out.append((best[1], best[2]))
            for side in best[3:]:
                if len(np.unique(y[side])) > 1:
                    later.append((number, side))
                number += 1
        level = later
    return out


def test_forest_equals_plain_trees(spark):
    x, y = h.blobs(60, 3, 4, seed=4, spread=9.0)
    s = h.to_samples(spark, x, cluster=y)
    got = forest.random_forest(s, 5, 7)
    codes = got.codes(x)
    ids = np.array(h.vector(s.withColumn("h", F.xxhash64("sample_id")), "h"))
    for t, tree in enumerate(got.trees):
        w = forest.draw_weights(ids, t, 7)
        inner = [(f, b) for f, b in zip(tree.feature, tree.bin) if f >= 0]
        assert inner == plain_tree(codes, y, w, got.edges, t, 7, 3)
        assert tree.counts[0].tolist() == np.bincount(y, w, 3).tolist()
    # Leaves are pure, so samples that a tree saw go where their class is.
    assert (got.probabilities(x).argmax(1) == y).mean() > 0.9


def test_draws_are_poisson_and_differ_by_tree():
    ids = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 200_000)
    w = forest.draw_weights(ids, 3, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(w, forest.draw_weights(ids, 4, 42))[0, 1]) < 0.01


def test_predictions_do_not_depend_on_partitions(spark):
    x, y = h.blobs(150, 3, 9, seed=2, spread=8.0)
    s = h.to_samples(spark, x, cluster=y)
    train, test = s.filter("sample_id % 4 <> 0"), s.filter("sample_id % 4 = 0")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in (4, 8, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(h.vector(classify_rf(train.repartition(n), test.repartition(n), n_trees=20), "predicted").tolist())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]
    assert (np.array(seen[0]) == y[::4]).mean() > 0.8


@pytest.mark.parametrize("values", [np.zeros((12, 3)), np.arange(36.0).reshape(12, 3)])
def test_one_class_and_flat_features(spark, values):
    one = h.to_samples(spark, values, cluster=np.full(12, 4))
    assert set(h.vector(classify_rf(one, one, n_trees=3), "predicted")) == {4}
    two = h.to_samples(spark, values, cluster=np.arange(12) // 9)
    got = h.vector(classify_rf(two, two, n_trees=25), "predicted")
    assert (got == 0).all() if not values.any() else (got == np.arange(12) // 9).mean() > 0.8


def test_levels_in_several_passes(spark, monkeypatch):
    x, y = h.blobs(60, 3, 4, seed=4, spread=9.0)
    s = h.to_samples(spark, x, cluster=y)
    whole = forest.random_forest(s, 4, 7)
    monkeypatch.setattr(forest, "MAX_COUNTS", 1)
    monkeypatch.setattr(forest, "PACKED_ROWS", 7)
    parts = forest.random_forest(s, 4, 7, max_depth=3)
    assert (whole.probabilities(x)[:, 0] >= 0).all() and max(max(t.depth) for t in parts.trees) <= 3
    for a, b in zip(whole.trees, parts.trees):
        assert a.feature[0] == b.feature[0] and a.bin[0] == b.bin[0]


def test_a_pass_sends_what_rows_can_count(spark, monkeypatch):
    """Counts that are zero stay behind: deep levels have more nodes than rows to fill them."""
    key, w = np.array([5, 1, 5, 900_000]), np.array([1, 2, 3, 1])
    for size in (16, 1_000_000):
        keys, sums = forest._counted(key[:3] if size == 16 else key, w[:3] if size == 16 else w, size)
        assert keys.tolist() == [1, 5] + [900_000] * (size > 16) and sums.tolist() == [2, 4] + [1] * (size > 16)
    x, y = h.blobs(60, 3, 4, seed=4, spread=9.0)
    s = h.to_samples(spark, x, cluster=y)
    whole = forest.random_forest(s, 4, 7)
    monkeypatch.setattr(forest, "MAX_COUNTS", 200)  # two nodes a group
    parts = forest.random_forest(s, 4, 7)
    for a, b in zip(whole.trees, parts.trees):
        for name in ("feature", "bin", "left", "depth", "counts"):
            assert (getattr(a, name) == getattr(b, name)).all()
