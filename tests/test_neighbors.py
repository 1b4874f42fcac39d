import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coterie.operators import impute as impute_module, neighbors
from coterie.operators.impute import donor_kernel, gap_bounds, knn_impute_samples, side_donors
from coterie.operators.neighbors import best_kernel, cheapest, knn, knn_affinity, side_kernel
from coterie.operators.validate import classify_knn
from coterie.plans import grid, tree
from coterie.plans.cells import pivot_distances
from coterie.plans.tree import meet

from helpers import blobs, distances, impute, nearest, to_samples, vector, with_copies


def found(df, n, k):
    t = df.toPandas().sort_values(["sample_id", "rank"])
    assert len(t) == n * k
    return t["neighbor_id"].to_numpy().reshape(n, k)


@pytest.mark.parametrize("block_rows", [2048, 50, 16, 3])
def test_knn_is_exact(spark, block_rows):
    """One leaf, a few, and many leaves in many branches: the same rows."""
    x, _ = blobs(120)
    s = to_samples(spark, x)
    assert (found(knn(s, s, 4, block_rows), 120, 4) == nearest(x, 4)).all()


@pytest.mark.parametrize("block_rows", [2048, 8])
def test_knn_with_a_third_of_rows_equal(spark, block_rows):
    x = with_copies(90)
    s = to_samples(spark, x)
    assert (found(knn(s, s, 3, block_rows), 90, 3) == nearest(x, 3)).all()


def named(samples):
    return samples.withColumn("sample_id", F.format_string("A/%03d", "sample_id"))


def test_searches_on_texts_as_ids(spark):
    """Blocks without rows on one side fit IDs that are texts, as those of merged data sets."""
    x, _ = blobs(60)
    s = to_samples(spark, x)
    want = {(f"A/{i:03d}", f"A/{j:03d}") for i, row in enumerate(nearest(x, 3)) for j in row}
    near = knn(named(s), named(s), 3, 8).collect()
    assert {(r.sample_id, r.neighbor_id) for r in near} == want
    x[np.random.default_rng(6).random(x.shape) < 0.2] = np.nan
    got = vector(knn_impute_samples(named(to_samples(spark, x)), 3, 8), "features")
    assert np.allclose(np.array(got.tolist()), impute(x, 3))


def test_pruning_survives_a_large_offset(spark):
    x, _ = blobs(100, 5, 3, seed=4)
    s = to_samples(spark, x * [1.0, 100.0, 0.01] + 1e6)
    want = nearest(x * [1.0, 100.0, 0.01] + 1e6, 3)
    assert (found(knn(s, s, 3, 8), 100, 3) == want).all()


def test_few_leaves_are_visited(spark, monkeypatch):
    """Points on a plane: the leaves that a query visits hardly grow with the points."""
    seen = []

    def counted(points, visits, *rest):
        seen[-1] += visits.count()
        return meet(points, visits, *rest)

    monkeypatch.setattr(tree, "meet", counted)
    rng = np.random.default_rng(9)
    for n in (400, 1600):
        seen.append(0)
        x = rng.random((n, 2)) * np.sqrt(n)
        s = to_samples(spark, x)
        assert (found(knn(s, s, 3, 16), n, 3) == nearest(x, 3)).all()
        seen[-1] /= n
    # 25 and 100 leaves: all of them would be four times as many.
    assert seen[0] < 12 and seen[1] < 1.5 * seen[0]


def test_tree_with_a_crowded_leaf(spark):
    """Half the points lie far closer together than the blocks can tell apart."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(100, 3)) * 1e-7, rng.normal(size=(100, 3)) * 10])
    s = to_samples(spark, x)
    t = knn(s, s, 4, 8).toPandas().sort_values(["sample_id", "rank"])
    d = np.sort(distances(x), axis=1)[:, 1:5]
    assert np.allclose(t["dist"].to_numpy().reshape(200, 4), d, rtol=1e-9)


def test_cheapest_merge_is_exact(spark):
    rng = np.random.default_rng(6)
    x, w = rng.normal(size=(150, 3)) * 4, rng.integers(1, 50, 150).astype(float)
    rows = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, w))],
                                 "qid long, features array<double>, w double")
    cost = distances(x) ** 2 * (w[:, None] * w[None] / (w[:, None] + w[None]))
    np.fill_diagonal(cost, np.inf)
    for block_rows in (2048, 6):
        got = cheapest(rows, rows.withColumnRenamed("qid", "pid"), 2, True, True, block_rows).toPandas()
        got = got.sort_values(["qid", "rank"])
        assert (got["pid"].to_numpy().reshape(150, 2) == np.argsort(cost, axis=1)[:, :2]).all()


def test_hashed_search_finds_most_neighbours(spark):
    x, _ = blobs(800, 12, 6, seed=2, spread=1.0)
    s = to_samples(spark, x)
    want = nearest(x, 5)
    got = found(knn(s, s, 5, 40, mode="lsh"), 800, 5)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(got, want)]) >= 0.9
    assert (found(knn(s, s, 5, mode="lsh"), 800, 5) == want).all()  # one cell
    with pytest.raises(ValueError):
        knn(s, s, 5, mode="other")


def test_knn_of_nothing_and_of_one(spark):
    s = to_samples(spark, np.ones((3, 2)))
    for mode in ("exact", "lsh"):
        assert knn(s, s.limit(0), 2, mode=mode).count() == 0
        assert knn(s.limit(0), s, 2, mode=mode).count() == 0
        assert sorted((r.sample_id, r.neighbor_id) for r in knn(s, s, 1, mode=mode).collect()) == [(0, 1), (1, 0), (2, 0)]


def test_affinity_is_symmetric_and_counts_directions(spark):
    x, _ = blobs(60)
    w = np.zeros((60, 60))
    for r in knn_affinity(to_samples(spark, x)).collect():
        w[r.i, r.j] = r.w
    a = np.zeros((60, 60))
    for i, near in enumerate(nearest(x, 9)):
        a[i, near] = 1
    assert np.allclose(w, (a + a.T) / 2)


def test_classify_knn_ties_take_the_smallest_label(spark):
    x = np.array([[0.0], [1.0], [-1.0], [2.0], [-2.0], [0.1]])
    train = to_samples(spark, x[1:5], cluster=np.array([1, 0, 1, 0]))
    test = to_samples(spark, x[:1], cluster=np.array([0]))
    assert vector(classify_knn(train, test, 4), "predicted").tolist() == [0]


@pytest.mark.parametrize("block_rows", [2048, 12])
def test_impute_equals_brute_force(spark, block_rows):
    x, _ = blobs(70, 3, 6)
    x[np.random.default_rng(3).random(x.shape) < 0.1] = np.nan
    got = knn_impute_samples(to_samples(spark, x), 5, block_rows)
    assert np.allclose(np.array(vector(got, "features").tolist()), impute(x, 5))


def test_imputation_visits_few_leaves_at_random_gaps(spark, monkeypatch):
    """One value in a hundred is missing, so hardly any feature is whole in a leaf."""
    seen = []

    def counted(points, visits, *rest):
        seen.append(visits.count())
        return meet(points, visits, *rest)

    monkeypatch.setattr(tree, "meet", counted)
    x, _ = blobs(600, 12, 8, seed=5)
    x[np.random.default_rng(3).random(x.shape) < 0.01] = np.nan
    receivers = np.isnan(x).any(1).sum()
    got = knn_impute_samples(to_samples(spark, x), 5, 25)
    assert np.allclose(np.array(vector(got, "features").tolist()), impute(x, 5))
    assert receivers > 30 and sum(seen) / receivers < 12  # half of the 24 leaves


def test_gap_bounds_hold():
    rng = np.random.default_rng(8)
    x, donors, pivots = (rng.normal(size=(n, 6)) * 3 for n in (40, 200, 5))
    x[rng.random(x.shape) < 0.2] = np.nan
    donors[rng.random(donors.shape) < 0.2] = np.nan
    d2 = pivot_distances(donors, pivots)
    leaf = d2.argmin(1)
    radius = np.array([np.sqrt(d2[leaf == c, c].max()) for c in range(5)])
    most = np.array([np.isnan(donors[leaf == c]).sum(1).max() for c in range(5)])
    low = gap_bounds(x, np.ones(40), pivots, radius, -most.astype(float))
    for i in range(40):
        both = ~np.isnan(x[i]) & ~np.isnan(donors)
        cost = (np.where(both, x[i] - donors, 0) ** 2).sum(1) * 6 / np.maximum(both.sum(1), 1)
        for c in range(5):
            able = (leaf == c) & both.any(1)
            assert low[i, c] <= cost[able].min() + 1e-9
    assert (low > 0).any()


def test_impute_copies_and_hopeless_gaps(spark):
    x = with_copies(45)
    x[:5, 1] = np.nan  # copies with the same gap
    x[44] = np.nan
    x[44, 0] = 3.0
    x[:44, 0] = np.nan  # row 44 shares no feature with any other
    got = np.array(vector(knn_impute_samples(to_samples(spark, x), 3), "features").tolist())
    assert np.allclose(got, impute(x, 3))


def rows_of(x, key, ids, w=1.0):
    return pd.DataFrame({key: ids, "features": list(x), "w": w})


def sorted_rows(df, cols):
    return df.sort_values(cols).reset_index(drop=True)[cols]


@pytest.mark.parametrize("kind", ["noise", "offset", "far", "ties", "tiny"])
@pytest.mark.parametrize("ward", [False, True])
def test_sides_find_what_a_block_pair_does(monkeypatch, kind, ward):
    """Single precision rules pairs out, but costs and ties are those of the differences."""
    for module in (neighbors, grid):
        for name, value in (("QUERY_STEP", 64), ("POINT_STEP", 128)):
            monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(9)
    noise = rng.normal(size=(600, 5))
    x = {"noise": noise, "offset": noise + 1e6, "ties": rng.integers(0, 4, (600, 5)).astype(float), "tiny": noise * 1e-200,
         "far": np.where(np.arange(600)[:, None] < 300, noise, noise * 1e-3 + 1e5)}[kind]
    ids, w = rng.permutation(600) * 3, rng.integers(1, 5, 600).astype(float)
    points, queries = rows_of(x, "pid", ids, w), rows_of(x[:150], "qid", ids[:150], w[:150])
    for k, skip_self in ((1, True), (4, False)):
        want = best_kernel(k, ward, skip_self)(points, queries)
        cols = ["qid", "cost", "pid"]
        assert sorted_rows(side_kernel(k, ward, skip_self)(points, queries), cols).equals(sorted_rows(want, cols))


@pytest.mark.parametrize("point_bytes", [48 << 20, 900])
@pytest.mark.parametrize("pays", [True, False])
def test_knn_by_sides_or_tree_is_the_same(spark, monkeypatch, point_bytes, pays):
    """Many points: a tree is tried, and used if it pays."""
    monkeypatch.setattr(neighbors, "FEW_BLOCKS", 1)
    monkeypatch.setattr(neighbors, "QUERY_SIDES", 10**6 if pays else -1)
    monkeypatch.setattr(grid, "POINT_BYTES", point_bytes)
    monkeypatch.setattr(grid, "SIDE_QUERIES", 20)
    x, _ = blobs(120)
    s = to_samples(spark, x)
    assert (found(knn(s, s, 4, 16), 120, 4) == nearest(x, 4)).all()


def test_rows_sent_don_t_grow_with_the_leaves():
    """615,000 vectors of 64 numbers are 301 leaves, each of which a query without bounds would go to."""
    queries, points = grid.n_sides(615_000, 615_000, 512)
    assert queries + points <= 40 and 615_000 * 512 / points <= 64 << 20


@pytest.mark.parametrize("kind", ["noise", "many", "offset", "ties"])
def test_sides_fill_gaps_as_a_block_pair_does(monkeypatch, kind):
    for module in (impute_module, grid):
        for name, value in (("QUERY_STEP", 64), ("POINT_STEP", 128)):
            monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(10)
    x = rng.integers(0, 4, (500, 6)).astype(float) if kind == "ties" else rng.normal(size=(500, 6)) + 1e6 * (kind == "offset")
    x[rng.random(x.shape) < (0.6 if kind == "many" else 0.1)] = np.nan
    if kind == "many":  # few donors have one feature
        x[:, 3] = np.where(np.arange(500) % 100 == 7, x[:, 4], np.nan)
    ids = rng.permutation(500) * 3
    points, queries = rows_of(x, "pid", ids), rows_of(x[:150], "qid", ids[:150])
    cols = ["qid", "pos", "cost", "pid", "x"]
    assert sorted_rows(side_donors(5)(points, queries), cols).equals(sorted_rows(donor_kernel(5)(points, queries), cols))


@pytest.mark.parametrize("pays", [True, False])
def test_impute_by_sides_or_tree_is_the_same(spark, monkeypatch, pays):
    monkeypatch.setattr(impute_module, "FEW_BLOCKS", 1)
    monkeypatch.setattr(impute_module, "QUERY_SIDES", 10**6 if pays else -1)
    monkeypatch.setattr(grid, "POINT_BYTES", 900)
    x, _ = blobs(80)
    x[np.random.default_rng(6).random(x.shape) < 0.2] = np.nan
    got = vector(knn_impute_samples(to_samples(spark, x), 3, 16), "features")
    assert np.allclose(np.array(got.tolist()), impute(x, 3))


def test_texts_as_ids_are_no_chunks(monkeypatch):
    """Where pandas keeps texts in Arrow, parts one below the other are chunks, which a task can't return."""
    for module in (impute_module, neighbors, grid):
        for name, value in (("QUERY_STEP", 16), ("POINT_STEP", 32)):
            monkeypatch.setattr(module, name, value, raising=False)
    x, _ = blobs(60)
    gaps = np.where(np.random.default_rng(3).random(x.shape) < 0.2, np.nan, x)
    ids = np.array([f"A/{i}" for i in range(60)])
    with pd.option_context("future.infer_string", True):
        for kernel, at in ((side_kernel(2, False, True), x), (side_donors(3), gaps), (donor_kernel(3), gaps)):
            out = kernel(rows_of(at, "pid", ids), rows_of(at, "qid", ids))
            for col in ("qid", "pid"):
                assert isinstance(pa.Array.from_pandas(out[col], type=pa.string()), pa.Array)


def test_only_gaps_left_open_are_searched_again(monkeypatch):
    """Half of the values are missing: few gaps of a sample lack donors among its nearest."""
    full, again = donor_kernel(5), []

    def counted(points, queries, *asked):
        out = full(points, queries, *asked)
        again.append(len(out[["qid", "pos"]].drop_duplicates()))
        return out

    monkeypatch.setattr(impute_module, "donor_kernel", lambda k: counted)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 30))
    x[rng.random(x.shape) < 0.5] = np.nan
    got = side_donors(5)(rows_of(x, "pid", np.arange(400)), rows_of(x, "qid", np.arange(400)))
    cols = ["qid", "pos", "cost", "pid", "x"]
    want = full(rows_of(x, "pid", np.arange(400)), rows_of(x, "qid", np.arange(400)))
    assert sorted_rows(got, cols).equals(sorted_rows(want, cols))
    assert sum(again) < 0.02 * np.isnan(x).sum()
