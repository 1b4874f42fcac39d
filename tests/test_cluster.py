import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from coterie.operators import cluster, consensus, kmeans as km, validate
from coterie.operators.cluster import spectral, spectral_embedding, ward
from coterie.operators.consensus import (
    coassociation, consensus_features, fuzzy_consensus, fuzzy_ensemble, hard_ensemble, wide_labels,
)
from coterie.operators.fuzzy import fuzzy_cmeans, with_start
from coterie.operators.labels import canonical as canonical_df, defuzzify
from coterie.operators.neighbors import knn_affinity

import helpers as h


@pytest.fixture(scope="module")
def planted(spark):
    x, truth = h.blobs(90, 3, 5)
    return x, h.canonical(truth), h.to_samples(spark, x).persist()


@pytest.mark.parametrize("method", [
    lambda s: km.kmeans(s, 3, n_init=3), lambda s: ward(s, 3), lambda s: spectral(s, 3, n_init=3),
    lambda s: canonical_df(defuzzify(fuzzy_cmeans(s, 3).memberships(s))),
    lambda s: hard_ensemble(s, 3, n_init=3), lambda s: fuzzy_ensemble(s, 3, n_init=3),
], ids=["kmeans", "ward", "spectral", "fuzzy", "hard_ensemble", "fuzzy_ensemble"])
def test_planted_clusters_are_found(planted, method):
    _, truth, s = planted
    assert (h.vector(method(s)) == truth).all()


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("k", [2, 4])
def test_ward_equals_greedy_merging(spark, seed, k):
    x = np.random.default_rng(seed).normal(size=(40, 3))
    assert (h.vector(ward(h.to_samples(spark, x), k)) == h.greedy_ward(x, k)).all()


def test_ward_rounds_equal_greedy_merging(spark):
    """Merging rounds on Spark, with the neighbour search pruned by a tree of leaves."""
    x = np.random.default_rng(5).normal(size=(40, 3))
    got = ward(h.to_samples(spark, x), 3, top_rows=15, block_rows=12)
    assert (h.vector(got) == h.greedy_ward(x, 3)).all()


@pytest.mark.parametrize("seed", [0, 1])
def test_ward_with_ties_is_the_same_wherever_rounds_run(spark, seed):
    x = np.random.default_rng(seed).integers(0, 4, (24, 2)).astype(float)
    s = h.to_samples(spark, x).persist()
    here = h.vector(ward(s, 3))
    assert (h.vector(ward(s.repartition(5), 3, top_rows=1 + 9 * seed, block_rows=64)) == here).all()


def test_ward_undoes_costly_merges_of_early_rounds(spark):
    """Two far outliers pair up early, yet their merge is the costliest."""
    x = np.vstack([np.random.default_rng(2).normal(size=(20, 2)), [[1000.0, 0], [2000.0, 0]]])
    got = ward(h.to_samples(spark, x), 3, top_rows=12, block_rows=64)
    assert (h.vector(got) == h.greedy_ward(x, 3)).all()


def test_ward_with_copies(spark):
    x = h.with_copies(45)
    assert (h.vector(ward(h.to_samples(spark, x), 3)) == h.greedy_ward(x, 3)).all()


def test_ward_on_texts_as_ids_and_on_few_rows(spark):
    x, truth = h.blobs(90, 3, 3)
    named = h.to_samples(spark, x).withColumn("sample_id", F.format_string("s%03d", "sample_id"))
    assert (h.vector(ward(named, 3)) == h.canonical(truth)).all()
    assert ward(named.limit(0), 3).count() == 0
    assert h.vector(ward(named.limit(2), 3)).tolist() == [0, 1]
    assert h.vector(ward(named, 1)).tolist() == [0] * 90
    with pytest.raises(ValueError):
        ward(named, 3, mode="other")


def test_ward_from_clustering_features(spark):
    """Weights and means of a few dozen leaves lead to the planted clusters."""
    x, truth = h.blobs(300, 4, 4, seed=3)
    s = h.to_samples(spark, np.vstack([x, np.repeat(x[:1], 150, 0)]))
    truth = np.append(truth, np.repeat(truth[0], 150))
    member, summaries = cluster.clustering_features(
        s.groupBy("features").agg(F.min("sample_id").alias("id"), F.count("*").cast("double").alias("w")), 300, 40)
    rows = summaries.collect()
    assert 20 <= len(rows) <= 80 and sum(r.w for r in rows) == 450 and member.count() == 300
    whole = sum(r.w * np.array(r.features) for r in rows) / 450
    assert np.allclose(whole, np.vstack([x, np.repeat(x[:1], 150, 0)]).mean(0))
    assert (h.vector(ward(s, 4, mode="summaries", summaries=50)) == h.canonical(truth)).all()


@pytest.mark.parametrize(("nodes", "edges"), [(cluster.BLOCK_NODES, cluster.EDGES_PER_ROW), (7, 10)])
def test_spectral_iteration_matches_dense_eigenvectors(spark, monkeypatch, nodes, edges):
    """One block, and many blocks with their edges dealt over several rows."""
    monkeypatch.setattr(cluster, "BLOCK_NODES", nodes)
    monkeypatch.setattr(cluster, "EDGES_PER_ROW", edges)
    x, _ = h.blobs(60, 1, 2, spread=2.0)
    s = h.to_samples(spark, x)
    edges = knn_affinity(s).persist()
    w = np.zeros((60, 60))
    for r in edges.collect():
        w[r.i, r.j] = r.w
    deg = w.sum(1)
    lam, q = np.linalg.eigh(w / np.sqrt(deg[:, None] * deg[None]))
    want = (q[:, ::-1][:, :3] / np.sqrt(deg)[:, None])
    got = np.array(h.vector(spectral_embedding(edges, s, 3), "features").tolist())
    for c in range(3):
        cos = abs(got[:, c] @ want[:, c]) / np.linalg.norm(got[:, c]) / np.linalg.norm(want[:, c])
        assert cos > 0.999


def test_spectral_embedding_of_a_star_and_a_lone_node(spark, monkeypatch):
    """A hub that a third of all edges meet, and a node without any."""
    monkeypatch.setattr(cluster, "BLOCK_NODES", 8)
    monkeypatch.setattr(cluster, "EDGES_PER_ROW", 5)
    links = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 29)]
    edges = spark.createDataFrame([(a, b, 1.0) for i, j in links for a, b in ((i, j), (j, i))], "i long, j long, w double")
    s = h.to_samples(spark, np.zeros((31, 1)))
    got = np.array(h.vector(spectral_embedding(edges, s, 2), "features").tolist())
    a = np.zeros((31, 31))
    for i, j in links:
        a[i, j] = a[j, i] = 1
    size = np.sqrt(np.where(a.sum(1) > 0, a.sum(1), 1))
    lam, q = np.linalg.eigh(a / size[:, None] / size[None])
    want = q[:, ::-1][:, :2] / size[:, None]
    for c in range(2):
        assert abs(got[:, c] @ want[:, c]) / np.linalg.norm(got[:, c]) / np.linalg.norm(want[:, c]) > 0.999


def test_kmeans_weights_count_as_copies(spark):
    x, _ = h.blobs(30, 2, 3)
    w = np.where(np.arange(30) == 0, 50, 1)
    weighted = km.kmeans_centres(h.to_samples(spark, x, w=w), [2], n_init=3)[2]
    copied = km.kmeans_centres(h.to_samples(spark, np.vstack([x, np.repeat(x[:1], 49, 0)])), [2], n_init=3)[2]
    assert np.allclose(sorted(weighted.tolist()), sorted(copied.tolist()))


def test_kmeans_on_fewer_distinct_points_than_clusters(spark):
    s = h.to_samples(spark, np.ones((10, 2)))
    assert set(h.vector(km.kmeans(s, 3, n_init=2))) == {0}


def test_kmeans_centres_are_a_fixed_point(planted):
    x, _, s = planted
    c = km.kmeans_centres(s, [3], n_init=2)[3]
    own = h.distances(x, c).argmin(1)
    assert np.allclose(c, [x[own == j].mean(0) for j in range(3)], atol=1e-2)


def test_fuzzy_equals_twin(spark):
    x, _ = h.blobs(60, 3, 4, spread=3.0)
    s = h.to_samples(spark, x)
    u0 = np.array(h.vector(with_start(s, 3, 42), "u0").tolist())
    u, c = h.fuzzy(x, u0)
    fit = fuzzy_cmeans(s, 3)
    assert np.allclose(fit.centres, c)
    got = np.array(h.vector(fit.memberships(s), "u").tolist())
    assert np.allclose(got, u) and np.allclose(got.sum(1), 1)
    assert np.isclose(fit.partition_coefficient, (u**2).sum() / 60)


def runs_of(spark, n=80, k=3, r=4, seed=0):
    runs = np.random.default_rng(seed).integers(0, k, size=(r, n))
    rows = [(i, s, int(c)) for i, run in enumerate(runs) for s, c in enumerate(run)]
    return runs, spark.createDataFrame(rows, "run int, sample_id long, cluster int")


def test_compressed_coassociation_is_the_full_matrix(spark):
    runs, df = runs_of(spark)
    full = h.coassociation(runs)
    sig = h.vector(wide_labels(df), "sig")
    co = {(tuple(r.sig_i), tuple(r.sig_j)): r.co for r in coassociation(df).collect()}
    got = np.array([[co.get((tuple(a), tuple(b)), 0.0) for b in sig] for a in sig])
    assert np.allclose(got, full) and np.allclose(np.diag(got), 1) and np.allclose(got, got.T)


@pytest.mark.parametrize("weights", [[1, 1, 1, 1], [5, 1, 1, 2]])
def test_consensus_coordinates_keep_distances_of_the_scaled_matrix(spark, weights):
    runs, df = runs_of(spark)
    full = h.minmax(h.coassociation([r for r, w in zip(runs, weights) for _ in range(w)]))
    at = {tuple(r.sig): np.array(r.features) for r in consensus_features(df, weights).collect()}
    z = np.array([at[tuple(s)] for s in h.vector(wide_labels(df), "sig")])
    assert np.allclose(h.distances(z), h.distances(full), atol=1e-8)


def test_fuzzy_consensus_does_not_depend_on_partitions(spark):
    x, truth = h.blobs(60)
    runs, df = runs_of(spark, 60, 3, 3)
    df = spark.createDataFrame([(r, s, int(truth[s] if r < 2 else runs[2][s])) for r in range(3) for s in range(60)],
                               "run int, sample_id long, cluster int")
    a = h.vector(fuzzy_consensus(df, 3, [2.0, 1.0, 1.0]))
    b = h.vector(fuzzy_consensus(df.repartition(5), 3, [2.0, 1.0, 1.0]))
    assert (a == b).all() and (a == h.canonical(truth)).all()


def test_the_top_of_the_tree_grows_with_the_vectors_and_is_bounded(spark, monkeypatch):
    assert [cluster.top_of_tree(n) for n in (100, 1000, 5000, 10**6)] == [512, 512, 2500, 4096]
    x = np.random.default_rng(5).normal(size=(60, 3))
    s, kernel = h.to_samples(spark, x), cluster.best_kernel
    asked, on_spark = [], []

    def counted(*a, **options):
        inner = kernel(*a, **options)

        def run(points, queries):
            asked.append(len(queries))
            return inner(points, queries)

        return run

    round_of = cluster._merge_round
    monkeypatch.setattr(cluster, "best_kernel", counted)
    monkeypatch.setattr(cluster, "_merge_round", lambda *a: on_spark.append(a[1]) or round_of(*a))
    monkeypatch.setattr(cluster, "TOP_ROWS", 4)
    monkeypatch.setattr(cluster, "TOP_STEP", 8)
    got = h.vector(cluster.ward(s, 3, block_rows=64))
    assert on_spark and min(on_spark) > 30 and max(asked) <= 8
    assert (got == h.greedy_ward(x, 3)).all()


def test_a_multiplication_shuffles_only_what_is_sent(spark):
    sc = spark.sparkContext
    edge = (0, np.array([0, 0], "<i4").tobytes(), np.array([0, 1], "<i4").tobytes(), np.array([1, 0], "<i4").tobytes(),
            np.array([2.0, 3.0]).tobytes())
    v = np.array([[1.0], [10.0]]).tobytes()
    packed = sc.parallelize([(0, edge)]).partitionBy(2)
    state = sc.parallelize([(0, (2, v, v)), (1, (1, v[:8], v[:8]))]).partitionBy(2)
    grown = cluster._grow(packed, state, 1, 0, 2)
    assert grown.toDebugString().decode().count("+-(") == 3  # the two inputs, and what is sent
    found = {b: (n, np.frombuffer(new).tolist(), np.frombuffer(basis).tolist()) for b, (n, new, basis) in grown.collect()}
    assert found == {0: (2, [20.0, 3.0], [1.0, 20.0, 10.0, 3.0]), 1: (1, [0.0], [1.0, 0.0])}


@pytest.mark.parametrize("of", ["ensemble", "ablation"])
def test_base_clusterings_run_at_once(spark, monkeypatch, of):
    """None of the three waits for another one to end."""
    met = threading.Barrier(3, timeout=60)

    def run(samples, k, *_, **__):
        met.wait()
        return samples.select("sample_id", F.lit(0).alias("cluster"))

    module = consensus if of == "ensemble" else validate
    for name in ("kmeans", "ward", "spectral"):
        monkeypatch.setattr(module, name, run)
    s = h.to_samples(spark, h.blobs(12)[0])
    if of == "ensemble":
        assert consensus.base_runs(s, 2).groupBy("run").count().count() == 3
    else:
        assert list(validate.base_clusterings(s, 2)) == ["kmeans", "ward", "spectral"]


def test_few_blocks_of_vectors_are_multiplied_in_few_tasks(spark, monkeypatch):
    seen = []
    grow = cluster._grow

    def counted(packed, state, p, j, n_parts):
        seen.append(n_parts)
        return grow(packed, state, p, j, n_parts)

    monkeypatch.setattr(cluster, "_grow", counted)
    monkeypatch.setattr(cluster, "BLOCK_NODES", 40)
    x, _ = h.blobs(120)
    cluster.spectral_embedding(cluster.knn_affinity(h.to_samples(spark, x), 4), h.to_samples(spark, x), 3)
    assert set(seen) == {1}


def test_blocks_of_vectors_grow_with_the_nodes(spark, monkeypatch):
    """What blocks send each other follows the tasks, not the square of the nodes."""
    assert cluster._layout(500, 400, 8) == (1, 1)
    assert [cluster._layout(n, 400, 8) for n in (50_000, 600_000)] == [(8, 8), (18, 18)]
    assert cluster._layout(600_000, 40_000, 8)[0] > 900  # a basis this wide needs smaller blocks
    seen, numbered = [], cluster._numbered
    monkeypatch.setattr(cluster, "_numbered", lambda *a: seen.append(numbered(*a)) or seen[-1])
    monkeypatch.setattr(cluster, "BLOCK_NODES", 4)
    x, _ = h.blobs(160)
    s = h.to_samples(spark, x)
    got = h.vector(cluster.spectral_embedding(knn_affinity(s, 4), s, 2), "features")
    n = len(x)
    assert len(got) == n and seen[0].select("block").distinct().count() == cluster._layout(n, 8 * 10 * 4, 8)[0] <= 8


def test_points_are_sent_to_few_sides_of_queries():
    from coterie.plans.grid import n_sides

    assert n_sides(600, 2_000, 400) == (2, 1) and n_sides(50_000, 50_000, 400) == (24, 1)
    assert n_sides(60_000, 600_000, 400) == (3, 10)  # 24 sides of queries before
    assert n_sides(600_000, 600_000, 400) == (10, 10) and n_sides(60_000, 600_000, 400, 64)[0] == 20
