import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coterie.operators.figures import cluster_ranks, silhouette_histogram
from coterie.operators.metrics import _added_up, _cluster_sums
from coterie.operators.metrics import adjusted_rand, davies_bouldin, evaluate, silhouette, silhouette_samples
from coterie.operators.validate import choose_k, train_test_split
from coterie.plans import blocks

import helpers as h


def test_silhouette_over_many_blocks(spark):
    x, truth = h.blobs(150, 3, 4, spread=4.0)
    labels = truth.copy()
    labels[7] = 9  # alone in its cluster
    got = silhouette_samples(h.to_samples(spark, x), h.to_labels(spark, labels), block_rows=20)
    assert np.allclose(h.vector(got, "silhouette"), h.silhouettes(x, labels))


def test_a_task_adds_up_what_its_blocks_find(spark):
    """A row per sample and cluster for a pair of sides, not for each of their blocks."""
    x, truth = h.blobs(120, 3, 4, spread=4.0)
    s = h.to_samples(spark, x, y=truth).select("sample_id", "features", F.array("y").alias("clusters"))
    sums = blocks.block_pairs(s, 120, 32, "sample_id", _cluster_sums, "sample_id long, run_at int, own int, cluster int, s double",
                              block_rows=10, min_sides=1, merge=_added_up)
    assert sums.count() == 120 * 3 * blocks.n_sides(120, 32, 10)


def test_linear_silhouette_equals_pairs(spark):
    x, truth = h.blobs(80, 3, 4, spread=4.0)
    x = np.vstack([x, np.repeat(x[:1], 40, 0)]) + 1e4
    labels = np.append(truth, np.repeat(truth[0], 40))
    labels[7] = 9  # alone in its cluster
    got = silhouette_samples(h.to_samples(spark, x), h.to_labels(spark, labels), metric="sqeuclidean")
    d = h.distances(x) ** 2
    want = []
    for i, c in enumerate(labels):
        means = {o: d[i, labels == o].sum() / max(1, (labels == o).sum() - (o == c)) for o in np.unique(labels)}
        b = min(v for o, v in means.items() if o != c)
        want.append(0.0 if (labels == c).sum() == 1 else (b - means[c]) / max(b, means[c]))
    assert np.allclose(h.vector(got, "silhouette"), want, atol=1e-6)
    with pytest.raises(ValueError):
        silhouette_samples(h.to_samples(spark, x), h.to_labels(spark, labels), metric="cosine")


def test_rows_are_sent_a_square_root_of_the_blocks_times(monkeypatch):
    assert [blocks.n_sides(n * 2048, 400) for n in (1, 4, 100, 2500)] == [1, 2, 10, 50]
    monkeypatch.setattr(blocks, "SIDE_BYTES", 1 << 20)
    assert blocks.n_sides(100 * 2048, 400) == 79  # a side must fit in memory


def test_silhouette_of_copies(spark):
    x = h.with_copies(60) + 1e5
    labels = np.arange(60) % 2
    got = silhouette_samples(h.to_samples(spark, x), h.to_labels(spark, labels))
    assert np.allclose(h.vector(got, "silhouette"), h.silhouettes(x, labels), atol=1e-6)


def test_degenerate_labels_give_null(spark):
    x, _ = h.blobs(12)
    s, y = h.to_samples(spark, x), h.to_labels(spark, np.arange(12) % 2, "y")
    for labels in (np.zeros(12), np.arange(12)):
        row = evaluate(s, h.to_labels(spark, labels), y).first()
        assert row.silhouette is None and row.davies_bouldin is None and row.ari is not None


def test_many_runs_equal_single_runs(spark):
    x, truth = h.blobs(60, spread=5.0)
    s, y = h.to_samples(spark, x), h.to_labels(spark, truth, "y")
    runs = [truth, np.arange(60) % 4]
    both = spark.createDataFrame([(r, i, int(c)) for r, lab in enumerate(runs) for i, c in enumerate(lab)],
                                 "run int, sample_id long, cluster int")
    many = {r.run: r for r in evaluate(s, both, y).collect()}
    for r, lab in enumerate(runs):
        one = evaluate(s, h.to_labels(spark, lab), y).first()
        for m in ("silhouette", "davies_bouldin", "ari"):
            assert np.isclose(many[r][m], one[m])
    assert np.isclose(silhouette(s, h.to_labels(spark, truth)).first()[0], h.silhouettes(x, truth).mean())
    assert davies_bouldin(s, h.to_labels(spark, truth)).first()[0] > 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=4, max_size=30))
def test_adjusted_rand_properties(spark, pairs):
    a, b = np.array(pairs).T
    ab = adjusted_rand(h.to_labels(spark, a, "y"), h.to_labels(spark, b)).first()[0]
    ba = adjusted_rand(h.to_labels(spark, b, "y"), h.to_labels(spark, a)).first()[0]
    renamed = adjusted_rand(h.to_labels(spark, a, "y"), h.to_labels(spark, 7 - a)).first()[0]
    assert np.isclose(ab, ba) and -1 <= ab <= 1 + 1e-9 and np.isclose(renamed, 1)


def test_choose_k_prefers_the_smaller_k_and_has_a_start_value(spark):
    pick = lambda rows: choose_k(spark.createDataFrame(rows, "k int, silhouette double")).first().k
    assert pick([(4, 0.5), (3, 0.5), (2, 0.1)]) == 3
    assert pick([(3, None), (4, None)]) == 2


def test_split_is_exact_at_any_prefix_depth(spark):
    x, _ = h.blobs(101)
    s = h.to_samples(spark, x)
    deep = train_test_split(s, small=1)
    assert deep.filter("is_test").count() == 31
    assert (h.vector(deep, "is_test") == h.vector(train_test_split(s), "is_test")).all()


def test_cluster_ranks_are_a_permutation_sorted_by_cluster(spark):
    labels = np.arange(50) % 4
    t = cluster_ranks(h.to_labels(spark, labels)).toPandas().sort_values("rank")
    assert t["rank"].tolist() == list(range(50)) and t["cluster"].is_monotonic_increasing


def test_histogram_of_one_value(spark):
    v = spark.createDataFrame([(0.25,)] * 3, "silhouette double")
    t = silhouette_histogram(v).toPandas()
    assert t["n"].sum() == 3 and len(t) == 20


def test_a_job_measures_distances_once_for_all_its_clusterings(spark, monkeypatch):
    """Once to choose k, once for the final clustering, the ablation and the figures."""
    from coterie.operators import metrics
    from coterie.plans import jobs

    calls, pairs = [], metrics.block_pairs
    monkeypatch.setattr(metrics, "block_pairs", lambda *a, **o: calls.append(1) or pairs(*a, **o))
    monkeypatch.setattr(jobs, "classifier_test", lambda *a: None)
    x, truth = h.blobs(40)
    s = h.to_samples(spark, x)
    y = spark.createDataFrame([(i, int(c)) for i, c in enumerate(truth)], "sample_id long, y int")
    out = jobs.analyse(s.select("sample_id", F.posexplode("features").alias("gene", "value")), y, n_init=2)
    assert out["silhouettes"].columns == ["sample_id", "cluster", "silhouette"]
    final = out["metrics"].first()
    want = metrics.evaluate(out["samples"], out["labels"], y).first()
    assert len(calls) == 3  # the last is this test's own
    assert final.asDict() == pytest.approx(want.asDict())
    rows = {r.method: r for r in out["ablation"].collect()}
    assert rows["Fuzzy Ensemble"].silhouette == pytest.approx(want.silhouette) and len(rows) == 4
