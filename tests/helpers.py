"""Small inputs and brute-force twins."""

import numpy as np


def blobs(n=120, k=3, d=5, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, d)) * 10
    truth = np.arange(n) % k
    return centres[truth] + rng.normal(size=(n, d)) * spread, truth


def with_copies(n=90, d=4, seed=1):
    """A third of all rows are one point."""
    x, _ = blobs(n, 3, d, seed)
    x[: n // 3] = x[0]
    return x


def to_samples(spark, x, **extra):
    rows = [(i, [None if np.isnan(v) else float(v) for v in r], *[int(c[i]) for c in extra.values()])
            for i, r in enumerate(x)]
    schema = "sample_id long, features array<double>" + "".join(f", {c} int" for c in extra)
    return spark.createDataFrame(rows, schema)


def to_labels(spark, labels, col="cluster"):
    return spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], f"sample_id long, {col} int")


def vector(df, col="cluster"):
    return df.select("sample_id", col).toPandas().sort_values("sample_id")[col].to_numpy()


def canonical(labels):
    seen = {}
    return np.array([seen.setdefault(int(c), len(seen)) for c in labels])


def distances(x, y=None):
    y = x if y is None else y
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))


def nearest(x, k):
    """Neighbours by (distance, id), the point itself left out."""
    d = distances(x)
    out = []
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (round(d[i, j], 9), j))
        out.append(order[:k])
    return np.array(out)


def greedy_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                na, nb = len(groups[a]), len(groups[b])
                c = na * nb / (na + nb) * ((x[groups[a]].mean(0) - x[groups[b]].mean(0)) ** 2).sum()
                if best is None or c < best[0]:
                    best = (c, a, b)
        _, a, b = best
        groups[a] += groups.pop(b)
    labels = np.empty(len(x), dtype=int)
    for g, members in enumerate(groups):
        labels[members] = g
    return canonical(labels)


def impute(x, k):
    out = x.copy()
    n, d = x.shape
    for i in range(n):
        for g in np.flatnonzero(np.isnan(x[i])):
            donors = []
            for j in range(n):
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if j != i and not np.isnan(x[j, g]) and both.any():
                    donors.append((((x[i, both] - x[j, both]) ** 2).sum() * d / both.sum(), j))
            best = [x[j, g] for _, j in sorted(donors)[:k]]
            out[i, g] = np.mean(best) if best else np.nanmean(x[:, g])
    return out


def coassociation(runs):
    runs = np.array(runs)
    return (runs[:, :, None] == runs[:, None, :]).mean(0)


def minmax(m):
    lo, hi = m.min(0), m.max(0)
    return (m - lo) / np.where(hi > lo, hi - lo, 1)


def fuzzy(x, u, m=2.0, error=0.005, passes=1000):
    """u: rows x clusters."""
    u = u / u.sum(1, keepdims=True)
    for _ in range(passes):
        um = u**m
        c = um.T @ x / um.sum(0)[:, None]
        d = np.maximum(distances(x, c), 1e-15)
        new = d ** (-2 / (m - 1))
        new /= new.sum(1, keepdims=True)
        if np.linalg.norm(new - u) < error:
            return new, c
        u = new
    return u, c


def silhouettes(x, labels):
    d = distances(x)
    out = []
    for i in range(len(x)):
        same = (labels == labels[i]) & (np.arange(len(x)) != i)
        if not same.any():
            out.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b))
    return np.array(out)
