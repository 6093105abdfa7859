"""Kernels against plain versions and on clouds with known structure."""

import itertools
import math

import numpy as np

from colloquy.operators import kernels as K


def brute_force(phi, edges):
    n, k = phi.shape
    p = np.zeros((n, k))
    for x in itertools.product(range(k), repeat=n):
        w = math.exp(sum(phi[i, x[i]] for i in range(n)) + sum(s if x[i] == x[j] else d for i, j, s, d in edges))
        for i in range(n):
            p[i, x[i]] += w
    return p / p.sum(1, keepdims=True)


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(0)
    for _ in range(20):
        phi = rng.normal(size=(5, 3))
        edges = [(int(rng.integers(0, i)), i, *rng.normal(size=2)) for i in range(1, 5)]
        a = [np.array(x) for x in zip(*edges, strict=True)]
        p, method = K.propagate(phi, a[0].astype(int), a[1].astype(int), a[2], a[3], tolerance=1e-9, most=200)
        assert method == "bp"
        np.testing.assert_allclose(p, brute_force(phi, edges), atol=1e-5)


def test_no_edges_is_softmax():
    p, _ = K.propagate(np.log([[0.2, 0.8]]), *(np.array([], int),) * 2, *(np.array([]),) * 2)
    np.testing.assert_allclose(p, [[0.2, 0.8]])


def plain_upgma(d, k):
    groups = [[i] for i in range(len(d))]
    while len(groups) > k:
        best = min(((np.mean([d[a][b] for a in x for b in y]), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(groups), 2)), key=lambda t: t[0])
        groups[best[1]] += groups[best[2]]
        del groups[best[2]]
    of = {m: g for g, members in enumerate(groups) for m in members}
    first = {}
    return [first.setdefault(of[i], len(first)) for i in range(len(d))]


def test_upgma_is_the_plain_one():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.normal(size=(12, 4))
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        assert K.upgma(d, k=4) == plain_upgma(d, 4)


def cloud(directions, n, spread, seed=0):
    rng = np.random.default_rng(seed)
    x = np.vstack([np.eye(16)[d] + spread * rng.normal(size=(n, 16)) for d in directions])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_two_voices_are_impure_and_one_is_pure():
    assert K.purity_of(cloud([0, 1], 20, 0.05), np.full(40, 3.0), 0.2)[1] == "impure"
    assert K.purity_of(cloud([0], 40, 0.05), np.full(40, 3.0), 0.2)[1] in ("no_margin", "within_same_voice_range", "lopsided_split")
    assert K.purity_of(cloud([0, 1], 2, 0.05), np.full(4, 3.0), 0.2)[1] == "too_few_observations"


def test_kmeans_finds_clouds():
    labels = K.kmeans(cloud([0, 1, 2], 10, 0.05), 3)
    assert labels == [0] * 10 + [1] * 10 + [2] * 10


def test_posteriors_do_not_depend_on_row_order(spark):
    phi = spark.createDataFrame([(1, i, c, float((i * 3 + j) % 5)) for i in range(6) for j, c in enumerate("ab")], "session_id long, ref long, candidate string, log_phi double")
    edges = spark.createDataFrame([(1, i, i + 1, -0.3, -1.2) for i in range(5)], "session_id long, i long, j long, log_same double, log_diff double")
    get = lambda a, b: sorted((r.ref, r.candidate, round(r.p, 9)) for r in K.posteriors(a, b).collect())
    assert get(phi, edges) == get(phi.orderBy("log_phi").repartition(3), edges.orderBy("j"))


def test_many_models_at_once_are_each_alone():
    draw = np.random.default_rng(3)
    models = []
    for m in range(40):
        n, e = int(draw.integers(1, 9)), int(draw.integers(0, 14))
        # strong ties, of which some never settle
        same = draw.uniform(0.01, 0.99, e)
        models.append((draw.normal(size=(n, 3)) * 3, draw.integers(0, n, e), draw.integers(0, n, e), np.log(same), np.log(1 - same)))
    starts = np.cumsum([0, *[len(m[0]) for m in models[:-1]]])
    left, right = (np.concatenate([m[x] + s for m, s in zip(models, starts, strict=True)]) for x in (1, 2))
    p, settled = K.propagate_all(np.concatenate([m[0] for m in models]), left, right, *(np.concatenate([m[x] for m in models]) for x in (3, 4)), np.array([len(m[0]) for m in models]))
    for m, s, ok in zip(models, starts, settled, strict=True):
        alone, method = K.propagate(*m)
        assert (p[s : s + len(alone)] == alone).all() and ok == (method == "bp")
    assert settled.any() and not settled.all()
