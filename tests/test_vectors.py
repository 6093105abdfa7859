"""Similarity in blocks against plain numpy, whatever the block size."""

import numpy as np
import pytest

from colloquy.operators import vectors as V

OBS = "session_id long, ref long, label long, vector array<double>"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(s, 100 * s + i, i % 3, [float(x) for x in np.round(rng.normal(size=4), 1)]) for s, n in ((1, 25), (2, 9), (3, 1)) for i in range(n)]
    return out + [(1, 900, 0, [0.0] * 4), (1, 901, 0, out[0][3])]  # a zero vector and a tie


def cosines(rows, session):
    own = sorted(r for r in rows if r[0] == session)
    x = np.array([r[3] for r in own])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(n == 0, 1, n)
    return own, x @ x.T


@pytest.mark.parametrize("block", [1000, 7])
def test_blocks_are_plain(spark, rows, block):
    obs = spark.createDataFrame(rows, OBS)
    edges, close, base = {}, set(), {}
    for s in (1, 2, 3):
        own, c = cosines(rows, s)
        ids = [r[1] for r in own]
        distances = []
        for i in range(len(own)):
            best = sorted((j for j in range(len(own)) if j != i), key=lambda j: (-round(c[i, j], 9), ids[j]))[:2]
            edges |= {(s, min(ids[i], ids[j]), max(ids[i], ids[j])): round(c[i, j], 6) for j in best}
            for j in range(i + 1, len(own)):
                if round(c[i, j], 6) >= 0.5:
                    close.add((s, ids[i], ids[j]))
                if own[i][2] == own[j][2]:
                    distances.append(1 - c[i, j])
        if distances:
            base[s] = *(round(x, 6) for x in np.percentile(distances, [50, 95])), len(distances)
    assert {(r.session_id, r.i, r.j): round(r.cosine, 6) for r in V.knn_edges(obs, 2, block).collect()} == edges
    assert {(r.session_id, r.i, r.j) for r in V.pairs(obs, 0.5, block).collect()} == close
    assert {r.session_id: (round(r.p50, 6), round(r.p95, 6), r.n) for r in V.same_voice_baseline(obs, block).collect()} == base


def test_empty(spark):
    none = spark.createDataFrame([], OBS)
    assert V.knn_edges(none, 2).count() == 0 and V.pairs(none, 0.1).count() == 0 and V.same_voice_baseline(none).count() == 0
