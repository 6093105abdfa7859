"""Iterative work on one session: belief propagation, clustering, purity.

A session has a few hundred utterances whatever the size of the corpus, so Spark
deals sessions to tasks and a short array kernel does one. Groups of other kinds
don't belong here.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = -50.0


def _normalised(log: np.ndarray) -> np.ndarray:
    e = np.exp(log - log.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def propagate(phi: np.ndarray, left: np.ndarray, right: np.ndarray, same: np.ndarray, different: np.ndarray, sweeps: int = 10, most: int = 30, damping: float = 0.5, tolerance: float = 1e-4) -> tuple[np.ndarray, str]:
    """Marginals of a pairwise model whose edges only tell equal from unequal; by damped messages, or mean field if they don't settle."""
    if not len(left):
        return _normalised(phi), "bp"
    p, settled = propagate_all(phi, left, right, same, different, np.array([len(phi)]), sweeps, most, damping, tolerance)
    return p, "bp" if settled[0] else "mean_field"


def propagate_all(phi: np.ndarray, left: np.ndarray, right: np.ndarray, same: np.ndarray, different: np.ndarray, sizes: np.ndarray, sweeps: int = 10, most: int = 30, damping: float = 0.5, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """``propagate`` for many models at once, whose nodes follow each other: model m has ``sizes[m]`` of them, one at least, and edges stay within a model.

    (marginals, whether messages settled, by model). A model is taken out as soon as it
    settles, and a node's messages are added in its own edges' order, so that each model
    has the very numbers it has alone.
    """
    out, settled = np.empty(phi.shape), np.zeros(len(sizes), bool)
    k = phi.shape[1]
    own = np.repeat(np.arange(len(sizes)), sizes)  # whose node it is
    rows, message, before = np.arange(len(phi)), None, None

    def at_nodes(nodes: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        return np.column_stack([np.bincount(nodes, x[:, c], n) for c in range(k)])

    def edges() -> tuple:
        both = np.concatenate([left, right]), np.concatenate([right, left]), np.concatenate([np.arange(len(left)) + len(left), np.arange(len(left))])
        return *both, np.exp(np.tile(same, 2)[:, None]), np.exp(np.tile(different, 2)[:, None])

    def keep(stays: np.ndarray) -> None:
        """Only these models' nodes and edges are left."""
        nonlocal phi, left, right, same, different, own, rows, message, before
        node = stays[own]
        edge = node[left]
        place = np.cumsum(node) - 1
        message = message[np.tile(edge, 2)]
        left, right, same, different = place[left[edge]], place[right[edge]], same[edge], different[edge]
        phi, own, rows, before = phi[node], own[node], rows[node], before[node]

    src, dst, back, s, d = edges()
    message = np.zeros((len(src), k))
    for sweep in range(1, most + 1):
        base = (phi + at_nodes(dst, message, len(phi)))[src] - message[back]
        top = base.max(1, keepdims=True)
        e = np.exp(base - top)
        # all others differ, this one is equal: scaled by the largest of the row
        fresh = np.log(np.maximum((e.sum(1, keepdims=True) - e) * d + e * s, 1e-300)) + top
        message = damping * message + (1 - damping) * fresh
        p = _normalised(phi + at_nodes(dst, message, len(phi)))
        if before is not None and sweep >= sweeps:
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            still = np.maximum.reduceat(np.abs(p - before).max(1), starts) <= tolerance
            done = np.zeros(len(sizes), bool)
            done[own[starts]] = still
            if still.any():
                out[rows[done[own]]] = p[done[own]]
                settled |= done
                before = p
                keep(~done)
                if not len(phi):
                    return out, settled
                src, dst, back, s, d = edges()
                continue
        before = p
    q = np.full(phi.shape, 1 / k)
    for _ in range(50):
        near = q[dst] * s + (1 - q[dst]) * d
        q = damping * q + (1 - damping) * _normalised(phi + at_nodes(src, np.log(np.maximum(near, 1e-12)), len(phi)))
    out[rows] = q
    return out, settled


def posteriors(potentials: DataFrame, edges: DataFrame) -> DataFrame:
    """potentials (session_id, ref, candidate, log_phi), edges (session_id, i, j, log_same, log_diff) to (session_id, ref, candidate, p, method)."""

    def run(key, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        wide = nodes.pivot_table(index="ref", columns="candidate", values="log_phi", fill_value=MISSING)
        if wide.empty:
            return pd.DataFrame(columns=["session_id", "ref", "candidate", "p", "method"])
        at = {r: i for i, r in enumerate(wide.index)}
        ok = links[links["i"].isin(at) & links["j"].isin(at) & (links["i"] != links["j"])].sort_values(["i", "j"])
        p, method = propagate(wide.to_numpy(float), ok["i"].map(at).to_numpy(int), ok["j"].map(at).to_numpy(int), ok["log_same"].to_numpy(float), ok["log_diff"].to_numpy(float))
        out = pd.DataFrame(p, index=wide.index, columns=wide.columns).stack().rename("p").reset_index()
        return out.assign(session_id=key[0], method=method)[["session_id", "ref", "candidate", "p", "method"]]

    kind = {c: potentials.schema[c].dataType.simpleString() for c in ("session_id", "ref")}
    return potentials.groupBy("session_id").cogroup(edges.groupBy("session_id")).applyInPandas(run, f"session_id {kind['session_id']}, ref {kind['ref']}, candidate string, p double, method string")


def _units(vectors: pd.Series) -> np.ndarray:
    return _units_of(vectors.to_numpy())


def _units_of(vectors) -> np.ndarray:
    x = np.vstack(vectors).astype(float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def upgma(distance: np.ndarray, k: int | None = None, threshold: float | None = None) -> list[int]:
    """Average linkage until k clusters are left or the nearest two are farther than threshold; numbered by first member.

    Of equally near pairs the first is merged, row by row. Every row keeps its
    nearest; a merge only moves the distances to one row, so only rows that lose
    their nearest by it are looked through again.
    """
    n = len(distance)
    if n < 2:
        return [0] * n
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, of, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    near = d.argmin(1)
    best = d[np.arange(n), near]
    live = n
    while live > 1 and (k is None or live > k):
        first = int(best.argmin())
        if threshold is not None and best[first] > threshold:
            break
        i, j = sorted((first, int(near[first])))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[i] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        of[of == of[j]] = of[i]
        alive[j], best[j] = False, np.inf
        live -= 1
        others = alive.copy()
        others[i] = False
        nearer = others & ((row < best) | ((row == best) & (i <= near)))
        lost = others & ~nearer & ((near == i) | (near == j))
        near[nearer], best[nearer] = i, row[nearer]
        for r in (*np.flatnonzero(lost), i):
            near[r] = d[r].argmin()
            best[r] = d[r, near[r]]
    numbers: dict[int, int] = {}
    return [numbers.setdefault(int(c), len(numbers)) for c in of]


def kmeans(x: np.ndarray, k: int, restarts: int = 10, most: int = 100, seed: int = 0) -> list[int]:
    """Spherical k-means of unit rows: evenly spread seeds first, then random ones; the first best restart wins."""
    n, best, found = len(x), -np.inf, None
    k = min(k, n)
    source = random.Random(seed)
    for restart in range(restarts):
        picks = [i * n // k for i in range(k)] if restart == 0 else source.sample(range(n), k)
        c, labels = x[picks].copy(), None
        for _ in range(most):
            now = (x @ c.T).argmax(1)
            if labels is not None and (now == labels).all():
                break
            labels = now
            for j in range(k):
                if (labels == j).any():
                    m = x[labels == j].mean(0)
                    c[j] = m / (np.linalg.norm(m) or 1)
        score = float((x * c[labels]).sum())
        if score > best + 1e-12:
            best, found = score, labels
    first: dict[int, int] = {}
    return [first.setdefault(int(c), len(first)) for c in found]


def clusters(obs: DataFrame, method: str, **setting) -> DataFrame:
    """(session_id, ref, cluster) by upgma (k or threshold) or kmeans (k, seed)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ref")
        x = _units(pdf["vector"])
        ids = upgma(np.clip(1 - x @ x.T, 0, 2), **setting) if method == "upgma" else kmeans(x, **setting)
        return pd.DataFrame({"session_id": pdf["session_id"], "ref": pdf["ref"], "cluster": ids})

    kind = {c: obs.schema[c].dataType.simpleString() for c in ("session_id", "ref")}
    return obs.select("session_id", "ref", "vector").groupBy("session_id").applyInPandas(run, f"session_id {kind['session_id']}, ref {kind['ref']}, cluster int")


def rand_index(a: list[int], b: list[int]) -> float:
    n = len(a)
    cells = np.zeros((max(a) + 1, max(b) + 1))
    np.add.at(cells, (a, b), 1)
    two = lambda v: float((v * (v - 1) / 2).sum())
    x, y, both, all_ = two(cells.sum(1)), two(cells.sum(0)), two(cells), n * (n - 1) / 2
    most, chance = (x + y) / 2, x * y / all_ if all_ else 0.0
    return 1.0 if n < 2 or most == chance else (both - chance) / (most - chance)


#: Fixed values of the purity gates.
MARGIN, MIN_MEMBERS, MIN_SECONDS, MOST, RESAMPLES, SHARE, ALIKE, STABLE, SEED = 0.10, 3, 10.0, 200, 20, 0.8, 0.8, 0.8, 20240914


def purity_of(x: np.ndarray, seconds: np.ndarray, p95: float) -> tuple[float, str, float, float]:
    """(purity, reason, separation, worst distance within): gates from the cheapest on, resampling last.

    Of more than MOST observations the longest ones are judged, as the fixed values say.
    """
    if len(x) < 2 * MIN_MEMBERS:
        return 1.0, "too_few_observations", 0.0, 1.0
    if len(x) > MOST:
        keep = np.sort(np.argsort(-seconds, kind="stable")[:MOST])
        x, seconds = x[keep], seconds[keep]
    side = np.array(kmeans(x, 2, seed=SEED))
    if side.max() == 0:
        return 1.0, "no_split_found", 0.0, 1.0
    parts = [x[side == s] for s in (0, 1)]
    middle = [p.mean(0) / (np.linalg.norm(p.mean(0)) or 1) for p in parts]
    sep = float(1 - middle[0] @ middle[1])
    within = max(1 - ((p.sum(0) @ p.sum(0)) - len(p)) / (len(p) * (len(p) - 1)) if len(p) > 1 else 0.0 for p in parts)
    spoken = [seconds[side == s].sum() for s in (0, 1)]
    for failed, reason in ((min(map(len, parts)) < MIN_MEMBERS, "lopsided_split"), (min(spoken) < MIN_SECONDS, "not_enough_speech"), (sep <= within + MARGIN, "no_margin"), (sep <= p95, "within_same_voice_range")):
        if failed:
            return 1.0, reason, sep, within
    source, stable = random.Random(SEED), 0
    for _ in range(RESAMPLES):
        some = sorted(source.sample(range(len(x)), max(2, int(round(SHARE * len(x))))))
        stable += rand_index(kmeans(x[some], 2, seed=SEED), side[some].tolist()) >= ALIKE
    share = stable / RESAMPLES
    return share, "impure" if share >= STABLE else "unstable_split", sep, within


def purity(obs: DataFrame, p95: float) -> DataFrame:
    """(session_id, label, purity, reason, sep, within) of each label's observations."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ref")
        value = purity_of(_units(pdf["vector"]), pdf["duration"].to_numpy(float), p95)
        return pd.DataFrame([(pdf["session_id"].iloc[0], pdf["label"].iloc[0], *value)], columns=["session_id", "label", "purity", "reason", "sep", "within"])

    kind = {c: obs.schema[c].dataType.simpleString() for c in ("session_id", "label")}
    return obs.select("session_id", "label", "ref", "vector", "duration").groupBy("session_id", "label").applyInPandas(run, f"session_id {kind['session_id']}, label {kind['label']}, purity double, reason string, sep double, within double")


def relabel(turns: DataFrame, clustered: DataFrame) -> DataFrame:
    """Turns (session_id, turn, start, end) take the cluster of their own vector, else of the clustered turn nearest in time, of equals the earlier.

    Two windows find the nearest on either side; nothing is compared pairwise.
    """
    from pyspark.sql.window import Window

    middle = (F.col("start") + F.col("end")) / 2
    marked = turns.join(clustered, ["session_id", "turn"], "left").withColumn("mid", middle)
    own = F.when(F.col("cluster").isNotNull(), F.struct("mid", "cluster"))
    w = Window.partitionBy("session_id").orderBy("mid", "turn")
    both = marked.withColumns({"before": F.last(own, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first(own, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    nearer = F.col("after").isNull() | (F.col("mid") - F.col("before.mid") <= F.col("after.mid") - F.col("mid"))
    return both.select("session_id", "turn", F.when(nearer, F.col("before.cluster")).otherwise(F.col("after.cluster")).alias("cluster"))
