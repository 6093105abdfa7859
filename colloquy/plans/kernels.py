"""Queries that run kernels per session, and the lifecycle."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from colloquy import adapters as A
from colloquy.operators import evidence as E
from colloquy.operators import kernels as K
from colloquy.operators import vectors as V
from colloquy.plans.evidence import _evidence, _obs, _prior
from colloquy.streaming import answers as W
from colloquy.streaming import lifecycle as L


def bp_posteriors(spark, sf_dir):
    nodes = _obs(spark, sf_dir).select("session_id", "ref", F.lit(0.5).alias("alpha"))
    phi = E.fuse(nodes, _evidence(spark, sf_dir), _prior(spark, sf_dir))
    edges = V.knn_edges(_obs(spark, sf_dir), 4).select("session_id", "i", "j", F.lit(math.log(0.7)).alias("log_same"), F.lit(math.log(0.3)).alias("log_diff"))
    return K.posteriors(phi, edges).select("session_id", "ref", "candidate", F.round("p", 5).alias("p"), "method")


def upgma(spark, sf_dir):
    return K.clusters(A.observations(spark, sf_dir), "upgma", k=5)


def kmeans(spark, sf_dir):
    return K.clusters(A.observations(spark, sf_dir), "kmeans", k=4, seed=7)


def purity(spark, sf_dir):
    found = K.purity(A.observations(spark, sf_dir), 0.9)
    return found.select("session_id", "label", F.round("purity", 3).alias("purity"), "reason", F.round("sep", 4).alias("sep"))


def relabel(spark, sf_dir):
    """Segments as turns; those whose number divides by three have a cluster, the rest take the nearest."""
    t = A.segments(spark, sf_dir).select("session_id", F.col("seg_idx").alias("turn"), "start", "end")
    return K.relabel(t, t.filter("turn % 3 = 0").select("session_id", "turn", (F.col("turn") / 3 % 4).cast("int").alias("cluster")))


def _requests(spark, sf_dir):
    """Event k of a session asks for the k-th status, but every fifth asks for another."""
    seg = A.segments(spark, sf_dir)
    names = F.array(*[F.lit(s) for s in L.STATUSES])
    n = F.when(F.col("seg_idx") % 5 == 4, (F.col("seg_idx") * 7 + F.col("session_id")) % 21).otherwise((F.col("seg_idx") - F.floor(F.col("seg_idx") / 5)) % 20 + 1)
    return seg.select("session_id", F.col("seg_idx").cast("long").alias("at"), F.element_at(names, (n % 21 + 1).cast("int")).alias("status"))


def session_lifecycle(spark, sf_dir):
    return L.replay(_requests(spark, sf_dir))


def _answers(spark, sf_dir):
    """Every fortieth observation of a session is answered in turn by its label, every 120th by nobody."""
    o = _obs(spark, sf_dir).filter("ref % 40 = 0")
    return o.select("session_id", F.col("ref").alias("seq"), "ref", F.when(F.col("ref") % 120 > 0, F.concat(F.lit("member:"), F.col("label").cast("string"))).alias("candidate"))


def answer_loop(spark, sf_dir):
    """What each answer of a review moves, belief kept from one to the next."""
    nodes = _obs(spark, sf_dir).select("session_id", "ref", F.lit(0.5).alias("alpha"))
    phi = E.fuse(nodes, _evidence(spark, sf_dir), _prior(spark, sf_dir))
    edges = V.knn_edges(_obs(spark, sf_dir), 1).select("session_id", "i", "j", F.lit(math.log(0.6)).alias("log_same"), F.lit(math.log(0.4)).alias("log_diff"), F.lit(0.75).alias("likeness"))
    moves = W.replayed(W.events_of(phi, edges, _answers(spark, sf_dir)))
    return moves.select("session_id", "seq", "ref", "candidate", F.round("p", 5).alias("p"), "asked", "ended")


QUERIES = {f.__name__: f for f in (answer_loop, bp_posteriors, upgma, kmeans, purity, relabel, session_lifecycle)}

_NAMES = ", ".join(f"'{s}'" for s in L.STATUSES)
_EDGES = ", ".join(f"'{e}'" for e in L.EDGES)
ORACLES = {
    "relabel": f"""WITH {A.SEGMENTS_SQL}, m AS (SELECT session_id, seg_idx AS turn, (start + "end") / 2 AS mid, CASE WHEN seg_idx % 3 = 0 THEN (seg_idx // 3) % 4 END AS cluster FROM segments),
      x AS (SELECT session_id, turn, mid, last_value(CASE WHEN cluster IS NOT NULL THEN (mid, cluster) END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY mid, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
        first_value(CASE WHEN cluster IS NOT NULL THEN (mid, cluster) END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY mid, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM m)
      SELECT session_id, turn, CASE WHEN a IS NULL OR mid - b[1] <= a[1] - mid THEN b[2] ELSE a[2] END AS cluster FROM x""",
    "session_lifecycle": f"""WITH RECURSIVE {A.SEGMENTS_SQL}, r AS (SELECT session_id, seg_idx, [{_NAMES}][(CASE WHEN seg_idx % 5 = 4 THEN (seg_idx * 7 + session_id) % 21 ELSE (seg_idx - seg_idx // 5) % 20 + 1 END) % 21 + 1] AS target FROM segments),
      fold(session_id, i, status, accepted, rejected) AS (SELECT DISTINCT session_id, 0::BIGINT, 'uploaded', 0, 0 FROM r UNION ALL
        SELECT f.session_id, i + 1, CASE WHEN status || '>' || target IN ({_EDGES}) THEN target ELSE status END, accepted + CASE WHEN status || '>' || target IN ({_EDGES}) THEN 1 ELSE 0 END, rejected + CASE WHEN status || '>' || target IN ({_EDGES}) THEN 0 ELSE 1 END
        FROM fold f JOIN r ON r.session_id = f.session_id AND r.seg_idx = f.i)
      SELECT session_id, status, accepted, rejected FROM fold QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY i DESC) = 1""",
}
