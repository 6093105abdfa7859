"""Queries over voice embeddings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import adapters as A
from colloquy.operators import vectors as V

_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"


def _hits(spark, sf_dir, k=10):
    return V.top_prints(A.observations(spark, sf_dir), A.prints(spark, sf_dir), k)


HITS_SQL = f"""
WITH {A.OBSERVATIONS_SQL}, {A.PRINTS_SQL}, pairs AS (
  SELECT o.session_id, o.ref, p.id, p.candidate, o.label, {_COS.format('o.vector', 'p.vector')} AS cosine
  FROM observations o JOIN prints p ON p.session_id = o.session_id
), hits AS (SELECT *, row_number() OVER (PARTITION BY session_id, ref ORDER BY round(cosine, 9) DESC, id) AS rank FROM pairs QUALIFY rank <= 10)
"""


def cosine_topk(spark, sf_dir):
    return _hits(spark, sf_dir, 3).select("session_id", "ref", "id", "candidate", F.round("cosine", 5).alias("cosine"), "rank")


def nearest_select(spark, sf_dir):
    return V.select_nearest(_hits(spark, sf_dir), 8, 0.1).select("session_id", "ref", "id", F.round("cosine", 5).alias("cosine"), "rank")


def candidate_score(spark, sf_dir):
    return V.candidate_scores(_hits(spark, sf_dir), 2).select("session_id", "ref", "candidate", F.round("score", 5).alias("score"))


def label_score(spark, sf_dir):
    obs = A.observations(spark, sf_dir)
    return V.label_scores(V.candidate_scores(_hits(spark, sf_dir), 2), obs).select("session_id", "label", "candidate", F.round("score", 5).alias("score"))


def match_verdict(spark, sf_dir):
    """No hit or a short turn is pending; a score of at least 0.2 is taken over by itself."""
    best = _hits(spark, sf_dir, 1).join(A.observations(spark, sf_dir).select("session_id", "ref", "duration"), ["session_id", "ref"])
    status = F.when(F.col("duration") < 3, "pending").when(F.col("cosine") >= 0.2, "auto").otherwise("pending")
    return best.select("session_id", "ref", "candidate", F.round("cosine", 5).alias("cosine"), status.alias("status"))


def knn_edges(spark, sf_dir):
    return V.knn_edges(A.observations(spark, sf_dir), 3).select("session_id", "i", "j", F.round("cosine", 5).alias("cosine"))


def similar_pairs(spark, sf_dir):
    """Pairs of different labels that are more alike than a threshold."""
    return V.pairs(A.observations(spark, sf_dir), 0.25).filter(F.col("label_i") != F.col("label_j")).select("session_id", "i", "j", F.round("cosine", 5).alias("cosine"))


def centroids(spark, sf_dir):
    c = V.centroids(A.observations(spark, sf_dir), ["label"])
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 5).alias("x"))


def intra_cosine(spark, sf_dir):
    return V.intra_cosine(A.observations(spark, sf_dir), ["session_id", "label"]).select("session_id", "label", "n", F.round("intra", 5).alias("intra"))


def split_geometry(spark, sf_dir):
    obs = A.observations(spark, sf_dir).withColumn("half", F.col("label") % 2)
    return V.split_geometry(obs, "half").select("session_id", F.round("sep", 5).alias("sep"), F.round("within", 5).alias("within"), "n0", "n1")


def rand_index(spark, sf_dir):
    obs = A.observations(spark, sf_dir).withColumns({"a": F.col("label") % 3, "b": F.col("label") % 4})
    return V.rand_index(obs, ["session_id"], "a", "b").select("session_id", F.round("ari", 6).alias("ari"))


def voice_baseline(spark, sf_dir):
    return V.same_voice_baseline(A.observations(spark, sf_dir)).select("session_id", F.round("p50", 5).alias("p50"), F.round("p95", 5).alias("p95"), "n")


def merge_verdict(spark, sf_dir):
    """Labels of a session two by two: nearest first."""
    obs = A.observations(spark, sf_dir)
    c = V.centroids(obs, ["session_id", "label"])
    times = obs.groupBy("session_id", "label").agg(F.min("ref").alias("first"), F.max("ref").alias("last"))
    side = lambda s: c.join(times, ["session_id", "label"]).select("session_id", *[F.col(x).alias(f"{x}_{s}") for x in ("label", "centroid", "first", "last")])
    pairs = side("a").join(side("b"), "session_id").filter("label_a < label_b").withColumn("distance", 1 - V.cosine("centroid_a", "centroid_b"))
    apart = (F.col("last_a") < F.col("first_b")) | (F.col("last_b") < F.col("first_a"))
    verdict = V.merge_verdict(F.round("distance", 6), F.lit(0.95), (F.col("label_a") + F.col("label_b")) % 7 == 0, ~apart, F.col("label_a") == 0, F.col("label_b") - 2)
    return pairs.select("session_id", "label_a", "label_b", F.round("distance", 5).alias("distance"), verdict.alias("verdict"))


def quality_score(spark, sf_dir):
    seg = A.segments(spark, sf_dir).select("session_id", "seg_idx", F.round(F.col("end") - F.col("start"), 3).alias("seconds"), "speaker_confidence")
    db = F.when(F.col("seg_idx") % 7 == 0, None).otherwise(F.round(F.col("speaker_confidence") * 30, 2))
    score = V.quality(V.length_score(F.col("seconds")), V.snr_score(F.col("db")), V.overlap_score(F.col("speaker_confidence") / 4))
    return seg.withColumn("db", db).withColumn("score", score).select("session_id", "seg_idx", F.round("score", 4).alias("score"), V.usable(F.round("score", 6), F.col("seconds")).alias("usable"))


def anchor_conflict(spark, sf_dir):
    hits = _hits(spark, sf_dir, 1).join(A.observations(spark, sf_dir).select("session_id", "ref", "label"), ["session_id", "ref"])
    return V.anchor_conflict(hits, 0.25)


def length_outlier(spark, sf_dir):
    obs = A.segments(spark, sf_dir).select("session_id", F.col("seg_idx").alias("ref"), F.round(F.col("end") - F.col("start"), 3).alias("duration"))
    return V.length_outliers(obs).select("session_id", "ref", "duration", F.round("limit", 4).alias("limit"))


def confidence_collapse(spark, sf_dir):
    return V.confidence_collapse(A.segments(spark, sf_dir).filter("speaker IS NOT NULL"), 0.95).select("session_id", "speaker", F.round("own", 4).alias("own"), F.round("middle", 4).alias("middle"))


QUERIES = {f.__name__: f for f in (
    cosine_topk, nearest_select, candidate_score, label_score, match_verdict, knn_edges, similar_pairs, centroids, intra_cosine, split_geometry, rand_index, voice_baseline,
    merge_verdict, quality_score, anchor_conflict, length_outlier, confidence_collapse,
)}

_PAIRS = f"WITH {A.OBSERVATIONS_SQL}, pairs AS (SELECT a.session_id, a.ref AS i, b.ref AS j, a.label AS label_i, b.label AS label_j, {_COS.format('a.vector', 'b.vector')} AS cosine FROM observations a JOIN observations b ON a.session_id = b.session_id AND a.ref < b.ref)"
_SCORES = HITS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, ref, candidate ORDER BY round(cosine, 9) DESC, id) AS r FROM hits), scores AS (SELECT session_id, ref, any_value(label) AS label, candidate, avg(cosine) AS score FROM r WHERE r <= 2 GROUP BY session_id, ref, candidate)"""
_CENTROIDS = """, parts AS (SELECT {keys}, unnest(vector) AS x, unnest(range(64)) AS pos FROM observations), means AS (SELECT {keys}, pos, avg(x) AS x FROM parts GROUP BY ALL), norms AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY {keys})) AS u FROM means)"""

ORACLES = {
    "cosine_topk": HITS_SQL + "SELECT session_id, ref, id, candidate, round(cosine, 5) AS cosine, rank FROM hits WHERE rank <= 3",
    "nearest_select": HITS_SQL + "SELECT session_id, ref, id, round(cosine, 5) AS cosine, rank FROM hits WHERE rank = 1 OR (rank <= 8 AND cosine >= 0.1)",
    "candidate_score": _SCORES + "SELECT session_id, ref, candidate, round(score, 5) AS score FROM scores",
    "label_score": _SCORES + "SELECT session_id, label, candidate, round(max(score), 5) AS score FROM scores GROUP BY 1, 2, 3",
    "match_verdict": HITS_SQL + "SELECT h.session_id, h.ref, candidate, round(cosine, 5) AS cosine, CASE WHEN duration < 3 THEN 'pending' WHEN cosine >= 0.2 THEN 'auto' ELSE 'pending' END AS status FROM hits h JOIN observations o USING (session_id, ref) WHERE rank = 1",
    "knn_edges": _PAIRS + """, both_ AS (SELECT session_id, i, j, cosine FROM pairs UNION ALL SELECT session_id, j, i, cosine FROM pairs), near AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY session_id, i ORDER BY round(cosine, 9) DESC, j) <= 3)
      SELECT session_id, least(i, j) AS i, greatest(i, j) AS j, round(max(cosine), 5) AS cosine FROM near GROUP BY 1, 2, 3""",
    "similar_pairs": _PAIRS + "SELECT session_id, i, j, round(cosine, 5) AS cosine FROM pairs WHERE label_i <> label_j AND round(cosine, 6) >= 0.25",
    "centroids": f"WITH {A.OBSERVATIONS_SQL}{_CENTROIDS.format(keys='label')} SELECT label, pos, round(u, 5) AS x FROM norms",
    "intra_cosine": _PAIRS + ", c AS (SELECT session_id, label, count(*) AS n FROM observations GROUP BY 1, 2) SELECT p.session_id, label_i AS label, any_value(c.n) AS n, round(avg(cosine), 5) AS intra FROM pairs p JOIN c ON c.session_id = p.session_id AND c.label = label_i WHERE label_i = label_j GROUP BY 1, 2",
    "split_geometry": f"""WITH {A.OBSERVATIONS_SQL.replace('label, (1', 'label % 2 AS label, (1')}{_CENTROIDS.format(keys='session_id, label')}, sep AS (SELECT a.session_id, 1 - sum(a.u * b.u) AS sep FROM norms a JOIN norms b ON a.session_id = b.session_id AND a.pos = b.pos AND a.label = 0 AND b.label = 1 GROUP BY 1),
      inner_ AS (SELECT session_id, label, avg(cosine) AS intra FROM (SELECT a.session_id, a.label, {_COS.format('a.vector', 'b.vector')} AS cosine FROM observations a JOIN observations b ON a.session_id = b.session_id AND a.label = b.label AND a.ref < b.ref) GROUP BY 1, 2), w AS (SELECT session_id, max(1 - intra) AS within FROM inner_ GROUP BY 1)
      SELECT s.session_id, round(sep, 5) AS sep, round(coalesce(within, 0), 5) AS within, (SELECT count(*) FROM observations o WHERE o.session_id = s.session_id AND label = 0) AS n0, (SELECT count(*) FROM observations o WHERE o.session_id = s.session_id AND label = 1) AS n1 FROM sep s LEFT JOIN w USING (session_id)""",
    "rand_index": f"""WITH {A.OBSERVATIONS_SQL}, c AS (SELECT session_id, label % 3 AS a, label % 4 AS b, count(*) AS n FROM observations GROUP BY 1, 2, 3), s AS (SELECT session_id, sum(n * (n - 1) / 2) AS both_, sum(n) AS n FROM c GROUP BY 1),
      x AS (SELECT session_id, sum(n * (n - 1) / 2) AS x FROM (SELECT session_id, a, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1), y AS (SELECT session_id, sum(n * (n - 1) / 2) AS y FROM (SELECT session_id, b, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1)
      SELECT session_id, round((both_ - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 6) AS ari FROM s JOIN x USING (session_id) JOIN y USING (session_id)""",
    "voice_baseline": _PAIRS + "SELECT session_id, round(quantile_cont(1 - cosine, 0.5), 5) AS p50, round(quantile_cont(1 - cosine, 0.95), 5) AS p95, count(*) AS n FROM pairs WHERE label_i = label_j GROUP BY 1",
    "merge_verdict": f"""WITH {A.OBSERVATIONS_SQL}{_CENTROIDS.format(keys='session_id, label')}, t AS (SELECT session_id, label, min(ref) AS first, max(ref) AS last FROM observations GROUP BY 1, 2),
      d AS (SELECT a.session_id, a.label AS label_a, b.label AS label_b, 1 - sum(a.u * b.u) AS distance FROM norms a JOIN norms b ON a.session_id = b.session_id AND a.pos = b.pos AND a.label < b.label GROUP BY 1, 2, 3)
      SELECT d.session_id, label_a, label_b, round(distance, 5) AS distance, CASE WHEN (label_a + label_b) % 7 = 0 THEN 'conflict' WHEN round(distance, 6) > 0.95 THEN 'too_far' WHEN NOT (x.last < y.first OR y.last < x.first) AND label_a <> 0 THEN 'overlap' WHEN label_b - 2 <= 0 THEN 'no_gain' ELSE 'merge' END AS verdict
      FROM d JOIN t x ON x.session_id = d.session_id AND x.label = label_a JOIN t y ON y.session_id = d.session_id AND y.label = label_b""",
    "quality_score": f"""WITH {A.SEGMENTS_SQL}, s AS (SELECT session_id, seg_idx, round("end" - start, 3) AS seconds, speaker_confidence AS c, CASE WHEN seg_idx % 7 = 0 THEN NULL ELSE round(speaker_confidence * 30, 2) END AS db FROM segments),
      p AS (SELECT *, CASE WHEN seconds < 1 THEN 0 ELSE least(1, greatest(0, (seconds - 1) / 5)) END AS l, CASE WHEN db IS NULL THEN 0.6 ELSE least(1, greatest(0, (db - 5) / 15)) END AS n, least(1, greatest(0, 1 - 2 * greatest(0, c / 4))) AS o FROM s),
      q AS (SELECT *, CASE WHEN l = 0 OR n = 0 OR o = 0 THEN 0 ELSE pow(l, 0.4) * pow(n, 0.35) * pow(o, 0.25) END AS score FROM p)
      SELECT session_id, seg_idx, round(score, 4) AS score, round(score, 6) >= 0.35 AND seconds >= 1 AS usable FROM q""",
    "anchor_conflict": HITS_SQL + "SELECT session_id, label, count(DISTINCT candidate) AS candidates FROM hits WHERE rank = 1 AND cosine >= 0.25 GROUP BY 1, 2 HAVING count(DISTINCT candidate) >= 2",
    "length_outlier": f"""WITH {A.SEGMENTS_SQL}, d AS (SELECT session_id, seg_idx AS ref, round("end" - start, 3) AS duration FROM segments), l AS (SELECT session_id, quantile_cont(duration, 0.99) AS "limit" FROM d GROUP BY 1)
      SELECT session_id, ref, duration, round("limit", 4) AS "limit" FROM d JOIN l USING (session_id) WHERE duration > "limit" """,
    "confidence_collapse": f"""WITH {A.SEGMENTS_SQL}, k AS (SELECT * FROM segments WHERE speaker IS NOT NULL), o AS (SELECT session_id, speaker, avg(speaker_confidence) AS own FROM k GROUP BY 1, 2), m AS (SELECT session_id, quantile_cont(speaker_confidence, 0.5) AS middle FROM k GROUP BY 1)
      SELECT session_id, speaker, round(own, 4) AS own, round(middle, 4) AS middle FROM o JOIN m USING (session_id) WHERE own < 0.95 * middle""",
}
