"""Queries over evidence and posteriors, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import adapters as A
from colloquy.operators import evidence as E
from colloquy.operators import vectors as V
from colloquy.plans.vectors import HITS_SQL, _hits
from colloquy.shared import stash


def _scores(spark, sf_dir):
    """Similarities are near 0 here; half of one plus them is what the calibration takes."""
    return V.candidate_scores(_hits(spark, sf_dir), 2).withColumn("score", (1 + F.col("score")) / 2)


def _obs(spark, sf_dir):
    return A.observations(spark, sf_dir)


def _evidence(spark, sf_dir):
    q = _obs(spark, sf_dir).select("session_id", "ref", (F.col("duration") / 9).alias("quality"))
    return _scores(spark, sf_dir).join(q, ["session_id", "ref"]).select("session_id", "ref", "candidate", F.lit("voice").alias("channel"), E.voice_llr(F.col("score"), F.col("quality")).alias("log_lr"))


def _prior(spark, sf_dir):
    c = A.prints(spark, sf_dir).select("session_id", "candidate").distinct()
    unknown = c.select("session_id").distinct().withColumn("candidate", F.lit("unknown"))
    return c.union(unknown).withColumn("p", F.when(F.col("candidate") == "unknown", 0.1).otherwise(0.2))


def _posterior(spark, sf_dir, evidence=None):
    nodes = _obs(spark, sf_dir).select("session_id", "ref", F.lit(0.5).alias("alpha"))
    return E.softmax(E.fuse(nodes, _evidence(spark, sf_dir) if evidence is None else evidence, _prior(spark, sf_dir)), ["session_id", "ref"])


POSTERIOR_SQL = HITS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, ref, candidate ORDER BY round(cosine, 9) DESC, id) AS r FROM hits
), scores AS (SELECT session_id, ref, candidate, (1 + avg(cosine)) / 2 AS score FROM r WHERE r <= 2 GROUP BY 1, 2, 3
), evidence AS (SELECT s.session_id, s.ref, candidate, least(6, greatest(-6, 12 * (score - 0.55))) * (duration / 9) AS log_lr FROM scores s JOIN observations o USING (session_id, ref)
), prior AS (SELECT DISTINCT session_id, candidate, 0.2 AS p FROM prints UNION ALL SELECT DISTINCT session_id, 'unknown', 0.1 FROM prints
), phi AS (SELECT o.session_id, o.ref, p.candidate, ln(p.p) + coalesce(log_lr, 0) AS log_phi FROM observations o JOIN prior p USING (session_id) LEFT JOIN evidence e ON e.session_id = o.session_id AND e.ref = o.ref AND e.candidate = p.candidate
), ex AS (SELECT *, exp(log_phi - max(log_phi) OVER (PARTITION BY session_id, ref)) AS e FROM phi
), post AS (SELECT session_id, ref, candidate, e / sum(e) OVER (PARTITION BY session_id, ref) AS p FROM ex
), rk AS (SELECT *, row_number() OVER (PARTITION BY session_id, ref ORDER BY p DESC, candidate) AS k FROM post
), summary AS (SELECT session_id, ref, max(candidate) FILTER (k = 1) AS best, max(p) FILTER (k = 1) AS p_max, max(p) FILTER (k = 1) - coalesce(max(p) FILTER (k = 2), 0) AS margin, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS entropy FROM rk GROUP BY 1, 2)
"""


def voice_llr(spark, sf_dir):
    return _evidence(spark, sf_dir).select("session_id", "ref", "candidate", F.round("log_lr", 4).alias("log_lr"))


def fusion_softmax(spark, sf_dir):
    return _posterior(spark, sf_dir).select("session_id", "ref", "candidate", F.round("p", 5).alias("p"))


def entropy_rank(spark, sf_dir):
    """The least certain utterances, worst first, as many as twenty of a session."""
    from pyspark.sql.window import Window

    s = E.summary(_posterior(spark, sf_dir))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.round("entropy", 7).desc(), "ref"))
    return s.withColumn("rank", rank).filter("rank <= 20").select("session_id", "ref", F.round("entropy", 5).alias("entropy"), F.round("margin", 5).alias("margin"), "rank")


def _status(spark, sf_dir):
    evidence = stash(_evidence(spark, sf_dir))  # comparing voices is dear, and two branches need it
    s = E.summary(_posterior(spark, sf_dir, evidence))
    voice = evidence.groupBy("session_id", "ref").agg(F.max("log_lr").alias("voice"))
    c = lambda x: F.round(x, 7)
    status = E.classify(c("p_max"), c("margin"), c("voice"), F.col("ref") % 5 == 0, F.col("ref") % 11 == 0, F.col("ref") % 13 == 0)
    return s.join(voice, ["session_id", "ref"]).withColumn("status", status)


_STATUS = POSTERIOR_SQL + """, voice AS (SELECT session_id, ref, max(log_lr) AS voice FROM evidence GROUP BY 1, 2), st AS (
  SELECT s.*, voice, CASE WHEN ref % 13 = 0 THEN 'user_confirmed'
    WHEN ref % 11 = 0 THEN CASE WHEN round(p_max, 7) >= 0.95 AND round(margin, 7) >= 0.75 THEN 'propagated' WHEN round(p_max, 7) >= 0.6 THEN 'auto_low' ELSE 'unresolved' END
    WHEN round(p_max, 7) >= 0.9 AND round(margin, 7) >= 0.5 AND (ref % 5 = 0 OR round(voice, 7) >= 3) THEN 'auto_high' WHEN round(p_max, 7) >= 0.6 THEN 'auto_low' ELSE 'unresolved' END AS status
  FROM summary s JOIN voice USING (session_id, ref))
"""


def status(spark, sf_dir):
    return _status(spark, sf_dir).select("session_id", "ref", "best", F.round("p_max", 5).alias("p_max"), F.round("margin", 5).alias("margin"), "status")


def status_buckets(spark, sf_dir):
    return _status(spark, sf_dir).groupBy("session_id").pivot("status", E.STATUSES).count().na.fill(0)


def coverage(spark, sf_dir):
    rows = _status(spark, sf_dir).join(_obs(spark, sf_dir).select("session_id", "ref", F.col("duration").alias("seconds")), ["session_id", "ref"]).withColumn("stakes", F.when(F.col("ref") % 4 == 0, None).otherwise((F.col("ref") % 10) / 10))
    return E.coverage(rows).select("session_id", F.round("coverage", 5).alias("coverage"), F.round("unresolved_stakes", 5).alias("unresolved_stakes"))


def _shares(spark, sf_dir):
    return E.speech_share(_posterior(spark, sf_dir), _obs(spark, sf_dir).select("session_id", "ref", F.col("duration").alias("seconds")))


def speech_share(spark, sf_dir):
    return _shares(spark, sf_dir).select("session_id", "candidate", F.round("share", 4).alias("share"))


def dm_prior(spark, sf_dir):
    return E.dm_prior(_shares(spark, sf_dir)).select("session_id", "candidate", F.round("log_lr", 4).alias("log_lr"))


def identity_posterior(spark, sf_dir):
    scores = _scores(spark, sf_dir).join(_obs(spark, sf_dir).select("session_id", "ref", "label"), ["session_id", "ref"])
    return E.identity_posterior(scores).select("session_id", "label", "candidate", F.round("p", 5).alias("p"))


def pooled_posterior(spark, sf_dir):
    p = _posterior(spark, sf_dir).join(_obs(spark, sf_dir).select("session_id", "ref", "label"), ["session_id", "ref"])
    return p.groupBy("session_id", "label", "candidate").agg(F.round(F.avg("p"), 5).alias("p"))


def answer_probabilities(spark, sf_dir):
    return E.answer_probabilities(_posterior(spark, sf_dir).filter("candidate <> 'unknown'")).select("session_id", "ref", "option", F.round("chance", 5).alias("chance"))


def shortlist(spark, sf_dir):
    q = _obs(spark, sf_dir).select("session_id", F.concat(F.lit("q"), F.col("ref").cast("string")).alias("prompt"), F.lit("who_said").alias("kind"), (F.col("ref") % 9 == 0).alias("blocking"), F.col("duration").alias("reach"), (1 + F.col("ref") % 3).cast("double").alias("cost"))
    return E.shortlist(q, 24).select("session_id", "prompt", "blocking", "position")


def global_entropy(spark, sf_dir):
    return E.summary(_posterior(spark, sf_dir)).groupBy("session_id").agg(F.round(F.sum(F.col("entropy") * (1 + F.col("ref") % 3)), 3).alias("entropy"))


def silverman(spark, sf_dir):
    return E.bandwidth(A.segments(spark, sf_dir).filter("speaker IS NOT NULL"), ["session_id", "speaker"], "speaker_confidence").select("session_id", "speaker", "n", F.round("bandwidth", 5).alias("bandwidth"))


def kde_density(spark, sf_dir):
    samples = A.segments(spark, sf_dir).select(F.col("session_id").alias("key"), F.col("speaker_confidence").alias("s"))
    points = samples.select("key").distinct().select("key", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.5, 0.9)])).alias("x"))
    return E.kde_log_density(points, samples, 0.1).select("key", "x", F.round("log_density", 4).alias("log_density"))


def address_channel(spark, sf_dir):
    """Every third line speaks to the assistant; gaps are made from text lengths."""
    u = A.utterances(spark, sf_dir).select("session_id", "ordinal", "speaker", F.when(F.col("ordinal") % 3 == 1, "assistant").alias("addressed"), F.when(F.col("ordinal") > 1, (F.length("text") % 20).cast("double")).alias("gap"))
    return E.address(u).select("session_id", "ordinal", "candidate", F.round("log_lr", 4).alias("log_lr"))


def _capabilities(spark, sf_dir):
    c = A.table(spark, sf_dir, "lineitem")
    source = F.element_at(F.array(*[F.lit(s) for s in ("dm", "answer", "wiki", "transcript")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return c.select((F.col("l_suppkey") % 50).alias("member"), F.concat(F.lit("skill:"), (F.col("l_partkey") % 20).cast("string")).alias("capability"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("polarity"), source.alias("source"), F.col("l_discount").alias("confidence"))


def capability_store(spark, sf_dir):
    return E.best_capabilities(_capabilities(spark, sf_dir))


def capability_channel(spark, sf_dir):
    """A session's roster are the members whose number has its remainder by 25."""
    members = E.best_capabilities(_capabilities(spark, sf_dir)).withColumn("candidate", F.concat(F.lit("member:"), F.col("member").cast("string")))
    needs = A.segments(spark, sf_dir).select("session_id", F.col("seg_idx").alias("ref"), F.explode(F.array(*[F.concat(F.lit("skill:"), ((F.col("session_id") + F.lit(k) * F.col("seg_idx")) % 20).cast("string")) for k in (1, 3)])).alias("capability"))
    roster = needs.select("session_id", (F.col("session_id") % 25).alias("table")).distinct().join(members.select("candidate", (F.col("member") % 25).alias("table")).distinct(), "table").select("session_id", "candidate")
    return E.capability(needs, members.select("candidate", "capability", "polarity"), roster)


QUERIES = {f.__name__: f for f in (
    voice_llr, fusion_softmax, entropy_rank, status, status_buckets, coverage, speech_share, dm_prior, identity_posterior, pooled_posterior, answer_probabilities, shortlist,
    global_entropy, silverman, kde_density, address_channel, capability_store, capability_channel,
)}

_SHARES = POSTERIOR_SQL + ", shares AS (SELECT session_id, candidate, sum(p * duration) AS share FROM post JOIN observations USING (session_id, ref) WHERE candidate <> 'unknown' GROUP BY 1, 2)"
_CAPS = """WITH caps AS (SELECT l_suppkey % 50 AS member, 'skill:' || (l_partkey % 20) AS capability, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS polarity, ['dm', 'answer', 'wiki', 'transcript'][l_linenumber % 4 + 1] AS source, l_discount AS confidence FROM lineitem
), best AS (SELECT member, capability, arg_max((polarity, source), (CASE source WHEN 'dm' THEN 1.0 WHEN 'answer' THEN 0.9 WHEN 'wiki' THEN 0.8 ELSE 0.4 END, confidence, source, polarity)) AS b, max(confidence) AS confidence FROM caps GROUP BY 1, 2
), store AS (SELECT member, capability, b[1] AS polarity, b[2] AS source, confidence FROM best)"""

ORACLES = {
    "voice_llr": POSTERIOR_SQL + "SELECT session_id, ref, candidate, round(log_lr, 4) AS log_lr FROM evidence",
    "fusion_softmax": POSTERIOR_SQL + "SELECT session_id, ref, candidate, round(p, 5) AS p FROM post",
    "entropy_rank": POSTERIOR_SQL + "SELECT session_id, ref, round(entropy, 5) AS entropy, round(margin, 5) AS margin, row_number() OVER (PARTITION BY session_id ORDER BY round(entropy, 7) DESC, ref) AS rank FROM summary QUALIFY rank <= 20",
    "status": _STATUS + "SELECT session_id, ref, best, round(p_max, 5) AS p_max, round(margin, 5) AS margin, status FROM st",
    "status_buckets": _STATUS + "SELECT session_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in E.STATUSES) + " FROM st GROUP BY 1",
    "coverage": _STATUS + """, w AS (SELECT st.session_id, status, coalesce(CASE WHEN ref % 4 = 0 THEN NULL ELSE (ref % 10) / 10 END, 0.5) AS stakes, duration FROM st JOIN observations USING (session_id, ref))
      SELECT session_id, round(CASE WHEN sum(stakes * duration) > 0 THEN sum(stakes * duration) FILTER (status IN ('auto_high', 'propagated', 'user_confirmed')) / sum(stakes * duration) ELSE 1 END, 5) AS coverage,
        round(CASE WHEN sum(stakes) > 0 THEN coalesce(sum(stakes) FILTER (status NOT IN ('auto_high', 'propagated', 'user_confirmed')), 0) / sum(stakes) ELSE 0 END, 5) AS unresolved_stakes FROM w GROUP BY 1""",
    "speech_share": _SHARES + "SELECT session_id, candidate, round(share, 4) AS share FROM shares",
    "dm_prior": _SHARES + "SELECT session_id, candidate, round(least(1.5, greatest(-1.5, 0.5 * ln(share / avg(share) OVER (PARTITION BY session_id)))), 4) AS log_lr FROM shares",
    "identity_posterior": POSTERIOR_SQL + """, b AS (SELECT s.session_id, label, candidate, max(least(6, greatest(-6, 12 * (score - 0.55)))) AS llr FROM scores s JOIN observations USING (session_id, ref) GROUP BY 1, 2, 3), x AS (SELECT *, exp(llr - max(llr) OVER (PARTITION BY session_id, label)) AS e FROM b)
      SELECT session_id, label, candidate, round(e / sum(e) OVER (PARTITION BY session_id, label), 5) AS p FROM x""",
    "pooled_posterior": POSTERIOR_SQL + "SELECT post.session_id, label, candidate, round(avg(p), 5) AS p FROM post JOIN observations USING (session_id, ref) GROUP BY 1, 2, 3",
    "answer_probabilities": POSTERIOR_SQL + """, k AS (SELECT * FROM post WHERE candidate <> 'unknown') SELECT session_id, ref, candidate AS option, round(0.85 * p / sum(p) OVER (PARTITION BY session_id, ref), 5) AS chance FROM k UNION ALL SELECT DISTINCT session_id, ref, 'idk', 0.15 FROM k""",
    "shortlist": f"""WITH {A.OBSERVATIONS_SQL} SELECT session_id, 'q' || ref AS prompt, ref % 9 = 0 AS blocking, row_number() OVER (PARTITION BY session_id ORDER BY ref % 9 = 0 DESC, round(duration / (1 + ref % 3), 9) DESC, 'q' || ref) AS position FROM observations QUALIFY position <= 24""",
    "global_entropy": POSTERIOR_SQL + "SELECT session_id, round(sum(entropy * (1 + ref % 3)), 3) AS entropy FROM summary GROUP BY 1",
    "silverman": f"""WITH {A.SEGMENTS_SQL}, s AS (SELECT session_id, speaker, count(*) AS n, stddev_samp(speaker_confidence) AS sd FROM segments WHERE speaker IS NOT NULL GROUP BY 1, 2)
      SELECT session_id, speaker, n, round(CASE WHEN n < 2 THEN 0.02 ELSE greatest(0.02, 1.06 * sd * pow(n, -0.2)) END, 5) AS bandwidth FROM s""",
    "kde_density": f"""WITH {A.SEGMENTS_SQL}, x AS (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS x) SELECT session_id AS key, x, round(ln(sum(exp(-0.5 * pow((x - speaker_confidence) / 0.1, 2)))) - ln(count(*)) - ln(0.1) - 0.5 * ln(2 * pi()), 4) AS log_density FROM segments, x GROUP BY 1, 2""",
    "address_channel": f"""WITH {A.UTTERANCES_SQL}, u AS (SELECT *, CASE WHEN ordinal % 3 = 1 THEN 'assistant' END AS addressed, CASE WHEN ordinal > 1 THEN length(text) % 20 END AS gap FROM utterances), l AS (SELECT *, lag(addressed) OVER w AS t, lag(speaker) OVER w AS f FROM u WINDOW w AS (PARTITION BY session_id ORDER BY ordinal)),
      g AS (SELECT * FROM l WHERE t IS NOT NULL AND (gap IS NULL OR gap <= 12)) SELECT session_id, ordinal, candidate, round(sum(v), 4) AS log_lr FROM (SELECT session_id, ordinal, t AS candidate, 2.5 AS v FROM g UNION ALL SELECT session_id, ordinal, f, -0.4 FROM g) GROUP BY 1, 2, 3""",
    "capability_store": _CAPS + "SELECT * FROM store",
    "capability_channel": _CAPS + f""", {A.SEGMENTS_SQL}, m AS (SELECT 'member:' || member AS candidate, member % 25 AS t, capability, polarity FROM store), needs AS (SELECT session_id, seg_idx AS ref, 'skill:' || ((session_id + unnest([1, 3]) * seg_idx) % 20) AS capability FROM segments)
      SELECT n.session_id, n.ref, c.candidate, round(least(3, greatest(-3, sum(1.2 * coalesce(polarity, 0)))), 6) AS log_lr FROM needs n JOIN (SELECT DISTINCT candidate, t FROM m) c ON c.t = n.session_id % 25 LEFT JOIN m ON m.candidate = c.candidate AND m.capability = n.capability GROUP BY 1, 2, 3""",
}
