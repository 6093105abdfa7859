"""Queries over questions, gains, plans and the graph they act on, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy import adapters as A
from colloquy.operators import evidence as E
from colloquy.operators import planning as P
from colloquy.operators import vectors as V
from colloquy.plans.vectors import ORACLES as VECTOR_SQL
from colloquy.plans.evidence import POSTERIOR_SQL, _evidence, _obs, _posterior, _prior


def _array(values):
    return F.array(*[F.lit(v) for v in values])


def _nodes(spark, sf_dir):
    """Observations are moments; their number says of what kind and how much hangs on them."""
    kind = F.element_at(_array(["action", "decision", "dialogue", "aside"]), (F.col("ref") % 4 + 1).cast("int"))
    gist = F.when(F.col("ref") % 6 > 0, F.concat(F.lit("Opens door "), F.col("ref").cast("string")))
    text = F.when(F.col("ref") % 9 > 0, F.concat(F.lit(" I say  "), F.col("label").cast("string"), F.lit("-"), F.col("ref").cast("string")))
    return _obs(spark, sf_dir).select("session_id", "ref", kind.alias("kind"), gist.alias("gist"), text.alias("text"), ((F.col("ref") % 11) / 10).alias("stakes"))


def question_drafts(spark, sf_dir):
    return P.questions(_nodes(spark, sf_dir), _posterior(spark, sf_dir)).select("session_id", "ref", "kind", "prompt", "stakes")


def question_suppression(spark, sf_dir):
    asked = P.questions(_nodes(spark, sf_dir), _posterior(spark, sf_dir))
    moments = _obs(spark, sf_dir).select("session_id", "ref", (F.col("ref") % 10 == 0).alias("answered"), (F.col("label") < 5).alias("confident"), F.when(F.col("ref") % 7 == 0, True).alias("covered"))
    return P.suppressed(asked, _posterior(spark, sf_dir), moments).select("session_id", "ref", "kind", "reason")


def question_overlap(spark, sf_dir):
    l = A.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("session_id"), F.col("l_orderkey").alias("question"), F.col("l_partkey").alias("target"))
    seen = A.table(spark, sf_dir, "part").filter("p_size > 25").select((F.col("p_partkey") % 10).alias("session_id"), F.col("p_partkey").alias("target"))
    return P.overlap(l, seen).select("session_id", "question", F.round("share", 6).alias("share"))


def question_gains(spark, sf_dir):
    l = A.table(spark, sf_dir, "lineitem")
    options = l.select((F.col("l_orderkey") % 100).alias("session_id"), F.col("l_orderkey").alias("question"), (F.col("l_discount") * 2).alias("chance"), F.when(F.col("l_linenumber") < 4, F.col("l_quantity") / 10).alias("entropy_after"), (F.col("l_orderkey") % 10 / 10).alias("stakes"), (1 + F.col("l_orderkey") % 2).cast("double").alias("cost"), (F.col("l_orderkey") % 5 / 4).alias("overlap"))
    base = l.select((F.col("l_orderkey") % 100).alias("session_id")).distinct().select("session_id", (4 + F.col("session_id") / 50).alias("entropy"))
    return P.gains(options, base).select("session_id", "question", F.round("gain", 5).alias("gain"), F.round("score", 5).alias("score"))


def review_stop(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", P.stop(F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 400_000, 4)), (F.col("o_orderkey") % 10) / 40, F.col("o_custkey") % 3).alias("reason"))


def blocking_moments(spark, sf_dir):
    """Moments with stakes that nobody is sure of, by session."""
    s = E.summary(_posterior(spark, sf_dir)).join(_nodes(spark, sf_dir).select("session_id", "ref", "stakes"), ["session_id", "ref"])
    sure = (F.round("p_max", 7) >= 0.90) & (F.round("margin", 7) >= 0.50)
    return s.filter((F.col("stakes") >= P.EVENT_STAKES) & ~sure).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("first"))


def coupling_and_trust(spark, sf_dir):
    o = _obs(spark, sf_dir)
    purity, quality = F.when(F.col("ref") % 5 > 0, F.col("ref") % 13 / 10), F.when(F.col("ref") % 4 > 0, F.col("duration") / 9)
    return o.select("session_id", "ref", F.round(P.coupling_eps(purity), 6).alias("eps"), F.round(P.trust(purity, quality, F.col("ref") % 7 / 10 - 0.1), 6).alias("alpha"))


def _spoken(spark, sf_dir):
    """Segments as lines of two voices; a third of the sessions has lines without a vector."""
    s = A.segments(spark, sf_dir)
    return s.select("session_id", F.col("seg_idx").alias("ref"), F.col("speaker").alias("voice"), "start", "end", ((F.col("session_id") % 3 > 0) | (F.col("seg_idx") % 2 == 0)).alias("has_vector"))


def graph_edges(spark, sf_dir):
    lines = _spoken(spark, sf_dir)
    near = lines.filter("voice IS NOT NULL AND ref % 4 = 0").select("session_id", "voice", F.col("ref").alias("i"), (F.col("ref") + 4).alias("j"))
    voices = lines.filter("voice IS NOT NULL").select("session_id", "voice").distinct().filter("session_id % 4 > 0").withColumn("purity", (F.col("session_id") % 11) / 10)
    e = P.edges(lines.withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000}), near, voices)
    return e.select("session_id", "i", "j", F.round("eps", 5).alias("eps"), "kind")


def structural_answers(spark, sf_dir):
    l = A.segments(spark, sf_dir).select("session_id", F.col("seg_idx").alias("ref"), F.concat(F.lit("V"), (F.col("seg_idx") % 4).cast("string")).alias("voice"))
    s = l.select("session_id").distinct()
    return P.effective_voices(l, s.filter("session_id % 3 = 0").select("session_id", F.lit("V2").alias("voice")), s.filter("session_id % 2 = 0").select("session_id", F.lit("V3").alias("voice"), F.lit("V1").alias("into")))


def answered_potentials(spark, sf_dir):
    """A potential per observation and candidate; the longest line of a voice is answered, the voices of even labels too."""
    phi = E.fuse(_obs(spark, sf_dir).select("session_id", "ref", F.lit(0.5).alias("alpha")), _evidence(spark, sf_dir), _prior(spark, sf_dir))
    o = _obs(spark, sf_dir)
    name = lambda c: F.concat(F.lit("member:"), c.cast("string"))
    answers = o.filter("duration = 9").select("session_id", "ref", F.when(F.col("label") == 3, P.IDK).otherwise(name(F.col("label"))).alias("candidate"))
    voices = o.select("session_id", "ref", F.col("label").alias("voice"))
    voiced = o.select("session_id", F.col("label").alias("voice")).distinct().filter("voice % 2 = 0").select("session_id", "voice", name(F.col("voice")).alias("candidate"))
    needs = o.filter("duration > 6").select("session_id", "ref", F.concat(F.lit("skill:"), (F.col("label") % 3).cast("string")).alias("capability"))
    learned = spark.createDataFrame([("skill:0", "member:1"), ("skill:2", "member:4")], "capability string, candidate string")
    return P.with_answers(phi, voices, answers, voiced, needs, learned).select("session_id", "ref", "candidate", F.round("log_phi", 4).alias("log_phi"))


def _answers(spark, sf_dir):
    longest = F.min_by("ref", F.struct((-F.col("duration")).alias("d"), "ref")).alias("ref")
    return _obs(spark, sf_dir).groupBy("session_id", "label").agg(longest).select("session_id", "ref", F.concat(F.lit("member:"), F.col("label").cast("string")).alias("candidate"))


def answer_owed(spark, sf_dir):
    """After: a voice's answer counts for all its lines of over seven seconds."""
    more = _obs(spark, sf_dir).filter("duration > 7").select("session_id", "ref", F.concat(F.lit("member:"), F.col("label").cast("string")).alias("candidate"), F.lit("user_answer").alias("channel"), F.lit(4.5).alias("log_lr"))
    after = E.softmax(E.fuse(_obs(spark, sf_dir).select("session_id", "ref", F.lit(0.5).alias("alpha")), _evidence(spark, sf_dir).unionByName(more), _prior(spark, sf_dir)), ["session_id", "ref"])
    return P.owed(_posterior(spark, sf_dir), after, _answers(spark, sf_dir))


def answer_contradictions(spark, sf_dir):
    cos = A.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("session_id"), F.col("l_orderkey").alias("ref"), F.concat(F.lit("member:"), (F.col("l_suppkey") % 6).cast("string")).alias("candidate"), (F.col("l_quantity") / 50).alias("cosine"))
    said = A.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("session_id"), F.col("o_orderkey").alias("ref"), F.concat(F.lit("member:"), (F.col("o_custkey") % 6).cast("string")).alias("candidate"))
    return P.contradicted(said, cos)


def identity_with_prior(spark, sf_dir):
    pooled = _evidence(spark, sf_dir).join(_obs(spark, sf_dir).select("session_id", "ref", F.col("label").alias("voice")), ["session_id", "ref"]).groupBy("session_id", "voice", "candidate").agg(F.avg("log_lr").alias("llr"))
    return P.identity_with_prior(pooled, _prior(spark, sf_dir)).select("session_id", "voice", "candidate", F.round("p", 5).alias("p"))


def _points(spark, sf_dir):
    member = F.when(F.col("l_suppkey") % 3 == 0, (F.col("l_suppkey") % 20).cast("string")).when(F.col("l_suppkey") % 3 == 1, "")
    user = F.when(F.col("l_partkey") % 4 > 0, (F.col("l_partkey") % 30).cast("string"))
    return A.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 40).alias("session_id"), F.col("l_orderkey").alias("ref"), member.alias("member"), user.alias("user"), F.col("l_discount").alias("cosine"))


def hit_candidates(spark, sf_dir):
    return P.candidate_hits(_points(spark, sf_dir))


def resolved_candidates(spark, sf_dir):
    members = spark.range(40).select(F.col("id").alias("session_id"), F.explode(F.sequence(F.lit(0), F.lit(14))).alias("u")).select("session_id", F.col("u").cast("string").alias("user"), (F.col("u") + F.col("session_id") % 3).cast("string").alias("member"))
    return P.resolved_candidates(P.candidate_hits(_points(spark, sf_dir)), members)


def roster_index(spark, sf_dir):
    m = A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("session_id"), F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("member"), F.when(F.col("c_custkey") % 20 == 0, "dm").otherwise("player").alias("role"), F.col("c_mktsegment").alias("player"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Hero "), (F.col("c_custkey") % 8).cast("string"))).when(F.col("c_custkey") % 3 == 1, "").alias("character"))
    return P.roster_index(m)


def exclusion_windows(spark, sf_dir):
    lines = A.utterances(spark, sf_dir).select("session_id", F.col("ordinal").cast("int").alias("ordinal"))
    o = A.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("session_id"), F.concat(F.lit("P"), (F.col("o_orderkey") % 4).cast("string")).alias("candidate"), F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 6).cast("int")).alias("first"), F.when(F.col("o_orderstatus") != "O", (F.col("o_orderkey") % 9).cast("int")).alias("last"), "o_orderpriority")
    notes = o.filter("o_orderpriority < '3'").select("session_id", "candidate", "first", "last")
    scenes = o.filter("o_orderpriority > '4'").select("session_id", "first", "last", F.array("candidate", F.lit("P9")).alias("absent"))
    return P.exclusions(notes, scenes, lines)


def enrolment_gate(spark, sf_dir):
    o = _obs(spark, sf_dir).select("session_id", "ref", (F.col("duration") / 4).alias("seconds"), F.when(F.col("ref") % 3 > 0, F.col("ref") % 11 / 10).alias("purity"), F.when(F.col("ref") % 5 > 0, F.col("label") / 10).alias("quality"))
    return P.enrolment(o).select("session_id", "ref", "outcome")


def cluster_rule(spark, sf_dir):
    return P.stop_rule(A.segments(spark, sf_dir).filter("session_id % 5 > 0 OR speaker IS NULL"))


def capability_contradiction(spark, sf_dir):
    l = A.table(spark, sf_dir, "lineitem")
    needs = l.select((F.col("l_orderkey") % 200).alias("session_id"), (F.col("l_suppkey") % 4).alias("label"), F.concat(F.lit("skill:"), (F.col("l_partkey") % 6).cast("string")).alias("capability")).filter("session_id % 9 > label")
    members = spark.createDataFrame([(m, f"skill:{s}") for m, own in (("a", (0, 1, 2)), ("b", (2, 3)), ("c", (0, 3, 4, 5)), ("d", (1, 3, 4))) for s in own], "member string, capability string")
    return P.unmet(needs, members).select("session_id", "label", F.array_join("requires", ",").alias("requires"))


def trigger_order(spark, sf_dir):
    kinds = ["anchor_conflict", "capability_contradiction", "aba_pattern", "length_outlier", "confidence_collapse"]
    l = A.table(spark, sf_dir, "lineitem")
    k = (F.col("l_partkey") % 5 + 1).cast("int")
    fired = l.select((F.col("l_orderkey") % 100).alias("session_id"), (F.col("l_suppkey") % 5).alias("label"), F.element_at(_array(kinds), k).alias("kind"), F.element_at(_array([0.9, 0.8, 0.7, 0.5, 0.5]), k).alias("weight")).distinct()
    return P.triggers(fired)


def split_spans(spark, sf_dir):
    return P.split_spans(A.segments(spark, sf_dir).filter("speaker IS NOT NULL").select("session_id", F.col("speaker").alias("label"), (F.col("seg_idx") % 2 * (F.col("session_id") % 3)).cast("int").alias("side"), "start", "end")).select("session_id", "label", "boundary", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def merge_proposals(spark, sf_dir):
    from colloquy.plans.vectors import merge_verdict

    found = merge_verdict(spark, sf_dir).select("session_id", F.col("label_a").alias("a"), F.col("label_b").alias("b"), "distance", "verdict")
    return P.proposals(found).select("session_id", "a", "b", "distance", "place")


def similarity_map(spark, sf_dir):
    """To each moment those alike, both ways, the most alike first."""
    half = V.pairs(_obs(spark, sf_dir), 0.2).select("session_id", "i", "j", "cosine")
    both = half.union(half.select("session_id", "j", "i", "cosine"))
    return both.groupBy("session_id", F.col("i").alias("ref")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.round("cosine", 5)).alias("c"), "j"))), lambda x: x["j"].cast("string")), ",").alias("alike"))


def channel_weights(spark, sf_dir):
    """What utterances' channels said of candidates, and who it was; campaigns grow in number with the table, not in size."""
    l = A.table(spark, sf_dir, "lineitem")
    examples = l.select(F.expr("l_orderkey DIV 100").alias("campaign"), F.col("l_orderkey").alias("example"), F.element_at(_array(["voice", "address", "roll"]), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("channel"), F.concat(F.lit("c"), (F.col("l_partkey") % 3).cast("string")).alias("candidate"), F.round(F.col("l_discount") * 20 - 1, 3).alias("log_lr"), F.concat(F.lit("c"), (F.col("l_orderkey") % 3).cast("string")).alias("chosen"))
    return P.channel_weights(examples).select("campaign", "channel", F.round("weight", 4).alias("weight"))


def review_plans(spark, sf_dir):
    """Conversations are sessions: who said what, with a tie between a speaker's lines that follow each other."""
    u = A.utterances(spark, sf_dir).select("session_id", F.col("ordinal").alias("ref"), "speaker", "text")
    roles = F.explode(_array(["assistant", "system", "unknown", "user"]))
    phi = u.select("session_id", "ref", "speaker", roles.alias("candidate")).select("session_id", "ref", "candidate", F.when((F.col("candidate") == F.col("speaker")) & (F.col("ref") % 3 > 0), 1.0).when(F.col("candidate") == "unknown", -1.0).otherwise(0.0).alias("log_phi"))
    w = Window.partitionBy("session_id", "speaker").orderBy("ref")
    ties = u.withColumn("j", F.lead("ref").over(w)).filter("j IS NOT NULL").select("session_id", F.col("ref").alias("i"), "j", F.lit(math.log(0.8)).alias("log_same"), F.lit(math.log(0.2)).alias("log_diff"), F.when(F.col("ref") % 2 == 0, 0.8).alias("likeness"))
    nodes = u.select("session_id", "ref", F.lit("dialogue").alias("kind"), F.lit(None).cast("string").alias("gist"), F.concat(F.col("ref").cast("string"), F.lit(" "), F.col("text")).alias("text"), (0.2 + F.col("ref") % 5 / 5).alias("stakes"))
    asked = P.questions(nodes, phi)
    plan = P.review_plan(phi, ties, asked, nodes.select("session_id", "ref", "stakes"))
    return plan.select("session_id", "step", F.md5("prompt").alias("prompt_md5"), "answer", F.round("gain", 5).alias("gain"), F.round("entropy", 5).alias("entropy"), "ended")


QUERIES = {f.__name__: f for f in (
    question_drafts, question_suppression, question_overlap, question_gains, review_stop, blocking_moments, coupling_and_trust, graph_edges, structural_answers, answered_potentials, answer_owed, answer_contradictions, identity_with_prior,
    hit_candidates, resolved_candidates, roster_index, exclusion_windows, enrolment_gate, cluster_rule, capability_contradiction, trigger_order, split_spans, merge_proposals, similarity_map, channel_weights, review_plans,
)}

_QUESTIONS = POSTERIOR_SQL + """, nd AS (SELECT session_id, ref, ['action', 'decision', 'dialogue', 'aside'][ref % 4 + 1] AS kind, CASE WHEN ref % 6 > 0 THEN 'Opens door ' || ref END AS gist, CASE WHEN ref % 9 > 0 THEN 'I say ' || label || '-' || ref ELSE '' END AS quote, (ref % 11) / 10 AS stakes FROM observations),
pl AS (SELECT session_id, ref, count(*) AS n FROM post WHERE candidate <> 'unknown' GROUP BY 1, 2 HAVING count(*) >= 2), qs AS (SELECT nd.session_id, nd.ref, 'who_did' AS kind, 'Who o' || gist[2:] || '?' AS prompt, stakes, quote FROM nd JOIN pl USING (session_id, ref) WHERE kind IN ('action', 'decision') AND gist IS NOT NULL
  UNION ALL SELECT nd.session_id, nd.ref, 'who_said', 'Who said: “' || quote || '”?', stakes, quote FROM nd JOIN pl USING (session_id, ref) WHERE kind IN ('dialogue', 'decision') AND quote <> '')"""
_POINTS = "SELECT l_orderkey % 40 AS session_id, l_orderkey AS ref, CASE WHEN l_suppkey % 3 = 0 THEN 'member:' || (l_suppkey % 20) WHEN l_partkey % 4 > 0 THEN 'user:' || (l_partkey % 30) END AS candidate, l_discount AS cosine FROM lineitem"
_PURITY, _QUALITY = "CASE WHEN ref % 5 > 0 THEN ref % 13 / 10 END", "CASE WHEN ref % 4 > 0 THEN duration / 9 END"
_ONE = "coalesce(least(1, greatest(0, {0})), 1)"
ORACLES = {
    "question_drafts": _QUESTIONS + " SELECT session_id, ref, kind, prompt, stakes FROM qs",
    "question_suppression": _QUESTIONS + """, pc AS (SELECT session_id, ref, count(*) FILTER (candidate <> 'unknown' AND round(p, 9) >= 0.02) AS plausible FROM post GROUP BY 1, 2) SELECT q.session_id, q.ref, q.kind, CASE WHEN q.ref % 10 = 0 THEN 'already_answered' WHEN label < 5 AND round(p_max, 9) >= 0.9 AND round(margin, 9) >= 0.5 THEN 'posterior_already_answers_it'
      WHEN stakes < 0.15 THEN 'filler' WHEN plausible < 2 THEN 'degenerate_candidate_set' WHEN q.ref % 7 = 0 THEN 'subject_already_covered' WHEN quote = '' THEN 'no_concrete_moment' ELSE '' END AS reason FROM qs q JOIN observations o USING (session_id, ref) JOIN summary s USING (session_id, ref) JOIN pc USING (session_id, ref)""",
    "question_overlap": """WITH t AS (SELECT DISTINCT l_suppkey % 10 AS session_id, l_orderkey AS question, l_partkey AS target FROM lineitem) SELECT session_id, question, round(count(p_partkey) / count(*), 6) AS share FROM t LEFT JOIN part ON p_partkey = target AND p_partkey % 10 = session_id AND p_size > 25 GROUP BY 1, 2""",
    "question_gains": """WITH g AS (SELECT l_orderkey % 100 AS session_id, l_orderkey AS question, greatest(0, 4 + l_orderkey % 100 / 50 - sum(l_discount * 2 * CASE WHEN l_linenumber < 4 THEN l_quantity / 10 ELSE 4 + l_orderkey % 100 / 50 END)) AS gain FROM lineitem GROUP BY 1, 2)
      SELECT session_id, question, round(gain, 5) AS gain, round(gain * (question % 10 / 10) / (1 + question % 2) - 0.5 * (question % 5 / 4), 5) AS score FROM g""",
    "review_stop": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR round(o_totalprice / 400000, 4) < 0.15 THEN 'gain_floor' WHEN o_orderkey % 10 / 40 <= 0.1 AND o_custkey % 3 = 0 THEN 'target_reached' ELSE '' END AS reason FROM orders""",
    "blocking_moments": POSTERIOR_SQL + "SELECT session_id, count(*) AS n, min(ref) AS first FROM summary WHERE (ref % 11) / 10 >= 0.5 AND NOT (round(p_max, 7) >= 0.9 AND round(margin, 7) >= 0.5) GROUP BY 1",
    "coupling_and_trust": f"""WITH {A.OBSERVATIONS_SQL} SELECT session_id, ref, round(coalesce(0.05 + 0.45 * (1 - least(1, greatest(0, {_PURITY}))), 0.5), 6) AS eps, round({_ONE.format(_PURITY)} * {_ONE.format(_QUALITY)} * {_ONE.format('ref % 7 / 10 - 0.1')}, 6) AS alpha FROM observations""".replace("least(1, greatest(0, " + _PURITY + "))), 0.5)", "CASE WHEN ref % 5 > 0 THEN least(1, greatest(0, ref % 13 / 10)) END), 0.5)").replace(_ONE.format(_PURITY), "CASE WHEN ref % 5 > 0 THEN least(1, greatest(0, ref % 13 / 10)) ELSE 1 END").replace(_ONE.format(_QUALITY), "CASE WHEN ref % 4 > 0 THEN least(1, duration / 9) ELSE 1 END"),
    "graph_edges": f"""WITH {A.SEGMENTS_SQL}, l AS (SELECT session_id, seg_idx AS ref, speaker AS voice, start / 1000 AS s, "end" / 1000 AS e, session_id % 3 > 0 OR seg_idx % 2 = 0 AS v FROM segments), h AS (SELECT session_id, voice, bool_and(v) AS whole, CASE WHEN session_id % 4 > 0 THEN 0.05 + 0.45 * (1 - (session_id % 11) / 10) ELSE 0.5 END AS eps FROM l WHERE voice IS NOT NULL GROUP BY 1, 2),
      c AS (SELECT session_id, voice, ref AS i, lead(ref) OVER (PARTITION BY session_id, voice ORDER BY s, ref) AS j FROM l WHERE voice IS NOT NULL), t AS (SELECT session_id, ref AS i, lead(ref) OVER w AS j, lead(s) OVER w - e AS gap FROM l WINDOW w AS (PARTITION BY session_id ORDER BY s, ref))
      SELECT session_id, i, j, round(eps, 5) AS eps, 'same_voice' AS kind FROM c JOIN h USING (session_id, voice) WHERE NOT whole AND j IS NOT NULL UNION ALL SELECT session_id, ref, ref + 4, round(eps, 5), 'same_voice' FROM l JOIN h USING (session_id, voice) WHERE whole AND ref % 4 = 0
      UNION ALL SELECT session_id, i, j, round(least(0.49, 0.3 * (1 + least(gap, 30) / 30)), 5), 'continuity' FROM t WHERE j IS NOT NULL AND gap <= 30""",
    "structural_answers": f"""WITH {A.SEGMENTS_SQL} SELECT session_id, seg_idx AS ref, CASE WHEN seg_idx % 4 = 2 AND session_id % 3 = 0 THEN NULL WHEN seg_idx % 4 = 3 AND session_id % 2 = 0 THEN 'V1' ELSE 'V' || (seg_idx % 4) END AS voice FROM segments""",
    "answered_potentials": POSTERIOR_SQL + """SELECT f.session_id, f.ref, candidate, round(log_phi + CASE WHEN duration = 9 AND label <> 3 AND candidate = 'member:' || label THEN 8 ELSE 0 END + CASE WHEN label % 2 = 0 AND candidate = 'member:' || label THEN 4.5 ELSE 0 END
      + CASE WHEN duration > 6 AND ((label % 3 = 0 AND candidate = 'member:1') OR (label % 3 = 2 AND candidate = 'member:4')) THEN 1.2 ELSE 0 END, 4) AS log_phi FROM phi f JOIN observations o USING (session_id, ref)""",
    "answer_owed": POSTERIOR_SQL.rstrip() + """, q AS (SELECT f.*, log_phi + CASE WHEN duration > 7 AND candidate = 'member:' || label THEN 4.5 ELSE 0 END AS phi2 FROM phi f JOIN observations o USING (session_id, ref)), e2 AS (SELECT *, exp(phi2 - max(phi2) OVER (PARTITION BY session_id, ref)) AS e2 FROM q), p2 AS (SELECT session_id, ref, candidate, e2 / sum(e2) OVER (PARTITION BY session_id, ref) AS p2 FROM e2),
      a AS (SELECT session_id, ref FROM observations QUALIFY row_number() OVER (PARTITION BY session_id, label ORDER BY duration DESC, ref) = 1), m AS (SELECT session_id, ref, max(abs(p2 - p)) AS m FROM post JOIN p2 USING (session_id, ref, candidate) GROUP BY 1, 2) SELECT session_id, ref FROM m ANTI JOIN a USING (session_id, ref) WHERE round(m, 9) >= 0.001""",
    "answer_contradictions": """WITH r AS (SELECT l_orderkey % 50 AS session_id, l_orderkey AS ref, l_suppkey % 6 = o_custkey % 6 AS own, l_quantity / 50 AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey), g AS (SELECT session_id, ref, coalesce(max(c) FILTER (own), 0) AS a, coalesce(max(c) FILTER (NOT own), 0) AS b FROM r GROUP BY 1, 2) SELECT session_id, ref FROM g WHERE round(b - a, 9) > 0.25 AND round(b, 9) >= 0.75""",
    "identity_with_prior": POSTERIOR_SQL.rstrip() + """, k AS (SELECT e.session_id, label AS voice, e.candidate, avg(log_lr) + ln(any_value(p.p)) AS s FROM evidence e JOIN observations USING (session_id, ref) JOIN prior p ON p.session_id = e.session_id AND p.candidate = e.candidate GROUP BY 1, 2, 3), x AS (SELECT *, exp(s - max(s) OVER (PARTITION BY session_id, voice)) AS e FROM k) SELECT session_id, voice, candidate, round(e / sum(e) OVER (PARTITION BY session_id, voice), 5) AS p FROM x""",
    "hit_candidates": f"WITH p AS ({_POINTS}) SELECT session_id, ref, candidate, max(cosine) AS cosine FROM p WHERE candidate IS NOT NULL GROUP BY 1, 2, 3",
    "resolved_candidates": f"""WITH p AS ({_POINTS}), m AS (SELECT s AS session_id, 'user:' || u AS candidate, 'member:' || (u + s % 3) AS other FROM range(40) a(s), range(15) b(u)) SELECT p.session_id, ref, coalesce(other, p.candidate) AS candidate, max(cosine) AS cosine FROM p LEFT JOIN m USING (session_id, candidate) WHERE p.candidate IS NOT NULL GROUP BY 1, 2, 3""",
    "roster_index": """WITH r AS (SELECT c_nationkey AS session_id, c_custkey, 'member:' || lpad(c_custkey::VARCHAR, 6, '0') AS candidate, CASE WHEN c_custkey % 3 = 0 THEN 'Hero ' || (c_custkey % 8) ELSE c_mktsegment END AS label, c_custkey % 20 = 0 AS dm FROM customer)
      SELECT session_id, candidate, label, dm, CASE WHEN row_number() OVER (PARTITION BY session_id, lower(label) ORDER BY c_custkey DESC) = 1 THEN lower(label) END AS name FROM r UNION ALL SELECT DISTINCT session_id, 'unknown', '?', false, NULL FROM r""",
    "exclusion_windows": f"""WITH {A.UTTERANCES_SQL}, o AS (SELECT o_custkey % 100 AS session_id, 'P' || (o_orderkey % 4) AS c, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 6 END AS a, CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 9 END AS b, o_orderpriority AS p FROM orders), s AS (SELECT session_id, c, a, b FROM o WHERE p < '3' OR p > '4' UNION ALL SELECT session_id, 'P9', a, b FROM o WHERE p > '4')
      SELECT DISTINCT u.session_id, u.ordinal, c AS candidate FROM s JOIN utterances u ON u.session_id = s.session_id AND ordinal >= coalesce(a, 0) AND ordinal <= coalesce(b, 1000)""",
    "enrolment_gate": f"""WITH {A.OBSERVATIONS_SQL} SELECT session_id, ref, CASE WHEN duration / 4 < 1 THEN 'too_short' WHEN ref % 3 > 0 AND ref % 11 / 10 < 0.9 THEN 'impure' WHEN ref % 5 = 0 OR label / 10 < 0.5 THEN 'poor_quality' ELSE 'enrolled' END AS outcome FROM observations""",
    "cluster_rule": f"""WITH {A.SEGMENTS_SQL}, n AS (SELECT session_id, count(DISTINCT speaker)::INT AS n FROM segments WHERE session_id % 5 > 0 OR speaker IS NULL GROUP BY 1) SELECT session_id, CASE WHEN n > 0 THEN n END AS k, CASE WHEN n = 0 THEN 0.25 END::DOUBLE AS threshold FROM n""",
    "trigger_order": """WITH f AS (SELECT DISTINCT l_orderkey % 100 AS session_id, l_suppkey % 5 AS label, ['anchor_conflict', 'capability_contradiction', 'aba_pattern', 'length_outlier', 'confidence_collapse'][l_partkey % 5 + 1] AS kind, [0.9, 0.8, 0.7, 0.5, 0.5][l_partkey % 5 + 1]::DOUBLE AS weight FROM lineitem) SELECT *, row_number() OVER (PARTITION BY session_id, label ORDER BY weight DESC, kind) AS place FROM f""",
    "split_spans": f"""WITH {A.SEGMENTS_SQL}, s AS (SELECT *, seg_idx % 2 * (session_id % 3) AS side FROM segments WHERE speaker IS NOT NULL) SELECT session_id, speaker AS label, round((max("end") FILTER (side = 0) + min(start) FILTER (side = 1)) / 2, 3) AS boundary, round(greatest(0, min(start) - 2), 3) AS start, round(max("end") + 2, 3) AS "end" FROM s GROUP BY 1, 2""",
    "merge_proposals": "WITH v AS (" + VECTOR_SQL["merge_verdict"] + ") SELECT session_id, label_a AS a, label_b AS b, distance, row_number() OVER (PARTITION BY session_id ORDER BY round(distance, 9), label_a, label_b) AS place FROM v WHERE verdict = 'merge'",
    "similarity_map": f"""WITH {A.OBSERVATIONS_SQL}, p AS (SELECT a.session_id, a.ref, b.ref AS j, list_dot_product(a.vector, b.vector) / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector))) AS c FROM observations a JOIN observations b ON a.session_id = b.session_id AND a.ref <> b.ref) SELECT session_id, ref, string_agg(j::VARCHAR, ',' ORDER BY round(c, 5) DESC, j) AS alike FROM p WHERE round(c, 6) >= 0.2 GROUP BY 1, 2""",
}
