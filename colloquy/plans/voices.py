"""Queries over voices as wholes and over the status of lines, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from colloquy import adapters as A
from colloquy.operators import evidence as E
from colloquy.operators import transcript as T
from colloquy.operators import vectors as V
from colloquy.operators import verdicts as D
from colloquy.operators import voices as W
from colloquy.plans.evidence import _evidence, _obs, _prior
from colloquy.plans.vectors import HITS_SQL, _hits
from colloquy.shared import stash

def _at():
    """The place of an observation in its session."""
    return F.col("ref") % A.SESSION


def _segments(spark, sf_dir):
    """Observations as segments ten seconds apart, most of them nine seconds long; the diarizer changes its label every third and starts anew every sixtieth."""
    o = _obs(spark, sf_dir)
    start = (_at() * 10).cast("double")
    end = start + F.when(F.col("ref") % 9 >= 3, 9.0).otherwise(F.col("duration"))
    return o.select("session_id", _at().alias("seg_idx"), start.alias("start"), end.alias("end"), F.concat(F.lit("R"), F.floor(F.col("ref") / 3) % 3).alias("speaker"), F.floor(_at() / 60).alias("chunk"), F.lit("").alias("text"), F.lit(1.0).alias("speaker_confidence"), "vector")


def _relabelled(spark, sf_dir):
    s = _segments(spark, sf_dir)
    turns = T.speaker_turns(s)
    enrolled = V.centroids(A.prints(spark, sf_dir), ["session_id", "candidate"])
    anchors = enrolled.select("session_id", F.substring_index("candidate", ":", -1).cast("int").alias("id"), F.col("candidate").alias("user"), F.col("centroid").alias("vector"))
    ends = s.select("session_id").distinct().select("session_id", F.when(F.col("session_id") % 2 == 0, 6).alias("k"), F.when(F.col("session_id") % 2 == 0, 2.0).otherwise(0.9).alias("threshold"))
    return W.relabel(s.drop("vector"), turns, W.turn_vectors(turns, s, 4.0), anchors, ends, least=0.25)


def voice_relabel(spark, sf_dir):
    """Sessions of even number end at six voices, the others where clusters are farther apart than 0.9."""
    return _relabelled(spark, sf_dir).segments.select("session_id", "seg_idx", "speaker")


def voice_labels(spark, sf_dir):
    return _relabelled(spark, sf_dir).voices.select("session_id", "label", "turns", F.round("seconds", 3).alias("seconds"), "user", F.round("cosine", 5).alias("cosine"))


def _spoken(spark, sf_dir):
    """Lines half a second apart, every 97th of them long; the diarizer's label is another at every line."""
    o = _obs(spark, sf_dir)
    start = _at() / 2
    long_ = F.when(F.col("ref") % 97 == 0, 20.0).otherwise(0.0)
    return o.select("session_id", F.col("label").alias("voice"), "ref", start.alias("start"), (start + F.col("duration") + long_).alias("end"), (F.col("ref") % 3).alias("label"), (F.col("ref") % 17 / 16).alias("confidence"), "vector", "duration")


def _suspicions(spark, sf_dir):
    o = _spoken(spark, sf_dir)
    needs = o.filter("ref % 40 = 0").select("session_id", "voice", F.concat(F.lit("c"), F.col("ref") % 7).alias("capability"))
    people = A.prints(spark, sf_dir).select("candidate").distinct()
    n = F.substring_index("candidate", ":", -1).cast("int")
    members = people.select(F.col("candidate").alias("member"), F.explode(F.array(*[F.concat(F.lit("c"), (n + k) % 7) for k in range(3)])).alias("capability"))
    return W.suspicions(o, _hits(spark, sf_dir, 1), needs, members, 0.25)


def voice_suspicions(spark, sf_dir):
    return _suspicions(spark, sf_dir).select("session_id", "voice", "kind", "weight", "place")


def voice_verdicts(spark, sf_dir):
    """What is said of each voice, with how far lines of one voice are apart in the session as the measure."""
    o = _obs(spark, sf_dir)
    found = W.identity_verdicts(_spoken(spark, sf_dir), _suspicions(spark, sf_dir), V.same_voice_baseline(o).select("session_id", "p95"))
    return found.select("session_id", "voice", "n", "seconds", F.round("purity", 3).alias("purity"), "impure", "reason", F.round("sep", 4).alias("sep"), F.array_join("triggers", ",").alias("triggers"))


def _graph(spark, sf_dir):
    """Potentials, edges and evidence: lines by voice, every fifth also by what it takes to say it."""
    o = _obs(spark, sf_dir)
    able = o.filter("ref % 5 = 0").select("session_id", "ref", F.concat(F.lit("member:"), F.col("label")).alias("candidate"), F.lit("capability").alias("channel"), (2 + F.col("ref") % 3).cast("double").alias("log_lr"))
    evidence = stash(_evidence(spark, sf_dir)).unionByName(able)
    phi = E.fuse(o.select("session_id", "ref", F.lit(0.5).alias("alpha")), evidence, _prior(spark, sf_dir))
    near = V.knn_edges(o, 1).select("session_id", "i", "j", F.lit(math.log(0.97)).alias("log_same"), F.lit(math.log(0.03)).alias("log_diff"), F.when(F.col("i") % 2 == 0, 0.9).otherwise(0.6).alias("likeness"))
    return phi, near, evidence


def _answered(spark, sf_dir):
    """(answers, answers about voices): every 20th line is answered by its label, every 100th by nobody; voice 3 is known."""
    o = _obs(spark, sf_dir)
    own = o.filter("ref % 20 = 0").select("session_id", "ref", F.when(F.col("ref") % 100 == 0, "idk").otherwise(F.concat(F.lit("member:"), F.col("label"))).alias("candidate"))
    return own, o.select("session_id").distinct().select("session_id", F.lit(3).alias("voice"), F.lit("member:3").alias("candidate"))


def belief_status(spark, sf_dir):
    """Every line's status from the graph before and after the answers, and who decided it."""
    o = _obs(spark, sf_dir)
    phi, edges, evidence = _graph(spark, sf_dir)
    own, heard = _answered(spark, sf_dir)
    needs = o.filter("ref % 11 = 0").select("session_id", "ref", F.lit("sing").alias("capability"))
    learned = A.prints(spark, sf_dir).select("candidate").distinct().filter("candidate = 'member:1'").select("candidate", F.lit("sing").alias("capability"))
    found = D.verdicts(phi, edges, evidence, o.select("session_id", "ref", F.col("label").alias("voice")), own, heard, needs, learned, edges)
    return found.select("session_id", "ref", "best", F.round("p_max", 4).alias("p_max"), F.round("margin", 4).alias("margin"), "channel", "status", "decided_by")


QUERIES = {f.__name__: f for f in (voice_relabel, voice_labels, voice_suspicions, voice_verdicts, belief_status)}

ORACLES = {
    "voice_suspicions": HITS_SQL + f""", o AS (SELECT session_id, label AS voice, ref, ref % {A.SESSION} / 2 AS s, ref % {A.SESSION} / 2 + duration + CASE WHEN ref % 97 = 0 THEN 20 ELSE 0 END AS e, ref % 3 AS raw, ref % 17 / 16 AS conf FROM observations),
      m AS (SELECT session_id, quantile_cont(e - s, 0.99) AS far, quantile_cont(conf, 0.5) AS middle FROM o GROUP BY 1),
      b AS (SELECT *, e - s AS len, lead(raw) OVER w AS r2, lead(raw, 2) OVER w AS r3, lead(s, 2) OVER w - e AS gap FROM o WINDOW w AS (PARTITION BY session_id, voice ORDER BY s, ref)),
      wants AS (SELECT DISTINCT session_id, voice, 'c' || (ref % 7) AS c FROM o WHERE ref % 40 = 0),
      has AS (SELECT DISTINCT candidate AS member, 'c' || ((split_part(candidate, ':', 2)::INT + k) % 7) AS c FROM prints, range(3) r(k)),
      able AS (SELECT session_id, voice, member, count(*) AS n FROM wants JOIN has USING (c) GROUP BY 1, 2, 3),
      f AS (SELECT session_id, voice, 'aba_pattern' AS kind, 0.7::DOUBLE AS weight FROM b WHERE raw = r3 AND raw <> r2 AND gap <= 3 GROUP BY 1, 2
        UNION ALL SELECT session_id, voice, 'length_outlier', 0.6 FROM b JOIN m USING (session_id) WHERE far > 0 AND len > far GROUP BY 1, 2
        UNION ALL SELECT session_id, voice, 'confidence_collapse', 0.5 FROM b JOIN m USING (session_id) WHERE middle > 0 AND conf < 0.6 * middle GROUP BY 1, 2
        UNION ALL SELECT session_id, label, 'anchor_conflict', 1.0 FROM hits WHERE rank = 1 AND cosine >= 0.25 GROUP BY 1, 2 HAVING count(DISTINCT candidate) >= 2
        UNION ALL SELECT session_id, voice, 'capability_contradiction', 0.8 FROM wants GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) > coalesce((SELECT max(n) FROM able WHERE able.session_id = wants.session_id AND able.voice = wants.voice), 0))
      SELECT session_id, voice, kind, weight, row_number() OVER (PARTITION BY session_id, voice ORDER BY weight DESC, kind) AS place FROM f""",
}
