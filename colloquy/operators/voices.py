"""Voices of a session as wholes: labels from vectors and enrolled people, what speaks against a voice, and the verdict on it."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.operators import kernels as K
from colloquy.operators import planning as P
from colloquy.operators import transcript as T
from colloquy.operators import vectors as V
from colloquy.shared import stash

#: How far clusters may be apart, how alike an enrolled voice must be, how labels are written.
THRESHOLD, ANCHORED, LABEL = 0.5, 0.6, "SPEAKER_%02d"
#: How heavily each reason weighs, and their bounds.
WEIGHTS = {"anchor_conflict": 1.0, "capability_contradiction": 0.8, "aba_pattern": 0.7, "length_outlier": 0.6, "confidence_collapse": 0.5}
ANCHOR_LEAST, ABA_SECONDS, LONG, COLLAPSE = 0.75, 3.0, 0.99, 0.6


class Relabelled(NamedTuple):
    """segments as they were with the new speaker; voices (session_id, label, cluster, turns, seconds, centroid, user, cosine)."""

    segments: DataFrame
    voices: DataFrame


def _linked(embedded: DataFrame, rule: DataFrame | None, threshold: float) -> DataFrame:
    """(session_id, turn, cluster) by average linkage, a session a task."""
    none = (F.lit(None).cast("int").alias("k"), F.lit(None).cast("double").alias("threshold"))
    rows = embedded.join(rule.select("session_id", "k", "threshold"), "session_id", "left") if rule is not None else embedded.select("*", *none)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        x = K._units(pdf["vector"])
        k, far = pdf["k"].iloc[0], pdf["threshold"].iloc[0]
        ids = K.upgma(np.clip(1 - x @ x.T, 0, 2), k=None if pd.isna(k) else int(k), threshold=threshold if pd.isna(far) else float(far))
        return pd.DataFrame({"session_id": pdf["session_id"], "turn": pdf["turn"], "cluster": ids})

    kind = {c: embedded.schema[c].dataType.simpleString() for c in ("session_id", "turn")}
    return rows.select("session_id", "turn", "vector", "k", "threshold").groupBy("session_id").applyInPandas(run, f"session_id {kind['session_id']}, turn {kind['turn']}, cluster int")


def inherited(turns: DataFrame, clustered: DataFrame) -> DataFrame:
    """(session_id, turn, cluster): a turn's own cluster, else that of the clustered turn whose middle is nearest, of equals the turn of the lowest number; null where a session has none.

    Two windows over a session's turns by their middles find the nearest on either side.
    """
    middle = (F.col("start") + F.col("end")) / 2
    rows = turns.select("session_id", "turn", middle.alias("mid")).join(clustered, ["session_id", "turn"], "left")
    at_once = Window.partitionBy("session_id", "mid")
    lowest = F.min(F.when(F.col("cluster").isNotNull(), F.struct("turn", "cluster"))).over(at_once)
    own = F.when(F.col("cluster").isNotNull(), F.struct("mid", "low"))
    w = Window.partitionBy("session_id").orderBy("mid", "turn")
    both = rows.withColumn("low", lowest).withColumns({"before": F.last(own, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first(own, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["mid"] - F.col("mid")).alias("far"), F.col(c)["low"]["turn"].alias("turn"), F.col(c)["low"]["cluster"].alias("cluster")))
    nearest = F.array_min(F.filter(F.array(side("before"), side("after")), lambda s: s.isNotNull()))
    return both.select("session_id", "turn", F.coalesce("cluster", nearest["cluster"]).alias("cluster"))


def relabel(segments: DataFrame, turns: DataFrame, embedded: DataFrame, anchors: DataFrame | None = None, rule: DataFrame | None = None, threshold: float = THRESHOLD, least: float = ANCHORED) -> Relabelled:
    """Labels of a session's own making in place of those that the diarizer gave.

    segments (session_id, seg_idx, speaker, ..), turns as ``transcript.speaker_turns``
    has them, embedded (session_id, turn, vector) for the turns with a vector,
    anchors (session_id, id, user, vector) for the people who may be there, of
    equally near ones that of the lowest id; rule (session_id, k, threshold) where
    sessions end their linkage at a number of voices. Clusters are numbered by
    their first segment. Turns without a vector take the label of the nearest in
    time; a session without any vector and segments in no turn keep what they had.

    Linkage is what a task does for a session; it is written, as means, labels and
    segments all need it. Everything else is grouping and windows.
    """
    clustered = stash(_linked(embedded, rule, threshold))
    keys = ["session_id", "cluster"]
    spoken = turns.select("session_id", "turn", (F.col("end") - F.col("start")).alias("seconds"), F.array_min("indices").alias("first"))
    voices = clustered.join(spoken, ["session_id", "turn"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("turns"), F.sum("seconds").alias("seconds"), F.min("first").alias("first"))
    number = (F.row_number().over(Window.partitionBy("session_id").orderBy("first", "cluster")) - 1).cast("int")
    named = voices.select(*keys, "turns", "seconds", F.format_string(LABEL, number).alias("label"))
    means = V.centroids(clustered.join(embedded, ["session_id", "turn"]).withColumn("vector", F.col("vector").cast("array<double>")), keys)
    voices = named.join(means, keys)
    if anchors is not None:
        near = V.nearest(means.select("session_id", F.col("cluster").alias("id"), F.col("centroid").alias("vector")), anchors, 1).filter(F.col("cosine") >= least)
        snapped = near.join(anchors.select("session_id", "id", "user"), ["session_id", "id"]).select("session_id", F.col("ref").alias("cluster"), "user", "cosine")
        voices = voices.join(snapped, keys, "left")
    else:
        voices = voices.select("*", F.lit(None).cast("string").alias("user"), F.lit(None).cast("double").alias("cosine"))
    of_turn = inherited(turns, clustered).join(named.select(*keys, "label"), keys, "left").select("session_id", "turn", "label")
    new = turns.select("session_id", "turn", F.explode("indices").alias("seg_idx")).join(of_turn, ["session_id", "turn"]).select("session_id", "seg_idx", F.col("label").alias("_label"))
    out = segments.join(new, ["session_id", "seg_idx"], "left")
    relabelled = out.select(*[F.coalesce("_label", "speaker").alias("speaker") if c == "speaker" else c for c in segments.columns])
    return Relabelled(relabelled, voices.select("session_id", "label", "cluster", "turns", "seconds", "centroid", "user", "cosine"))


def rewrite_speakers(transcript: DataFrame, relabelled: DataFrame) -> DataFrame:
    """A transcript (session_id, start, end, speaker, ..) with the labels of the relabelled segments (session_id, seg_idx, start, end, speaker) of equal times, of several the last; the rest stays."""
    keys = ["session_id", "start", "end"]
    new = relabelled.filter("speaker IS NOT NULL").groupBy(*keys).agg(F.max_by("speaker", "seg_idx").alias("_label"))
    out = transcript.join(new, keys, "left")
    return out.select(*[F.coalesce("_label", "speaker").alias("speaker") if c == "speaker" else c for c in transcript.columns])


def suspicions(obs: DataFrame, hits: DataFrame, needs: DataFrame, members: DataFrame, least: float = ANCHOR_LEAST) -> DataFrame:
    """(session_id, voice, kind, weight, place): every reason to think that a voice is several people, the heaviest first.

    obs (session_id, voice, ref, start, end, label, confidence), hits (session_id, ref,
    candidate, cosine, rank) of enrolled voices, needs (session_id, voice,
    capability), members (member, capability). Enrolled voices of two people found
    surely; needs that no member meets together; the diarizer's label changed and
    back within three seconds; a line longer than the session's 99th percentile;
    a confidence under 0.6 of the session's median. What is null says nothing.
    """
    keys = ["session_id", "voice"]
    length = F.col("end") - F.col("start")
    w = Window.partitionBy(*keys).orderBy("start", "ref")
    second, third = F.lead("label").over(w), F.lead("label", 2).over(w)
    back = (F.col("label") == third) & (F.col("label") != second) & (F.lead("start", 2).over(w) - F.col("end") <= ABA_SECONDS)
    session = obs.groupBy("session_id").agg(F.percentile(length, F.lit(LONG)).alias("long"), F.percentile("confidence", F.lit(0.5)).alias("middle"))
    own = obs.withColumn("back", back).groupBy(*keys).agg(F.bool_or(F.coalesce("back", F.lit(False))).alias("back"), F.max(length).alias("longest"), F.min("confidence").alias("least"))
    both = own.join(session, "session_id")
    seen: dict[str, Column] = {
        "aba_pattern": F.col("back"),
        "length_outlier": (F.col("long") > 0) & (F.col("longest") > F.col("long")),
        "confidence_collapse": (F.col("middle") > 0) & (F.col("least") < COLLAPSE * F.col("middle")),
    }
    heard = both.select(*keys, F.explode(F.filter(F.array(*[F.when(on, F.lit(k)) for k, on in seen.items()]), lambda k: k.isNotNull())).alias("kind"))
    matched = hits.join(obs.select("session_id", "ref", F.col("voice").alias("label")), ["session_id", "ref"])
    two = V.anchor_conflict(matched, least).select("session_id", F.col("label").alias("voice"), F.lit("anchor_conflict").alias("kind"))
    clash = P.unmet(needs.withColumnRenamed("voice", "label"), members).select("session_id", F.col("label").alias("voice"), F.lit("capability_contradiction").alias("kind"))
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), F.col("kind"))
    fired = heard.unionByName(two).unionByName(clash).withColumn("weight", weight)
    return P.triggers(fired.withColumnRenamed("voice", "label")).withColumnRenamed("label", "voice")


def identity_verdicts(obs: DataFrame, fired: DataFrame, baseline: DataFrame) -> DataFrame:
    """(session_id, voice, n, seconds, purity, impure, reason, sep, triggers, first, second): whether a voice is one person, why it was suspected, and if it is two, whose lines are whose.

    obs (session_id, voice, ref, vector, duration), fired as ``suspicions`` has it,
    baseline (session_id, p95): a session without one has nothing to compare the
    distance of the sides with. first and second are null for a pure voice. A voice
    is one task, of which not more than 200 lines are judged for purity.
    """
    keys = ["session_id", "voice"]
    rows = obs.join(baseline.select("session_id", "p95"), "session_id", "left")
    kind = {c: obs.schema[c].dataType.simpleString() for c in (*keys, "ref")}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ref")
        x, p95 = K._units(pdf["vector"]), pdf["p95"].iloc[0]
        purity, reason, sep, _ = K.purity_of(x, pdf["duration"].to_numpy(float), -np.inf if pd.isna(p95) else float(p95))
        sides = [None, None]
        if reason == "impure":
            side = np.array(K.kmeans(x, 2, restarts=25, seed=K.SEED))
            sides = [pdf["ref"].to_numpy()[side == s].tolist() for s in (0, 1)]
        return pd.DataFrame([(*(pdf[c].iloc[0] for c in keys), len(pdf), float(pdf["duration"].sum()), purity, reason == "impure", reason, sep, *sides)], columns=[*keys, "n", "seconds", "purity", "impure", "reason", "sep", "first", "second"])

    judged = rows.select(*keys, "ref", "vector", "duration", "p95").groupBy(*keys).applyInPandas(run, f"session_id {kind['session_id']}, voice {kind['voice']}, n long, seconds double, purity double, impure boolean, reason string, sep double, first array<{kind['ref']}>, second array<{kind['ref']}>")
    why = fired.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "kind"))), lambda t: t["kind"]).alias("triggers"))
    found = judged.join(why, keys, "left").withColumn("triggers", F.coalesce("triggers", F.array().cast("array<string>")))
    return found.select(*keys, "n", "seconds", "purity", "impure", "reason", "sep", "triggers", "first", "second")


def turn_vectors(turns: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(session_id, turn, vector): the mean of the vectors (session_id, seg_idx, vector) of a turn's segments, for the turns of at least that many seconds."""
    long_ = T.observations(turns, least).select("session_id", "turn", F.explode("indices").alias("seg_idx"))
    return V.centroids(long_.join(vectors, ["session_id", "seg_idx"]), ["session_id", "turn"]).withColumnRenamed("centroid", "vector")
