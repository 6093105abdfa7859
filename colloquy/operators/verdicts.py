"""The status of every line from the graph itself: what was answered, what an answer carried over, what a second channel bears out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import evidence as E
from colloquy.operators import kernels as K
from colloquy.operators import planning as P
from colloquy.operators import review as R
from colloquy.shared import stash


def answered_lines(answers: DataFrame, voices: DataFrame, voice_answers: DataFrame) -> DataFrame:
    """(session_id, ref) of the lines that an answer names, by themselves or by their voice (session_id, ref, voice); "don't know" names nobody."""
    own = answers.filter(F.col("candidate") != P.IDK).select("session_id", "ref")
    heard = voices.join(voice_answers.filter(F.col("candidate") != P.IDK), ["session_id", "voice"]).select("session_id", "ref")
    return own.unionByName(heard).distinct()


def verdicts(potentials: DataFrame, edges: DataFrame, evidence: DataFrame, voices: DataFrame, answers: DataFrame, voice_answers: DataFrame, needs: DataFrame, learned: DataFrame, alike: DataFrame) -> DataFrame:
    """(session_id, ref, best, p_max, margin, entropy, channel, status, decided_by) of each line.

    potentials (session_id, ref, candidate, log_phi) and edges are the graph without
    answers; evidence (session_id, ref, channel, candidate, log_lr) is what it was
    made of; answers, voice_answers, needs and learned as ``planning.with_answers``
    has them, alike (session_id, i, j, likeness) the lines that an answer is carried
    over to.

    Inference runs twice, without the answers and with them; both results are
    written, as each is read more than once. A line whose distribution the answers
    moved and that nobody answered itself is inferred, and must clear the higher
    bar. Of the rest a line is certain only with a second reason besides its
    voice: a channel that speaks for the best candidate by itself, or a voice
    strong enough. Without answers nothing is inferred.
    """
    known = answers.filter(F.col("candidate") != P.IDK)
    more = R.spread_answers(known, alike).join(known.select("session_id", "ref"), ["session_id", "ref"], "left_anti")
    keys = ["session_id", "ref", "candidate"]
    told = P.with_answers(potentials, voices, answers, voice_answers, needs, learned).join(more.withColumnRenamed("log_lr", "carried"), keys, "left").select(*keys, (F.col("log_phi") + F.coalesce("carried", F.lit(0.0))).alias("log_phi"))
    before, after = stash(K.posteriors(potentials, edges)), stash(K.posteriors(told, edges))
    lines = E.summary(after)
    second = R.corroboration(evidence, lines.select("session_id", "ref", "best")).select("session_id", "ref", "channel")
    own_voice = evidence.filter("channel = 'voice'").select("session_id", "ref", F.col("candidate").alias("best"), F.col("log_lr").alias("voice"))
    anyone = answered_lines(answers, voices, voice_answers).withColumn("answered", F.lit(True))
    moved = P.owed(before, after, known).withColumn("inferred", F.lit(True))
    rows = lines.join(second, ["session_id", "ref"], "left").join(own_voice, ["session_id", "ref", "best"], "left").join(anyone, ["session_id", "ref"], "left").join(moved, ["session_id", "ref"], "left")
    rows = rows.na.fill(False, ["answered", "inferred"]).na.fill(0.0, ["voice"])
    c = lambda x: F.round(x, 9)
    status = E.classify(c("p_max"), c("margin"), c("voice"), F.col("channel").isNotNull(), F.col("inferred"), F.col("answered"))
    by = F.when(F.col("answered"), "question").when(F.col("inferred"), "propagation").otherwise("engine")
    return rows.select("session_id", "ref", "best", "p_max", "margin", "entropy", "channel", status.alias("status"), by.alias("decided_by"))
