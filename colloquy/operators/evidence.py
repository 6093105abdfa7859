"""Evidence, fusion and status. Everything is long: a row for session, utterance, channel and candidate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.vectors import clamp

#: Fixed values of the model, by channel: log likelihood ratios and caps.
SELF_NAME_FIRST, SELF_NAME_THIRD = 3.5, 2.0
CAPABILITY, CAPABILITY_CAP = 1.2, 3.0
ADDRESS, ADDRESSER, ADDRESS_GAP = 2.5, -0.4, 12.0
NARRATION, VOICE_MODE, ROLL, USER_ANSWER = 2.2, 2.0, 1.0, 8.0
OUT_OF_WORLD_DM, OUT_OF_WORLD = 0.8, 0.3
DM_PRIOR, DM_PRIOR_CAP = 0.5, 1.5
SPREAD_CAP, ABSENT = 0.5, math.log(0.05)
SLOPE, MIDPOINT, CLIP = 12.0, 0.55, 6.0
MIN_BANDWIDTH = 0.02
#: Statuses from least to most certain.
STATUSES = ["unresolved", "auto_low", "auto_high", "propagated", "user_confirmed"]
CONFIDENT = STATUSES[2:]


def voice_llr(score: Column, quality: Column) -> Column:
    """The linear calibration, clipped, scaled by quality."""
    return clamp(SLOPE * (score - MIDPOINT), -CLIP, CLIP) * clamp(quality, 0, 1)


def bandwidth(samples: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Silverman's rule with a floor."""
    s = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(x).alias("sd"), (F.max(x) - F.min(x)).alias("range"))
    spread = F.when(F.col("sd") > 0, F.col("sd")).when(F.col("range") > 0, F.col("range")).otherwise(MIN_BANDWIDTH)
    return s.select(*keys, "n", F.when(F.col("n") < 2, MIN_BANDWIDTH).otherwise(F.greatest(F.lit(MIN_BANDWIDTH), 1.06 * spread * F.pow(F.col("n"), F.lit(-0.2)))).alias("bandwidth"))


def kde_log_density(points: DataFrame, samples: DataFrame, h: float) -> DataFrame:
    """Per point (key, x) the log density of a Gaussian kernel estimate over samples (s) of the same key.

    Equal samples are counted first.
    """
    counted = samples.groupBy("key", "s").agg(F.count(F.lit(1)).alias("n"))
    z = (F.col("x") - F.col("s")) / h
    terms = points.join(counted, "key").groupBy("key", "x").agg(F.sum(F.col("n") * F.exp(-0.5 * z * z)).alias("t"), F.sum("n").alias("n"))
    return terms.select("key", "x", (F.log("t") - F.log("n") - math.log(h) - 0.5 * math.log(2 * math.pi)).alias("log_density"))


def spread(total: Column, candidates: Column) -> Column:
    """What the others lose when one gains total."""
    return -F.least(F.lit(SPREAD_CAP), F.abs(total) / candidates)


def speech_share(posteriors: DataFrame, utterances: DataFrame) -> DataFrame:
    """Per candidate the seconds it likely spoke; unknown is left out."""
    return posteriors.filter("candidate <> 'unknown'").join(utterances.select("session_id", "ref", "seconds"), ["session_id", "ref"]).groupBy("session_id", "candidate").agg(F.sum(F.col("p") * F.col("seconds")).alias("share"))


def dm_prior(shares: DataFrame) -> DataFrame:
    """Half the log of a share over the mean share of its session, within the cap; nothing if nobody spoke."""
    w = Window.partitionBy("session_id")
    mean = F.avg("share").over(w)
    value = F.when(F.col("share") <= 0, -DM_PRIOR_CAP).otherwise(clamp(DM_PRIOR * F.log(F.col("share") / F.col("mean")), -DM_PRIOR_CAP, DM_PRIOR_CAP))
    return shares.withColumn("mean", mean).filter("mean > 0").withColumn("log_lr", value)


def capability(needs: DataFrame, members: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per utterance and candidate: 1.2 for each requirement met, less 1.2 for each ruled out, within the cap.

    needs (session_id, ref, capability), members (candidate, capability, polarity
    +1 or -1), candidates (session_id, candidate).
    """
    all_ = needs.join(candidates, "session_id").join(members, ["candidate", "capability"], "left")
    return all_.groupBy("session_id", "ref", "candidate").agg(clamp(F.sum(CAPABILITY * F.coalesce("polarity", F.lit(0))), -CAPABILITY_CAP, CAPABILITY_CAP).alias("log_lr"))


def address(utterances: DataFrame) -> DataFrame:
    """2.5 for whom the line before spoke to (addressed), if it ended at most twelve seconds ago or is unknown to have."""
    w = Window.partitionBy("session_id").orderBy("ordinal")
    before = utterances.withColumns({"_to": F.lag("addressed").over(w), "_from": F.lag("speaker").over(w)})
    near = F.col("gap").isNull() | (F.col("gap") <= ADDRESS_GAP)
    to = before.filter(F.col("_to").isNotNull() & near)
    gains = to.select("session_id", "ordinal", F.col("_to").alias("candidate"), F.lit(ADDRESS).alias("log_lr"))
    loses = to.select("session_id", "ordinal", F.col("_from").alias("candidate"), F.lit(ADDRESSER).alias("log_lr"))
    return gains.union(loses).groupBy("session_id", "ordinal", "candidate").agg(F.sum("log_lr").alias("log_lr"))


def fuse(nodes: DataFrame, evidence: DataFrame, prior: DataFrame, identity: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """log_phi of every candidate of every node: ln prior + alpha * ln identity + the weighted ratios.

    nodes (session_id, ref, alpha), prior (session_id, candidate, p) gives the
    candidates of a session; a channel without an opinion adds nothing.
    """
    dense = nodes.join(prior, "session_id").withColumn("base", F.log(F.greatest(F.col("p"), F.lit(1e-6))))
    w = F.lit(1.0)
    for channel, value in (weights or {}).items():
        w = F.when(F.col("channel") == channel, value).otherwise(w)
    summed = evidence.groupBy("session_id", "ref", "candidate").agg(F.sum(F.col("log_lr") * w).alias("llr"))
    out = dense.join(summed, ["session_id", "ref", "candidate"], "left").withColumn("log_phi", F.col("base") + F.coalesce("llr", F.lit(0.0)))
    if identity is not None:
        named = identity.select("session_id", "ref", "candidate", F.col("p").alias("ident"))
        out = out.join(named, ["session_id", "ref", "candidate"], "left").withColumn("log_phi", F.col("log_phi") + F.col("alpha") * F.log(F.greatest(F.coalesce("ident", F.lit(1e-9)), F.lit(1e-9))))
    return out.select("session_id", "ref", "candidate", "log_phi")


def softmax(rows: DataFrame, keys: list[str], x: str = "log_phi", temperature: float = 1.0) -> DataFrame:
    w = Window.partitionBy(*keys)
    e = F.exp((F.col(x) - F.max(x).over(w)) / temperature)
    return rows.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def summary(posteriors: DataFrame) -> DataFrame:
    """Per node: best candidate (of equals the smallest name), p_max, margin to the second, entropy in nats."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("neg"), "candidate")))
    plogp = F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p")).otherwise(0.0))
    s = posteriors.groupBy("session_id", "ref").agg(ranked.alias("r"), plogp.alias("entropy"))
    second = F.when(F.size("r") > 1, -F.col("r")[1]["neg"]).otherwise(0.0)
    return s.select("session_id", "ref", F.col("r")[0]["candidate"].alias("best"), (-F.col("r")[0]["neg"]).alias("p_max"), (-F.col("r")[0]["neg"] - second).alias("margin"), "entropy")


def classify(p: Column, margin: Column, voice: Column, corroborated: Column, propagated: Column, answered: Column) -> Column:
    """One of STATUSES. An answer goes first; what was inferred from an answer must clear the higher bar and never counts as observed."""
    low = F.when(p >= 0.60, "auto_low").otherwise("unresolved")
    spread_ = F.when((p >= 0.95) & (margin >= 0.75), "propagated").otherwise(low)
    seen = F.when((p >= 0.90) & (margin >= 0.50) & (corroborated | (voice >= 3.0)), "auto_high").otherwise(low)
    return F.when(answered, "user_confirmed").when(propagated, spread_).otherwise(seen)


def coverage(rows: DataFrame) -> DataFrame:
    """Per session the share of stakes times seconds that is confident (1 if there are none), and of stakes that isn't (0): a line that is only leaned towards is as open as one that nothing is known of."""
    weight = F.coalesce("stakes", F.lit(0.5)) * F.col("seconds")
    sure = F.sum(F.when(F.col("status").isin(*CONFIDENT), weight).otherwise(0.0))
    lost = F.sum(F.when(~F.coalesce(F.col("status").isin(*CONFIDENT), F.lit(False)), F.coalesce("stakes", F.lit(0.5))).otherwise(0.0))
    stakes = F.sum(F.coalesce("stakes", F.lit(0.5)))
    return rows.groupBy("session_id").agg(F.when(F.sum(weight) > 0, sure / F.sum(weight)).otherwise(1.0).alias("coverage"), F.when(stakes > 0, lost / stakes).otherwise(0.0).alias("unresolved_stakes"))


def identity_posterior(scores: DataFrame) -> DataFrame:
    """Per voice (label) the best calibrated ratio of each candidate, as a distribution."""
    best = scores.groupBy("session_id", "label", "candidate").agg(F.max(voice_llr(F.col("score"), F.lit(1.0))).alias("llr"))
    return softmax(best, ["session_id", "label"], "llr")


def answer_probabilities(posteriors: DataFrame, unsure: float = 0.15) -> DataFrame:
    """The chance of each answer if a share of people doesn't know: (session_id, ref, option, chance)."""
    total = F.sum("p").over(Window.partitionBy("session_id", "ref"))
    known = posteriors.select("session_id", "ref", F.col("candidate").alias("option"), ((1 - unsure) * F.col("p") / total).alias("chance"))
    return known.union(posteriors.select("session_id", "ref").distinct().select("session_id", "ref", F.lit("idk"), F.lit(unsure)))


def shortlist(questions: DataFrame, most: int = 24) -> DataFrame:
    """Per session the questions worth simulating: blocking ones first, then by reach over cost."""
    w = Window.partitionBy("session_id").orderBy(F.col("blocking").desc(), F.round(F.col("reach") / F.col("cost"), 9).desc(), "kind", "prompt")
    return questions.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most)


def best_capabilities(rows: DataFrame) -> DataFrame:
    """Per member and capability the entry of the most trusted source, then the most certain one."""
    trust = F.when(F.col("source") == "dm", 1.0).when(F.col("source") == "answer", 0.9).when(F.col("source") == "wiki", 0.8).otherwise(0.4)
    return rows.groupBy("member", "capability").agg(F.max_by(F.struct("polarity", "source"), F.struct(trust.alias("t"), "confidence", "source", "polarity")).alias("b"), F.max("confidence").alias("confidence")).select("member", "capability", "b.polarity", "b.source", "confidence")
