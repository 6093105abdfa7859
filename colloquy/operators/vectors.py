"""Vector analytics. Similarity joins always have a session or campaign as an equality key.

All pairs of a session are compared as matrices: Spark deals blocks of at most
BLOCK rows a side to tasks, and a task returns what the operator keeps of a block
pair (the best k of a row, pairs over a threshold, counts), never all of it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.vectors import clamp, cosine, unit


def centroids(rows: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """The mean of each group's vectors, scaled to length one; sums are taken before the shuffle, position by position."""
    parts = rows.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    return parts.groupBy(*keys).agg(unit(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])).alias("centroid"))


def units(rows: DataFrame) -> DataFrame:
    return rows.withColumn("unit", unit("vector"))


BLOCK = 1024
#: Bins over distances from 0 to 2 by which percentiles are found.
BINS = 4096


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.vstack(vectors.to_numpy()).astype(float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _in_blocks(left: DataFrame, right: DataFrame, keys: list[str], run: Callable[[tuple, pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, block: int = BLOCK) -> DataFrame:
    """run(key, left rows, right rows, their cosines) of each pair of blocks of a group; both sides have keys, id and vector.

    A group of at most ``block`` rows a side is one pair. Of larger ones, of which
    there are few, the sizes are joined; Spark broadcasts them only below its threshold.
    """
    def large(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name)).filter(F.col(name) > 1)

    sizes = large(left, "_nl").join(large(right, "_nr"), keys, "full")

    def side(df: DataFrame, own: str, other: str, own_n: str, other_n: str) -> DataFrame:
        counted = df.join(sizes, keys, "left").withColumns({"_nl": F.coalesce("_nl", F.lit(1)), "_nr": F.coalesce("_nr", F.lit(1))})
        dealt = counted.withColumn(own, F.pmod(F.xxhash64("id"), F.col(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))).drop("_nl", "_nr")
        return dealt.select(*[F.col(c).alias(c) for c in dealt.columns])  # columns of its own, as both sides may be one table

    def pair(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({f.split(" ")[0]: [] for f in schema.split(", ")})
        a, b = a.sort_values("id", ignore_index=True), b.sort_values("id", ignore_index=True)
        return run(key, a, b, _unit_rows(a["vector"]) @ _unit_rows(b["vector"]).T)

    deal = [*keys, "_l", "_r"]
    return side(left, "_l", "_r", "_nl", "_nr").groupBy(*deal).cogroup(side(right, "_r", "_l", "_nr", "_nl").groupBy(*deal)).applyInPandas(pair, schema)


def _best(cosine_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the best k of each row, of equals (to nine places) the first; excluded ones are -inf."""
    order = np.argsort(-np.round(cosine_, 9), axis=1, kind="stable")[:, :k]
    rows = np.repeat(np.arange(len(cosine_)), order.shape[1])
    columns = order.ravel()
    keep = np.isfinite(cosine_[rows, columns])
    return rows[keep], columns[keep]


def _kind(df: DataFrame, *columns: str) -> list[str]:
    return [df.schema[c].dataType.simpleString() for c in columns]


def nearest(left: DataFrame, right: DataFrame, k: int, itself: bool = True, block: int = BLOCK) -> DataFrame:
    """Per left row (session_id, id) the k most similar right rows of its session: session_id, ref, id, cosine, rank; itself: a row may find its own id."""

    def run(key, a: pd.DataFrame, b: pd.DataFrame, c: np.ndarray) -> pd.DataFrame:
        if not itself:
            c = np.where(a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None], -np.inf, c)
        i, j = _best(c, k)
        return pd.DataFrame({"session_id": key[0], "ref": a["id"].to_numpy()[i], "id": b["id"].to_numpy()[j], "cosine": c[i, j]})

    session, ref = _kind(left, "session_id", "id")
    some = _in_blocks(left.select("session_id", "id", "vector"), right.select("session_id", "id", "vector"), ["session_id"], run, f"session_id {session}, ref {ref}, id {_kind(right, 'id')[0]}, cosine double", block)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("session_id", "ref").orderBy(F.round("cosine", 9).desc(), "id"))).filter(F.col("rank") <= k)


def top_prints(obs: DataFrame, prints: DataFrame, k: int) -> DataFrame:
    """Per observation the k most similar prints of its session: session_id, ref, id, candidate, cosine, rank."""
    found = nearest(obs.withColumnRenamed("ref", "id"), prints, k)
    return found.join(prints.select("session_id", "id", "candidate"), ["session_id", "id"]).select("session_id", "ref", "id", "candidate", "cosine", "rank")


def select_nearest(hits: DataFrame, most: int = 8, floor: float = 0.2) -> DataFrame:
    """The best hit always, further ones up to most while they reach floor."""
    return hits.filter((F.col("rank") == 1) | ((F.col("rank") <= most) & (F.col("cosine") >= floor)))


def candidate_scores(hits: DataFrame, top: int = 3) -> DataFrame:
    """Per observation and candidate the mean cosine of its best ``top`` prints."""
    w = Window.partitionBy("session_id", "ref", "candidate").orderBy(F.round("cosine", 9).desc(), "id")
    return hits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).groupBy("session_id", "ref", "candidate").agg(F.avg("cosine").alias("score"))


def label_scores(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Per label and candidate the best score over the label's observations."""
    return scores.join(labels.select("session_id", "ref", "label"), ["session_id", "ref"]).groupBy("session_id", "label", "candidate").agg(F.max("score").alias("score"))


def pairs(obs: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Pairs i < j within a session with a cosine (to six places) of at least ``least``: session_id, i, j, cosine, label_i, label_j."""

    def run(key, a: pd.DataFrame, b: pd.DataFrame, c: np.ndarray) -> pd.DataFrame:
        left, right = a["id"].to_numpy(), b["id"].to_numpy()
        i, j = np.nonzero((np.round(c, 6) >= least) & (left[:, None] < right[None]))
        return pd.DataFrame({"session_id": key[0], "i": left[i], "j": right[j], "cosine": c[i, j], "label_i": a["label"].to_numpy()[i], "label_j": b["label"].to_numpy()[j]})

    rows = obs.select("session_id", F.col("ref").alias("id"), "vector", "label")
    session, ref, label = _kind(rows, "session_id", "id", "label")
    return _in_blocks(rows, rows, ["session_id"], run, f"session_id {session}, i {ref}, j {ref}, cosine double, label_i {label}, label_j {label}", block)


def knn_edges(obs: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The undirected edges from each observation to its k nearest: session_id, i, j, cosine, each once."""
    rows = obs.withColumnRenamed("ref", "id")
    near = nearest(rows, rows, k, itself=False, block=block)
    return near.groupBy("session_id", F.least("ref", "id").alias("i"), F.greatest("ref", "id").alias("j")).agg(F.max("cosine").alias("cosine"))


def intra_cosine(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean cosine of all pairs within a group, from sums: groups of one are left out.

    The sum over pairs of unit vectors is (|sum|^2 - n) / 2, so no pair is formed;
    zero vectors count as similar to nothing.
    """
    rows = units(obs).withColumn("_one", F.aggregate("unit", F.lit(0.0), lambda a, x: a + x * x))
    sums = rows.select(*keys, F.posexplode("unit").alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum("x").alias("s")).groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_one").alias("ones"))
    return counts.filter("n > 1").join(sums, keys).select(*keys, "n", ((F.col("square") - F.col("ones")) / (F.col("n") * (F.col("n") - 1))).alias("intra"))


def split_geometry(obs: DataFrame, side: str) -> DataFrame:
    """Two sides (0, 1) of each session: distance of the centroids, worst mean distance within a side, sizes."""
    keyed = obs.withColumn("side", F.col(side))
    c = centroids(keyed, ["session_id", "side"])
    zero, one = (c.filter(F.col("side") == s).select("session_id", F.col("centroid").alias(f"c{s}")) for s in (0, 1))
    inner = intra_cosine(keyed, ["session_id", "side"]).groupBy("session_id").agg(F.max(1 - F.col("intra")).alias("within"))
    sizes = keyed.groupBy("session_id").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    return zero.join(one, "session_id").join(sizes, "session_id").join(inner, "session_id", "left").select("session_id", (1 - cosine("c0", "c1")).alias("sep"), F.coalesce("within", F.lit(0.0)).alias("within"), "n0", "n1")


def rand_index(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings per group; 1 where it isn't defined."""
    two = lambda n: n * (n - 1) / 2
    cells = rows.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))
    both = cells.groupBy(*keys).agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("all"))
    side = lambda c, name: cells.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(two(F.col("n"))).alias(name))
    j = both.join(side(a, "in_a"), keys).join(side(b, "in_b"), keys)
    chance = F.col("in_a") * F.col("in_b") / two(F.col("all"))
    most = (F.col("in_a") + F.col("in_b")) / 2
    return j.select(*keys, F.when((F.col("all") < 2) | (most == chance), 1.0).otherwise((F.col("both") - chance) / (most - chance)).alias("ari"))


def same_voice_baseline(obs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Median and 95th percentile (linear interpolation) of the distance of pairs with one label, per session, and how many there are.

    Distances are counted in bins first; only those in the few bins that hold a
    wanted rank become rows.
    """
    rows = obs.select("session_id", "label", F.col("ref").alias("id"), "vector")
    session = _kind(rows, "session_id")[0]

    def distances(a: pd.DataFrame, b: pd.DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = 1 - c[a["id"].to_numpy()[:, None] < b["id"].to_numpy()[None]]
        return d, np.clip((d * BINS / 2).astype(int), 0, BINS - 1)

    def count(key, a: pd.DataFrame, b: pd.DataFrame, c: np.ndarray) -> pd.DataFrame:
        bins, n = np.unique(distances(a, b, c)[1], return_counts=True)
        return pd.DataFrame({"session_id": key[0], "bin": bins, "n": n})

    def pick(key, a: pd.DataFrame, b: pd.DataFrame, c: np.ndarray) -> pd.DataFrame:
        d, bins = distances(a, b, c)
        keep = np.isin(bins, a["bins"].iloc[0])
        return pd.DataFrame({"session_id": key[0], "bin": bins[keep], "d": d[keep]})

    keys = ["session_id", "label"]
    counted = _in_blocks(rows, rows, keys, count, f"session_id {session}, bin int, n long", block).groupBy("session_id", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("session_id")
    upto = F.sum("n").over(w.orderBy("bin"))
    ranked = counted.withColumns({"below": upto - F.col("n"), "all": F.sum("n").over(w)})
    places = [F.floor(F.lit(p) * (F.col("all") - 1)) for p in (0.5, 0.95)] + [F.ceil(F.lit(p) * (F.col("all") - 1)) for p in (0.5, 0.95)]
    held = F.lit(False)
    for at in places:
        held = held | ((at >= F.col("below")) & (at < F.col("below") + F.col("n")))
    wanted = ranked.filter(held)
    marked = rows.join(wanted.groupBy("session_id").agg(F.collect_list("bin").alias("bins")), "session_id")
    found = _in_blocks(marked, rows, keys, pick, f"session_id {session}, bin int, d double", block)
    order = F.row_number().over(Window.partitionBy("session_id", "bin").orderBy("d")) - 1
    placed = found.join(wanted, ["session_id", "bin"]).withColumn("at", F.col("below") + order)

    def value(p: float) -> Column:
        at = F.lit(p) * (F.col("all") - 1)
        low, high = (F.max(F.when(F.col("at") == f(at), F.col("d"))) for f in (F.floor, F.ceil))
        share = F.max(at - F.floor(at))
        return low + (high - low) * share

    return placed.groupBy("session_id").agg(value(0.5).alias("p50"), value(0.95).alias("p95"), F.max("all").alias("n"))


def merge_verdict(distance: Column, p50: Column, conflict: Column, overlaps: Column, is_dm: Column, gain: Column) -> Column:
    """Why two voices stay apart, or merge: the first reason that holds."""
    return F.when(conflict, "conflict").when(distance > p50, "too_far").when(overlaps & ~is_dm, "overlap").when(gain <= 0, "no_gain").otherwise("merge")


def length_score(seconds: Column, least: float = 1.0, full: float = 6.0) -> Column:
    return F.when(seconds < least, 0.0).otherwise(clamp((seconds - least) / (full - least), 0, 1))


def snr_score(db: Column, floor: float = 5.0, full: float = 20.0) -> Column:
    return F.when(db.isNull(), 0.6).otherwise(clamp((db - floor) / (full - floor), 0, 1))


def overlap_score(ratio: Column) -> Column:
    return clamp(1 - 2 * F.greatest(F.lit(0.0), ratio), 0, 1)


def quality(length: Column, snr: Column, overlap: Column) -> Column:
    """Weighted geometric mean; a zero anywhere is zero. Weights are fixed values: 0.40, 0.35, 0.25."""
    product = F.pow(length, F.lit(0.40)) * F.pow(snr, F.lit(0.35)) * F.pow(overlap, F.lit(0.25))
    return F.when((length == 0) | (snr == 0) | (overlap == 0), 0.0).otherwise(clamp(product, 0, 1))


def usable(score: Column, seconds: Column, least: float = 1.0) -> Column:
    return (score >= 0.35) & (seconds >= least)


def anchor_conflict(hits: DataFrame, threshold: float) -> DataFrame:
    """Groups (session_id, label) whose observations' best hits over threshold name two candidates or more."""
    best = hits.filter((F.col("rank") == 1) & (F.col("cosine") >= threshold))
    return best.groupBy("session_id", "label").agg(F.countDistinct("candidate").alias("candidates")).filter("candidates >= 2")


def length_outliers(obs: DataFrame, share: float = 0.99) -> DataFrame:
    """Observations longer than that percentile of their session."""
    limit = obs.groupBy("session_id").agg(F.expr(f"percentile(duration, {share})").alias("limit"))
    return obs.join(limit, "session_id").filter("duration > limit").select("session_id", "ref", "duration", "limit")


def confidence_collapse(rows: DataFrame, share: float = 0.6) -> DataFrame:
    """Labels whose mean confidence is under that share of the session's median."""
    own = rows.groupBy("session_id", "speaker").agg(F.avg("speaker_confidence").alias("own"))
    all_ = rows.groupBy("session_id").agg(F.expr("percentile(speaker_confidence, 0.5)").alias("middle"))
    return own.join(all_, "session_id").filter(F.col("own") < share * F.col("middle"))
