"""Voice samples from the namings of earlier sessions: which windows to take, and their prints in a store that a second run leaves as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import uuid5
from colloquy.functions.vectors import unit
from colloquy.operators.ordering import ranked
from colloquy.operators.transcript import sample_windows

#: Fixed value: the namespace of a sample's id (that of URLs), and what stands before its key.
NAMESPACE, PREFIX = "6ba7b811-9dad-11d1-80b4-00c04fd430c8", "dnd:history-sample:"


def first_in_order(rows: DataFrame, group: str, most: int, *order: str) -> DataFrame:
    """The first ``most`` rows of each group in the order given, however many rows a group has.

    Places come from ranges of the whole order and their sizes, so that no group is
    gathered in one task. Rows with a null group are one group.
    """
    placed = ranked(rows, F.asc(group), *[F.asc(c) for c in order], rank="_place")
    first = placed.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"))
    return placed.join(first, F.col(group).eqNullSafe(F.col("_group"))).filter(F.col("_place") < F.col("_first") + most).select(*rows.columns)


def manual_samples(history: DataFrame, segments: DataFrame, enrolled: DataFrame, *, min_seconds: float, max_seconds: float, min_confidence: float, per_label: int, per_run: int, tolerance: float = 1.5) -> DataFrame:
    """(campaign, at, session_id, label, user, key, index, start, end): windows to embed.

    history (campaign, at, session_id, label, user) says who a label was found to be,
    newest first by ``at``; segments are those of the sessions; enrolled has the keys
    (campaign, key) that the store holds. Each label gives its ``per_label`` longest
    confident runs. What is enrolled is skipped, of a window named twice the first
    naming counts, and the whole run of a campaign takes ``per_run`` windows, in order
    of history. Entries without a session, label or user and sessions without
    segments give nothing.
    """
    named = history.filter("session_id IS NOT NULL AND coalesce(label, '') <> '' AND user IS NOT NULL")
    windows = sample_windows(segments, min_seconds, max_seconds, min_confidence, per_label, tolerance)
    taken = named.join(windows.withColumnRenamed("speaker", "label"), ["session_id", "label"])
    key = F.concat_ws("#", F.col("session_id").cast("string"), "label", F.col("index").cast("string"))
    taken = taken.withColumn("key", key).join(enrolled.select("campaign", "key"), ["campaign", "key"], "left_anti")
    columns = ["campaign", "at", "session_id", "label", "user", "key", "index", "start", "end"]
    once = taken.groupBy("campaign", "key").agg(F.min_by(F.struct(*[c for c in columns if c not in ("campaign", "key")]), F.struct("at", "user")).alias("r"))
    return first_in_order(once.select("campaign", "key", "r.*").select(*columns), "campaign", per_run, "at", "session_id", "label", "index")


def enrol(samples: DataFrame, observations: DataFrame) -> DataFrame:
    """(id, campaign, user, key, vector, n): the print of each sample.

    observations (session_id, label, at, vector) are what an embedder makes of a
    moment; a print is the unit vector of the mean of those inside the window, ends
    included. A window without observations gives no print, so that a later run may
    try again. The id follows from the key: enrolling again overwrites.
    """
    inside = samples.join(observations.withColumnRenamed("at", "moment"), ["session_id", "label"]).filter((F.col("moment") >= F.col("start")) & (F.col("moment") <= F.col("end")))
    each = inside.select("campaign", "user", "key", F.posexplode("vector").alias("k", "x"), F.size("vector").alias("dim"))
    means = each.groupBy("campaign", "user", "key", "k").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    vectors = means.groupBy("campaign", "user", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]).alias("vector"), F.max("n").alias("n"))
    return vectors.select(uuid5(NAMESPACE, F.concat(F.lit(PREFIX), "key")).alias("id"), "campaign", "user", "key", unit(F.col("vector")).alias("vector"), "n")


def store(prints: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store with the fresh prints in place of those of their ids."""
    return prints.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)
