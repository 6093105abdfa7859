"""Event streams: envelopes, routing, deduplication, windows, sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ENVELOPE = "schema_version int, event_id string, occurred_at timestamp, type string, payload string"


def read_envelopes(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of JSON lines, one envelope each; unknown keys are ignored, broken lines have a null type."""
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_batch).json(path)


def parse_envelopes(raw: DataFrame, column: str = "value") -> DataFrame:
    """Envelopes in a text column, as a broker's source has them."""
    return raw.select(F.from_json(column, ENVELOPE).alias("e")).select("e.*")


def split_bad(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Envelopes with an id, a type and a time, and the rest for a dead-letter table."""
    good = F.col("event_id").isNotNull() & F.col("type").isNotNull() & F.col("occurred_at").isNotNull()
    return events.filter(good), events.filter(~good)


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once, as long as its copies come within the watermark."""
    return events.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["event_id"])


def route(events: DataFrame, topics: dict[str, list[str]]) -> dict[str, DataFrame]:
    return {queue: events.filter(F.col("type").isin(*types)) for queue, types in topics.items()}


def counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events by type in tumbling or sliding windows of their own time."""
    window = F.window("occurred_at", size, slide) if slide else F.window("occurred_at", size)
    return events.withWatermark("occurred_at", late).groupBy(window, "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "type", "n")


def gaps(events: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of one key's events with pauses shorter than gap."""
    return events.withWatermark("occurred_at", late).groupBy(key, F.session_window("occurred_at", gap)).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def latest_per_page(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a batch of page events the pages to index and those to remove from the index: the last event of a page decides."""
    last = batch.groupBy("page_id").agg(F.max_by(F.struct("type", "visibility", "occurred_at"), F.struct("occurred_at", "event_id")).alias("e")).select("page_id", "e.*")
    shown = F.col("type").isin("wiki.published", "wiki.updated") & (F.col("visibility") == "public")
    return last.filter(shown), last.filter(~shown)


def retries(deliveries: DataFrame, most: int) -> DataFrame:
    """(event, tries, outcome, delay) of deliveries (event, at, ok): done by the first that went well, dead after ``most`` that didn't, else waiting, for twice as long after every try."""
    n = F.row_number().over(Window.partitionBy("event").orderBy("at"))
    tried = deliveries.withColumn("n", n).filter(F.col("n") <= most)
    found = tried.groupBy("event").agg(F.min(F.when(F.col("ok"), F.col("n"))).alias("done"), F.max("n").alias("n"))
    waits = F.col("done").isNull() & (F.col("n") < most)
    outcome = F.when(F.col("done").isNotNull(), "done").when(F.col("n") >= most, "dead").otherwise("waiting")
    return found.select("event", F.coalesce("done", "n").alias("tries"), outcome.alias("outcome"), F.when(waits, F.pow(F.lit(2), "n").cast("long")).alias("delay"))


def progress(partial: DataFrame) -> DataFrame:
    """The farthest partial result of a session (session_id, chunk, at, result), of one chunk the last: as a stream's state in update mode holds it."""
    return partial.groupBy("session_id").agg(F.max("chunk").alias("chunk"), F.max_by("result", F.struct("chunk", "at")).alias("result"))


def to_sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs over what is there now and ends; write gets each micro-batch with its number, the same number again after a failure."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
