"""Transcript artifacts, recordings and vectors: readers, writers and builders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = "word:string,start:double,end:double,confidence:double"
SEGMENT = f"start:double,end:double,text:string,transcript:string,speaker:string,chunk:int,speaker_confidence:double,confidence:double,words:array<struct<{WORD}>>"
TRANSCRIPT = f"session_id string, language string, model string, segments array<struct<{SEGMENT}>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """JSON artifacts, one object a file, to rows of segments in their order; the schema is given, never inferred."""
    return spark.read.schema(TRANSCRIPT).json(path, multiLine=True).select("session_id", "language", F.posexplode("segments").alias("seg_idx", "s")).select("session_id", "language", "seg_idx", "s.*")


def normalise(segments: DataFrame) -> DataFrame:
    """Segments without times go; text falls back to transcript, a missing confidence to the mean of the words'; times to milliseconds."""
    mean = F.aggregate("words", F.lit(0.0), lambda a, w: a + F.coalesce(w["confidence"], F.lit(0.0)), lambda s: F.when(F.size("words") > 0, s / F.size("words")))
    return segments.filter("start IS NOT NULL AND end IS NOT NULL").withColumns({
        "start": F.round("start", 3), "end": F.round("end", 3), "text": F.trim(F.coalesce("text", "transcript", F.lit(""))), "confidence": F.coalesce("confidence", mean),
    }).drop("transcript")


def offset_chunks(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments and words of a recording's chunks moved by the chunk's offset (session_id, chunk, offset)."""
    moved = F.transform("words", lambda w: F.struct(w["word"].alias("word"), F.round(w["start"] + F.col("offset"), 3).alias("start"), F.round(w["end"] + F.col("offset"), 3).alias("end"), w["confidence"].alias("confidence")))
    return segments.join(chunks.select("session_id", "chunk", "offset"), ["session_id", "chunk"]).withColumns({"start": F.round(F.col("start") + F.col("offset"), 3), "end": F.round(F.col("end") + F.col("offset"), 3), "words": moved}).drop("offset")


def chunk_plan(recordings: DataFrame, seconds: float) -> DataFrame:
    """(session_id, duration) to chunks of that length, the last one shorter."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration") / seconds).cast("int"))
    return recordings.filter("duration > 0").select("session_id", "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).select("session_id", "chunk", (F.col("chunk") * seconds).alias("offset"), F.least(F.lit(seconds), F.col("duration") - F.col("chunk") * seconds).alias("length"))


def build_transcripts(segments: DataFrame, fields: tuple[str, ...] = ("start", "end", "speaker", "text")) -> DataFrame:
    """One artifact per session: its segments as an ordered array of the given fields."""
    rows = F.array_sort(F.collect_list(F.struct("seg_idx", *fields)))
    return segments.groupBy("session_id").agg(F.transform(rows, lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("segments"))


def write_artifacts(artifacts: DataFrame, path: str, revision: int) -> None:
    """A folder per revision; an earlier one is never changed."""
    artifacts.write.mode("errorifexists").json(f"{path}/revision={revision}")


def extract_segments(responses: DataFrame) -> DataFrame:
    """A provider's answer has utterances, else paragraphs, else words: the first that isn't empty."""
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    return responses.select("session_id", F.posexplode(F.coalesce(full("utterances"), full("paragraphs"), full("words"))).alias("seg_idx", "s")).select("session_id", "seg_idx", "s.*")


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def upsert_vectors(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Points by (session_id, label, index): a later revision of a key replaces the earlier."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    key = ["session_id", "label", "index"]
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("_new").desc()))).filter("_r = 1").drop("_r", "_new")


def point_id(*columns: str):
    """A stable id of a point, from what identifies it."""
    return F.sha2(F.concat_ws(":", *columns), 256)


def without_sessions(stored: DataFrame, sessions: DataFrame) -> DataFrame:
    return stored.join(sessions.select("session_id"), "session_id", "left_anti")
