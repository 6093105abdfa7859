"""The engine's logical inputs, made from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A pause of a day ends a turn in the events table, whose gaps are hours.
DAY = 86_400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seg_idx, start, end, speaker, chunk, speaker_confidence, text from events."""
    ts = F.col("ts").cast("timestamp")
    seconds = F.unix_micros(ts) / 1e6 - F.lit(1_704_067_200.0)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        (F.row_number().over(order) - 1).alias("seg_idx"),
        F.round(seconds, 3).alias("start"),
        F.round(seconds + F.col("value"), 3).alias("end"),
        F.when(F.col("event_type").isin("view", "click"), "A").when(F.col("event_type").isin("purchase", "signup"), "B").alias("speaker"),
        F.weekofyear(ts).alias("chunk"),
        (F.get_json_object("props", "$.k").cast("int") / 100).alias("speaker_confidence"),
        F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("text"),
    )


SEGMENTS_SQL = """
segments AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seg_idx,
    round(epoch_us(ts) / 1e6 - 1704067200.0, 3) AS start, round(epoch_us(ts) / 1e6 - 1704067200.0 + value, 3) AS "end",
    CASE WHEN event_type IN ('view', 'click') THEN 'A' WHEN event_type IN ('purchase', 'signup') THEN 'B' END AS speaker,
    weekofyear(ts) AS chunk, CAST(json_extract_string(props, '$.k') AS INT) / 100 AS speaker_confidence,
    event_type || ' ' || json_extract_string(props, '$.k') AS text
  FROM events
)"""


#: Observations of a session: sessions grow in number with the table, not in size.
SESSION = 250


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, ref, vector, label, duration from embeddings."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr(f"vec_id DIV {SESSION}").alias("session_id"),
        F.col("vec_id").alias("ref"),
        F.col("embedding").cast("array<double>").alias("vector"),
        "label",
        (1 + F.col("vec_id") % 9).cast("double").alias("duration"),
    )


OBSERVATIONS_SQL = f"""
observations AS (SELECT vec_id // {SESSION} AS session_id, vec_id AS ref, embedding::DOUBLE[] AS vector, label, (1 + vec_id % 9)::DOUBLE AS duration FROM embeddings)"""


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrolled voices: session_id, id, candidate, vector. Sessions go in twos: what one recorded is enrolled for the other."""
    return table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id DIV {SESSION} ^ 1").alias("session_id"), F.col("vec_id").alias("id"), F.concat(F.lit("member:"), F.col("label").cast("string")).alias("candidate"), F.col("embedding").cast("array<double>").alias("vector"))


PRINTS_SQL = f"""
prints AS (SELECT xor(vec_id // {SESSION}, 1) AS session_id, vec_id AS id, 'member:' || label AS candidate, embedding::DOUBLE[] AS vector FROM embeddings)"""


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).alias("ordinal"), F.col("role").alias("speaker"), "text")


UTTERANCES_SQL = """
utterances AS (SELECT conv_id AS session_id, turn + 1 AS ordinal, role AS speaker, text FROM conversations)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wiki pages: id, campaign, kind, title, status, visibility, updated, content from documents and labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("campaign"),
        F.col("lang").alias("kind"),
        F.regexp_replace("text", r"\n[\s\S]*", "").alias("title"),
        F.when(F.col("quality") == 1, "published").otherwise("draft").alias("status"),
        F.when(F.col("toxic") == 1, "dm_only").otherwise("public").alias("visibility"),
        (F.col("doc_id") * 7919 % 1000).alias("updated"),
        F.col("n_chars").alias("size"),
    )


PAGES_SQL = r"""
wiki AS (
  SELECT d.doc_id AS id, source AS campaign, lang AS kind, regexp_replace(text, '\n[\s\S]*', '') AS title,
    CASE WHEN quality = 1 THEN 'published' ELSE 'draft' END AS status, CASE WHEN toxic = 1 THEN 'dm_only' ELSE 'public' END AS visibility,
    d.doc_id * 7919 % 1000 AS updated, n_chars AS size
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""
