"""Chat formatting: conversations rebuilt from a log of events, then rendered with a loss mask.

The log has streamed deltas, edits and regenerations of messages. It is grouped
by conversation and message, sorted by sequence and folded: a regeneration
discards what a message said so far, an edit replaces it, a delta adds to it.
The messages of a conversation are then put in order and rendered.

A rendered turn is ``### Role: text</turn>`` and a line end. Inside texts and
roles the three strings that could be taken for markup are written as escapes:
backslash as ``\\b``, ``###`` as ``\\h`` and ``</turn>`` as ``\\t``; in roles, a
colon is ``\\c``. Every backslash in the output thus begins an escape, and no text can end its turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.llm.common import table

END = "</turn>\n"
SPAN = "array<struct<start:long,length:long>>"


def escaped(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in (("</turn>", "\\t"), ("###", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


#: Roles that are rendered with a capital; all others as they are.
NAMES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}


def label(role: Column) -> Column:
    """A role as it is rendered; a role that looks like the rendering of another is marked."""
    plain = F.replace(escaped(role), F.lit(":"), F.lit("\\c"))
    return F.when(role.isin(*NAMES), F.initcap(role)).when(role.isin(*NAMES.values()), F.concat(F.lit("\\="), role)).otherwise(plain)


def role_of(label: Column) -> Column:
    plain = unescaped(F.replace(F.replace(label, F.lit("\\="), F.lit("")), F.lit("\\c"), F.lit(":")))
    return F.when(label.isin(*NAMES.values()), F.lower(label)).otherwise(plain)


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, role, text) of events (conv_id, message_id, seq, kind, role, text).

    kind is ``delta``, ``edit`` or ``regenerate``; events of other kinds change
    nothing. A message stands where its first event stands; its role is that of
    its first event that has one. Events of one message with the same seq are
    ordered regenerate, edit, delta, then by text. A null text is empty; a message
    whose events leave no text stays as an empty one.
    """
    rank = F.when(F.col("kind") == "regenerate", 0).when(F.col("kind") == "edit", 1).when(F.col("kind") == "delta", 2)
    log = events.select("conv_id", "message_id", "seq", rank.alias("rank"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("rank IS NOT NULL")
    per_message = log.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("seq"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "rank", "text"))).alias("role"),
        # the last event that wipes what came before; deltas count from there
        F.max(F.when(F.col("rank") < 2, F.struct("seq", "rank", "text"))).alias("base"),
        F.array_sort(F.collect_list(F.struct("seq", "rank", "text"))).alias("events"),
    )
    after = F.filter("events", lambda e: (e["rank"] == 2) & (F.col("base").isNull() | (e > F.col("base"))))
    start = F.when(F.col("base.rank") == 1, F.col("base.text")).otherwise(F.lit(""))
    return per_message.select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), F.concat(start, F.array_join(F.transform(after, lambda e: e["text"]), "")).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): a row per conversation, turns by seq, then role, then text.

    mask has a span of code points (start from 0, length) for each assistant
    message with a text: that text, as escaped, and nothing of the markup.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("### "), label(role), F.lit(": "))
    turn = messages.select("conv_id", "seq", role.alias("role"), text.alias("text"), head.alias("head"), escaped(text).alias("body"))
    turn = turn.withColumn("turn", F.concat("head", "body", F.lit(END))).withColumn("chars", F.length("turn").cast("long"))
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    placed = turn.withColumn("n", F.row_number().over(order)).withColumn("begin", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    span = F.when((F.col("role") == "assistant") & (F.length("body") > 0), F.struct((F.coalesce("begin", F.lit(0)) + F.length("head")).cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    sorted_turns = F.array_sort(F.collect_list(F.struct("n", "turn", span.alias("span"))))
    return placed.groupBy("conv_id").agg(sorted_turns.alias("turns")).select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).cast(SPAN).alias("mask"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array<struct<role, text>>."""
    parts = F.filter(F.split(formatted, END), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, ": ")
        return F.struct(role_of(F.substring(p, F.lit(5), at - 5)).alias("role"), unescaped(F.substring(p, at + 2, F.length(p))).alias("text"))

    return F.transform(parts, turn)


#: Characters of a streamed delta.
DELTA = 1000


def events_of(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log: each row streams one message in deltas of DELTA characters, repeated rows one each.

    Messages are numbered within their conversation, by turn, role and text, so that
    folding and rendering need no other shuffle. A null turn comes first.
    """
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    rows = conversations.select("conv_id", "role", "text", number.cast("long").alias("message_id"))
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(F.coalesce("text", F.lit(""))) / DELTA).cast("int") - 1))
    deltas = rows.select("*", F.explode(parts).alias("part"))
    piece = F.substring("text", F.col("part") * DELTA + 1, F.lit(DELTA))
    return deltas.select("conv_id", "message_id", (F.shiftleft("message_id", 20) + F.col("part")).alias("seq"), F.lit("delta").alias("kind"), "role", piece.alias("text"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = render(fold(events_of(own.unionByName(extra))))
    turns = F.col("turns")
    all_text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("mask", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return out.select("conv_id", "formatted", "mask", parse(F.col("formatted")).alias("turns")).select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(all_text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"replace(replace(replace({0}, '\', '\b'), '###', '\h'), '</turn>', '\t')"
OP4_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || {_ESCAPED.format('role')} || ': ' || {_ESCAPED.format('text')} || '</turn>') + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
