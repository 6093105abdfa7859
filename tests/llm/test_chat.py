import random

from pyspark.sql import functions as F

from colloquy.llm import chat
from tests.helpers import connection, same

ROW = "conv_id long, seq long, role string, text string"
EVENT = "conv_id long, message_id string, seq long, kind string, role string, text string"


def plain(text):
    return text.replace("\\t", "</turn>").replace("\\h", "###").replace("\\b", "\\")


def test_round_trip_of_hostile_texts(spark):
    source = random.Random(3)
    bits = ["\\", "#", "##", "###", "</turn>", "</", "turn>", "\n", "b", "h", "t", "c", "=", ": ", "User", "é", "😀"]
    roles = ["user", "User", "assistant", "a: b", "###", "\\=User", "", "Assistant", ":", None]
    rows = [(i // 3, i % 3, source.choice(roles), "".join(source.choices(bits, k=source.randint(0, 8))) if i % 7 else None) for i in range(600)]
    out = chat.render(spark.createDataFrame(rows, ROW)).select("conv_id", "formatted", "mask", chat.parse(F.col("formatted")).alias("turns")).collect()
    assert len(out) == 200
    for r in out:
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == want
        assert [plain(r.formatted[s.start : s.start + s.length]) for s in r["mask"]] == [t for role, t in want if role == "assistant" and t]


def folded(spark, events):
    return [(r.role, r.text) for r in chat.fold(spark.createDataFrame(events, EVENT)).orderBy("conv_id", "seq").collect()]


def test_deltas_edits_and_regenerations(spark):
    m = lambda seq, kind, text, role=None: (1, "m", seq, kind, role, text)
    assert folded(spark, [m(2, "delta", "lo"), m(1, "delta", "Hel", "assistant")]) == [("assistant", "Hello")]
    assert folded(spark, [m(1, "delta", "a", "user"), m(2, "regenerate", None), m(3, "delta", "b")]) == [("user", "b")]
    assert folded(spark, [m(1, "delta", "a"), m(2, "edit", "x"), m(3, "delta", "y"), m(4, "typing", "?")]) == [("", "xy")]
    assert folded(spark, [m(1, "delta", None, "user")]) == [("user", "")]
    assert folded(spark, []) == []


def test_repeated_rows_and_nulls_are_turns_of_their_own(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, None, None), (None, None, "user", "b")], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: len(r.t) for r in chat.render(chat.fold(chat.events_of(rows))).select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()}
    assert out == {1: 3, None: 1}


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    same(chat.op4_chat_format(spark, sf), connection(sf), chat.OP4_SQL)


def test_long_texts_stream_in_deltas(spark):
    """Texts of many deltas, ties, repeated rows and columns with clashing names come back as they were."""
    long = "é### </turn>\\b" * 700
    rows = [(1, 0, "user", long, "x", 1), (1, 1, "assistant", long[::-1], "x", 2), (1, 1, "assistant", "tie", "x", 3), (1, 1, "assistant", "tie", "x", 4), (2, None, None, None, None, None), (2, 0, "user", "", None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string, message_id int")
    events = chat.events_of(df)
    assert events.groupBy("conv_id", "message_id").count().agg({"count": "max"}).first()[0] == -(-len(long) // chat.DELTA)
    out = {r.conv_id: r for r in chat.render(chat.fold(events)).select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("user", long), *sorted([("assistant", "tie"), ("assistant", "tie"), ("assistant", long[::-1])])]
    assert [(t.role, t.text) for t in out[2].turns] == [("", ""), ("user", "")]
