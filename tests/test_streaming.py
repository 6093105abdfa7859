"""Streams over files give what batch gives."""

import json

from pyspark.sql import functions as F

from colloquy.streaming import events as V
from colloquy.streaming import lifecycle as L


def test_lifecycle_stream_is_batch(spark, tmp_path):
    rows = [(s, i, L.STATUSES[(i * (s % 3 + 1) + 1) % 21]) for s in range(6) for i in range(20)]
    df = spark.createDataFrame(rows, "session_id long, at long, status string")
    for k in range(3):
        df.filter(f"at % 20 >= {k * 7} AND at < {(k + 1) * 7}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 50).parquet(str(tmp_path / "in/*"))
    q = L.lifecycle(stream).writeStream.format("memory").queryName("life").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("life").groupBy("session_id").agg(F.max_by("status", "at").alias("status"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    assert sorted(map(tuple, last.collect())) == sorted((r.session_id, r.status, r.accepted, r.rejected) for r in L.replay(df).collect())


def test_every_status_can_fail_but_failed():
    assert all("failed" in follow for s, follow in L.NEXT.items() if s != "failed") and len(L.STATUSES) == 21


def test_envelopes_once_routed_and_counted(spark, tmp_path):
    event = lambda i, kind: json.dumps({"schema_version": 1, "event_id": f"e{i}", "occurred_at": f"2024-01-01T00:{i:02d}:00Z", "type": kind, "payload": "{}", "more": 1})
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join([event(0, "x"), event(1, "y"), event(1, "y"), "broken"]))
    good, _ = V.split_bad(V.read_envelopes(spark, str(tmp_path / "in")))
    seen = []
    V.to_sink(V.once(good), lambda df, n: seen.extend(r.event_id for r in df.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(seen) == ["e0", "e1"]


def test_latest_event_of_a_page_decides(spark):
    rows = [(1, "wiki.published", "public", 1, "a"), (1, "wiki.archived", "public", 2, "b"), (2, "wiki.updated", "public", 1, "c"), (3, "wiki.updated", "dm_only", 1, "d")]
    df = spark.createDataFrame(rows, "page_id long, type string, visibility string, occurred_at long, event_id string")
    shown, gone = V.latest_per_page(df)
    assert [r.page_id for r in shown.collect()] == [2] and sorted(r.page_id for r in gone.collect()) == [1, 3]
