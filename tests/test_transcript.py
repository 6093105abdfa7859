"""Turns against a sequential version; windows, packing and ranges on small inputs."""

import random

from pyspark.sql import functions as F

from colloquy.operators import transcript as T

SEGMENT = "session_id long, seg_idx int, start double, end double, speaker string, chunk int, text string, speaker_confidence double"


def sequential(rows, tolerance):
    turns, open_ = [], None
    for idx, start, end, speaker, chunk in rows:
        if not speaker or not end > start:
            continue
        if open_ and open_["speaker"] == speaker and open_["chunk"] == chunk and start - open_["end"] <= tolerance:
            open_["end"] = max(open_["end"], end)
            open_["indices"].append(idx)
        else:
            open_ = {"speaker": speaker, "chunk": chunk, "start": start, "end": end, "indices": [idx]}
            turns.append(open_)
    return turns


def test_turns_are_sequential_ones(spark):
    source = random.Random(4)
    rows, expected = [], {}
    for session in range(60):
        t, own = 0.0, []
        for i in range(source.randint(0, 25)):
            t += source.choice([0.2, 1.5, 1.6, 5.0, -1.0])
            own.append((i, round(t, 3), round(t + source.choice([-1, 0, 0.5, 3]), 3), source.choice(["A", "B", "", None]), source.choice([None, 1, 2])))
        expected[session] = sequential(own, 1.5)
        rows += [(session, i, s, e, sp, c, "x", 0.5) for i, s, e, sp, c in own]
    df = spark.createDataFrame(rows, SEGMENT)
    for frame in (df, df.repartition(7).orderBy("end")):
        found = {}
        for r in T.speaker_turns(frame, 1.5).orderBy("session_id", "turn").collect():
            found.setdefault(r.session_id, []).append({"speaker": r.speaker, "chunk": r.chunk, "start": r.start, "end": r.end, "indices": r.indices})
        assert found == {s: t for s, t in expected.items() if t}


def test_boundary_on_a_kept_row_cuts_and_on_a_skipped_row_is_lost(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.0, "A", None, "a", 1.0), (1, 1, 1.0, 1.0, "A", None, "b", 1.0), (1, 2, 1.1, 2.0, "A", None, "c", 1.0)], SEGMENT)
    cut = lambda i: T.speaker_turns(df, 1.5, spark.createDataFrame([(1, i)], "session_id long, seg_idx int")).count()
    assert (cut(1), cut(2)) == (1, 2)


def test_longest_window_takes_the_earliest_of_equals(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 2.0, "A", None, "", 1.0), (1, 1, 10.0, 12.0, "A", None, "", 1.0)], SEGMENT)
    assert [(r.start, r.end) for r in T.longest_windows(df, 1.5).collect()] == [(0.0, 1.5)]


def test_packing_keeps_a_long_sentence_whole(spark):
    text = "Aa bb. Cc dd! " + "x" * 20 + "? Ee."
    df = spark.createDataFrame([(1, 0, "A", text)], "session_id long, turn int, speaker string, text string")
    assert [r.text for r in T.utterances(df, 14).orderBy("ordinal").collect()] == ["Aa bb. Cc dd!", "x" * 20 + "?", "Ee."]


def test_chunk_ranges_go_on_for_lines_over_budget(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([50, 500, 50, 60])], "session_id long, idx int, tokens int")
    assert [(r.start, r.end) for r in T.chunk_ranges(df, 100, 0.5).orderBy("chunk").collect()] == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_empty_input(spark):
    assert T.speaker_turns(spark.createDataFrame([], SEGMENT)).count() == 0


def test_splitting_keeps_every_word(spark):
    words = [("a", 0.0, 1.0), ("bb", 1.0, 2.0), ("c", 2.0, 4.0)]
    rows = [("s", 1, 0.0, 4.0, "a bb c", words, 2.5), ("s", 2, 0.0, 4.0, "x y z w", None, 1.0), ("s", 3, 0.0, 4.0, "one", None, 2.0), ("s", 4, 0.0, 4.0, "p q", words, 9.0), ("s", 5, 0.0, 4.0, None, None, 2.0)]
    df = spark.createDataFrame(rows, f"session_id string, ordinal int, start double, end double, text string, words {T.WORDS}, cut double")
    found = {(r.ordinal, r.part): (r.start, r.end, r.text) for r in T.split_at(df).collect()}
    assert found[1, 0] == (0.0, 2.5, "a bb") and found[1, 1] == (2.5, 4.0, "c")
    assert found[2, 0][2] == "x" and found[2, 1][2] == "y z w"
    assert (found[3, 0][2], found[3, 1][2]) == ("", "one") and found[4, 0] == (0.0, 4.0, "p q") and found[4, 1] == (4.0, 4.0, "")
    assert (found[5, 0][2], found[5, 1][2]) == ("", "")
    at = df.filter("ordinal < 3").orderBy("ordinal").select(T.time_at(F.lit(0.5), F.col("start"), F.col("end"), F.col("words"))).collect()
    assert [r[0] for r in at] == [2.0, 2.0]
