import json

from colloquy.sources import artifacts as S


def test_transcripts_to_segments_and_back(spark, tmp_path):
    doc = {"session_id": "s", "language": "it", "model": "m", "segments": [{"start": 0.0, "end": 1.00049, "transcript": " hi ", "speaker": "A", "words": [{"word": "hi", "start": 0.0, "end": 1.0, "confidence": 0.5}]}, {"start": None, "end": 2.0, "text": "x"}]}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    rows = S.normalise(S.read_transcripts(spark, str(tmp_path))).collect()
    assert [(r.seg_idx, r.start, r.end, r.text, r.confidence) for r in rows] == [(0, 0.0, 1.0, "hi", 0.5)]
    built = S.build_transcripts(S.normalise(S.read_transcripts(spark, str(tmp_path)))).collect()
    assert built[0].segments[0].text == "hi"


def test_chunk_plan_ends_with_a_short_chunk(spark):
    df = spark.createDataFrame([("s", 25.0)], "session_id string, duration double")
    assert [(r.offset, r.length) for r in S.chunk_plan(df, 10.0).collect()] == [(0.0, 10.0), (10.0, 10.0), (20.0, 5.0)]


def test_upsert_replaces_by_key(spark):
    rows = lambda v: spark.createDataFrame([("s", "A", 0, v)], "session_id string, label string, index int, v int")
    assert [r.v for r in S.upsert_vectors(rows(1), rows(2)).collect()] == [2]


def test_first_filled_level_of_a_response_counts(spark):
    kind = "array<struct<text:string>>"
    df = spark.createDataFrame([("a", [], [("p",)], [("w",)]), ("b", None, [], [("w",)])], f"session_id string, utterances {kind}, paragraphs {kind}, words {kind}")
    assert {(r.session_id, r.text) for r in S.extract_segments(df).collect()} == {("a", "p"), ("b", "w")}
