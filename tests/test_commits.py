import pytest

from colloquy.sources import commits as C


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "session_id long, v string")


def rows(df):
    return sorted(map(tuple, df.collect()))


class Killed(Exception):
    pass


def test_all_tables_or_none(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/plan"
    assert C.current(spark, base)["number"] == 0
    assert C.commit(spark, base, {"a": frame(spark, (1, "old")), "b": frame(spark, (1, "old"))}, 1) == 1
    broken = frame(spark, (1, "x")).selectExpr("session_id", "raise_error('gone') AS v")
    with pytest.raises(Exception, match="gone"):  # the job dies in the second table
        C.commit(spark, base, {"a": frame(spark, (1, "new")), "b": broken}, 2)
    assert rows(C.read(spark, base, "a")) == [(1, "old")] == rows(C.read(spark, base, "b"))
    real = C._publish

    def killed(*_):
        raise Killed

    monkeypatch.setattr(C, "_publish", killed)
    with pytest.raises(Killed):  # and between the last table and the marker
        C.commit(spark, base, {"a": frame(spark, (1, "new")), "b": frame(spark, (1, "new"))}, 2)
    assert rows(C.read(spark, base, "a")) == [(1, "old")] and C.current(spark, base)["number"] == 1
    monkeypatch.setattr(C, "_publish", real)
    assert C.commit(spark, base, {"b": frame(spark, (1, "new"))}, 2) == 2
    assert rows(C.read(spark, base, "a")) == [(1, "old")] and rows(C.read(spark, base, "b")) == [(1, "new")] and rows(C.read(spark, base, "b", 1)) == [(1, "old")]
    assert C.forget(spark, base, keep=1) in (4, 5) and rows(C.read(spark, base, "b")) == [(1, "new")] and rows(C.read(spark, base, "a")) == [(1, "old")]


def test_two_writers(spark, tmp_path):
    base = f"file://{tmp_path}/plan"
    C.commit(spark, base, {"a": frame(spark, (1, "x"))})
    with pytest.raises(FileExistsError):
        C.commit(spark, base, {"a": frame(spark, (1, "y"))}, after=0)
    with pytest.raises(FileExistsError):
        C._publish(spark, base, 1, {})
    with pytest.raises(FileNotFoundError):
        C.read(spark, base, "z")


def test_a_session_is_replaced_whole(spark, tmp_path):
    base = f"file://{tmp_path}/plan"

    def plan(sessions, questions, revision):
        lines = spark.createDataFrame([(s, f"r{i}", i, 0.0, 1.0) for s in sessions for i in range(3)], "session_id long, ref string, ordinal int, start double, end double")
        beliefs = spark.createDataFrame([(s, "r0", c, p) for s in sessions for c, p in (("a", 0.25), ("b", 0.5), ("c", 0.25))] + [(s, "r1", "a", 1.0) for s in sessions], "session_id long, ref string, candidate string, p double")
        verdicts = spark.createDataFrame([(s, "r0", "propagated") for s in sessions], "session_id long, ref string, status string")
        other = lambda n: spark.createDataFrame([(s, i) for s in sessions for i in range(n)], "session_id long, i int")
        return C.persist_plan(base, lines, beliefs, verdicts, other(1), other(2), other(questions), revision)

    assert plan([1, 2], 3, 1) == 1
    assert plan([2, 3], 1, 2) == 2
    assert {(r.session_id, r.n_questions, r.n_lines, r.revision) for r in C.read(spark, base, "sessions").collect()} == {(1, 3, 3, 1), (2, 1, 3, 2), (3, 1, 3, 2)}
    assert C.read(spark, base, "questions").filter("session_id = 2").count() == 1 and C.read(spark, base, "questions").filter("session_id = 1").count() == 3
    own = {r.ref: r for r in C.read(spark, base, "attributions").filter("session_id = 3").collect()}
    assert (own["r0"].best, own["r0"].confidence, own["r0"].margin, own["r0"].status) == ("b", 0.5, 0.25, "propagated")
    assert (own["r1"].margin, own["r2"].best, own["r2"].status) == (1.0, None, "unresolved")
