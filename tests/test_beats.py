"""Beats alike, by rows and by joins, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions.text import content_words
from colloquy.operators import resolve as R

BEAT = "session_id int, i int, span string, text string"


def plain(rows, threshold):
    """rows (session_id, i, span, words): every pair of a session is compared."""
    out = {}
    for s, i, x, a in rows:
        for t, j, y, b in rows:
            if s is not None and s == t and i < j and x != y and a and b:
                score = len(a & b) / len(a | b)
                if score >= threshold:
                    out[s, i, j] = round(score, 9)
    return out


@pytest.mark.parametrize("threshold, long_session", [(0.35, 20_000), (0.35, 0), (0.35, 12), (0.1, 20_000), (0.1, 12), (1.0, 12)])
def test_beats_alike_are_all_found(spark, threshold, long_session):
    draw = random.Random(11)
    words = ["dragon"] * 8 + [f"word{n}" for n in range(14)]  # one word is in most beats
    rows = [(s, i, draw.choice(["a", "b", "c", None]), " ".join(draw.choice(words) for _ in range(draw.randint(0, 7)))) for s in [*range(7), None] for i in range(draw.randint(1, 25))]
    rows += [(9, 0, "a", None), (9, 1, "b", ""), (10, 0, "a", "alone here again")]
    beats = spark.createDataFrame(rows, BEAT)
    told = [(r.session_id, r.i, r.span, set(r.w)) for r in beats.select("*", content_words(F.col("text")).alias("w")).collect()]
    got = R.similar_beats(beats, threshold, long_session).collect()
    assert {(r.session_id, r.i, r.j): round(r.score, 9) for r in got} == plain(told, threshold) and len(got) == len({(r.session_id, r.i, r.j) for r in got}) > 0


def test_no_beats(spark):
    none = spark.createDataFrame([], BEAT)
    assert R.similar_beats(none).count() == 0 and R.similar_beats(none).columns == ["session_id", "i", "j", "score"]


def test_words_of_a_session_are_not_shuffled_one_by_one(spark):
    rows = spark.createDataFrame([(s, i, str(i), "dragon castle river") for s in range(4) for i in range(4)], BEAT)
    plan = R.similar_beats(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
