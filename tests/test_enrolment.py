import random

from pyspark.sql import functions as F

from colloquy.operators import enrolment as E

LIMITS = dict(min_seconds=2.0, max_seconds=10.0, min_confidence=0.5, per_label=2, per_run=7)


def made(spark):
    source = random.Random(3)
    segments, observations = [], []
    for s in range(12):
        at = 0.0
        for i in range(30):
            label, n = source.choice("AB"), round(source.uniform(0.5, 6), 2)
            segments.append((s, i, at, round(at + n, 2), label, source.choice([None, 0.2, 0.9])))
            observations.append((s, label, at + n / 2, [source.uniform(-1, 1) for _ in range(4)]))
            at = round(at + n + source.uniform(0, 3), 2)
    history = [(s % 2, 100 - s, s, label, f"u{label}") for s in range(10) for label in "AB"] + [(0, 1, 0, "A", "later"), (0, 0, None, "A", "u"), (0, 0, 3, "", "u"), (1, 0, 5, "B", None), (1, 0, 77, "A", "u")]
    return (
        spark.createDataFrame(history, "campaign long, at long, session_id long, label string, user string"),
        spark.createDataFrame(segments, "session_id long, seg_idx int, start double, end double, speaker string, speaker_confidence double"),
        spark.createDataFrame(observations, "session_id long, label string, at double, vector array<double>"),
    )


def test_the_cap_follows_the_history(spark):
    history, segments, _ = made(spark)
    none = spark.createDataFrame([], "campaign long, key string")
    got = E.manual_samples(history, segments, none, **LIMITS).collect()
    every = E.manual_samples(history, segments, none, **{**LIMITS, "per_run": 10_000}).collect()
    for campaign in (0, 1):
        own = sorted((r for r in every if r.campaign == campaign), key=lambda r: (r.at, r.session_id, r.label, r["index"]))
        assert sorted(r.key for r in got if r.campaign == campaign) == sorted(r.key for r in own[:7]) and len(own) > 7
    assert len({r.key for r in every}) == len(every) and {r.user for r in every if r.key.startswith("0#A")} == {"later"}  # the first naming by ``at``
    plan = E.manual_samples(history, segments, none, **LIMITS)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_running_again_enrols_what_is_left_and_then_nothing(spark):
    history, segments, observations = made(spark)
    prints = E.enrol(E.manual_samples(history, segments, spark.createDataFrame([], "campaign long, key string"), **LIMITS), observations).limit(0)
    sizes = []
    for _ in range(8):
        fresh = E.enrol(E.manual_samples(history, segments, prints, **LIMITS), observations)
        prints = spark.createDataFrame(E.store(prints, fresh).collect(), prints.schema)
        sizes.append(prints.count())
        if len(sizes) > 1 and sizes[-1] == sizes[-2]:
            break
    assert sizes[-1] == sizes[-2] and sizes[0] <= 14 and sizes == sorted(sizes)
    rows = prints.collect()
    assert len({r.id for r in rows}) == len({r.key for r in rows}) == len(rows)
    for r in rows:
        assert abs(sum(x * x for x in r.vector) - 1) < 1e-9


def test_prints_are_means_inside_the_window(spark):
    samples = spark.createDataFrame([(1, 0, 5, "A", "u", "5#A#0", 0, 1.0, 3.0), (1, 0, 5, "A", "u", "5#A#1", 1, 8.0, 9.0)], "campaign long, at long, session_id long, label string, user string, key string, index int, start double, end double")
    seen = spark.createDataFrame([(5, "A", 1.0, [3.0, 0.0]), (5, "A", 3.0, [0.0, 4.0]), (5, "A", 3.1, [9.0, 9.0]), (5, "B", 2.0, [9.0, 0.0]), (6, "A", 2.0, [9.0, 0.0])], "session_id long, label string, at double, vector array<double>")
    rows = E.enrol(samples, seen).collect()
    assert [(r.key, r.n) for r in rows] == [("5#A#0", 2)] and [round(x, 9) for x in rows[0].vector] == [0.6, 0.8]


def test_first_rows_of_a_hot_group(spark):
    df = spark.range(2000).select(F.lit(None).cast("string").alias("g"), "id").unionByName(spark.range(5).select(F.lit("x").alias("g"), "id"))
    got = E.first_in_order(df, "g", 10, "id").collect()
    assert sorted((r.g or "", r.id) for r in got) == [("", i) for i in range(10)] + [("x", i) for i in range(5)]
