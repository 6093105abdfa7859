"""Samples and links against plain versions, and awkward rows."""

import random
import re

from colloquy.operators import views as V
from pyspark.sql import functions as F


def plain_sample(lines, head, most):
    if sum(len(x) + 1 for x in lines) <= most:
        return list(range(len(lines)))
    used, rest = sum(len(x) + 1 for x in lines[:head]), lines[head:]
    heads = list(range(min(head, len(lines))))
    if not rest or used >= most:
        return heads
    take = max(2, (most - used) // max(1, sum(len(x) + 1 for x in rest) // len(rest)))
    while take >= 2:
        spread = list(range(len(rest))) if take >= len(rest) else [round(k * (len(rest) - 1) / (take - 1)) for k in range(take)]
        if used + sum(len(rest[i]) + 1 for i in spread) <= most:
            return heads + sorted({i + head for i in spread})
        take //= 2
    return heads


def test_samples_are_the_plain_ones(spark):
    draw = random.Random(2)
    sessions = {s: ["x" * draw.choice([0, 5, 30, 200]) for _ in range(draw.choice([1, 3, 4, 20, 60]))] for s in range(60)}
    rows = [(s, i, x) for s, lines in sessions.items() for i, x in enumerate(lines)]
    found = {}
    for r in V.sample_lines(spark.createDataFrame(rows, "session_id int, i int, line string"), 3, 700).collect():
        found.setdefault(r.session_id, []).append(r.i)
    assert {s: sorted(x) for s, x in found.items()} == {s: plain_sample(x, 3, 700) for s, x in sessions.items()}


def test_links_are_the_longest_whole_words(spark):
    names = [("red", "red-one"), ("red ring", "the-ring"), ("bolt", "bolt"), ("a.b", "dot")]

    def plain(text):
        order = sorted(names, key=lambda n: -len(n[0]))
        pattern = "|".join(re.escape(n) for n, _ in order)
        return re.sub(rf"(?i)(?<!\w)(?:{pattern})(?!\w)", lambda m: f"[{m[0]}]({dict(names)[m[0].lower()]})", text)

    texts = ["Red ring and red", "bolted bolt", "", "red", "éred a.b acb", "RED RING red ring,bolt"]
    got = {r.t: r.l for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.linked(F.col("t"), names).alias("l")).collect()}
    assert got == {t: plain(t) for t in texts}


def test_nothing_in_nothing_out(spark):
    assert V.sample_lines(spark.createDataFrame([], "session_id int, i int, line string")).count() == 0
    assert V.attributed_lines(spark.createDataFrame([(1, 1, "u_1", None, "  ", None, None), (1, 2, "u_2", None, "a", None, None)], "session_id int, ordinal int, ref string, start double, text string, name string, status string")).collect()[0].line == "[u_2 00:00:00] (unattributed): a"


def test_references_are_dealt_by_note(spark):
    from colloquy.plans import views as Q

    out = Q.note_references(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # before slugs are gathered and before pages are ranked; no slug is made of a line
    assert plan.count("RepartitionByExpression") >= 2
    assert not [x for x in plan.splitlines() if "l_linenumber" in x and "regexp_replace" in x]
