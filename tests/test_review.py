"""Channels, scenes, patches and names on small inputs."""

import math
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from colloquy.operators import resolve
from colloquy.operators import review as R


def test_channels_point_and_spread(spark):
    lines = spark.createDataFrame([("s", 1, "meta", "npc_dialogue", "ghost", None, ["b"]), ("s", 2, None, "player", None, "a", None)], "session_id string, ordinal int, kind string, mode string, roll_owner string, answered string, excluded array<string>")
    roster = spark.createDataFrame([("s", "dm"), ("s", "a"), ("s", "b"), ("s", "unknown")], "session_id string, candidate string")
    found = {(r.ordinal, r.channel, r.candidate): r.log_lr for r in R.channels(lines, roster, "dm").collect()}
    assert found[1, "narration", "dm"] == 2.2 and found[1, "narration", "a"] == -0.5
    assert found[1, "voice_mode", "dm"] == 2.0 and (1, "roll", "a") not in found
    assert found[1, "ooc", "dm"] == 0.8 and (1, "ooc", "unknown") not in found
    assert found[1, "identity_note", "b"] == math.log(0.05) and found[2, "user_answer", "a"] == 8.0


def test_a_roster_of_one_has_no_others(spark):
    lines = spark.createDataFrame([("s", 1, None, "narration", None, None, None)], "session_id string, ordinal int, kind string, mode string, roll_owner string, answered string, excluded array<string>")
    assert [(r.channel, r.log_lr) for r in R.channels(lines, spark.createDataFrame([("s", "dm")], "session_id string, candidate string"), "dm").collect()] == [("narration", 2.2)]


def test_scenes_cover_the_session(spark):
    scenes = spark.createDataFrame([("s", 1, 5, 3, None), ("s", 2, 2, 9, "inn"), ("s", 3, None, 4, "x")], "session_id string, pos int, first int, last int, location string")
    lines = spark.createDataFrame([("s", i) for i in range(1, 8)], "session_id string, ordinal int")
    laid = [tuple(r)[1:] for r in R.lay_scenes(scenes, lines).orderBy("scene").collect()]
    assert laid == [(1, 1, 4, "inn"), (2, 5, 7, "unclear")]


def test_what_is_confirmed_stays(spark):
    stored = spark.createDataFrame([("s", "A", "x", True), ("s", "B", "y", False), ("s", "C", "z", False)], "session_id string, label string, who string, confirmed boolean")
    incoming = spark.createDataFrame([("s", "A", "n"), ("s", "B", "m"), ("s", "D", "o")], "session_id string, label string, who string")
    assert {r.label: (r.who, r.confirmed) for r in R.upsert_assignments(stored, incoming).collect()} == {"A": ("x", True), "B": ("m", False), "D": ("o", False)}


def test_names(spark):
    df = spark.createDataFrame([("Uomo urlante",), ("Sir Lucius",), ("la guardia",), ("Guardia Miles",), (None,), ("",)], "n string")
    found = [r[0] for r in df.select(R.is_generic(F.col("n"), ["uomo", "guardia", "sir"], person=True)).collect()]
    assert found == [True, False, True, False, True, True]


def test_renames_are_shielded(spark):
    df = spark.createDataFrame([("Anna meets Anna Maria and annalisa",)], "t string")
    assert df.select(R.rename_all(F.col("t"), {"Anna": "Bea", "Anna Maria": "Anna", "Bea": "Cora"})).first()[0] == "Bea meets Anna and annalisa"


def test_recall_of_names(spark):
    df = spark.createDataFrame([(1, "Then Mara met Otto. The end", "Yesterday Mara saw Ivo! Otto left")], "id int, draft string, benchmark string")
    r = R.name_recall(df).first()
    assert (r.shared, r.missing, r.extra, r.draft_sentences, r.benchmark_words) == (1, 1, 1, 2, 6)


def test_groups_keep_every_line(spark):
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate([5, 5, 30, 1, 1, 1, 1])], "session_id string, idx int, tokens int")
    assert [r.group for r in R.greedy_groups(df, 10, 3).orderBy("idx").collect()] == [0, 0, 1, 2, 2, 2, 3]


def test_self_naming(spark):
    claims = spark.createDataFrame([("s", 1, " Mara ", True, 2.0), ("s", 2, "nobody", True, 1.0)], "session_id string, ordinal int, name string, first_person boolean, strength double")
    names = spark.createDataFrame([("s", "mara", "a")], "session_id string, name string, candidate string")
    roster = spark.createDataFrame([("s", c) for c in "abcdefgh"], "session_id string, candidate string")
    found = {(r.ordinal, r.candidate): r.log_lr for r in R.self_name(claims, names, roster).collect()}
    assert found[1, "a"] == 3.5 and found[1, "b"] == -3.5 / 8 and len(found) == 8


def test_rewriting_by_times(spark):
    t = spark.createDataFrame([("s", 0, 0.0, 1.0, "A", "a"), ("s", 1, 1.0, 2.0, "B", "b")], "session_id string, seg_idx int, start double, end double, speaker string, text string")
    r = spark.createDataFrame([("s", 0, 0.0, 1.0, "X", "x"), ("s", 1, 0.0, 1.0, None, "y")], "session_id string, pos int, start double, end double, speaker string, text string")
    assert [(x.speaker, x.text) for x in R.rewrite_segments(t, r).orderBy("seg_idx").collect()] == [(None, "y"), ("B", "b")]


def test_near_names_are_brute_force(spark):
    dice = random.Random(5)
    names = ["alexander", "miles", "vice sceriffo miles falco", "abc", "a", "ab ab ab", "mara", "bree of the hill", "hill bree"] + ["".join(dice.choice("abn e") for _ in range(dice.randint(2, 14))) for _ in range(60)]
    names = sorted({" ".join(sorted(n.split())) for n in names} - {""})
    typed = {"elexander", "miles", "lmies", "xara"}
    for n in names:
        i = dice.randrange(len(n))
        typed |= {n[:i] + dice.choice("abz") + n[i + 1 :], n[:i] + n[i + 1 :], "q" + n, n + "s"}
    typed = sorted({" ".join(sorted(n.split())) for n in typed} - {""})
    want = {}
    for a in names:
        for b in typed:
            r, x, y = SequenceMatcher(None, a, b).ratio(), set(a.split()), set(b.split())
            if a == b or r >= 0.84 or x <= y or y <= x or (r >= 0.78 and x & y):
                want[a, b] = "same_name" if a == b else "same_entity" if r >= 0.84 else "related"
    side = lambda rows: spark.createDataFrame([(n,) for n in rows], "name string")
    got = {(r.a, r.b): r.tier for r in resolve.fuzzy_matches(side(names), side(typed)).collect()}
    assert want["alexander", "elexander"] == "same_entity" and want["falco miles sceriffo vice", "miles"] == "related"
    assert got == want


def test_fuzzy_matches_read_names_once(spark, tmp_path):
    spark.createDataFrame([(n,) for n in ["red ring", "ring red", "blue bolt"] * 50], "name string").write.parquet(f"{tmp_path}/names")
    names = spark.read.parquet(f"{tmp_path}/names")
    found = resolve.fuzzy_matches(names, names)
    assert not [f for f in found.inputFiles() if str(tmp_path) in f]  # copies are dropped before names are folded and paired
    assert {(r.a, r.b, r.tier) for r in found.collect()} == {("red ring", "red ring", "same_name"), ("blue bolt", "blue bolt", "same_name")}
