"""Voices and verdicts against plain versions that look at everything again at every step."""

import random

import numpy as np
import pytest

from colloquy.operators import kernels as K
from colloquy.operators import transcript as T
from colloquy.operators import verdicts as D
from colloquy.operators import voices as W
from tests.test_kernels import cloud

SEGMENT = "session_id int, seg_idx int, start double, end double, speaker string, chunk int, text string, speaker_confidence double"


def plain_linkage(distance, k=None, threshold=None):
    """The whole matrix is searched for every merge."""
    d = np.array(distance, float)
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1 and (k is None or len(groups) > k):
        best = None
        for x in range(len(groups)):
            for y in range(x + 1, len(groups)):
                i, j = groups[x][0], groups[y][0]
                if best is None or d[i, j] < best[0]:
                    best = d[i, j], x, y
        if threshold is not None and best[0] > threshold:
            break
        _, x, y = best
        i, j, a, b = groups[x][0], groups[y][0], len(groups[x]), len(groups[y])
        d[i] = d[:, i] = (a * d[i] + b * d[j]) / (a + b)
        groups[x] = groups[x] + groups[y]
        del groups[y]
    of = {m: g for g, members in enumerate(groups) for m in members}
    first = {}
    return [first.setdefault(of[i], len(first)) for i in range(len(d))]


@pytest.mark.parametrize("seed", range(30))
def test_linkage_is_the_plain_one_with_ties_too(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 25))
    d = rng.integers(0, 4, (n, n)).astype(float) if seed % 2 else rng.random((n, n))
    d = np.triu(d, 1) + np.triu(d, 1).T
    for setting in ({"k": int(rng.integers(1, n + 1))}, {"threshold": float(rng.random() * 2)}, {"k": 3, "threshold": 0.5}):
        assert K.upgma(d, **setting) == plain_linkage(d, **setting)
    assert K.upgma(np.zeros((0, 0)), k=1) == [] and K.upgma(np.zeros((1, 1)), k=1) == [0]


def test_linkage_of_one_point_many_times_is_no_cube():
    import time

    at = time.perf_counter()
    assert set(K.upgma(np.zeros((1500, 1500)), k=1)) == {0}
    assert time.perf_counter() - at < 20


def plain_relabel(segments, turns, vectors, anchors, k, threshold, least):
    """One session: segments (seg_idx, speaker), turns {turn: (start, end, indices)}, vectors {turn: vector}, anchors [(user, vector)]."""
    unit = lambda v: np.asarray(v, float) / (np.linalg.norm(v) or 1)
    have = sorted(vectors)
    x = np.array([unit(vectors[t]) for t in have])
    ids = plain_linkage(np.clip(1 - x @ x.T, 0, 2), k, threshold) if have else []
    of = dict(zip(have, ids, strict=True))
    members = {c: [t for t in have if of[t] == c] for c in set(ids)}
    order = sorted(members, key=lambda c: min(turns[t][2][0] for t in members[c]))
    label = {c: f"SPEAKER_{i:02d}" for i, c in enumerate(order)}
    middle = {t: (a + b) / 2 for t, (a, b, _) in turns.items()}
    speaker = dict(segments)
    for t, (_, _, indices) in turns.items():
        if have:
            own = of[t] if t in of else of[min(have, key=lambda e: (abs(middle[e] - middle[t]), e))]
            for i in indices:
                speaker[i] = label[own]
    voices = {}
    for c, ts in members.items():
        mean = unit(np.mean([vectors[t] for t in ts], axis=0))
        best = None
        for user, v in anchors:
            s = float(mean @ unit(v))
            if s >= least and (best is None or round(s, 9) > round(best[1], 9)):
                best = user, s
        voices[label[c]] = (len(ts), round(sum(turns[t][1] - turns[t][0] for t in ts), 3), best and best[0], best and round(best[1], 5))
    return speaker, voices


def test_relabel_is_the_plain_one(spark):
    draw, rng = random.Random(5), np.random.default_rng(5)
    rows, vectors, anchors, rule = [], {}, [], []
    for s in range(8):
        at = 0.0
        for i in range(draw.randint(1, 30)):
            length = draw.choice([0.0, 1.0, 2.0, 4.0])  # whole numbers, so that middles are equally far
            rows.append((s, i, at, at + length, draw.choice(["A", "B", None]), i // 9, "t", 1.0))
            at += length + draw.choice([0.0, 2.0])
        anchors += [(s, n, f"u{n}", [float(v) for v in rng.normal(size=6)]) for n in range(3)]
        if s % 3:
            rule.append((s, 3 if s % 3 == 1 else None, 0.7 if s % 3 == 2 else None))
    segments = spark.createDataFrame(rows, SEGMENT)
    turns = T.speaker_turns(segments)
    found = {}
    for t in turns.collect():
        found.setdefault(t.session_id, {})[t.turn] = (t.start, t.end, list(t.indices))
    for s, own in found.items():
        for t in own:
            if s != 7 and draw.random() < 0.6:  # session 7 has no vector at all
                vectors[s, t] = [float(v) for v in rng.normal(size=6) + 2 * np.eye(6)[t % 3]]
    embedded = spark.createDataFrame([(s, t, v) for (s, t), v in vectors.items()], "session_id int, turn int, vector array<double>")
    out = W.relabel(segments, turns, embedded, spark.createDataFrame(anchors, "session_id int, id int, user string, vector array<double>"), spark.createDataFrame(rule, "session_id int, k int, threshold double"), threshold=0.5, least=0.3)
    got, voices = {}, {}
    for r in out.segments.collect():
        got.setdefault(r.session_id, {})[r.seg_idx] = r.speaker
    for r in out.voices.collect():
        voices.setdefault(r.session_id, {})[r.label] = (r.turns, round(r.seconds, 3), r.user, None if r.cosine is None else round(r.cosine, 5))
    ends = {s: (k, far) for s, k, far in rule}
    for s in range(8):
        k, far = ends.get(s, (None, None))
        own = {t: v for (x, t), v in vectors.items() if x == s}
        speaker, want = plain_relabel([(r[1], r[4]) for r in rows if r[0] == s], found.get(s, {}), own, [(u, v) for x, _, u, v in anchors if x == s], k, 0.5 if far is None else far, 0.3)
        assert got[s] == speaker and voices.get(s, {}) == want
    assert 7 not in voices and any(v[2] for own in voices.values() for v in own.values())
    assert out.segments.columns == segments.columns


def test_relabel_of_nothing_and_without_anchors(spark):
    segments = spark.createDataFrame([(1, 0, 0.0, 1.0, "A", 0, "t", 1.0), (1, 1, 9.0, 10.0, None, 0, "t", 1.0)], SEGMENT)
    turns = T.speaker_turns(segments)
    none = spark.createDataFrame([], "session_id int, turn int, vector array<double>")
    out = W.relabel(segments, turns, none)
    assert {(r.seg_idx, r.speaker) for r in out.segments.collect()} == {(0, "A"), (1, None)} and out.voices.count() == 0
    one = spark.createDataFrame([(1, 0, [1.0, 0.0])], "session_id int, turn int, vector array<double>")
    out = W.relabel(segments, turns, one)
    assert {(r.seg_idx, r.speaker) for r in out.segments.collect()} == {(0, "SPEAKER_00"), (1, None)}
    assert [(r.label, r.user, r.cosine) for r in out.voices.collect()] == [("SPEAKER_00", None, None)]


def test_a_transcript_takes_the_labels_of_equal_times(spark):
    new = spark.createDataFrame([(1, 0, 0.0, 1.0, "S0"), (1, 1, 0.0, 1.0, "S1"), (1, 2, 1.0, 2.0, None)], "session_id int, seg_idx int, start double, end double, speaker string")
    old = spark.createDataFrame([(1, 0.0, 1.0, "x", "a"), (1, 1.0, 2.0, "y", "b"), (1, 0.0, 1.5, "z", "c"), (1, None, None, "w", "d"), (2, 0.0, 1.0, "v", "e")], "session_id int, start double, end double, speaker string, text string")
    assert {(r.text, r.speaker) for r in W.rewrite_speakers(old, new).collect()} == {("a", "S1"), ("b", "y"), ("c", "z"), ("d", "w"), ("e", "v")}


def test_null_says_nothing_and_no_rows_give_none(spark):
    obs = spark.createDataFrame([(1, 1, i, float(i), float(i), None, None) for i in range(4)], "session_id int, voice int, ref int, start double, end double, label string, confidence double")
    hits = spark.createDataFrame([(1, 0, "a", None, 1), (1, 1, "b", 0.9, 1), (1, 2, "c", 0.9, 2)], "session_id int, ref int, candidate string, cosine double, rank int")
    needs = spark.createDataFrame([(1, 1, "x")], "session_id int, voice int, capability string")
    members = spark.createDataFrame([("m", "y")], "member string, capability string")
    assert W.suspicions(obs, hits, needs, members).count() == 0
    assert W.suspicions(obs.limit(0), hits, needs.limit(0), members).count() == 0


def test_a_voice_of_two_is_told_apart(spark):
    two, one = cloud([0, 1], 12, 0.05), cloud([2], 24, 0.05, seed=1)
    rows = [(1, v, 100 * v + i, [float(y) for y in x], 3.0) for v, xs in ((1, two), (2, one)) for i, x in enumerate(xs)]
    obs = spark.createDataFrame(rows, "session_id int, voice int, ref int, vector array<double>, duration double")
    fired = spark.createDataFrame([(1, 1, "aba_pattern", 0.7, 2), (1, 1, "anchor_conflict", 1.0, 1)], "session_id int, voice int, kind string, weight double, place int")
    got = {r.voice: r for r in W.identity_verdicts(obs, fired, spark.createDataFrame([(1, 0.2)], "session_id int, p95 double")).collect()}
    assert got[1].impure and got[1].triggers == ["anchor_conflict", "aba_pattern"] and got[1].seconds == 72
    assert {frozenset(got[1].first), frozenset(got[1].second)} == {frozenset(range(100, 112)), frozenset(range(112, 124))}
    assert not got[2].impure and got[2].triggers == [] and got[2].first is None and got[2].second is None
    unmeasured = {r.voice: r.impure for r in W.identity_verdicts(obs, fired, spark.createDataFrame([], "session_id int, p95 double")).collect()}
    assert unmeasured == {1: True, 2: False}


def plain_status(phi, edges, evidence, voice_of, answers, voice_answers, needs, learned, alike):
    """{ref: (best, status, decided_by, channel)} of one session by dictionaries: phi {ref: {candidate: x}}, edges [(i, j, same, different)]."""
    names, refs = sorted({c for own in phi.values() for c in own}), sorted(phi)
    at = {r: i for i, r in enumerate(refs)}
    e = sorted((x for x in edges if x[0] in at and x[1] in at), key=lambda x: x[:2])
    i, j = (np.array([at[x[k]] for x in e], int) for k in (0, 1))

    def infer(own):
        p = K.propagate(np.array([[own[r].get(c, K.MISSING) for c in names] for r in refs]), i, j, np.array([x[2] for x in e], float), np.array([x[3] for x in e], float))[0]
        return {r: dict(zip(names, map(float, p[at[r]]), strict=True)) for r in refs}

    told = {r: dict(own) for r, own in phi.items()}
    known = {r: c for r, c in answers.items() if c != "idk"}
    for r, own in told.items():
        heard = voice_answers.get(voice_of[r])
        for c in own:
            own[c] += 8.0 * (known.get(r) == c) + 4.5 * (heard == c) + sum(1.2 for n in needs.get(r, ()) if (c, n) in learned)
    for a, b, likeness in alike:
        for x, y in ((a, b), (b, a)):
            if round(likeness, 6) >= 0.7 and x in known and y not in known and known[x] in told[y]:
                told[y][known[x]] += 2.5 * likeness
    before, after, out = infer(phi), infer(told), {}
    for r in refs:
        ranked = sorted(after[r].items(), key=lambda x: (-x[1], x[0]))
        best, top, second = ranked[0][0], ranked[0][1], ranked[1][1]
        p, margin = round(top, 9), round(top - second, 9)
        said = {k: v for (ref, k, c), v in evidence.items() if ref == r and c == best}
        why = max(((v, k) for k, v in said.items() if k != "voice" and v >= 1.5), default=(None, None))[1]
        answered = r in known or voice_of[r] in voice_answers
        moved = r not in known and round(max(abs(before[r][c] - after[r][c]) for c in names), 9) >= 1e-3
        low = "auto_low" if p >= 0.6 else "unresolved"
        if answered:
            status, by = "user_confirmed", "question"
        elif moved:
            status, by = "propagated" if p >= 0.95 and margin >= 0.75 else low, "propagation"
        else:
            status, by = "auto_high" if p >= 0.9 and margin >= 0.5 and (why or said.get("voice", 0.0) >= 3.0) else low, "engine"
        out[r] = best, status, by, why
    return out


def test_status_without_answers_or_rows(spark):
    phi = spark.createDataFrame([(1, r, c, x) for r in (1, 2) for c, x in (("a", 4.0), ("b", 0.0))], "session_id int, ref int, candidate string, log_phi double")
    edges = spark.createDataFrame([(1, 1, 2, -0.1, -2.0, 0.9)], "session_id int, i int, j int, log_same double, log_diff double, likeness double")
    evidence = spark.createDataFrame([(1, 1, "voice", "a", 4.0), (1, 2, "voice", "b", 4.0)], "session_id int, ref int, channel string, candidate string, log_lr double")
    voices = spark.createDataFrame([(1, 1, 5), (1, 2, None)], "session_id int, ref int, voice int")
    none = spark.createDataFrame([], "session_id int, ref int, candidate string"), spark.createDataFrame([], "session_id int, voice int, candidate string")
    rest = spark.createDataFrame([], "session_id int, ref int, capability string"), spark.createDataFrame([], "candidate string, capability string"), edges
    got = {r.ref: (r.best, r.status, r.decided_by) for r in D.verdicts(phi, edges, evidence, voices, *none, *rest).collect()}
    assert got == {1: ("a", "auto_high", "engine"), 2: ("a", "auto_low", "engine")}  # the voice of line 2 speaks for another
    nobody = spark.createDataFrame([(1, 1, "idk")], "session_id int, ref int, candidate string")
    assert {r.decided_by for r in D.verdicts(phi, edges, evidence, voices, nobody, none[1], *rest).collect()} == {"engine"}
    assert D.verdicts(phi.limit(0), edges, evidence, voices, *none, *rest).count() == 0
