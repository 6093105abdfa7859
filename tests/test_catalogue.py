"""Every query of the engine against its SQL in DuckDB, or against a plain version where it has none."""

import hashlib
import itertools
import math
from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy import adapters as A
from colloquy import catalogue
from colloquy.operators import kernels as K
from colloquy.operators import resolve as R
from colloquy.plans import evidence as P
from colloquy.plans import naming, relational
from tests import test_naming, test_voices
from tests.helpers import connection, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def approx_distinct(spark, rows):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_returnflag", "l_partkey", "l_extendedprice").collect()
    for r in rows:
        own = [x for x in lines if x.l_returnflag == r.l_returnflag]
        n, prices = len({x.l_partkey for x in own}), sorted(x.l_extendedprice for x in own)
        assert abs(r.parts - n) <= 0.08 * n
        assert prices[int(0.47 * len(prices))] <= r["median"] <= prices[int(0.53 * len(prices))]
    assert len(rows) == len({x.l_returnflag for x in lines})


def conflict_matching(spark, rows):
    want, by = set(), defaultdict(list)
    for r in R.similar_beats(relational._beats(spark, SF)).collect():
        by[r.session_id].append((-round(r.score, 9), r.i, r.j))
    for session, pairs in by.items():
        taken = set()
        for _, i, j in sorted(pairs):
            if not {i, j} & taken and sum(s == session for s, *_ in want) < 10:
                taken |= {i, j}
                want.add((session, i, j))
    assert {(r.session_id, r.i, r.j) for r in rows} == want and want


def unify_names(spark, rows):
    def near(a, b):
        x, y = a.split(), b.split()
        opening = set(x) & set(y) and (x[: len(y)] == y or y[: len(x)] == x)
        return sorted(x) == sorted(y) or opening or SequenceMatcher(None, " ".join(sorted(x)), " ".join(sorted(y))).ratio() >= 0.84

    want, by = {}, defaultdict(list)
    for r in R.merge_names(relational._items(spark, SF).drop("chunk_name")).collect():
        by[r.session_id].append((-r.mentions, -r.chunks, -len(r.key), r.key))
    for session, names in by.items():
        kept = []
        for *_, name in sorted(names):
            want[session, name] = next((k for k in kept if near(k, name)), name)
            kept += [name] * (want[session, name] == name)
    assert {(r.session_id, r.name): r.canonical for r in rows} == want


def fuzzy_match(spark, rows):
    names = {r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").collect()}
    key = lambda n: " ".join(sorted(n.split()))
    left, right, want = {key(n) for n in names}, {key(n + "s") for n in names}, set()
    for a, b in itertools.product(left, right):
        ratio, x, y = SequenceMatcher(None, a, b).ratio(), set(a.split()), set(b.split())
        if a == b or ratio >= 0.84 or x <= y or y <= x or (ratio >= 0.78 and x & y):
            want.add((a, b))
    assert {(r.a, r.b) for r in rows} == want


def by_session(spark):
    out = defaultdict(list)
    for r in A.observations(spark, SF).orderBy("session_id", "ref").collect():
        out[r.session_id].append(r)
    return {s: (own, K._units_of([r.vector for r in own])) for s, own in out.items()}


def bp_posteriors(spark, rows):
    from colloquy.operators import evidence as E
    from colloquy.operators import vectors as V

    phi = E.fuse(P._obs(spark, SF).select("session_id", "ref", F.lit(0.5).alias("alpha")), P._evidence(spark, SF), P._prior(spark, SF)).collect()
    edges = V.knn_edges(P._obs(spark, SF), 4).collect()
    want = {}
    for s in {r.session_id for r in phi}:
        refs, names = sorted({r.ref for r in phi if r.session_id == s}), sorted({r.candidate for r in phi if r.session_id == s})
        x = np.full((len(refs), len(names)), K.MISSING)
        at = {r: i for i, r in enumerate(refs)}
        for r in phi:
            if r.session_id == s:
                x[at[r.ref], names.index(r.candidate)] = r.log_phi
        own = sorted((at[r.i], at[r.j]) for r in edges if r.session_id == s)
        p, _ = K.propagate(x, *(np.array(c) for c in zip(*own, strict=True)), np.full(len(own), math.log(0.7)), np.full(len(own), math.log(0.3)))
        want |= {(s, r, n): p[i, k] for i, r in enumerate(refs) for k, n in enumerate(names)}
    assert len(rows) == len(want) and all(abs(r.p - want[r.session_id, r.ref, r.candidate]) < 2e-5 for r in rows)


def upgma(spark, rows):
    want = {(s, r.ref): c for s, (own, x) in by_session(spark).items() for r, c in zip(own, K.upgma(np.clip(1 - x @ x.T, 0, 2), k=5), strict=True)}
    assert {(r.session_id, r.ref): r.cluster for r in rows} == want


def kmeans(spark, rows):
    want = {(s, r.ref): c for s, (own, x) in by_session(spark).items() for r, c in zip(own, K.kmeans(x, 4, seed=7), strict=True)}
    assert {(r.session_id, r.ref): r.cluster for r in rows} == want


def purity(spark, rows):
    want = {}
    for s, (own, x) in by_session(spark).items():
        for label in {r.label for r in own}:
            at = [i for i, r in enumerate(own) if r.label == label]
            want[s, label] = K.purity_of(x[at], np.array([own[i].duration for i in at]), 0.9)[:2]
    assert {(r.session_id, r.label): (r.purity, r.reason) for r in rows} == {k: (round(p, 3), why) for k, (p, why) in want.items()}


def label_splits(spark, rows):
    want = {}
    for s, (own, x) in by_session(spark).items():
        for label in {r.label for r in own}:
            at = [i for i, r in enumerate(own) if r.label == label]
            sides = K.kmeans(x[at], 2, restarts=25, seed=20240914) if len(at) >= 6 else [0] * len(at)
            if min(sides.count(0), sides.count(1)) < 3:
                sides = [0] * len(at)
            want |= {(s, own[i].ref): side for i, side in zip(at, sides, strict=True)}
    assert {(r.session_id, r.ref): r.side for r in rows} == want


def page_matches(spark, rows):
    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    key = lambda n: " ".join(sorted(n.split()))
    tiers, want = {}, defaultdict(lambda: [0, 0])

    def tier(a, b):
        ratio, x, y = SequenceMatcher(None, a, b).ratio(), set(a.split()), set(b.split())
        return "same_name" if a == b else "same_entity" if ratio >= 0.84 else "related" if x <= y or y <= x or (ratio >= 0.78 and x & y) else None

    for e, p in itertools.product(parts, parts):
        if not 5 < p.p_size <= 45:
            continue
        pair = key(e.p_name + "s" if e.p_partkey % 2 == 0 else e.p_name), key(p.p_name)
        if pair not in tiers:
            tiers[pair] = tier(*pair)
        if tiers[pair]:
            cell = want[tiers[pair], e.p_type == p.p_type]
            cell[0] += 1
            cell[1] += e.p_partkey * 31 + p.p_partkey
    assert {(r.tier, r.same_kind): [r.n, r["pairs"]] for r in rows} == dict(want)


def carried_places(spark, rows):
    got = {(r.session_id, r.i): r.place for r in rows}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        lines = d.text.split("\n")
        fresh = [(i, t + " again" if i % 4 == 3 else t) for i, t in enumerate(lines) if i % 7 != 6]
        keys = [" ".join(t.split()).casefold() for _, t in fresh]
        whole_ = [" ".join(t.split()).casefold() for t in lines]
        for k, (i, _) in enumerate(fresh):
            if whole_.count(keys[k]) == 1 and keys.count(keys[k]) == 1 and i % 4 != 3:
                assert got[d.doc_id, i] == f"p{i}"  # an untouched line that is told once keeps its place
        assert {i for s, i in got if s == d.doc_id} == {i for i, _ in fresh}


def answer_loop(spark, rows):
    """The last word on every posterior is that of a whole run over the potentials that all answers left."""
    from colloquy.operators import evidence as E
    from colloquy.operators import vectors as V
    from colloquy.operators.planning import SPREAD, USER_ANSWER
    from colloquy.plans import kernels as Q

    phi = E.fuse(Q._obs(spark, SF).select("session_id", "ref", F.lit(0.5).alias("alpha")), Q._evidence(spark, SF), Q._prior(spark, SF)).toPandas()
    links = V.knn_edges(Q._obs(spark, SF), 1).toPandas()
    told = Q._answers(spark, SF).toPandas().sort_values("seq")
    seen = 0
    for session, own in phi.groupby("session_id"):
        wide = own.pivot_table(index="ref", columns="candidate", values="log_phi", fill_value=K.MISSING)
        e = links[links["session_id"] == session].sort_values(["i", "j"])
        ij = [(a, b) for a, b in zip(e["i"], e["j"]) if a != b]
        asked = unsure = 0
        done = set()
        for r in told[told["session_id"] == session].itertuples():
            if asked == 8 or unsure == 2:
                break
            asked += 1
            if r.candidate is None or r.candidate not in wide.columns:
                unsure += 1
                continue
            unsure = 0
            wide.loc[r.ref, r.candidate] += USER_ANSWER
            done.add(r.ref)
            for a, b in ij + [(b, a) for a, b in ij]:
                if a == r.ref and b not in done:
                    wide.loc[b, r.candidate] += SPREAD * 0.75
        at = {x: i for i, x in enumerate(wide.index)}
        i, j = np.array([at[a] for a, _ in ij]), np.array([at[b] for _, b in ij])
        p = K.propagate(wide.to_numpy(float), i, j, np.full(len(ij), math.log(0.6)), np.full(len(ij), math.log(0.4)), sweeps=300, most=3000, tolerance=1e-12)[0]
        last = {}
        for r in sorted((r for r in rows if r.session_id == session and r.ref is not None), key=lambda r: r.seq):
            last[r.ref, r.candidate] = r.p
        for (ref, c), x in last.items():
            assert abs(p[at[ref], list(wide.columns).index(c)] - x) < 2e-3  # what moves by less isn't told
            seen += 1
        assert max(r.asked for r in rows if r.session_id == session) == asked
    assert seen > 20


def _walked(spark):
    """What a walk over one session at a time makes of the same items, and the sessions' lines."""
    if not _walk:
        items = [(r.session_id, r.kind, r.chunk, r.pos, r.name, r.aliases, r.mentions, r.text, r.facts, r.is_party) for r in naming._items(spark, SF).collect()]
        lines = [(r.session_id, r.i, r.text) for r in naming._lines(spark, SF).collect()]
        _walk.extend([items, lines, *test_naming.plain(items, [(s, t) for s, _, t in lines])])
    return _walk


_walk: list = []


def names_written(spark, rows):
    items, lines, *_ = _walked(spark)
    by = defaultdict(list)
    for s, _, t in lines:
        by[s].append(t)
    want = {(s, n): test_naming.times("\n".join(by[s]), n) for s, n in {(i[0], i[4]) for i in items}}
    assert {(r.session_id, r["name"]): r.written for r in rows} == {k: n for k, n in want.items() if n}


def session_unify(spark, rows):
    to = _walked(spark)[2]
    got = {(r.session_id, r.kind, r.key): r.to for r in rows}
    assert {k: got[k] for k in to} == to and len(got) == len(to) and sum(k[2] != v for k, v in to.items()) > 20


def session_merge(spark, rows):
    folded = _walked(spark)[4]
    got = {(r.session_id, r.kind, r.key): r for r in rows}
    assert set(got) == set(folded)
    for k, e in folded.items():
        r = got[k]
        assert (r["name"], r.mentions, r.is_party) == (e["name"], e["mentions"], e["party"])
        assert set(x.lower() for x in r.facts.split("|")) == {x.lower() for x in e["facts"]}


def session_renames(spark, rows):
    assert {(r.session_id, r.dropped): r.canonical for r in rows} == _walked(spark)[3]


def renamed_lines(spark, rows):
    _, lines, _, renames, _ = _walked(spark)
    by = defaultdict(dict)
    for (s, a), b in renames.items():
        by[s][a] = b
    got = {(r.session_id, r.i): r.text for r in rows}
    assert len(got) == len(lines)
    for s, i, t in lines:
        assert got[s, i] == hashlib.md5(test_naming.plain_rename(t, by[s]).encode()).hexdigest()


def _plain_sessions(spark):
    """What a plain walk over one session at a time makes of its segments, turns, vectors and enrolled people."""
    if not _plain:
        from colloquy.operators import transcript as T
        from colloquy.plans import voices as Q

        segments = Q._segments(spark, SF).collect()
        vector = {(r.session_id, r.seg_idx): np.array(r.vector) for r in segments}
        prints = defaultdict(lambda: defaultdict(list))
        for r in A.prints(spark, SF).collect():
            prints[r.session_id][r.candidate].append(np.array(r.vector))
        turns = defaultdict(dict)
        for t in T.speaker_turns(Q._segments(spark, SF)).collect():
            turns[t.session_id][t.turn] = (t.start, t.end, list(t.indices))
        for s, own in turns.items():
            have = {t: np.mean([vector[s, i] for i in x[2]], axis=0) for t, x in own.items() if x[1] - x[0] >= 4}
            have = {t: v / np.linalg.norm(v) for t, v in have.items()}
            people = [(c, np.mean(v, axis=0)) for c, v in sorted(prints[s].items(), key=lambda x: int(x[0].split(":")[1]))]
            lines = [(r.seg_idx, r.speaker) for r in segments if r.session_id == s]
            _plain[s] = test_voices.plain_relabel(lines, own, have, people, 6 if s % 2 == 0 else None, 2.0 if s % 2 == 0 else 0.9, 0.25)
    return _plain


_plain: dict = {}


def voice_relabel(spark, rows):
    got = defaultdict(dict)
    for r in rows:
        got[r.session_id][r.seg_idx] = r.speaker
    assert got == {s: speaker for s, (speaker, _) in _plain_sessions(spark).items()}


def voice_labels(spark, rows):
    got = defaultdict(dict)
    for r in rows:
        got[r.session_id][r.label] = (r.turns, r.seconds, r.user, r.cosine)
    want = {s: voices for s, (_, voices) in _plain_sessions(spark).items()}
    assert {s: {k: v[:3] for k, v in x.items()} for s, x in got.items()} == {s: {k: v[:3] for k, v in x.items()} for s, x in want.items()}
    assert all(abs((v[3] or 0) - (want[s][k][3] or 0)) < 2e-5 for s, x in got.items() for k, v in x.items()) and len(got[0]) == 6


def voice_verdicts(spark, rows):
    """Purity by the gates over plain numpy; reasons from the query that has SQL."""
    from colloquy.plans import voices as Q

    by, near = defaultdict(list), defaultdict(list)
    for r in A.observations(spark, SF).orderBy("ref").collect():
        by[r.session_id, r.label].append((np.array(r.vector) / np.linalg.norm(r.vector), r.duration))
    for (s, _), own in by.items():
        near[s] += [1 - float(a[0] @ b[0]) for a, b in itertools.combinations(own, 2)]
    why = defaultdict(list)
    for r in sorted(Q.voice_suspicions(spark, SF).collect(), key=lambda r: r.place):
        why[r.session_id, r.voice].append(r.kind)
    assert {(r.session_id, r.voice) for r in rows} == set(by)
    for r in rows:
        own = by[r.session_id, r.voice]
        purity, reason, sep, _ = K.purity_of(np.array([v for v, _ in own]), np.array([d for _, d in own]), float(np.percentile(near[r.session_id], 95)))
        assert (r.n, r.seconds, r.reason, r.impure) == (len(own), sum(d for _, d in own), reason, reason == "impure") and abs(r.purity - purity) < 1e-3 and abs(r.sep - sep) < 1e-4
        assert r.triggers == ",".join(why[r.session_id, r.voice])


def belief_status(spark, rows):
    from colloquy.plans import voices as Q

    phi, edges, evidence = (x.collect() for x in Q._graph(spark, SF))
    own, heard = (x.collect() for x in Q._answered(spark, SF))
    labels = {(r.session_id, r.ref): r.label for r in A.observations(spark, SF).collect()}
    got = defaultdict(dict)
    for r in rows:
        got[r.session_id][r.ref] = (r.best, r.status, r.decided_by, r.channel)
    assert sum(map(len, got.values())) == len(labels)
    for s in {k[0] for k in labels}:
        here = lambda xs: [x for x in xs if x.session_id == s]  # noqa: B023, E731
        potentials = defaultdict(dict)
        for r in here(phi):
            potentials[r.ref][r.candidate] = r.log_phi
        links = here(edges)
        want = test_voices.plain_status(
            potentials, [(e.i, e.j, e.log_same, e.log_diff) for e in links], {(e.ref, e.channel, e.candidate): e.log_lr for e in here(evidence)}, {r: v for (x, r), v in labels.items() if x == s},
            {r.ref: r.candidate for r in here(own)}, {r.voice: r.candidate for r in here(heard)}, {r: ["sing"] for x, r in labels if x == s and r % 11 == 0}, {("member:1", "sing")}, [(e.i, e.j, e.likeness) for e in links],
        )
        assert got[s] == want
    assert {x[1] for own in got.values() for x in own.values()} >= {"user_confirmed", "propagated", "auto_high", "auto_low", "unresolved"}


def channel_weights(spark, rows):
    """Gradient steps over dense arrays of examples, candidates and channels."""
    names, channels, by = ["c0", "c1", "c2"], ["address", "roll", "voice"], defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        by[r.l_orderkey // 100].append((r.l_orderkey, r.l_partkey % 3, channels.index(["voice", "address", "roll"][r.l_linenumber % 3]), round(r.l_discount * 20 - 1, 3)))
    got = {(r.campaign, r.channel): r.weight for r in rows}
    for campaign, lines in by.items():
        at = {e: n for n, e in enumerate(sorted({x[0] for x in lines}))}
        x, there = np.zeros((len(at), 3, 3)), np.zeros((len(at), 3), bool)
        for e, c, ch, lr in lines:
            x[at[e], c, ch] += lr
            there[at[e], c] = True
        own = sorted({x[2] for x in lines})
        x, w = x[:, :, own], np.ones(len(own))
        observed = x[np.arange(len(at)), [e % 3 for e in at]].sum(0)
        for _ in range(300):
            z = np.where(there, np.exp(x @ w), 0.0)
            p = z / z.sum(1, keepdims=True)
            w = np.clip(w + 0.5 * (observed - np.einsum("ec,ecn->n", p, x) - (w - 1)) / len(at), 0.0, 2.0)
        for ch, v in zip(own, w, strict=True):
            assert abs(got.pop((campaign, channels[ch])) - v) < 2e-4
    assert not got and len(by) > 10


def whole(*columns, least=1):
    """Rows are told apart by these columns, and there are some; what the operator does is tested elsewhere."""

    def check(spark, rows):
        keys = [tuple(r[c] for c in columns) for r in rows]
        assert len(keys) == len(set(keys)) >= least

    return check


PLAIN = {
    "answer_loop": answer_loop, "voice_relabel": voice_relabel, "voice_labels": voice_labels, "voice_verdicts": voice_verdicts, "belief_status": belief_status, "channel_weights": channel_weights,
    "names_written": names_written, "session_unify": session_unify, "session_merge": session_merge, "session_renames": session_renames, "renamed_lines": renamed_lines,
    "approx_distinct": approx_distinct, "conflict_matching": conflict_matching, "unify_names": unify_names, "fuzzy_match": fuzzy_match, "bp_posteriors": bp_posteriors, "upgma": upgma, "kmeans": kmeans, "purity": purity, "label_splits": label_splits, "page_matches": page_matches, "carried_places": carried_places,
    # against plain versions in test_views, test_planning and test_functions
    "sampled_lines": whole("session_id", "i", least=500), "linked_mentions": whole("text", least=50), "capability_contradiction": whole("session_id", "label", least=10), 
    "review_plans": whole("session_id", "step", least=20), "text_keys": whole("p_partkey", least=150), "name_counts": whole("doc_id", least=200), "renamed_beats": whole("p_name", least=50), "audio_measures": whole("vec_id", least=500),
}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLES:
        same(df, con, catalogue.ORACLES[name])
    else:
        PLAIN[name](spark, df.collect())


def test_oracles_have_queries():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and set(catalogue.QUERIES) - set(catalogue.ORACLES) == set(PLAIN)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
