"""Unification, counts and renames against a walk over one session at a time."""

import random
import re
from collections import defaultdict
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from colloquy.operators import naming as N
from colloquy.operators.review import FILLER_WORDS
from colloquy.operators.streams import cogrouped

ITEMS = "session_id long, kind string, chunk int, pos int, name string, aliases array<string>, mentions long, text string, facts array<string>, is_party boolean"


def key(name):
    return " ".join(name.lower().split())


def words(name):
    return re.findall(r"\w+", name.lower())


def tokens(name):
    return {w for w in words(name) if w not in FILLER_WORDS}


def times(corpus, name):
    return len(re.findall(rf"(?<!\w){re.escape(name)}(?!\w)", corpus, re.I))


def near(a, b, kind):
    """a: (name, aliases) of the kept one."""
    x, y = tokens(a[0]), tokens(b[0])
    if not x or not y:
        return False
    if (key(b[0]) in map(key, a[1]) or key(a[0]) in map(key, b[1])) and x & y:
        return True
    if x == y:
        return True
    r = SequenceMatcher(None, " ".join(sorted(x)), " ".join(sorted(y))).ratio()
    if kind != "character":
        return r >= 0.84
    u, v = words(a[0]), words(b[0])
    if u != v and (u[: len(v)] == v or v[: len(u)] == u):
        return True
    return r >= 0.78 and len(key(a[0])) > 1 and len(key(b[0])) > 1 and key(a[0])[:2] == key(b[0])[:2]


def plain(items, texts):
    """(to by (session, kind, key), renames by (session, dropped), folded by (session, kind, key))"""
    corpus = defaultdict(list)
    for s, t in texts:
        corpus[s].append(t or "")
    made = {}
    for r in sorted(items, key=lambda r: (r[2], r[3])):
        if not r[4] or not r[4].strip():
            continue
        e = made.setdefault((r[0], r[1], key(r[4])), {"name": r[4].strip(), "aliases": [], "mentions": 0, "chunks": 0, "facts": [], "party": False, "at": (r[2], r[3])})
        e["aliases"] += r[5] or []
        e["mentions"] += r[6] or 0
        e["chunks"] += 1
        e["facts"] += r[8] or []
        e["party"] |= bool(r[9])
    to, renames, folded = {}, {}, {}
    for place in (False, True):  # places after persons
        for session in sorted({s for s, k, _ in made}):
            own = [(x, e) for x, e in made.items() if x[0] == session and (x[1] == "location") == place]
            for kind in {x[1] for x, _ in own}:
                named, aliased, kept = {}, {}, []
                rank = lambda e: (times("\n".join(corpus[session]), e["name"]), e["mentions"], e["chunks"], len(e["name"]), -e["at"][0], -e["at"][1])  # noqa: B023, E731
                for x, e in sorted(((x, e) for x, e in own if x[1] == kind), key=lambda y: rank(y[1]), reverse=True):
                    e = {**e, "aliases": list(e["aliases"]), "facts": list(e["facts"])}
                    for k, at in kept:
                        if near((k["name"], k["aliases"]), (e["name"], e["aliases"]), kind):
                            to[x] = at[2]
                            if key(e["name"]) != key(k["name"]):
                                named[e["name"]] = k["name"]
                            for a in e["aliases"]:
                                if a.strip() and key(a) != key(k["name"]):
                                    aliased.setdefault(a, k["name"])
                            k["aliases"] += e["aliases"]
                            k["facts"] += e["facts"]
                            k["mentions"] += e["mentions"]
                            k["chunks"] += 1
                            k["party"] |= e["party"]
                            break
                    else:
                        to[x] = x[2]
                        kept.append((e, x))
                        folded[x] = e
                renames.update({(session, a): b for a, b in {**aliased, **named}.items()})
    return to, renames, folded


def sessions(seed, n=25, size=14):
    source = random.Random(seed)
    first = ["Hann", "Han", "Jackie", "Jace", "Sir Lucius", "Sir Rushus", "Shiran", "Sceriffo", "Vice sceriffo", "Letho", "the Hann", "Fatumastra", "Fatumastre", "Ospedale"]
    last = ["", "", "", " Caleto", " Konno", " Hyman", " di Fatumastra", " II", " of the Hill"]
    items, texts = [], []
    for s in range(n):
        pool = [source.choice(first) + source.choice(last) for _ in range(size)]
        for pos in range(size * 2):
            name = source.choice(pool)
            name = source.choice([name, name.upper(), f" {name} ", name.replace(" ", "  ")])
            aliases = source.choices([*pool, "il nano", " "], k=source.choice([0, 0, 1, 3]))
            items.append((s, source.choice(["character", "location"]), pos // 5, pos, name, aliases, source.randint(0, 3), source.choice(["", "a", "longer", "other one"]), source.choices(["F1", "f1", " F2", ""], k=2), source.random() < 0.1))
        for _ in range(30):
            texts.append((s, source.choice([" ", ", ", "-", "s "]).join(source.choices([*pool, "meets", "e poi", "HANN", "naïve"], k=6))))
    items += [(900, "character", 0, 0, "", None, 1, None, None, None), (900, "character", 0, 1, None, None, None, None, None, None), (901, "location", 0, 0, "the", ["of"], 1, "x", None, None)]
    texts += [(902, "nobody"), (None, "Hann"), (0, None), (0, "")]
    return items, texts


def frames(spark, items, texts):
    return spark.createDataFrame(items, ITEMS).repartition(3), spark.createDataFrame(texts, "session_id long, text string").repartition(3)


def test_whole_sessions_are_the_walk(spark):
    for seed in range(2):
        items, texts = sessions(seed)
        a, b = frames(spark, items, texts)
        ranked = N.standing(N.merge_items(a), b)
        unified = N.unify(ranked).collect()
        to, renames, folded = plain(items, texts)
        assert {(r.session_id, r.kind, r.key): r.to for r in unified if r.key != "the"} == {k: v for k, v in to.items() if k[2] != "the"}
        assert sum(k[2] != v for k, v in to.items()) > 60 and len({r.to for r in unified}) > 10
        entities, names = N.merge_session(a, b)
        assert {(r.session_id, r.dropped): r.canonical for r in names.collect()} == renames
        got = {(r.session_id, r.kind, r.key): r for r in entities.collect()}
        assert set(got) == set(folded)
        once = lambda xs: list({x.strip().lower(): x.strip() for x in reversed(xs) if x.strip()}.values())[::-1]
        for k, e in folded.items():
            r = got[k]
            all_ = len({i[2] for i in items if i[0] == k[0]})
            assert (r.name, r.mentions, r.is_party, r.confidence) == (e["name"], e["mentions"], e["party"], round(e["chunks"] / all_, 3))
            assert [x.lower() for x in r.aliases] == list(dict.fromkeys(x.lower() for x in once(e["aliases"]))) or sorted(x.lower() for x in r.aliases) == sorted(x.lower() for x in once(e["aliases"]))
            assert sorted(x.lower() for x in r.facts) == sorted(x.lower() for x in once(e["facts"]))


def test_the_reference_cases(spark):
    item = lambda s, name, aliases=(), mentions=1, kind="character", pos=0: (s, kind, pos, pos, name, list(aliases), mentions, "", [], False)
    items = [
        item(1, "Hann", pos=0), item(1, "Hann Caleto", mentions=3, pos=1),  # the beginning of a longer name
        item(2, "Hann", ["Sir Lucius"], 5), item(2, "Sir Lucius", mentions=2, pos=1),  # an alias without a word in common
        item(3, "Sir Lucius", ["Sir Rushus"], 5), item(3, "Sir Rushus", mentions=2, pos=1),
        item(4, "Jace", mentions=9), item(4, "Jackie", mentions=1, pos=1),  # the recording decides
        item(5, "Fatumastra", kind="location", mentions=4), item(5, "Ospedale di Fatumastra", kind="location", pos=1),
        item(6, "Sceriffo"), item(6, "Vice sceriffo", pos=1), item(7, "Hyman"), item(7, "Letho Hyman Feulner", pos=1),
        # an alias of a name that has folded tells of a third
        item(8, "Anna Bellini", mentions=9), item(8, "Anna Belini", ["Annetta Bellini Rossi"], 5, pos=1), item(8, "Annetta Bellini Rossi", mentions=1, pos=2),
    ]
    a, b = frames(spark, items, [(4, "Jackie! Jackie says"), (4, "so, JACKIE")])
    to = {(r.session_id, r.key): r.to for r in N.unify(N.standing(N.merge_items(a), b)).collect()}
    assert to[1, "hann"] == "hann caleto" and to[2, "sir lucius"] == "sir lucius" and to[3, "sir rushus"] == "sir lucius"
    assert to[4, "jace"] == "jackie" and to[5, "ospedale di fatumastra"] == "ospedale di fatumastra"
    assert all(to[k] == k[1] for k in to if k[0] in (6, 7)) and to[8, "annetta bellini rossi"] == "anna bellini"
    without = {(r.session_id, r.key): r.to for r in N.unify(N.standing(N.merge_items(a), None)).collect()}
    assert without[4, "jackie"] == "jace"


def plain_rename(text, names):
    if text is None:
        return None
    canonical = sorted(set(names.values()), key=lambda c: (-len(c), c))
    order = [(c, c) for c in canonical] + sorted(names.items(), key=lambda x: (-len(x[0]), x[0]))
    parts = [(text, False)]
    for old, new in order:
        out = []
        for t, done in parts:
            at = 0
            if not done:
                before = "".join(x for x, _ in out)
                del before
                for m in re.finditer(rf"(?<!\w){re.escape(old)}(?!\w)", t, re.I):
                    out += [(t[at : m.start()], False), (new, True)]
                    at = m.end()
            out.append((t[at:], done))
        parts = out
    return "".join(t for t, _ in parts)


def test_renamed_texts(spark):
    source = random.Random(2)
    pool = ["Hann", "Hann Caleto", "Caleto", "Sir", "Sir Lucius", "Jace", "è", "A.B."]
    names = [(s, a, b) for s in range(12) for a, b in {source.choice(pool): source.choice(pool) for _ in range(4)}.items()]
    texts = [(i, source.choice([*range(12), 50, None]), source.choice([" ", ", ", "_", "x "]).join(source.choices([*pool, "and", "HANN"], k=8)), "q") for i in range(300)] + [(900, 0, None, None), (901, 1, "", None)]
    df = spark.createDataFrame(texts, "id long, session_id long, text string, dropped string").repartition(4)
    out = N.rename_texts(df, spark.createDataFrame(names, "session_id long, dropped string, canonical string"))
    assert out.columns == df.columns
    want = {i: plain_rename(t, {a: b for s2, a, b in names if s2 == s}) for i, s, t, _ in texts}
    assert {r.id: r.text for r in out.collect()} == want and sum(want[i] != t for i, _, t, _ in texts) > 100


def test_counts_of_hot_sessions_and_overlaps(spark):
    texts = [(1, "a b a b a, A B")] * 400 + [(2, "aa a")] + [(s, "x") for s in range(10, 60)]
    names = spark.createDataFrame([(1, "a b a"), (1, "a"), (1, "A"), (1, "a b"), (2, "a"), (3, "x"), (1, "")], "session_id long, name string")
    df = spark.createDataFrame(texts, "session_id long, text string").repartition(5)
    assert {(r.session_id, r.name): r.written for r in N.written(names, df).collect()} == {(1, "a b a"): 400, (1, "a"): 1600, (1, "A"): 1600, (1, "a b"): 1200, (2, "a"): 1}
    stream = cogrouped(names, df, "session_id", share=8)
    parts = {r.part for r in stream.filter("key = 1").select("part").distinct().collect()}
    assert len(parts) > 4  # a hot session is dealt to several tasks, each with its names
    assert {r.part for r in stream.filter("key = 1 AND kind = 0").select("part").distinct().collect()} == parts
    plan = N.written(names, df)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "FlatMapGroups" not in plan


def test_no_rows(spark):
    a, b = frames(spark, [], [])
    entities, names = N.merge_session(a, b)
    assert entities.count() == 0 and names.count() == 0
    assert N.rename_texts(b, names).count() == 0


def test_words_of_any_script(spark):
    texts = spark.createDataFrame([(1, "È İstanbul, straße STRASSE ſee see"), (1, "日本 日本語")], "session_id long, text string")
    names = spark.createDataFrame([(1, n) for n in ("è", "straße", "日本", "istanbul", "see")], "session_id long, name string")
    assert {r.name: r.written for r in N.written(names, texts).filter(F.col("name") != "istanbul").collect()} == {"è": 1, "straße": 1, "日本": 1, "see": 1}


def test_rows_of_names_fold_as_rounds_do(spark):
    items, texts = sessions(5, n=12, size=20)
    a, b = frames(spark, items, texts)
    ranked = N.stash(N.standing(N.merge_items(a), b))
    told = lambda df: {(r.session_id, r.kind, r.key): r.to for r in df.collect()}
    walked = N.unify(ranked)
    plan = walked._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan  # no pair of names is shuffled
    assert told(walked) == told(N.unify(ranked, long=0)) == told(N.unify(ranked, long=9))
    assert sum(k[2] != v for k, v in told(walked).items()) > 40


def test_workers_import_names_without_the_letter_tables():
    import subprocess
    import sys

    code = "import colloquy.operators.naming, colloquy.functions.text as t; print(t._plain_letters.cache_info().currsize)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "0"
