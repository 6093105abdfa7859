"""The FM-index against plain search."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from colloquy.llm import decontaminate as D
from tests.helpers import connection, same

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for item, phrase in items:
            p = words(phrase)
            for k in range(max(0, len(p) - size) + 1 if p else 0):
                window = p[k : k + size]
                for i in range(len(w) - len(window) + 1):
                    if w[i : i + len(window)] == window:
                        hit.update(range(i, i + len(window)))
                        found.add(str(item))
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_suffix_array_and_search():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 400):
        s = rng.integers(1, 5, n)
        index = D.FMIndex(s, 9)
        full = [*s.tolist(), 0]
        assert D.suffix_array(np.array(full)).tolist() == sorted(range(n + 1), key=lambda i: full[i:])
        lengths = rng.integers(1, 5, 30)
        patterns = rng.integers(1, 10, (30, 4)) if n == 2 else rng.integers(1, 5, (30, 4))
        low, high = index.search(patterns, lengths)
        for p, m, a, b in zip(patterns, lengths, low, high, strict=True):
            want = [i for i in range(n - m + 1) if s[i : i + m].tolist() == p[:m].tolist()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def make(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, dec_hits string")
    return d, spark.createDataFrame(items, "item_id long, text string")


def test_find_is_brute_force(spark):
    source = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "ÀB", "Q9"]
    items = [(i, " ".join(source.choices(vocabulary, k=k))) for i, k in enumerate([1, 2, 4, 9, 10, 11, 25, 25, 40])] + [(50, None), (51, " .,"), (52, ""), (None, "w1 w2 w3")]
    docs = [(i, source.choice([" ", ", ", "\n"]).join(source.choices([*vocabulary, "other", "More"], k=source.randint(0, 300)))) for i in range(40)]
    docs += [(40, items[8][1].upper() + "!"), (41, None), (42, ""), (43, items[6][1] + " x " + items[7][1])]
    d, b = make(spark, docs, items)
    want = brute(docs, [(i, t) for i, t in items if i is not None])
    marks = brute(docs, items)
    for block in (D.BLOCK_BYTES, 200):
        for r in D.find(d, b, block_bytes=block).collect():
            n = sum(h.word_end - h.word_start for h in r.dec_hits)
            assert (r.dec_words, n, r.dec_items) == (want[r.doc_id][0], marks[r.doc_id][1], want[r.doc_id][2])


def test_a_shard_has_one_index_for_all_blocks(spark, monkeypatch):
    source = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(str(i), " ".join(source.choices(vocabulary, k=14))) for i in range(60)]
    texts = [" ".join(source.choices(vocabulary, k=200)) + " " + items[i][1] for i in range(20)]
    blocks = [D.Phrases(items[k::5], 10) for k in range(5)]
    built = []
    init = D.FMIndex.__init__
    monkeypatch.setattr(D.FMIndex, "__init__", lambda self, *a: (built.append(1), init(self, *a))[1])
    shard = D.Shard(pa.array(texts))
    for p in blocks:
        shard.mark(p)
    shard.build()
    for p in blocks:
        shard.search(p)
    want = brute(list(enumerate(texts)), items)
    spans = shard.spans()
    got = {i: (n, sum(b - a for a, b, _, _ in spans.get(i, [])), sorted(shard.items.get(i, ()))) for i, n in enumerate(shard.counts.tolist())}
    assert built == [1] and got == want and sum(n for _, n, _ in want.values()) >= 280


def test_a_document_longer_than_a_shard(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_BYTES", 500)
    monkeypatch.setattr(D, "GROUP_BYTES", 1500)
    passage = " ".join(f"p{i}" for i in range(12))
    docs = [(1, "filler words " * 300 + passage + " more" * 200), (2, "short"), (3, passage)]
    d, b = make(spark, docs, [(1, passage), (2, "x y z"), (3, "filler")])
    want = brute(docs, [(1, passage), (2, "x y z"), (3, "filler")])
    for block in (D.BLOCK_BYTES, 100):
        for r in D.find(d, b, block_bytes=block).collect():
            assert (r.dec_words, sum(h.word_end - h.word_start for h in r.dec_hits), r.dec_items) == want[r.doc_id]


def test_settings_of_the_session_stay(spark):
    before = dict(spark.sparkContext._conf.getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    D.op10_decontaminate(spark, SF).collect()
    assert before == (dict(spark.sparkContext._conf.getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))


def test_spans_cut_the_passage(spark):
    passage = "Ä one, two three four five six seven eight nine ten"
    d, b = make(spark, [(1, f"ééé before {passage}; after")], [(1, passage)])
    h = D.find(d, b).collect()[0]
    assert [h.text[s.char_start : s.char_end] for s in h.dec_hits] == [passage]


def test_clean_keeps_columns_whatever_their_names(spark):
    d, b = make(spark, [(1, "a b c"), (2, "nothing"), (2, "nothing"), (None, None)], [(1, "b c")])
    out = D.clean(d, b)
    assert out.columns == d.columns and sorted(map(str, (r.doc_id for r in out.collect()))) == ["2", "2", "None"]
    assert {r.dec_hits for r in out.collect()} == {"x"}


def test_empty_tables(spark):
    d, b = make(spark, [(1, "a b c")], [(1, "b c")])
    assert D.clean(d, b.limit(0)).count() == 1
    assert D.clean(d.limit(0), b).count() == 0


def test_digest_of_items(spark):
    out = D.op10_decontaminate(spark, SF).filter("n_items = 0").first()
    assert out.items_sha256 == hashlib.sha256(b"").hexdigest()


def test_sql(spark):
    same(D.op10_decontaminate(spark, SF), connection(SF), D.OP10_SQL)
