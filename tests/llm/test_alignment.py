import random
from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers
import pyarrow.parquet
import pytest
import sentencepiece
from tokenizers import Tokenizer

from colloquy.llm import alignment as A
from colloquy.llm.bpe import byte_of


@pytest.fixture(scope="module")
def plain():
    """Rows of (doc_id, text) the slow way: every pair of occurrences is looked at."""
    left = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = byte_of()

    def piece(i):
        p = right.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode()

    def spans(ids, name):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(name(i)), i))
            at = out[-1][1]
        return out

    def run(rows):
        made, documents = [], Counter()
        for doc, text in rows:
            a, b, target = [], [], b" " + (text or "").encode()
            if text:
                token = lambda i: bytes(byte[c] for c in left.id_to_token(i))
                a, b = spans(left.encode(" " + text, add_special_tokens=False).ids, token), spans(right.encode(text), piece)
                if b"".join(token(i) for _, _, i in a) != target or b"".join(piece(i) for _, _, i in b) != target:
                    a, b = [], []
            links = [(x, y) for s, e, x in a for t, f, y in b if s < f and t < e]
            documents.update(set(links))
            ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
            groups, start = [], 0
            for end in ends:
                own = lambda side: ",".join(str(i) for s, e, i in side if start <= s and e <= end)  # noqa: B023, E731
                groups.append(f"{own(a)}|{own(b)}")
                start = end
            made.append((doc, len(a), len(b), len(ends), links, sha256(";".join(groups).encode()).hexdigest() if a else ""))
        highest = defaultdict(int)
        for (x, _), n in documents.items():
            highest[x] = max(highest[x], n)
        return sorted(((d, na, nb, ng, len(links), sum(documents[p] == highest[p[0]] for p in links), sum(documents[p] for p in links), h) for d, na, nb, ng, links, h in made), key=repr)

    return run


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def collected(df, last):
    assert df.columns == [*COLUMNS, last]
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_a_plain_version(spark, plain):
    sf = "/root/testdata/sf0.001"
    t = pyarrow.parquet.read_table(f"{sf}/documents.parquet").to_pylist()
    short = [(r["doc_id"], r["text"]) for r in t if len(r["text"] or "") < 3000]
    rows = spark.createDataFrame(short, "doc_id long, text string").repartition(4)
    assert collected(A.align(rows, hashed=True), "groups") == plain(short)
    out = A.op12_alignment(spark, sf)
    assert {r.doc_id for r in out.collect()} == {r["doc_id"] for r in t} and out.columns == [*COLUMNS, "groups_sha256"]


def test_awkward_rows_in_small_slices_with_hot_ids(spark, plain, monkeypatch):
    monkeypatch.setattr(A, "SLICE_BYTES", 300)
    monkeypatch.setattr(A, "HELD", 50)
    source = random.Random(3)
    words = ["the", "The cat", "naïve", "日本語", "\n", "  ", "\t", "é́", "🙂", "<|endoftext|>", "<s>", "12345", "x" * 40, "''s"]
    rows = [(i, " ".join(source.choices(words, k=source.randint(0, 12)))) for i in range(120)]
    rows += [(300, None), (301, ""), (302, " "), (303, "a▁b"), (None, "the cat"), (304, "the cat " * 60), (5, "again"), (5, "again"), (305, "\x00\x01"), (306, " lead")]
    docs = spark.createDataFrame([(i, t, 1, "q", 2) for i, t in rows], "doc_id long, text string, a int, doc string, slice int").repartition(3)
    for hot in (A.HOT, 7):
        assert collected(A.align(docs, hashed=True, hot=hot), "groups") == plain(rows)
    assert A.align(docs.limit(0)).count() == 0


def test_groups_as_text(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r.groups for r in A.align(docs).collect()}
    assert out[2] == "" and all(len(g.split("|")) == 2 for g in out[1].split(";"))


@pytest.mark.parametrize("text", [" " * 300_000, "a" * 200_000, "\n" * 200_000, "the cat " * 50_000])
def test_very_long_texts_keep_their_bytes(text):
    pair = A.loaded(None, None, None)
    a, b = pair.encode(text)
    own = A.Alignment(pair, [a], [b])
    _, left, _ = own.links()
    assert len(own.a) and own.end_a[-1] == own.end_b[-1] == len(text.encode()) + 1
    assert len(left) == len(own.a) + len(own.b) - len(own.common)
    assert own.groups()[0].count(b";") == len(own.common) - 1 == own.n_groups()[0] - 1


def test_a_hot_id_is_dealt_to_several_tasks(spark):
    docs = spark.createDataFrame([(i, "the the") for i in range(400)], "doc_id long, text string").repartition(8)
    out = A.align(docs, hot=50)
    assert {(r.n_best, r.count_sum) for r in out.collect()} == {(2, 800)}
    plan = out._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
