import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow.parquet
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from colloquy.llm import bpe as B


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(B.TOKENIZER))


@pytest.fixture(scope="module")
def own():
    return B.Bpe()


def test_words_of_every_character():
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for around in "a1! \n":
        every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        for k in range(0, len(every), 50_000):
            text = around + around.join(every[k : k + 50_000]) + around
            at = [(a, b) for _, (a, b) in split.pre_tokenize_str(text)]
            assert [text[a:b] for a, b in at] == B.words(text)


def test_ids_equal_the_library(own, library):
    source = random.Random(4)
    letters = [chr(c) for c in range(0x250)] + list("‐–—‘’“”…€日本語 🙂́ \x85\x1c") + [" ", "a", "th", "ing", "<|endoftext|>", "<|endof", "'s", "'ll", "'", "12", "\n", "\t", "  "] * 30
    for _ in range(3000):
        text = "".join(source.choices(letters, k=source.randint(0, 60)))
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids.tolist()) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_plain_merging(own):
    """Against merging the leftmost pair of least rank, step by step."""
    source = random.Random(5)
    for _ in range(400):
        word = "".join(source.choices("aeinorst ", k=source.randint(1, 30))).encode()
        ids = [own.symbol[b] for b in word]
        while found := min(((own.rank[a << 20 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 20 | b in own.rank), default=None):
            i = found[1]
            ids[i : i + 2] = [own.made[found[0]]]
        assert own.merged(word) == ids


def test_decoding_of_broken_bytes(own, library):
    source = random.Random(6)
    for _ in range(500):
        ids = source.choices(range(60_000), k=source.randint(0, 20))
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [" " * 400_000, "\t" * 300_000, " \n" * 200_000, "a" * 300_000, "ab" * 150_000, "!?" * 150_000, "日本" * 60_000, "word " * 100_000, "x" + " " * 200_000 + "y"])
def test_very_long_runs(own, library, text):
    ids = own.encode(text)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids.tolist()) == text


def test_special_strings_as_plain_text(library):
    own = B.Bpe(specials=False)
    library.encode_special_tokens = True
    text = "a <|endoftext|> b<|endoftext|>"
    try:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    finally:
        library.encode_special_tokens = False


def test_the_number_of_kept_words_is_bounded(monkeypatch):
    monkeypatch.setattr(B, "KEPT_WORDS", 10)
    own = B.Bpe()
    text = " ".join(f"w{i % 37}x" for i in range(500))
    assert own.decode(own.encode(text).tolist()) == text and len(own._known) <= 10


def test_operator(spark, library):
    rows = [(1, "Hello, world's 12 <|endoftext|> end", 7), (1, "Hello, world's 12 <|endoftext|> end", 7), (None, None, 8), (2, "", 9), (3, "é" * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bpe_ids int").repartition(2)
    out = B.decode(B.encode(docs)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted((i or 0, t or "") for i, t, _ in rows)
    for r in out:
        assert r.bpe_ids == library.encode(r.text or "", add_special_tokens=False).ids and r.bpe_text == (r.text or "")
    assert B.encode(docs.limit(0)).count() == 0 and B.decode(B.encode(docs).selectExpr("cast(null as array<int>) bpe_ids", "'own' bpe_text", "doc_id")).select("bpe_text").distinct().collect()[0][0] is None


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in B.op13_bpe(spark, sf).collect()}
    rows = pyarrow.parquet.read_table(f"{sf}/documents.parquet").to_pylist()
    assert len(out) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        got = out[r["doc_id"]]
        assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(text.encode()).hexdigest())
