import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import packing as P
from colloquy.llm.encoders import RUN, Encoder, has_long_run


def plain_plan(lengths, window):
    """Best-fit decreasing, one piece at a time."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(c, i) for i, c in enumerate(left) if c >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(window - n)
    return sorted(left)


def test_the_plan_is_best_fit_decreasing():
    source = random.Random(2)
    for _ in range(50):
        lengths = [source.randint(1, 32) for _ in range(source.randint(0, 80))]
        steps = P.plan({n: lengths.count(n) for n in set(lengths)}, 32)
        used = {}
        for length, _, n, first, offset in steps:
            for s in range(first, first + n):
                assert used.get(s, 0) == offset
                used[s] = offset + length
        assert sorted(32 - u for u in used.values()) == plain_plan(lengths, 32)
        assert sorted(used) == list(range(len(used)))


def test_the_tree_finds_the_tightest():
    source = random.Random(1)
    tree, open_ = P.Capacities(100), []
    for _ in range(2000):
        c = source.randint(0, 100)
        if c in open_ and source.random() < 0.6:
            open_.remove(c)
            tree.add(c, -1)
        else:
            open_.append(c)
            tree.add(c, 1)
        least = source.randint(1, 100)
        assert tree.tightest(least) == min((x for x in open_ if x >= least), default=None)


def test_both_libraries_give_the_same_ids():
    source, encode = random.Random(7), Encoder()
    letters = [chr(c) for c in range(0x250)] + list("‐–—‘’“”…€日本 🙂") + [" ", "a", "<|endoftext|>", "'s", "12", "\n"] * 30
    for _ in range(3000):
        text = "".join(source.choices(letters, k=source.randint(0, 40)))
        assert encode(text) == encode.exact.encode(text, add_special_tokens=False).ids


def test_pieces_cover_every_document(spark):
    rows = [(i, "ab cd " * (i * 37 % 900)) for i in range(40)] + [(5, "again"), (5, "again"), (None, None), (41, ""), (42, "long " * 30_000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, length int").repartition(3)
    out = P.pack(docs).toPandas()
    encode = Encoder()
    assert out["length"].max() <= P.WINDOW
    own = out.sort_values(["sequence_id", "offset"])
    assert (own.groupby("sequence_id")["length"].cumsum() - own["length"] == own["offset"]).all()
    ids = np.array([*encode("long " * 30_000), P.END], "<u4")
    for r in out[out.doc_id == 42].itertuples():
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
    assert out["length"].sum() == sum(len(encode(t or "")) + 1 for _, t in rows)
    assert len(out[out.doc_id == 5]) == 3 and out.doc_id.isna().sum() == 1
    padding = 1 - out["length"].sum() / (P.WINDOW * out["sequence_id"].nunique())
    assert padding < 0.05


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_length(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same words here").alias("text"))
    out = P.pack(docs).toPandas()
    assert out.groupby("sequence_id")["length"].sum().max() <= P.WINDOW and len(out) == 500


LONG = [" " * 1_100_000, "\t" * 1_100_000, " \n" * 550_000, "a" * 300_000, "word " * 50_000 + " " * 100_000 + "x", "!?" * 100_000, ("Latin, with ü. " * 40_000), "<|endoftext|>" * 1000]


def test_both_libraries_give_the_same_ids_of_long_texts():
    encode = Encoder()
    for text in LONG:
        assert encode(text) == encode.exact.encode(text, add_special_tokens=False).ids


def test_long_runs_are_seen():
    n = RUN
    long = [" " * n, "a" * n, "a b " + "\n " * (n // 2), "x" + " \t" * n + "y", "a b" + "c" * n + " d"]
    short = ["", " ", " " * (n - 1), "a" * (n - 1), ("a" * (n - 1) + " ") * 3, ("a" + " " * (n - 1)) * 3, "a b c " * n, "  a" * n]
    assert all(map(has_long_run, long)) and not any(map(has_long_run, short))


def test_a_failure_of_the_fast_library_is_no_failure():
    encode = Encoder()

    class Broken:
        def encode(self, *_, **__):
            raise ValueError("Regex error while tokenizing")

    encode.fast = Broken()
    assert encode("a text") == encode.exact.encode("a text", add_special_tokens=False).ids


def test_two_megabytes_of_white_space_are_packed(spark):
    texts = [" " * 2_000_000, "\t" * 2_000_000, " \n" * 1_000_000, "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    out = P.pack(docs).toPandas()
    encode = Encoder()
    for i, text in enumerate(texts):
        ids = np.array([*encode.exact.encode(text, add_special_tokens=False).ids, P.END], "<u4")
        own = out[out.doc_id == i].sort_values("start")
        assert own["length"].sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own.itertuples()] == own.ids_crc32.tolist()
