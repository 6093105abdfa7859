import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pyarrow.parquet
from pyspark.sql import functions as F

from colloquy.llm import resampling as R

LOWER = str.maketrans(R.UPPER, R.LOWER)


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(docs, target, least=20, percent=25, buckets=10_000, seed=7):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])
    s, t = count(x for _, x in docs), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out, fit = [], []
    for i, text in docs:
        words, own = features(text)
        weight = math.floor(sum(gain[zlib.crc32(f.encode()) % buckets] for f in own) / len(own)) if own else 0
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None])
        if len(words) >= least:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def collected(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, df.collect()), key=repr)


def read(sf, name, *columns):
    t = pyarrow.parquet.read_table(f"{sf}/{name}.parquet", columns=list(columns))
    return list(zip(*(t.column(c).to_pylist() for c in columns)))


def test_query_equals_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    assert collected(R.op11_resampling(spark, sf)) == plain(read(sf, "documents", "doc_id", "text"), [t for t, in read(sf, "benchmark", "text")])


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "RUN_BYTES", 3000)
    monkeypatch.setattr(R, "PIECE_CHARS", 500)
    source = random.Random(8)
    words = ["Ähre", "the", "The", "x1", "日本", "ß", "a" * 700, "B"]
    text = lambda k: "".join(source.choice(words) + source.choice([" ", ", ", "\n", "--"]) for _ in range(k))
    docs = [(i, text(source.randint(0, 40))) for i in range(150)] + [(200, text(3000)), (201, None), (202, ""), (203, " ,.!"), (None, text(30)), (204, "w" * 2000), (5, text(25)), (5, "same " * 30), (205, "same " * 30)]
    target = [text(20) for _ in range(10)] + [None, ""]
    a = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, buckets int, of_task int, rank int").repartition(3)
    b = spark.createDataFrame([(t, 1) for t in target], "text string, item_id int")
    assert collected(R.resample(a, b)) == plain(docs, target)
    assert collected(R.resample(a, b.limit(0))) == plain(docs, [])
    assert R.resample(a.limit(0), b).count() == 0


def test_pieces_lose_no_word_and_no_pair():
    source = random.Random(9)
    for _ in range(300):
        text = "".join(source.choices("ab  ,é", k=source.randint(0, 200)))
        counter, most = Counter(), source.randint(1, 20)
        for piece, again in R.pieces(text, most):
            words, own = features(piece)
            counter.update(own)
            counter.subtract(words[:1] if again else [])
        assert +counter == Counter(features(text)[1])


def test_a_hot_score_ranks_every_row(spark):
    docs = spark.range(600).select(F.lit(3).cast("long").alias("doc_id"), F.lit("one two three four five " * 5).alias("text"))
    ranks = sorted(r.rank for r in R.resample(docs, docs).collect() if r.rank)
    assert ranks == list(range(1, 151))
