"""Text functions and sound measures against plain Python."""

import math
import re
import unicodedata
import uuid

import numpy as np
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import audio

NAMES = ["Città", "Łódź", "Ősz–Nő", "İzmir", "Ｆｕｌｌ １", "", "a.b", "ÀÈÌ  òù", "naïve café", "éclair", "Straße", "ŠČŽ", "Ω mega", "x²"]


def plain_key(value):
    decomposed = unicodedata.normalize("NFKD", value)
    return re.sub("[^0-9a-z]+", " ", "".join(c for c in decomposed if not unicodedata.combining(c)).lower()).strip()


def test_folded_is_the_decomposition(spark):
    letters = [chr(c) for c in [*range(0xA0, 0xD800), *range(0xE000, 0x20000, 3), 0x1D400, 0x1F100]]
    texts = NAMES + letters + ["ﬁn", "Oﬀice ½ ㎏", "№ 5", "x²ﬂ", "𝐀𝐁c", "Ǆ"]
    got = {r.t: r.k for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.folded(F.col("t")).alias("k")).collect()}
    assert got == {t: plain_key(t) for t in texts}


def test_uuid5(spark):
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    got = {r.t: r.u for r in spark.createDataFrame([(t,) for t in NAMES], "t string").select("t", X.uuid5(ns, F.col("t")).alias("u")).collect()}
    assert got == {t: str(uuid.uuid5(uuid.UUID(ns), t)) for t in NAMES}


def test_occurrences(spark):
    cases = [("The cat, the CAT; catalogue", "cat"), ("a.b a.bc A.B", "a.b"), ("", "x"), ("x", ""), ("città Città cittàx", "CITTÀ"), ("a b a b", "a b"), (None, "a")]
    got = [r.n for r in spark.createDataFrame(cases, "t string, n string").select(X.occurrences(F.col("t"), F.col("n")).alias("n")).collect()]
    assert got == [len(re.findall(rf"(?<!\w){re.escape(n)}(?!\w)", t, re.I)) if t and n else 0 for t, n in cases]


def test_sound(spark):
    rng = np.random.default_rng(1)
    quiet, loud = 0.01 * rng.normal(size=8000), np.sin(np.arange(8000) / 9)
    burst = np.concatenate([loud * 0.1, loud * 0.1, rng.normal(size=1500)])
    rows = [(1, [float(x) for x in np.concatenate([quiet, loud])]), (2, [0.0] * 5000), (3, []), (4, [float(x) for x in burst]), (5, None), (6, [0.1] * 10)]
    got = {r.k: (r.snr_db, r.overlap) for r in audio.measures(spark.createDataFrame(rows, "k int, samples array<double>"), "k", 8000).collect()}
    x = np.concatenate([quiet, loud])
    rms = sorted(math.sqrt(sum(v * v for v in x[i : i + 200]) / 200) for i in range(0, len(x) - 199, 80))
    want = 20 * math.log10(np.mean(rms[-(len(rms) // 10) :]) / np.mean(rms[: len(rms) // 5]))
    assert abs(got[1][0] - want) < 1e-6 and got[2] == (None, 0.0) and got[3] == (None, 0.0) and got[5] == (None, 0.0) and got[6] == (None, 0.0)
    assert 0.02 < got[4][1] < 0.5
