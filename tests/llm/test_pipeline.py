"""run() against its stages done one by one in plain Python."""

import re

import corpus_pipeline
from colloquy.llm import packing, quality
from colloquy.llm.encoders import Encoder
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_dedup import brute as copies

SF = "/root/testdata/sf0.001"


def test_run_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model, stats = quality.train(docs, labels)
    good = {r.doc_id for r in quality.with_score(stats, model, "qda_x").filter("qda_score >= 0.3").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    last = {}
    for i, t in rows:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        last[key] = max(i, last.get(key, i))
    rows = [(i, t) for i, t in rows if i in last.values()]
    near = copies(rows)
    rows = [(i, t) for i, t in rows if near[i][2]]
    found = leaks(rows, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    rows = [(i, t) for i, t in rows if not found[i][1]]
    out = corpus_pipeline.run(spark, SF).toPandas()
    encode = Encoder()
    assert out.groupby("doc_id")["length"].sum().to_dict() == {i: len(encode(t or "")) + 1 for i, t in rows}
    own = out.sort_values(["sequence_id", "offset"])
    assert (own.groupby("sequence_id")["length"].cumsum() - own["length"] == own["offset"]).all() and out.groupby("sequence_id")["length"].sum().max() <= 1024


def test_stages_keep_the_columns_whatever_they_are(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'x' AS kept", "1 AS component_id", "2 AS row", "3 AS dec_hits", "4 AS qda_score")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, empty):
            out = stage(spark, d, SF)
            assert out.columns == docs.columns and out.filter("kept <> 'x' OR dec_hits <> 3").count() == 0
