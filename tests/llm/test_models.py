"""Licence scan and quality classifier: held-out accuracy and awkward rows."""

import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import licences as L
from colloquy.llm import quality as Q

DOCS = "doc_id long, text string, qda_score string"


@pytest.fixture(scope="module")
def model(spark):
    return L.LicenceModel(spark)


def test_families(spark, model):
    cases = {
        "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc",
        "All rights reserved.": "reserved", "SPDX-License-Identifier: BSD-3-Clause": "bsd", "Die Katze kam mit dem Hund.": "unknown", "The license plate was stolen near MIT.": "unknown", "": "unknown",
        "Licensed under the Frobnicate License, Version 2.0.": "unknown", "The apache helicopter has all rights of way.": "unknown",
    }
    got = {r.paragraph: r.lic_family for r in model.classify(spark.createDataFrame([(t,) for t in cases], "paragraph string")).collect()}
    assert got == cases


def test_notices_that_no_frame_holds(spark, model):
    cases = {
        "Licensed under the GPLv3": "gpl", "Licensed under LGPLv2.1 or later": "gpl", "GPLv2+": "gpl", "GPLv3": "gpl", "AGPL-3.0": "gpl", "This library is free software under the terms of the LGPL.": "gpl", "Code is covered by the GNU GPL v2.": "gpl",
        "Use of this source code is governed by the GNU Affero General Public License.": "gpl", "This module is available under the ISC license": "isc", "License: ISC": "isc", "This program and the accompanying materials are made available under the Eclipse Public License v2.0": "epl", "EPL-2.0": "epl",
        "Unlicense": "unlicense", "This is free and unencumbered software released into the public domain.": "unlicense", "Distributed under the Boost Software License, Version 1.0. (See accompanying file)": "boost", "// SPDX-License-Identifier: Zlib": "zlib", "See the zlib license for details": "zlib",
        "This header is in the public domain.": "public_domain", "Written by A. Author and placed in the public domain.": "public_domain", "apache2": "apache", "Mozilla Public License Version 2.0": "mpl", "The code is offered under CC-BY-SA-4.0": "cc",
        "The domain was sold at a public auction.": "unknown", "A solar eclipse got a boost from public interest, all rights and duties aside.": "unknown",
    }
    got = {r.paragraph: (r.lic_family, r.gated) for r in model.classify(spark.createDataFrame([(t,) for t in cases], "paragraph string").withColumn("gated", F.col("paragraph").rlike(L.GATE))).collect()}
    assert {t: f for t, (f, _) in got.items()} == cases
    assert all(gated for f, gated in got.values() if f != "unknown")


def test_what_is_denied_or_mentioned_is_unknown_and_licence_texts_are_known(spark, model):
    cases = {
        "This file is not licensed under the MIT License.": "unknown", "The Apache License, Version 2.0 was compared with others in this article.": "unknown", "He wrote a book about the GNU General Public License.": "unknown",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.': "mit",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
        "Sous licence MIT.": "mit", "Lizenziert unter der Apache-2.0-Lizenz.": "apache", "Publicado bajo la licencia GPLv3.": "gpl",
        "used to endorse or promote products derived from this software without specific prior written permission.": "bsd",
        "* Redistributions in binary form must reproduce the above copyright notice,": "bsd", "this list of conditions and the following disclaimer in the documentation": "unknown",  # no licence word in it
        "The Mozilla Public License is long.": "unknown", "This was formerly released under the GPL.": "unknown", "": "unknown",
    }
    got = {r.paragraph: r.lic_family for r in model.classify(spark.createDataFrame([(t,) for t in cases], "paragraph string")).collect()}
    assert got == cases
    assert model.classify(spark.createDataFrame([(None,)], "paragraph string")).first().lic_family == "unknown"


def test_probabilities_are_calibrated(model):
    """The temperature lies inside its range, and of every group of held-out examples about as many are right as was said."""
    assert 0.02 < model.temperature < 50
    for said, right, n in model.reliability():
        assert n < 15 or abs(said - right) < 0.15, (said, right, n)


def test_order_decides(spark, model):
    words = "conditions following the that provided permitted are modification without or with forms binary and source in use and Redistribution"
    assert model.classify(spark.createDataFrame([(words,)], "paragraph string")).first().lic_family == "unknown"


def plain(docs):
    """A second way to the units: paragraphs one by one. (doc, paragraph, text, line) and how many paragraphs and candidates."""
    gate = re.compile(L.GATE.replace(r"\p{L}\p{N}_", r"\w"))
    out, counts = [], {}
    for i, text in docs:
        parts = [p for p in re.split(r"\n(?:[ \t\r\f#*/;>|-]*\n)+", text or "") if p.strip()]
        candidates = [p for p in parts if gate.search(p)]
        counts[i] = len(parts), len(candidates)
        for k, p in enumerate(candidates):
            whole = re.sub(r"\r?\n[ \t]*(?:[#*/;>|-]+[ \t]*)?", " ", p).strip(" ")
            own = [(s, False) for s in re.split(r"(?<=[.;!?])\s+", whole)] + ([(whole, False)] if len(whole.split(" ")) <= 400 else [])
            own += [(s, True) for s in re.split(r"\r?\n", p)] if "\n" in p else []
            out += [(i, k, s, line) for s, line in dict.fromkeys(own) if gate.search(s)]
    return out, counts


def test_query_is_brute_force(spark, model):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    flat, counts = plain(docs)
    family = {}
    for r in model.classify(spark.createDataFrame(flat, "i long, k int, paragraph string, line boolean"), notices_only=F.col("line")).collect():
        if r.lic_families:
            family.setdefault(r.i, {}).setdefault(r.k, set()).update(r.lic_families)
    got = {r.doc_id: r for r in L.op3_licence_scan(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, (n, candidates) in counts.items():
        own = family.get(i, {})
        assert (got[i].n_paragraphs, got[i].n_candidates, got[i].n_licences, got[i].families) == (n, candidates, len(own), ",".join(sorted({f for x in own.values() for f in x})))


def wrapped(text, width=76, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_wrapped_licences_are_one(spark, model):
    mit = "MIT License\n\nCopyright (c) 2020 Foo\n\n" + "\n\n".join(wrapped(t) for t in L.TEXTS["mit"])
    gpl = wrapped(L.TEXTS["gpl"][0].replace("version 3", "version 2"), 60, " * ") + "\n *\n" + wrapped(L.TEXTS["gpl"][1], 60, " * ")
    bsd = "# " + "\n#\n# ".join(wrapped(t, 70).replace("\n", "\n# ") for t in L.TEXTS["bsd"])
    isc = "\r\n\r\n".join(wrapped(t).replace("\n", "\r\n") for t in L.TEXTS["isc"])
    boost = "\n\n".join(wrapped(t, 50) for t in L.TEXTS["boost"])
    rows = [(1, mit, ""), (2, gpl, ""), (3, bsd, ""), (4, isc, ""), (5, boost, "")]
    got = {r.doc_id: (r.families, r.n_paragraphs, r.n_licences) for r in L.scan(spark.createDataFrame(rows, DOCS), model).collect()}
    assert {i: f for i, (f, _, _) in got.items()} == {1: ["mit"], 2: ["gpl"], 3: ["bsd"], 4: ["isc"], 5: ["boost"]}
    assert got[1][1:] == (5, 4) and got[2][1] == 2 and got[2][2] <= 2


def test_names_before_licensed_lists_and_denials(spark, model):
    cases = {
        "(c) 2020 Foo, MIT licensed": ["mit"], "MIT-licensed code": ["mit"], "Apache 2.0 licensed": ["apache"], "Code is BSD licensed.": ["bsd"], "This library is dual-licensed under MIT and Apache-2.0.": ["apache", "mit"],
        "Available under the GPL, the MPL 2.0 or the MIT license.": ["gpl", "mit", "mpl"], "The team plays under the BSD banner": [], "He sailed under the zlib flag": [], "You cannot use this under the Apache License": [], "We considered releasing it under the GPL": [],
        "You can't use this software under the MIT License.": [], "They don't release it under the GPL.": [], "This code isn't BSD licensed.": [], "Use this software under the MIT License.": ["mit"],
    }
    got = {r.paragraph: r.lic_families for r in model.classify(spark.createDataFrame([(t,) for t in cases], "paragraph string")).collect()}
    assert got == cases


def test_examples_are_held_out_by_source(model):
    gate = re.compile(L.GATE.replace(r"\p{L}\p{N}_", r"\w"))
    held = {s for _, _, s in L.examples() if s and zlib.crc32(s.encode()) % 5 == 0}
    assert any(f in held for f in L.FRAMES) and any(f in held for f in L.MENTIONS)
    assert len(model.unseen) == sum(s in held and gate.search(t) is not None for _, t, s in L.examples())
    right = [max(range(len(z)), key=z.__getitem__) == label for z, label in model.unseen]
    print("unseen", len(right), np.mean(right))
    assert np.mean(right) > 0.6  # of the classifier alone; templates confirm or refuse what it says


def test_scan_rows(spark, model):
    text = "First line.\n\nReleased under the MIT License.\n \nAll rights reserved."
    rows = [(1, text, "a"), (1, text, "a"), (2, None, None), (3, "", None), (None, "x\ny", None), (4, "word " * 50_000 + "\nAll rights reserved.", None)]
    got = sorted((str(r.doc_id), r.n_paragraphs, r.n_licences, ",".join(r.families)) for r in L.scan(spark.createDataFrame(rows, DOCS), model).collect())
    assert got == [("1", 3, 2, "mit,reserved"), ("1", 3, 2, "mit,reserved"), ("2", 0, 0, ""), ("3", 0, 0, ""), ("4", 1, 1, "reserved"), ("None", 1, 0, "")]
    assert L.scan(spark.createDataFrame([], DOCS), model).count() == 0
    long = "All rights reserved. " + "license word " * 30_000  # a long candidate, and names that clash
    odd = spark.createDataFrame([(1, long, "x", "y", 3)], "doc_id long, text string, families string, paragraph string, n int")
    assert L.scan(odd, model).select("n_paragraphs", "n_candidates").collect() == [(1, 1)]


def test_statistics_are_plain_counts():
    x = dict(zip(Q.STATISTICS, Q.statistics(pa.array(["Ab, ab ab 12!\né"]))[0], strict=True))
    assert np.isclose(np.expm1(x["chars"]), 15) and np.isclose(np.expm1(x["words"]), 5)
    assert np.isclose(x["same_as_last"] ** 2, 1 / 5) and np.isclose(x["upper"] ** 2, 1 / 16) and np.isclose(x["lines"] ** 2, 1 / 5)
    assert Q.statistics(pa.array([None, ""])).shape == (2, len(Q.STATISTICS))


def good(i):
    source = np.random.default_rng(i)
    return " ".join(source.choice(["the", "river", "ran", "down", "a", "hill", "and", "over", "stones"], 80)) + "."


def corpus(spark, n=200):
    rows = [(i, good(i) if i % 4 else "BUY!! NOW!! $$$ " * 20, "x") for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(n)] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    return spark.createDataFrame(rows + [(None, None, None), (n, "", None)], DOCS), labels


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(spark)
    trained, stats = Q.train(docs, labels)
    out = Q.with_score(stats, trained, "qda_x").filter(Q.held_out(F.col("doc_id"))).filter("doc_id < 200").collect()
    assert out and all((r.qda_score >= Q.THRESHOLD) == (r.doc_id % 4 > 0) for r in out)


def test_keep_good_keeps_columns(spark):
    docs, labels = corpus(spark)
    out = Q.keep_good(docs, labels)
    assert out.columns == docs.columns and {r.qda_score for r in out.collect()} <= {"x", None}
    assert sum(r.doc_id is not None and r.doc_id < 200 for r in out.collect()) == 150


def test_without_labels_nothing_is_known(spark):
    docs, labels = corpus(spark, 20)
    for known, score in ((labels.limit(0), 0.5), (labels.filter("quality = 1 AND doc_id > 1"), 1.0)):
        trained, stats = Q.train(docs, known)
        assert {r.qda_score for r in Q.with_score(stats, trained, "qda_x").collect()} == {score}
    assert Q.keep_good(docs.limit(0), labels).count() == 0


def test_query_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.95
