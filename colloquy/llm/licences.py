"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph ends at a blank line; its wrapped lines are joined and comment marks at
their beginnings go. A candidate is a paragraph that holds a licence word; all others
are unknown. Of a candidate its sentences, its lines and, if it is short, the whole
are classified by a sparse multinomial logistic regression over word n-grams. It is
trained on the paragraphs of whole licence texts, on pieces of them, on notices made
of names and frames, and on text of the unknown class: talk that only sounds like a
licence, licences that are mentioned or denied. Probabilities are calibrated by a
temperature, found by a line search against smoothed targets on held-out examples;
accuracy is told on those of frames and paragraphs that no training example came from.

A family counts if its probability is high enough and a template confirms it, in
order. Either the likeliest family has a licence text of which a paragraph shares runs
of three words with the candidate: most of the template's, or most of the candidate's.
Or a sentence is a notice: a granting phrase, words that may stand between, and a name
of the family, a name that is followed by "licensed", or the name alone, without a
negation before it. A paragraph may name several families: where the unknown class
is unlikely, each that a notice names.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import let, lower_ascii, stash, table

UNKNOWN = "unknown"
#: Names and identifiers of each family; V stands for a version.
FAMILIES = {
    "apache": ["Apache License, Version V", "Apache-V", "Apache Software License", "Apache Public License V", "Apache License", "Apache V"],
    "boost": ["Boost Software License, Version V", "Boost Software License", "BSL-V", "Boost License"],
    "bsd": ["BSD License", "BSD-3-Clause", "BSD 2-Clause License", "modified BSD License", "3-clause BSD License", "0BSD", "BSD"],
    "cc": ["CC BY V", "CC BY-NC V", "CC BY-SA V", "CC BY-NC-ND V", "CC BY-NC-SA V", "Creative Commons Attribution V License", "Creative Commons Attribution-NonCommercial V International License", "CC0 V", "CC0", "CC BY", "CC BY-NC", "CC BY-SA", "CC BY-NC-ND", "Creative Commons Attribution License", "Creative Commons Attribution V International License", "Creative Commons Attribution-ShareAlike V International License", "Creative Commons Zero"],
    "epl": ["Eclipse Public License, version V", "Eclipse Public License vV", "Eclipse Public License", "EPL-V", "EPL V", "EPL"],
    "gpl": ["GNU General Public License, version V", "GNU GPL vV", "GPL-V", "GNU Lesser General Public License, version V", "LGPL-V", "GNU Affero General Public License V", "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License", "AGPL-V", "GPLvV", "LGPLvV", "AGPLvV", "GNU LGPL vV", "GNU AGPL vV", "GPL", "LGPL", "AGPL", "GNU GPL"],
    "isc": ["ISC License", "ISC"],
    "mit": ["MIT License", "MIT", "Expat License", "X11 License", "MIT-style license"],
    "mpl": ["Mozilla Public License, version V", "MPL-V", "MPL V", "MPLvV", "Mozilla Public License", "Mozilla Public License Version V", "MPL"],
    "public_domain": ["Public Domain"],
    "unlicense": ["Unlicense", "Unlicense License"],
    "zlib": ["zlib License", "zlib/libpng License", "zlib"],
}
FRAMES = [
    "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This project is licensed under the terms of the {}.",
    "Distributed under the {}; see the file LICENSE for details.", "SPDX-License-Identifier: {}", "This program is free software: you can redistribute it and/or modify it under the terms of the {}.", "License: {}", "{}",
    "Copyright the authors. Available under the {}.", "You may not use this file except in compliance with the {}.", "Use of this source code is governed by the {}.", "See the {} for details.", "Dual licensed under the {} and another one.",
    "{} licensed.", "Copyright 2020 the authors, {} licensed.", "The code is {} licensed.", "{}-licensed code.", "Dual-licensed under {} and a commercial license.", "Use it under the terms of the {} or not at all.",
    "Sous licence {}.", "Distribué sous les termes de la licence {}.", "Veröffentlicht unter der Lizenz {}.", "Lizenziert unter der {}-Lizenz.", "Publicado bajo la licencia {}.",
]
#: Frames that name a licence and grant nothing.
MENTIONS = [
    "This file is not licensed under the {}.", "The {} was compared with others in this article.", "This library was never released under the {}.", "Lawyers have written much about the {}.", "It is no longer available under the {}.",
    "The history of the {} is the subject of the second chapter.", "Unlike the {}, other licences ask for more.", "We did not choose the {} because of its clauses.", "In a survey the {} was named by a third of all projects.", "Ce fichier n'est pas sous licence {}.",
    "You cannot use this file under the {}.", "We considered releasing it under the {}.", "They don't distribute it under the {}.", "The team plays under the {} banner.", "He sailed under the {} flag.", "She talked about the {} for an hour.", "It can't be relicensed under the {}.",
]
#: Whole licence texts and notices, as the licences have them, one paragraph each; fixed values.
TEXTS = {
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "apache": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "You must give any other recipients of the Work or Derivative Works a copy of this License; and You must cause any modified files to carry prominent notices stating that You changed the files.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ],
    "boost": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0",
    ],
    "cc": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit https://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ],
}
#: Short statements of families without a licence text, and how sentences with them are told: phrases that confirm the family.
STATEMENTS = {
    "public_domain": ["This work is in the public domain.", "Released into the public domain.", "Placed in the public domain by the author.", "I hereby place this file in the public domain.", "The author dedicates this work to the public domain.", "This code has been put into the public domain.", "Public domain; no rights reserved.", "Public domain.", "Written by the author and placed in the public domain."],
    "unlicense": ["This software is free and unencumbered and is released into the public domain.", "Free and unencumbered software."],
    "reserved": ["All rights reserved.", "Copyright 2.0. All rights reserved.", "No part of this publication may be reproduced without written permission; all rights reserved.", "All rights reserved by the publisher.", "Copyright (c) the authors, all rights reserved."],
}
PHRASES = {"public_domain": ["in the public domain", "into the public domain", "to the public domain"], "unlicense": ["free and unencumbered"], "reserved": ["all rights reserved"], "cc": ["waived all copyright and related or neighboring rights"]}
#: Sentences that hold licence words and grant nothing.
NEAR_MISSES = [
    "She lost her driving license on the way home.", "The restaurant applied for a liquor license.", "The apache helicopter landed at noon.", "He studied at MIT for four years.", "The warranty of the washing machine expired.",
    "Permission to land was denied.", "All seats are reserved.", "All rights and duties of members are listed below.", "The mozilla foundation met in spring.", "The license plate was stolen.", "Copyright law is taught in the second term.",
    "Their permission was asked and the table was reserved.", "A poetic license was taken with the facts.", "The gnu is an antelope of the plains.", "The version of events differs.", "He was released under bail.", "It is distributed in the north of the country.",
    "The domain of the king was public land.", "The boost to trade was distributed evenly.", "An eclipse was seen under a clear sky.", "The licence fee pays for public radio.", "The creative part of the team has a cc on every letter.",
]
#: Words of which a feature must hold one.
ANCHORS = [
    "licence", "licensed", "license", "licenses", "licences", "lizenz", "lizenziert", "licencia", "copyright", "permission", "warranty", "warranties", "redistribution", "redistributions", "redistribute", "rights", "reserved", "apache", "bsd", "gnu", "gpl", "lgpl", "mozilla", "mpl", "cc", "cc0", "creative", "spdx", "expat", "x11", "affero", "agpl", "isc", "epl", "bsl", "zlib", "unlicense", "unencumbered", "0bsd", "liable", "misrepresented", "sublicense",
]
#: Words that tell a grant from a mention or a denial; features of a candidate hold one of these or of ANCHORS.
CONTEXT = ["under", "released", "available", "distributed", "see", "sous", "unter", "bajo", "not", "never", "no", "longer", "unlike", "formerly", "compared", "survey", "history", "about", "choose", "pas", "is", "was"]
#: In capitals only, as the word is a common one in other languages.
CAPITAL = "MIT"
#: Names that a version follows without a space: GPLv3, Apache2.
GLUED = "agpl|lgpl|gpl|mpl|epl|bsl|apache|bsd"
GATE = r"(?<![A-Za-z0-9])((?i:" + "|".join(ANCHORS) + rf"|(?:{GLUED})v?[0-9]+|public[^\p{{L}}\p{{N}}_\n]+domain)|{CAPITAL})(?![A-Za-z0-9])"
THRESHOLD, COVER, LEAST_RUNS = 0.5, 0.7, 6
#: Ends of paragraphs: blank lines and lines of comment marks; how a wrapped line begins; words of a paragraph that is also taken as a whole.
PARAGRAPH, WRAPPED, SHORT = r"\n(?:[ \t\r\f#*/;>|-]*\n)+", r"[\r]?\n[ \t]*(?:[#*/;>|-]+[ \t]*)?", 400
#: Of a notice: what grants if the sentence also speaks of what is granted, what grants by itself, what may stand between that and the name, what may follow a name that stands alone, what denies.
WEAK = "under|see|sous|unter|bajo"
GRANT = "identifier|license|licence|licencia|lizenz|licensed|covered|governed|compliance|published"
BETWEEN = "or|the|a|an|terms|of|and|conditions|either|both|gnu|by|with|le|la|les|termes|der|die|dem|des|de|du|los|las|el|standard|simplified|new|license|licence|licencia|lizenz|is"
ALONE = "or|any|later|version|only|license|licence|lizenz|0|v|plus|the"
DENIED = "not|never|nor|neither|without|no|longer|formerly|previously|unlike|isn|wasn|aren|cannot|can t|don t|doesn t|didn t|won t|couldn t|shouldn t|consider|considered|considering|refused|declined|pas|nicht|nunca"
SPEAKS = "licen[cs]e[sd]?|licensing|relicensed|lizenz|lizenziert|licencia|release|released|releases|releasing|distribute|distributed|redistribute|redistributed|available|published|code|terms|termes|software|covered|governed|offered|provided|copyright|use|used|usable|library|program|package|module|header|project|file|files|work|source|sources|dual"
SENTENCE = r"(?<=[.;!?])\s+"


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits; runs of digits and dots become 0, CAPITAL gets a sign.

    A version is a word of its own: GPLv3 is gpl v 0, v2.0 is v 0.
    """
    marked = F.regexp_replace(text, rf"(?<![A-Za-z0-9]){CAPITAL}(?![A-Za-z0-9])", CAPITAL + "_")
    apart = F.regexp_replace(lower_ascii(marked), rf"(?<![a-z0-9])({GLUED})?(v?)(?<=[a-z])(?=[0-9])", "$1 $2 ")
    plain = F.regexp_replace(apart, r"[0-9]+(\.[0-9]+)*", "0")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def _runs(w: Column, n: int, kept=None) -> Column:
    """The runs of n words; kept says of a start (from 1) whether it counts."""
    last = F.size(w) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(starts, kept) if kept else starts, lambda i: F.array_join(F.slice(w, i, n), " "))


def grams(words: Column) -> Column:
    """The runs of one to three words with a licence word in them, and those of two or three with a word of CONTEXT."""
    anchors = F.array(*[F.lit(a) for a in [*ANCHORS, "x0", "domain", CAPITAL.lower() + "_"]])
    near = F.concat(anchors, F.array(*[F.lit(c) for c in CONTEXT]))
    of = lambda w, n: _runs(w, n, lambda i: F.arrays_overlap(F.slice(w, i, n), near if n > 1 else anchors))
    return let(words, lambda w: F.concat(of(w, 1), of(w, 2), of(w, 3)))


def examples() -> list[tuple[str, str, str]]:
    """(family, paragraph, source): notices from frames and names, paragraphs of licence texts and pieces of twelve words of them, and what is unknown. The source is what a row was made from, a frame or a paragraph."""
    named = [(f, n) for f, names in FAMILIES.items() for n in map(_versioned, names)]
    out = [(f, frame.format(n), frame) for f, n in named for frame in FRAMES]
    out += [(UNKNOWN, frame.format(n), frame) for _, n in named for frame in MENTIONS]
    for family, texts in [*TEXTS.items(), *STATEMENTS.items()]:
        for t in texts:
            w = t.split()
            # a paragraph is alone with its words: only its pieces can be held out
            out += [(family, t, "")] * 3 + [(family, " ".join(w[i : i + 12]), f"{t} {i % 3}" if i else "") for i in range(0, max(1, len(w) - 6), 4)]
    out += [(UNKNOWN, f"{a} {b}", a) for a in NEAR_MISSES for b in NEAR_MISSES]
    return sorted(out)


def _versioned(name: str) -> str:
    return name.replace("vV", "v2.0").replace("-V", "-2.0").replace(" V ", " 2.0 ") if not name.endswith(" V") else name[:-1] + "2.0"


class LicenceModel:
    """Fitted on ``examples`` (a few thousand rows, made by rule). A fifth of their sources, with all that was made from them, is kept apart to tell accuracy on (``unseen``); of the rest a fifth of the rows is held out for the temperature."""

    def __init__(self, spark: SparkSession, rows: list[tuple[str, str, str]] | None = None):
        rows = rows or examples()
        self.families = sorted({f for f, _, _ in rows})
        number = {f: i for i, f in enumerate(self.families)}
        data = spark.createDataFrame([(i, source, number[f], t) for i, (f, t, source) in enumerate(rows)], "i int, source string, label int, text string").filter(F.col("text").rlike(GATE))  # the classifier never sees others
        data = data.withColumn("unseen", (F.col("source") != "") & (F.pmod(F.crc32("source"), F.lit(5)) == 0)).withColumn("held", F.pmod(F.crc32(F.col("i").cast("string")), F.lit(5)) == 0).withColumn("grams", grams(words_of(F.col("text")))).coalesce(2).cache()
        # the vocabulary is that of the examples, far below the bound
        self.vectors = CountVectorizer(inputCol="grams", outputCol="counts", binary=True, minDF=2, vocabSize=1 << 20).fit(data)
        counts = self.vectors.transform(data).select("label", "held", "unseen", "counts").cache()
        self.model = LogisticRegression(featuresCol="counts", labelCol="label", family="multinomial", regParam=0.0005, maxIter=30).fit(counts.filter("NOT held AND NOT unseen"))
        scored = self.model.transform(counts.filter("held OR unseen")).select("label", "unseen", vector_to_array("rawPrediction").alias("z")).collect()  # some of the examples
        self.held = [(list(r.z), r.label) for r in scored if not r.unseen]
        self.unseen = [(list(r.z), r.label) for r in scored if r.unseen]
        self.temperature = _temperature(self.held)
        self.notices = self._notices(spark)
        flat = [(f, t) for f, texts in TEXTS.items() for t in texts]
        runs = spark.createDataFrame(flat, "f string, t string").select("f", F.array_distinct(let(words_of(F.col("t")), lambda w: _runs(w, 3))).alias("runs")).collect()
        self.templates = {f: [list(r.runs) for r in runs if r.f == f] for f in TEXTS}
        counts.unpersist()
        data.unpersist()

    def _notices(self, spark: SparkSession) -> dict[str, tuple[str, str, str]]:
        """Patterns of each family over the words of a sentence: what names it, what confirms it without a name if it is the likeliest, and what denies it."""
        flat = [(f, n) for f, names in FAMILIES.items() for n in map(_versioned, names)]
        names = spark.createDataFrame(flat, "f string, n string").select("f", F.array_join(words_of(F.col("n")), " ").alias("n")).collect()  # as many as FAMILIES has
        every = "|".join(sorted({r.n for r in names}, key=lambda n: (-len(n), n)))
        # other names may stand between, as in a list; what is taken once isn't read another way
        between = rf"(?: (?>(?:{every}|{BETWEEN})(?= |$)))*"
        out = {}
        for family in self.families:
            own = sorted({r.n for r in names if r.f == family}, key=lambda n: (-len(n), n))
            phrases = rf"(?<![^ ])(?:{'|'.join(PHRASES.get(family, [])) or '(?!)'})(?= |$)"
            name = rf"(?:{'|'.join(own) or '(?!)'})(?= |$)"
            grant = rf"(?:(?<![^ ])(?:{GRANT}){between} {name}|(?<![^ ]){name} licensed(?= |$))"
            weak = rf"(?<![^ ])(?:{WEAK}){between} {name}"
            alone = rf"^(?:(?:{ALONE}) )*{name}(?: (?:{ALONE}))*$"
            speaks = rf"^(?=(?:.* )?(?:{SPEAKS})(?: |$)).*"
            out[family] = rf"{grant}|{speaks}{weak}|{alone}", phrases, rf"(?<![^ ])(?:{DENIED})(?: [^ ]+){{0,4}} (?:{grant}|{weak}|{phrases})"
        return out

    def reliability(self, bins: int = 5) -> list[tuple[float, float, int]]:
        """(mean probability, share that is right, rows) of the held-out examples, by probability."""
        found = []
        for z, label in self.held:
            p = _softmax(z, self.temperature)
            best = max(range(len(p)), key=p.__getitem__)
            found.append((p[best], best == label))
        groups = [[f for f in found if min(int(f[0] * bins), bins - 1) == b] for b in range(bins)]
        return [(sum(p for p, _ in g) / len(g), sum(ok for _, ok in g) / len(g), len(g)) for g in groups if g]

    def classify(self, paragraphs: DataFrame, text_col: str = "paragraph", notices_only: Column | None = None) -> DataFrame:
        """Adds lic_families (array, sorted: all that are confirmed), lic_family (the likeliest if it is among these, else the first, else unknown) and lic_probability (of the likeliest).

        Null and empty paragraphs are unknown. Where notices_only holds, likeness to a licence text counts for nothing.
        """
        text = F.coalesce(F.col(text_col), F.lit(""))
        scored = self.model.transform(self.vectors.transform(paragraphs.withColumn("lic_words", words_of(text)).withColumn("grams", grams(F.col("lic_words")))))
        z = F.transform(vector_to_array("rawPrediction"), lambda x: x / self.temperature)
        scored = scored.withColumn("lic_z", z)
        top = F.array_max("lic_z")
        probability = F.lit(1.0) / F.aggregate("lic_z", F.lit(0.0), lambda a, x: a + F.exp(x - top))
        best = F.element_at(F.array(*[F.lit(f) for f in self.families]), F.array_position("lic_z", top).cast("int"))
        gated = text.rlike(GATE)
        sentences = F.when(gated, F.transform(F.split(text, SENTENCE), lambda s: F.array_join(words_of(s), " "))).otherwise(F.array().cast("array<string>"))
        named = scored.withColumn("lic_probability", probability).withColumn("lic_best", best).withColumn("lic_sentences", sentences)
        unknown = F.exp(F.element_at("lic_z", self.families.index(UNKNOWN) + 1) - top) * probability if UNKNOWN in self.families else F.lit(0.0)
        named = named.withColumn("lic_sentences", F.when(1 - unknown >= THRESHOLD, F.col("lic_sentences")).otherwise(F.array().cast("array<string>")))
        told = []
        for family, (grant, phrase, denied) in self.notices.items():
            if family != UNKNOWN:
                by_phrase = (F.col("lic_best") == family) & F.exists("lic_sentences", _said(phrase, denied)) if family in PHRASES else F.lit(False)
                told.append(F.when(F.exists("lic_sentences", _said(grant, denied)) | by_phrase, F.lit(family)))
        runs = F.array_distinct(_runs(F.col("lic_words"), 3))
        pairs = [F.lit(x) for f, texts in self.templates.items() for x in (f, texts)]

        def same(own: Column) -> Column:
            """Most of the template in the paragraph, or most of the paragraph in it."""
            def fits(template: Column) -> Column:
                common = F.size(F.array_intersect(template, own))
                return (common >= F.size(template) * COVER) | ((F.size(own) >= LEAST_RUNS) & (common >= F.size(own) * COVER))
            return F.exists(F.coalesce(F.element_at(F.create_map(*pairs), F.col("lic_best")), F.array().cast("array<array<string>>")), fits)

        sure = (F.col("lic_probability") >= THRESHOLD) & gated & (F.col("lic_best") != UNKNOWN)
        alike = sure & (~notices_only if notices_only is not None else F.lit(True)) & let(runs, same)
        families = F.when(gated, F.array_sort(F.array_distinct(F.array_compact(F.array(*told, F.when(alike, F.col("lic_best"))))))).otherwise(F.array().cast("array<string>"))
        found = named.withColumn("lic_families", families)
        family = F.when(F.array_contains("lic_families", F.col("lic_best")), F.col("lic_best")).otherwise(F.coalesce(F.get("lic_families", F.lit(0)), F.lit(UNKNOWN)))
        return found.select(*paragraphs.columns, "lic_families", family.alias("lic_family"), "lic_probability")


def _said(grant: str, denied: str):
    return lambda sentence: sentence.rlike(grant) & ~sentence.rlike(denied)


def _softmax(z: list[float], t: float) -> list[float]:
    top = max(z)
    e = [math.exp((x - top) / t) for x in z]
    return [x / sum(e) for x in e]


def _temperature(held: list[tuple[list[float], int]]) -> float:
    """Least cross-entropy by golden section over the logarithm. Targets are smoothed by one row in the class sizes, so that separable examples have a finite optimum."""
    if not held:
        return 1.0
    classes = len(held[0][0])
    other = 1 / (len(held) + classes)

    def loss(log_t: float) -> float:
        out = 0.0
        for z, label in held:
            p = _softmax(z, math.exp(log_t))
            out -= sum((1 - other if i == label else other / (classes - 1)) * math.log(max(x, 1e-300)) for i, x in enumerate(p))
        return out

    low, high, ratio = math.log(0.01), math.log(100), (math.sqrt(5) - 1) / 2
    for _ in range(30):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def joined(paragraph: Column) -> Column:
    """Wrapped lines as one, without comment marks at their beginnings."""
    return F.trim(F.regexp_replace(paragraph, WRAPPED, " "))


def units(paragraph: Column) -> Column:
    """(text, line) of what is classified of a candidate: its sentences, its whole if that is short, and of several lines each; only those with a licence word."""
    row = lambda line: lambda t: F.struct(t.alias("text"), F.lit(line).alias("line"))
    lines = F.split(paragraph, r"\r?\n")
    whole = let(joined(paragraph), lambda j: F.concat(F.split(j, SENTENCE), F.when(F.size(F.split(j, " ")) <= SHORT, F.array(j)).otherwise(F.array().cast("array<string>"))))
    all_ = F.concat(F.transform(F.array_distinct(whole), row(False)), F.when(F.size(lines) > 1, F.transform(lines, row(True))).otherwise(F.array().cast("array<struct<text:string,line:boolean>>")))
    return F.filter(all_, lambda u: u["text"].rlike(GATE))


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """One row per row of docs: doc_id, n_paragraphs, n_candidates, n_licences, families (array, sorted).

    A paragraph is a run of lines between blank ones, whatever its length. Candidates
    hold a licence word; n_licences counts those with a confirmed family, once each,
    though they may name several. A line of a wrapped paragraph counts as a notice only,
    as a piece of a licence text may be that of several. Null and empty texts have no
    paragraphs. Repeated rows each have a row of their own; other columns of docs,
    whatever their names, are ignored; no rows in, no rows out.
    """
    parts = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), PARAGRAPH), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    rows = stash(
        docs.select("doc_id", parts.alias("parts"))
        .select("doc_id", F.size("parts").cast("long").alias("n_paragraphs"), F.filter("parts", lambda p: p.rlike(GATE)).alias("candidates"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    each = rows.select("row", F.posexplode("candidates").alias("place", "paragraph")).select("row", "place", F.explode(units(F.col("paragraph"))).alias("u")).select("row", "place", "u.*")
    # written first: a filter would be pushed below the model and compute it again for every place that it stands in
    found = stash(model.classify(each, "text", F.col("line")).select("row", "place", "lic_families")).filter(F.size("lic_families") > 0)
    # families are few, so that a document's sets are small
    per_row = found.groupBy("row", "place").agg(F.collect_set("lic_families").alias("f")).groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_set("f"))))).alias("f"))
    return rows.join(per_row, "row", "left").select("doc_id", "n_paragraphs", F.size("candidates").cast("long").alias("n_candidates"), F.coalesce("n", F.lit(0)).cast("long").alias("n_licences"), F.coalesce("f", F.array().cast("array<string>")).alias("families"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), LicenceModel(spark))
    return found.select("doc_id", "n_paragraphs", "n_candidates", "n_licences", F.array_join("families", ",").alias("families"))
