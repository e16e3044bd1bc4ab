"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a line with a word. Its features are the distinct word n-grams (1 to 3;
lower-cased runs of ASCII letters, digits, dots and hyphens inside) that occur in the
notices below and hold a word that is no stop word. A multinomial logistic regression over them,
with a class for paragraphs that are no notice, is trained on the notices and titles whole, on
each sentence of a notice by itself and on its pieces as wrapped lines have them; and, as unknown, on
plain sentences, some with phrases of notices, and on the words of notices taken apart, without those that name a family.
Scores are calibrated: a family is believed above the greatest probability that any family
has for an unknown paragraph of the holdout, be unknown the likelier class or not. The comparison
with the notices decides between believed families: one is confirmed if at least half of the
paragraph's n-grams of two words are in its notices or titles, or a whole sentence of a notice is in the
paragraph; confirmed ones go first, then the likelier.

Paragraphs that the model cannot believe are left out before any n-gram is formed, by bounds from its weights: those without any word
of the notices (stop words aside), and those with a single one, if all the n-grams that it forms with stop words
together give no family more than the threshold. So that loses nothing.

Nulls: a null text has no paragraphs; null ids are scanned like others. Repeated rows and lines are classified alike. Of families of equal
probability (ties) the last by name is taken. Texts are scanned whole, whatever their length. Only doc_id and text are read, so
other columns may have any names. No documents: no rows. The notices are the standard short forms of public licences.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seams.llm.store import materialize

# Families and their notices.
NOTICES: tuple[tuple[str, str], ...] = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("agpl", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "SPDX-License-Identifier: MPL-2.0"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without prior written permission."),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache", "See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE."),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("zlib", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
)
# Families and titles of their licences.
TITLES: tuple[tuple[str, str], ...] = (
    ("apache", "Apache License"),
    ("apache", "Apache License, Version 2.0, January 2004"),
    ("apache", "Version 2.0, January 2004"),
    ("mit", "MIT License"),
    ("mit", "The MIT License (MIT)"),
    ("gpl", "GNU GENERAL PUBLIC LICENSE"),
    ("gpl", "GNU General Public License v3.0"),
    ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE"),
    ("lgpl", "GNU Lesser General Public License v2.1"),
    ("agpl", "GNU AFFERO GENERAL PUBLIC LICENSE"),
    ("agpl", "GNU Affero General Public License v3.0"),
    ("bsd", "BSD 2-Clause License"),
    ("bsd", "BSD 3-Clause License"),
    ("mpl", "Mozilla Public License"),
    ("mpl", "Mozilla Public License Version 2.0"),
    ("cc-by", "CC BY 4.0"),
    ("cc-by", "Creative Commons Attribution 4.0 International"),
    ("cc-by-nc", "CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("cc-by-sa", "CC BY-SA 4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("cc0", "CC0 1.0 Universal"),
    ("isc", "ISC License"),
    ("unlicense", "The Unlicense"),
    ("zlib", "zlib License"),
    ("boost", "Boost Software License, Version 1.0"),
)
# Sentences that are no notices.
PLAIN: tuple[str, ...] = (
    "The committee published its report on public transport in the spring.",
    "You may use this road until the bridge is open again.",
    "A copy of the letter was found in the library of the university.",
    "Her driving licence was renewed without a fee.",
    "The version of the story that we know is from the second edition.",
    "Free entry for children under ten, with or without their parents.",
    "The software works on all machines and the source of the error is known.",
    "He has the right to vote and the permission of the court.",
    "General conditions of the trade were met in part.",
    "The foundation of the house is of stone.",
    "The rights of the tenants are protected by law.",
    "A table was reserved for all of the guests.",
    "Two seats are reserved for members of the board.",
    "The general public was not admitted to the trial.",
    "The programme is subject to change without notice.",
    "She asked for permission to use the copy in the library.",
    "The source of the river is in a public park.",
    "No person may modify the form without written notice.",
    "The work of the author was published in a new version.",
    "Human rights and related issues were discussed for the first time.",
    "The files are on the table in the other room.",
    "He received a copy of the code of conduct along with the letter.",
    "It is free of charge for any person with a ticket.",
    "The terms of the contract were met by the company.",
    "The conditions on the road were better in the following year.",
    "Her book is in the public domain of ideas.",
    "The law firm redistributes the money to the owners.",
    "Parts of this publication were written in prison.",
)
# Sentences that borrow phrases of notices. They are for training only: held aside, one of them alone would set the threshold.
BORROWED: tuple[str, ...] = (
    "The house is subject to the terms of the sale.",
    "You should have received a letter from the court with this form.",
    "A guest may obtain a copy of the key at the desk.",
    "The following conditions were set by the judge.",
    "This project is a part of the history of the city.",
    "A copy of this report and the files of the case were lost.",
    "You may not use the lift in case of fire.",
    "The school has published the names as promised.",
)
# Stop words.
STOP = ("a", "all", "along", "an", "and", "any", "are", "as", "at", "be", "been", "by", "can", "for", "from", "has", "have", "in", "is", "it", "may", "met", "new", "no", "not", "of", "on", "or", "part", "that", "the", "this", "to", "under", "use", "with", "without", "you")

WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
CONFIRM = 0.5
UNKNOWN = "unknown"
#: Weights (feature, weight of each class), classes, intercepts and the calibrated probability.
Model = tuple[DataFrame, list[str], list[float], float]
PIECE = 8


def _cut(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


#: Families and words of the sentences of notices, of three words at least.
SENTENCES = [(f, _cut(s)) for f, t in NOTICES for s in re.split(r"[.;:]\s", t) if len(_cut(s)) >= 3]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _ngrams(words: str, k: int) -> Column:
    return F.expr(f"if(size({words}) < {k}, array(), transform(sequence(1, size({words}) - {k} + 1), i -> array_join(slice({words}, i, {k}), ' ')))")


def features(words: str) -> Column:
    """Distinct n-grams, of an array column of words, that hold a word that is no stop word."""
    grams = F.array_distinct(F.concat(*[_ngrams(words, k) for k in (1, 2, 3)]))
    return F.filter(grams, lambda g: F.size(F.array_except(F.split(g, " "), _strings(STOP))) > 0)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in sorted(values)])


def _pieces() -> list[tuple[str, list[str]]]:
    """Family and words of the notices, titles, sentences and pieces of PIECE words or fewer, of which each begins in the middle of the one before."""
    out = [(f, _cut(t)) for f, t in [*NOTICES, *TITLES]]
    out += [(f, s) for f, s in SENTENCES]
    for f, t in NOTICES:
        w = _cut(t)
        out += [(f, w[i : i + PIECE]) for i in range(0, len(w) - PIECE // 2, PIECE // 2) if len(w) > PIECE]
        if len(w) >= PIECE:
            out += [(f, w[: (len(w) + 1) // 2]), (f, w[len(w) // 2 :])]
    return out


def _naming() -> set[str]:
    """Words that the notices and titles of one family hold and those of others do not."""
    families: dict[str, set[str]] = {}
    for f, t in [*NOTICES, *TITLES]:
        for w in _cut(t):
            families.setdefault(w, set()).add(f)
    return {w for w, of in families.items() if len(of) == 1} - set(STOP)


def _training(spark: SparkSession) -> DataFrame:
    """family, w, aside: pieces of notices, and paragraphs that are no notices, every third of them for the holdout."""
    names, rows = _naming(), [(f, w, False) for f, w in _pieces()]
    rows += [(UNKNOWN, w, i % 3 == 2) for i, t in enumerate(PLAIN) for w in (_cut(t), _cut(t)[::-1])]
    rows += [(UNKNOWN, _cut(t), False) for t in BORROWED]
    for i, (_, t) in enumerate([*NOTICES, *((UNKNOWN, t) for t in PLAIN)]):
        w = [x for x in _cut(t) if x not in names]
        rows += [(UNKNOWN, x, i % 3 == 2) for x in [w[::-1], *([x] for x in w)]]
    told = "\n".join(f"{f}\t{a}\t{' '.join(w)}" for f, w, a in rows if w)
    cells = spark.range(1).select(F.explode(F.split(F.lit(told), "\n")).alias("row")).select(F.split("row", "\t").alias("c"))
    return cells.select(F.col("c")[0].alias("family"), F.split(F.col("c")[2], " ").alias("w"), (F.col("c")[1] == "True").alias("aside"))


def train(spark: SparkSession, steps: int = 60) -> Model:
    """(feature, weights per class), classes, intercepts, and the calibrated probability."""
    data = _training(spark).withColumn("f", features("w"))
    data = data.coalesce(1).cache()
    classes = [r.family for r in data.select("family").distinct().orderBy("family").collect()]  # the families above
    index = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))]), F.col("family"))
    vocabulary = CountVectorizer(inputCol="f", outputCol="x", binary=True, minDF=1.0).fit(data.where(F.col("family") != UNKNOWN))
    ready = vocabulary.transform(data).withColumn("label", index)
    weight = F.when(F.col("family") == UNKNOWN, F.lit(1.0)).otherwise(F.lit(4.0))
    model = LogisticRegression(featuresCol="x", maxIter=steps, regParam=0.002, family="multinomial", weightCol="weight").fit(ready.where(~F.col("aside")).withColumn("weight", weight))
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    rows = [F.struct(F.lit(g).alias("feature"), F.array(*[F.lit(float(v)) for v in matrix[:, i]]).alias("weights")) for i, g in enumerate(vocabulary.vocabulary)]
    held = model.transform(ready.where(F.col("aside") & (F.col("family") == UNKNOWN) & _may("w"))).select("probability").collect()  # from the sentences above
    unknown = classes.index(UNKNOWN)
    worst = max((max(p for i, p in enumerate(r.probability.toArray()) if i != unknown) for r in held), default=0.5)
    data.unpersist()
    return materialize(spark.range(1).select(F.inline(F.array(*rows))), "licence-weights"), classes, [float(b) for b in bias], float(worst)


def _cues() -> set[str]:
    """The words of notices and titles that are no stop words."""
    return {w for _, t in [*NOTICES, *TITLES] for w in _cut(t)} - set(STOP)


def _may(words: str, telling: set[str] | None = None) -> Column:
    """Whether words hold a cue, or, given the telling ones, two cues or a telling one."""
    cues = _strings(_cues())
    if telling is None:
        return F.arrays_overlap(words, cues)
    two = F.size(F.array_intersect(words, cues)) >= 2
    return two | F.arrays_overlap(words, _strings(telling)) if telling else two


def telling(model: Model) -> set[str]:
    """The cues that can make a family believed though the paragraph has no other one.

    Of a family and unknown alone the family's probability is the logistic function of the difference of their sums, more classes only
    lessen it, and the sum is at most that of all n-grams of the cue and stop words that speak for the family.
    """
    weights, classes, bias, least = model
    unknown = classes.index(UNKNOWN)
    most: dict[str, list[float]] = {}
    for r in weights.collect():  # the n-grams of the notices above
        own = set(r.feature.split(" ")) - set(STOP)
        if len(own) == 1:
            sums = most.setdefault(own.pop(), [b - bias[unknown] for b in bias])
            for i, w in enumerate(r.weights):
                sums[i] += max(0.0, w - r.weights[unknown])
    return {c for c, sums in most.items() if any(1 / (1 + math.exp(-x)) > least for i, x in enumerate(sums) if i != unknown)}


def paragraphs(docs: DataFrame, telling: set[str] | None = None) -> DataFrame:
    """(text_key, line, paragraph, w) of the lines that may be believed."""
    lines = docs.select(F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line", "paragraph"))
    return lines.withColumn("w", tokens(F.col("paragraph"))).where(_may("w", telling))


def _confirmed(family: str) -> Column:
    """Whether half of a paragraph's pairs of words (pairs) are in the family's notices and titles, or a sentence of its notices is in its words (told)."""
    own = {f"{x} {y}" for f, t in [*NOTICES, *TITLES] if f == family for x, y in zip(_cut(t), _cut(t)[1:])}
    whole = [F.contains("told", F.lit(f" {' '.join(s)} ")) for f, s in SENTENCES if f == family]
    near = (F.size("pairs") > 0) & (F.size(F.array_intersect("pairs", _strings(own))) >= CONFIRM * F.size("pairs"))
    return reduce(lambda x, y: x | y, whole, near)


def classify(told: DataFrame, model: Model | None = None) -> DataFrame:
    """(paragraph_key, family, probability, confirmed) of the distinct paragraphs that are believed to be notices. told: paragraph_key, w."""
    weights, classes, bias, least = model or train(told.sparkSession)
    n = range(len(classes))
    distinct = told.groupBy("paragraph_key").agg(F.first("w").alias("w"))
    distinct = materialize(distinct, "licence-paragraphs")
    flat = weights.select("feature", *[F.col("weights")[i].alias(f"w{i}") for i in n])  # as many rows as the notices have n-grams
    sums = distinct.select("paragraph_key", F.explode(features("w")).alias("feature")).join(F.broadcast(flat), "feature").groupBy("paragraph_key").agg(*[(F.sum(f"w{i}") + F.lit(bias[i])).alias(f"z{i}") for i in n])
    scores = sums.select("paragraph_key", F.array(*[F.col(f"z{i}") for i in n]).alias("z")).withColumn("e", F.expr("transform(z, x -> exp(x - array_max(z)))"))
    scored = scores.select("paragraph_key", F.expr("transform(e, x -> x / aggregate(e, 0D, (a, b) -> a + b))").alias("p"))
    families = [i for i in n if classes[i] != UNKNOWN]
    believed = scored.where(F.array_max(F.array(*[F.col("p")[i] for i in families])) > least).join(distinct, "paragraph_key")
    held = believed.withColumn("pairs", F.array_distinct(_ngrams("w", 2))).withColumn("told", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    each = [F.when(F.col("p")[i] > least, F.struct(_confirmed(classes[i]).alias("confirmed"), F.col("p")[i].alias("probability"), F.lit(classes[i]).alias("family"))) for i in families]
    return held.select("paragraph_key", F.greatest(*each).alias("best")).select("paragraph_key", "best.family", "best.probability", "best.confirmed")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (believed to be notices), n_confirmed, families (of confirmed lines, comma-joined), lines (line:family of all, from 1), probability (the greatest) of each document."""
    model = train(docs.sparkSession)
    told = materialize(paragraphs(docs, telling(model)).select("text_key", "line", F.xxhash64("paragraph").alias("paragraph_key"), "w"), "licence-lines")
    found = told.select("text_key", "line", "paragraph_key").distinct().join(classify(told, model), "paragraph_key")
    each = F.array_sort(F.collect_list(F.struct("line", "family")))
    texts = found.groupBy("text_key").agg(F.count("*").alias("n_lines"), F.count_if("confirmed").alias("n_confirmed"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"), F.array_join(F.transform(each, lambda x: F.concat_ws(":", (x["line"] + 1).cast("string"), x["family"])), ",").alias("lines"), F.max("probability").alias("probability"))
    zero = F.lit(0).cast("long")
    out = docs.select("doc_id", F.xxhash64("text").alias("text_key")).join(texts, "text_key", "left")
    return out.select("doc_id", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_confirmed", zero).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("lines", F.lit("")).alias("lines"), "probability")
